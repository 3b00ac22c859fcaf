"""Weights of candidates and their distribution over processors: block, cyclic and weight-aware.

Candidates are rows (idx, cand), idx numbering them from 0; results add weight and proc_id.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cartloom.operators.candidates import item_pairs
from cartloom.operators.running import numbered, running_sums
from cartloom.sources.shared import written

STRATEGIES = ("BL", "CL", "BWT", "CWT")


def indexed(candidates: DataFrame, counts: DataFrame | None = None, many: int | None = None) -> DataFrame:
    """idx and cand: in the order of the items' counts (descending, then item) for pairs if counts (item, count) are given, else by itemset.

    many: the number of candidates, if known; few are numbered in one task, others by range partitions.
    """
    if counts is None:
        return numbered(candidates.select("cand"), [F.col("cand")], "idx", many).select("idx", "cand")
    # an item's place is told by (-count, item), so items need no numbers
    each = candidates.select("cand", F.explode("cand").alias("item")).join(counts.select("item", "count"), "item")
    placed = each.groupBy("cand").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "item"))).alias("place"))
    return numbered(placed, [F.col("place")], "idx", many).select("idx", "cand")


def weighted_pairs(counts: DataFrame, found: int) -> DataFrame:
    """All pairs of the items of counts (item, count), of which there are found: cand, place (what indexed orders pairs by) and weight."""
    one = lambda side: F.struct((-F.col(f"{side}.count")).alias("c"), F.col(f"{side}.item").alias("item"))
    weight = F.col("a.count").cast("decimal(19,0)") * F.col("b.count").cast("decimal(19,0)")
    return item_pairs(counts.select("item", "count"), found).select(F.array("a.item", "b.item").alias("cand"), F.array_sort(F.array(one("a"), one("b"))).alias("place"), weight.cast("long").alias("weight"))


def weighted(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """weight: the sum over pairs of the candidate's items of the product of their counts; unknown items count 0.

    ((sum c)**2 - sum c**2) / 2, in decimals, as the squares of large counts have no room in a long; single items weigh 0.
    """
    each = candidates.select("idx", "cand", F.explode("cand").alias("item")).join(counts.select("item", F.col("count").alias("c")), "item", "left").na.fill(0, ["c"])
    wide = F.col("c").cast("decimal(18,0)")
    sums = each.groupBy("idx", "cand").agg(F.sum("c").cast("decimal(19,0)").alias("s"), F.sum((wide * wide).cast("decimal(28,0)")).alias("q"))
    return sums.select("idx", "cand", F.expr("cast((s * s - q) div 2 as long)").alias("weight"))


def block(candidates: DataFrame, p: int, n: int) -> DataFrame:
    """BL: blocks of n div p; the last processor takes the rest, and all of them if there are fewer than p."""
    size = n // p
    return candidates.withColumn("proc_id", (F.least(F.expr(f"idx div {size}"), F.lit(p - 1)) if size else F.lit(p - 1)).cast("long"))


def cyclic(candidates: DataFrame, p: int) -> DataFrame:
    """CL: idx modulo p."""
    return candidates.withColumn("proc_id", F.col("idx") % p)


def _order() -> list:
    return [F.desc("weight"), F.asc("idx")]


def cyclic_by_weight(candidates: DataFrame, p: int, many: int | None = None) -> DataFrame:
    """CWT: rank by weight, descending, modulo p."""
    return numbered(candidates, _order(), "r", many).withColumn("proc_id", F.col("r") % p).drop("r")


#: Ends of processors that are looked up at a time, and rows that are brought to the driver for them.
ENDS, END_ROWS = 2000, 2_000_000


def processor_ends(sums: DataFrame, p: int, target: float) -> list[int]:
    """The ranks (r) after which a processor ends: the first whose running sum has grown by target since the processor before ended.

    sums has r, before and after (running sums of weights) by descending weight. An end lies behind the one before by target
    and less than the weight of its own row, so the i-th can't be further behind i targets than the weights of the rows that reach the first i
    targets, which are heavier than the ends' rows. Only the rows of these spans are brought to the driver, so a few jobs find all
    ends; if the spans hold too many rows, fewer ends are looked up at a time and the spans start anew at the last of them.
    """
    cuts: list[int] = []
    if p < 2:
        return cuts
    base, first, step = 0, 0, ENDS
    heavy = sums.filter(F.col("weight") >= F.lit(target)).agg(F.count("*").alias("n"), F.max("after").alias("after")).first()
    if heavy.n and target > 0:  # each is a processor of its own, and all come first
        n = min(heavy.n, p - 1)
        last = heavy.after if n == heavy.n else sums.filter(F.col("r") == n - 1).first().after
        cuts, base, first = list(range(1, n + 1)), last, n
    if target <= 0:
        return list(range(1, p))
    while len(cuts) < p - 1:
        want = min(step, p - 1 - len(cuts))
        rows = sums.filter(F.col("r") >= first)
        place = lambda c: F.floor((F.col(c) - F.lit(base)).cast("double") / F.lit(target)).cast("long")
        reach = rows.filter((place("after") > place("before")) & (place("after") <= want)).select(place("after").alias("i"), "weight").collect()  # a row for each target
        weights = {r.i: r.weight for r in reach}
        slack, spans = 0.0, []
        for i in range(1, want + 1):
            slack += weights.get(i, 0)
            spans.append(slack * (1 + 1e-9) + 1)
        i = F.least(F.greatest(place("after"), F.lit(1)), F.lit(want))
        behind = (F.col("after") - F.lit(base)).cast("double") - i * F.lit(target)
        inside = rows.withColumn("_i", i.cast("int")).filter((behind >= -1 - F.lit(1e-9) * F.col("after")) & (behind <= F.element_at(F.array(*map(F.lit, spans)), F.col("_i"))))
        counts = {r["_i"]: r["count"] for r in inside.groupBy("_i").count().collect()}
        total, most = 0, 0
        for most in range(1, want + 1):
            total += counts.get(most, 0)
            if total > END_ROWS and most > 1:
                most -= 1
                break
        near = sorted((r.r, int(r.after)) for r in inside.filter(F.col("_i") <= most).select("r", "after").collect())
        ranks, found = [r for r, _ in near], len(cuts)
        while len(cuts) - found < most:
            at = bisect.bisect_left(ranks, first)
            while at < len(near) and float(near[at][1] - base) < target:
                at += 1
            if at == len(near):
                break
            first, base = near[at][0] + 1, near[at][1]
            cuts.append(first)
        if len(cuts) == found:
            break  # what is left doesn't reach the target
        step = max(1, most) if most < want else ENDS
    return cuts


def block_by_weight(candidates: DataFrame, p: int) -> DataFrame:
    """BWT: by descending weight to one processor until it has total / p, then to the next, which starts from 0; the last takes the rest.

    A processor ends at the first candidate whose running sum of weights has grown by total / p since the processor before ended.
    """
    sums = written(running_sums(candidates, _order(), {"before": F.col("weight"), "r": F.lit(1)}), "weights")
    sums = sums.withColumn("after", F.col("before") + F.col("weight"))
    target = (sums.agg(F.sum("weight")).first()[0] or 0) / p
    cuts = processor_ends(sums, p, target)
    if len(cuts) <= 64:
        proc = sum(((F.col("r") >= c).cast("long") for c in cuts), F.lit(0).cast("long"))
        return sums.select(*candidates.columns, proc.alias("proc_id"))
    own, names = np.array(cuts, np.int64), candidates.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proc = pa.array(np.searchsorted(own, batch.column("r").to_numpy(), side="right"), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), proc], [*names, "proc_id"])

    return sums.select(*candidates.columns, "r").mapInArrow(place, StructType([*candidates.schema.fields, StructField("proc_id", LongType())]))


def distribute(candidates: DataFrame, strategy: str, p: int, many: int | None = None) -> DataFrame:
    """candidates (idx, cand, weight) with their proc_id under a strategy; another name raises ValueError. many: their number, if known."""
    if strategy == "BL":
        return block(candidates, p, candidates.count() if many is None else many)
    if strategy == "CL":
        return cyclic(candidates, p)
    if strategy == "BWT":
        return block_by_weight(candidates, p)
    if strategy == "CWT":
        return cyclic_by_weight(candidates, p, many)
    raise ValueError(f"unknown strategy {strategy}")


def placed(assigned: DataFrame, p: int) -> DataFrame:
    """The rows of each processor in the partition of its number."""
    return assigned.repartitionById(p, F.col("proc_id").cast("int"))


def processor_load(spark: SparkSession, assigned: DataFrame, p: int) -> DataFrame:
    """Candidates and weight of each processor, also of those without any."""
    loads = assigned.groupBy("proc_id").agg(F.count("*").alias("candidates"), F.sum("weight").alias("weight"))
    return spark.range(p).withColumnRenamed("id", "proc_id").join(loads, "proc_id", "left").na.fill(0, ["candidates", "weight"])


def chunked(candidates: DataFrame, p: int, n: int) -> DataFrame:
    """Contiguous chunks of max(1, n div p) by idx, which can be more than p; p <= 1: one chunk."""
    return candidates.withColumn("chunk", F.expr(f"idx div {max(1, n // p)}") if p > 1 else F.lit(0).cast("long"))


def ceil_chunked(rows: DataFrame, p: int, n: int) -> DataFrame:
    """Chunks of ceil(n / p) by idx."""
    return rows.withColumn("chunk", F.expr(f"idx div {max(1, -(-n // p))}"))


def worth(candidates: int, p: int) -> bool:
    """Whether a level has a hundred candidates for each of p processors; smaller ones are one processor's."""
    return p > 1 and candidates >= 100 * p
