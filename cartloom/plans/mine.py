"""Frequent itemsets level by level: one engine, with presets for the known miners.

An occurrence of level k is a row (itemset, rest): an itemset that an order holds, and the order's
items behind its last one. The next level explodes rest, so a level needs no join with the data and no
shuffle by order; only candidates and counts, combined before the shuffle, move.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.operators import candidates as C
from cartloom.operators import distribute as D
from cartloom.operators import encode as E
from cartloom.operators import support as S
from cartloom.operators.running import numbered
from cartloom.sources.shared import observed, written

PRESETS = {
    "tid": {"threshold": "floor", "max_k": 10, "counting": "bitmap", "strategy": "BL", "processors": 1},
    "wdpa": {"threshold": "floor", "max_k": 5, "counting": "bitmap"},
    "naive": {"threshold": "fraction", "max_k": None, "counting": "matrix"},
    "ye": {"threshold": "floor_min1", "max_k": 5, "counting": "containment"},
}
COUNTING = ("extension", "containment", "bitmap", "matrix")


@dataclass
class Work:
    """What a level took: its candidates (none are listed where all pairs are counted at once), the ANDs of bitmaps, its frequent itemsets, and the seconds from its first candidate to its last count."""

    candidates: int
    intersections: int
    frequent: int
    seconds: float


def _level(k: int, counted: DataFrame, n: int) -> DataFrame:
    return counted.select(F.lit(k).alias("k"), "itemset", F.col("count").cast("long"), (F.col("count") / F.lit(float(n))).alias("support"))


def _frequent(k: int, counted: DataFrame, n: int, least: int) -> tuple[DataFrame, int, int]:
    """The frequent ones of (cand, count) as a table, their number, and the ANDs, from one job. A row without cand has ANDs as its count."""
    real = F.col("cand").isNotNull()
    good = real & (F.col("count") >= least)
    zero = F.lit(0).cast("long")
    rows, seen = observed(counted, "level", {"found": F.sum(F.when(good, 1).otherwise(zero)), "work": F.sum(F.when(real, zero).otherwise(F.col("count")))}, good)
    return _level(k, rows.withColumnRenamed("cand", "itemset"), n), seen["found"] or 0, seen["work"] or 0


def _counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df as a table, and its rows, from one job."""
    df, seen = observed(df, name, {"n": F.count(F.lit(1))})
    return df, seen["n"]


def frequent_items(pairs: DataFrame, min_support: float, threshold: str = "floor", n: int | None = None, strict: bool = False) -> DataFrame:
    """Level 1: k, itemset of one item, count, support."""
    n = E.count_orders(pairs) if n is None else n
    least = S.min_count(min_support, n, threshold, strict)
    counted = pairs.groupBy("item").agg(F.count("*").alias("count")).filter(F.col("count") >= least)
    return _level(1, counted.select(F.array("item").alias("itemset"), "count"), max(n, 1))


def mine(
    pairs: DataFrame, min_support: float, threshold: str = "floor", max_k: int | None = None, counting: str = "extension",
    strategy: str = "CWT", processors: int = 4, strict: bool = False, work: dict[int, Work] | None = None,
) -> DataFrame:
    """Frequent itemsets of rows (order_id, item): k, itemset (sorted), count, support. Repeated rows count once.

    counting: extension (of occurrences), containment (transactions walk a trie of candidates), bitmap (candidates
    dealt to processors by strategy, prefixes of them ANDed once) or matrix (pairs by products of blocks of the one-hot
    matrix, larger ones in contiguous chunks by bitmaps). All give the same rows. No orders, or no frequent item, give no rows.
    strict keeps a floor of 0, at which candidates that no order holds are frequent too; it needs the bitmap
    counting. work is filled with a Work for each level from 2 on that has any frequent itemset.
    """
    if counting not in COUNTING:
        raise ValueError(f"unknown counting {counting}")
    if strategy not in D.STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strict and counting != "bitmap":
        raise ValueError("strict needs the bitmap counting")
    held: list[DataFrame] = []
    try:
        return _mine(pairs, min_support, threshold, max_k, counting, strategy, processors, strict, {} if work is None else work, held)
    finally:  # also of a run that was cancelled
        for df in held:
            df.unpersist()


def _mine(pairs, min_support, threshold, max_k, counting, strategy, processors, strict, work, held) -> DataFrame:
    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def bitmaps_of(each: DataFrame, level: DataFrame, found: int) -> tuple[DataFrame, S.BitmapSize]:
        frequent = S.near(level.select(F.get("itemset", F.lit(0)).alias("item")), found)
        data = keep(E.tid_bitmaps(each.join(frequent, "item", "left_semi")))
        return data, S.bitmap_size(data)

    whole = keep(E.transactions(pairs))
    n, each = whole.count(), whole.select("order_id", F.explode("items").alias("item"))
    least = S.min_count(min_support, n, threshold, strict)
    level, found = _counted(frequent_items(each, min_support, threshold, n, strict), "level")
    levels, k = [level], 1
    if not found or max_k == 1:
        return level
    if counting in ("bitmap", "matrix"):
        data, size = bitmaps_of(each, level, found)
        counts = level.select(F.get("itemset", F.lit(0)).alias("item"), "count")
    else:
        # whole is already dealt by order, so the regrouping of the frequent items doesn't shuffle
        kept = each.join(S.near(level.select(F.get("itemset", F.lit(0)).alias("item")), found), "item", "left_semi")
        data = keep(E.transactions(kept))
        occurrences = data.select(F.posexplode("items").alias("i", "x"), "items").select(F.array("x").alias("itemset"), F.slice("items", F.col("i") + 2, F.size("items")).alias("rest"))
    while found and (max_k is None or k < max_k):
        k += 1
        began = time.perf_counter()
        if k == 2 and counting in ("extension", "matrix"):
            cands, many = None, 0  # all pairs that an order holds are counted
        elif k == 2 and counting == "bitmap":
            cands, many = _counted(D.weighted_pairs(counts, found), "candidates")
            if not many:
                break
        else:
            cands, many = _counted(C.next_candidates(level, k, found), "candidates")
            if not many:
                break
        if counting == "bitmap":
            p = processors if D.worth(many, processors) else 1
            if p > 1:
                weights = numbered(cands, [F.col("place")], "idx", many).drop("place") if k == 2 else D.weighted(D.indexed(cands, None, many), counts)
                dealt = D.distribute(weights, strategy, p, many)
                dealt = written(dealt, "dealt") if many > S.BROADCAST_CANDIDATES else dealt
            else:  # a level that isn't worth the processors is one processor's
                dealt = cands.select("cand").withColumn("proc_id", F.lit(0).cast("long"))
            counted = S.placed_counts(dealt, data, p, many, size).select("cand", "count")
            if least == 0:
                zeros = cands.join(counted.filter("cand IS NOT NULL"), "cand", "left").select("cand", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
                counted = zeros.unionByName(counted.filter("cand IS NULL"))
        elif counting == "matrix" and k == 2:
            counted = S.matrix_pairs(data, counts.select("item"), found, size)
        elif counting == "matrix":
            chunks = max(1, min(processors, many))
            dealt = D.chunked(D.indexed(cands, None, many), chunks, many).withColumnRenamed("chunk", "proc_id")
            counted = S.placed_counts(dealt, data, chunks, many, size).select("cand", "count")
        elif counting == "containment":
            counted = S.containment_support(cands, data, many)
        else:
            grown = occurrences.filter(F.size("rest") > 0).select("itemset", "rest", F.posexplode("rest").alias("i", "x"))
            grown = grown.select(F.concat("itemset", F.array("x")).alias("itemset"), F.slice("rest", F.col("i") + 2, F.size("rest")).alias("rest"))
            if cands is not None:
                grown = grown.join(S.near(cands.withColumnRenamed("cand", "itemset"), many), "itemset", "left_semi")
            occurrences = keep(grown)
            counted = occurrences.groupBy(F.col("itemset").alias("cand")).agg(F.count("*").alias("count"))
        level, found, ands = _frequent(k, counted, max(n, 1), least)
        if found:
            work[k] = Work(many, ands, found, time.perf_counter() - began)
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def mine_preset(pairs: DataFrame, preset: str, min_support: float, **more) -> DataFrame:
    return mine(pairs, min_support, **(PRESETS[preset] | more))


def mine_fpgrowth(pairs: DataFrame, min_support: float, threshold: str = "fraction") -> DataFrame:
    """The same rows by Spark's FP-growth, which cuts at the ceiling: for a floor it gets the least count, less a little. Repeated rows count once.

    Orders are grouped once and held until the itemsets are a table, as FP-growth reads them several times.
    """
    whole = E.transactions(pairs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = whole.agg(F.count("order_id")).first()[0]
        least = S.min_count(min_support, n, threshold)
        # each partition has trees of its own, which are merged: few of them are less work
        few = whole.coalesce(2 * whole.sparkSession.sparkContext.defaultParallelism)
        found = FPGrowth(itemsCol="items", minSupport=max(0.0, least / max(n, 1) * (1 - 1e-9))).fit(few).freqItemsets
        found = written(found, "fpgrowth")
    finally:
        whole.unpersist()
    return found.filter(F.col("freq") >= least).select(F.size("items").alias("k"), F.array_sort("items").alias("itemset"), F.col("freq").alias("count"), (F.col("freq") / F.lit(float(max(n, 1)))).alias("support"))


def sorted_itemsets(itemsets: DataFrame) -> DataFrame:
    """Levels in order, each by descending count, then itemset."""
    return itemsets.orderBy("k", F.desc("count"), "itemset")


def itemsets_per_level(itemsets: DataFrame) -> DataFrame:
    return itemsets.groupBy("k").agg(F.count("*").alias("itemsets"))


def support_sweep(pairs: DataFrame, supports: list[float], threshold: str = "floor", max_k: int | None = 5) -> DataFrame:
    """Itemsets for several supports from one run at the least: a larger one's are those with its count."""
    n = E.count_orders(pairs)
    base = mine(pairs, min(supports), threshold, max_k)
    parts = [base.filter(F.col("count") >= S.min_count(s, n, threshold)).withColumn("min_support", F.lit(float(s))) for s in supports]
    return reduce(DataFrame.unionByName, parts)
