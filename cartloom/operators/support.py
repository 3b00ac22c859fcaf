"""Support counts of given itemsets, by arrays, bitmaps, containment and conjunction.

Candidates are rows with a sorted array column cand; counts are 0 for itemsets that no order holds,
for unknown items and for the empty itemset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.operators.lattice import count_bitmaps, count_transactions, pair_products, squeezed, trie
from cartloom.sources.shared import importable

#: Candidate sets up to so many rows are broadcast; beyond, they are joined by a shuffle.
BROADCAST_CANDIDATES = 200_000


def near(df: DataFrame, rows: int) -> DataFrame:
    """A hint for a side whose rows have been counted."""
    return F.broadcast(df) if rows <= BROADCAST_CANDIDATES else df


def min_count(min_support: float, n: int, threshold: str = "floor", strict: bool = False) -> int:
    """The least count of a frequent itemset among n orders.

    floor: int(min_support * n) in doubles; floor_min1: the same, at least 1; fraction: the least c
    with c / n >= min_support. Below 1 the floor is raised to 1 unless strict.
    """
    if threshold == "fraction":
        c = max(0, int(min_support * n) - 2)
        while n and c / n < min_support:
            c += 1
        return max(1, c)
    if threshold not in ("floor", "floor_min1"):
        raise ValueError(f"unknown threshold {threshold}")
    return int(min_support * n) if strict and threshold == "floor" else max(1, int(min_support * n))


def array_support(candidates: DataFrame, vertical: DataFrame) -> DataFrame:
    """cand and count: the size of the intersection of its items' order lists."""
    items = candidates.select("cand", F.explode_outer("cand").alias("item"))
    lists = items.join(vertical, "item", "left").groupBy("cand").agg(F.collect_list(F.coalesce("tids", F.array().cast("array<bigint>"))).alias("x"), F.count("item").alias("k"))
    common = F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), F.get("x", F.lit(0)), lambda acc, t: F.array_intersect(acc, t))
    return lists.select("cand", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.size(common)).cast("long").alias("count"))


def bitmap_support(candidates: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """cand and count by ANDing bitmaps: a bucket counts if all items of the candidate are in it."""
    items = candidates.select("cand", F.size("cand").alias("k"), F.explode("cand").alias("item"))
    both = items.join(bitmaps, "item").groupBy("cand", "k", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bm")).alias("n"), F.count("*").alias("have"))
    counts = both.filter("have = k").groupBy("cand").agg(F.sum("n").alias("count"))
    return candidates.select("cand").join(counts, "cand", "left").select("cand", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


#: Bytes of bitmaps that a task holds, and candidates in a block.
TASK_BYTES, BLOCK_CANDIDATES = 64 << 20, 300_000
_BITMAP = 4096


@dataclass(frozen=True)
class BitmapSize:
    """How many buckets and rows a table of bitmaps has."""

    buckets: int
    rows: int


def bitmap_size(bitmaps: DataFrame) -> BitmapSize:
    return BitmapSize(*bitmaps.agg(F.countDistinct("bucket"), F.count("*")).first())


def placed_counts(assigned: DataFrame, bitmaps: DataFrame, processors: int = 1, many: int | None = None, size: BitmapSize | None = None) -> DataFrame:
    """proc_id, cand and count of candidates (cand, proc_id) of one size, counted by their processors, without those that no order holds.

    A processor's candidates are dealt to blocks by their prefix and its buckets to ranges; a task has one
    block and one range: the bitmaps of its items, which it gets once, and a trie of its candidates. There a prefix is
    ANDed once for all that begin with it, and nothing is below an empty one. A row without cand has in count how
    many ANDs a processor made. many: the number of candidates; size: of the bitmaps; both are counted if not given.
    """
    importable(assigned.sparkSession)
    many = assigned.count() if many is None else many
    size = bitmap_size(bitmaps) if size is None else size
    blocks = max(1, -(-many // (processors * BLOCK_CANDIDATES)))
    wanted = max(-(-size.rows * _BITMAP // TASK_BYTES), -(-assigned.sparkSession.sparkContext.defaultParallelism // (processors * blocks)))
    ranges = max(1, min(size.buckets, wanted))

    def count(mine: pa.Table, asked: pa.Table) -> pa.Table:
        cand = asked.column("cand").combine_chunks()
        items = pc.unique(mine.column("item"))
        k = len(cand[0]) if len(cand) else 1
        rows = pc.fill_null(pc.index_in(cand.flatten(), value_set=items), len(items)).to_numpy().astype(np.int64).reshape(-1, k)
        known = np.flatnonzero((rows < len(items)).all(1))  # others have an item that the range lacks
        t = trie(rows[known])
        counts, work = np.zeros(len(known), np.int64), 0
        number = pc.index_in(mine.column("item").combine_chunks(), value_set=items).to_numpy()
        bucket, bm = mine.column("bucket").to_numpy(), mine.column("bm").to_pylist()
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, np.int64)
        for x, y in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            own = order[x:y]
            bits = np.zeros((len(items) + 1, _BITMAP // 8), np.uint64)
            bits[number[own]] = np.frombuffer(b"".join([bm[i] for i in own]), np.uint64).reshape(len(own), -1)
            n, w = count_bitmaps(t, squeezed(bits, len(known)))
            counts[t.order] += n
            work += w
        held = np.flatnonzero(counts)
        proc = asked.column("proc_id")[0].as_py() if asked.num_rows else mine.column("proc_id")[0].as_py()
        found = pa.concat_arrays([cand.take(pa.array(known[held])), pa.nulls(1, cand.type)])
        return pa.table({"proc_id": pa.array(np.full(len(found), proc), pa.int64()), "cand": found, "n": pa.array([*counts[held], work], pa.int64())})

    prefix = F.slice("cand", F.lit(1), F.greatest(F.size("cand") - 1, F.lit(1)))
    dealt = assigned.select("proc_id", "cand", (F.pmod(F.xxhash64(prefix), F.lit(blocks)) if blocks > 1 else F.lit(0)).cast("long").alias("block"))
    needed = dealt.select("proc_id", "block", F.explode("cand").alias("item")).distinct().join(bitmaps, "item")
    needed = needed.select("proc_id", "block", F.pmod("bucket", F.lit(ranges)).cast("long").alias("range"), "bucket", "item", "bm")
    own = [F.col(c).alias(c) for c in ("proc_id", "block")]  # columns of its own beside needed's
    offered = dealt.select(*own, F.expr(f"explode(sequence(0L, {ranges - 1}L))").alias("range"), "cand")
    kind = assigned.schema["cand"].dataType.simpleString()
    key = ("proc_id", "block", "range")
    counted = needed.groupBy(*key).cogroup(offered.groupBy(*key)).applyInArrow(count, f"proc_id long, cand {kind}, n long")
    return counted.groupBy("proc_id", "cand").agg(F.sum("n").alias("count"))


def placed_support(assigned: DataFrame, bitmaps: DataFrame, processors: int = 1) -> DataFrame:
    """cand and count of all candidates (cand, proc_id) of one size, see placed_counts."""
    counts = placed_counts(assigned, bitmaps, processors).filter("cand IS NOT NULL").select("cand", "count")
    return assigned.select("cand").join(counts, "cand", "left").select("cand", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


#: Columns in a block of the one-hot matrix.
BLOCK_COLUMNS = 256


def matrix_pairs(bitmaps: DataFrame, items: DataFrame, many: int, size: BitmapSize | None = None) -> DataFrame:
    """cand and count of all pairs of the given items (item) that an order holds, from the one-hot matrix as bit-packed columns.

    Columns are dealt to blocks; a task multiplies two blocks over a range of rows, so a level of n items is
    (n / 256)**2 / 2 products of blocks and no candidate is listed. many: the number of items.
    """
    importable(bitmaps.sparkSession)
    size = bitmap_size(bitmaps) if size is None else size
    blocks = max(1, -(-many // BLOCK_COLUMNS))
    wanted = max(-(-2 * size.buckets * BLOCK_COLUMNS * _BITMAP // TASK_BYTES), -(-bitmaps.sparkSession.sparkContext.defaultParallelism * 2 // (blocks * (blocks + 1))))
    ranges = max(1, min(size.buckets, wanted))

    def multiply(key: tuple, mine: pa.Table) -> pa.Table:
        left, right = key[0].as_py(), key[1].as_py()
        of = mine.column("own").to_numpy()
        item = mine.column("item").combine_chunks()
        names = [pc.unique(item.filter(pa.array(of == b))) for b in (left, right)]
        total = np.zeros((len(names[0]), len(names[1])), np.int64)
        bucket, bm = mine.column("bucket").to_numpy(), mine.column("bm").to_pylist()
        at = [pc.fill_null(pc.index_in(item, value_set=x), -1).to_numpy() for x in names]
        for b in np.unique(bucket):
            sides = []
            for block, number, names_ in zip((left, right), at, names, strict=True):
                own = np.flatnonzero((bucket == b) & (of == block))
                bits = np.zeros((len(names_), _BITMAP // 8), np.uint64)
                bits[number[own]] = np.frombuffer(b"".join([bm[i] for i in own]), np.uint64).reshape(len(own), -1)
                sides.append(bits)
            total += pair_products(*sides)
        i, j = np.nonzero(total)
        x, y = names[0].take(pa.array(i)), names[1].take(pa.array(j))
        counts = pa.array(total[i, j], pa.int64())
        # within a block each pair is there twice; across blocks the smaller item may be on either side
        keep = pc.less(x, y) if left == right else pc.not_equal(x, y)
        swap = pc.greater(x, y)
        return pa.table({"a": pc.if_else(swap, y, x), "b": pc.if_else(swap, x, y), "n": counts}).filter(keep)

    own = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("long")
    columns = bitmaps.join(near(items, many), "item", "left_semi").withColumn("own", own)
    other = columns.withColumn("other", F.expr(f"explode(sequence(0L, {blocks - 1}L))"))
    sides = other.select(F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), F.pmod("bucket", F.lit(ranges)).cast("long").alias("range"), "own", "bucket", "item", "bm")
    kind = bitmaps.schema["item"].dataType.simpleString()
    products = sides.groupBy("left", "right", "range").applyInArrow(multiply, f"a {kind}, b {kind}, n long")
    return products.groupBy("a", "b").agg(F.sum("n").alias("count")).select(F.array("a", "b").alias("cand"), "count")


#: Candidates are sent to the tasks as a trie up to so many bytes; beyond, they are joined.
TRIE_BYTES = 64 << 20
#: Items of transactions that walk the trie at a time.
WALK_ITEMS = 20_000


def containment_support(candidates: DataFrame, horizontal: DataFrame, many: int | None = None) -> DataFrame:
    """cand and count of all candidates: the transactions (items, sorted) walk down a trie of those of one size.

    The trie goes to the tasks if it has at most TRIE_BYTES, and a task sums its counts before they are
    shuffled; a larger set of candidates is joined with the transactions. many: their number, if it is known and all are of one size.
    """
    candidates = candidates.select("cand").distinct()
    sizes = {r.k: r.n for r in candidates.groupBy(F.size("cand").alias("k")).agg(F.count("*").alias("n")).collect()} if many is None else None
    if sizes is None:
        sizes = {candidates.select(F.size("cand")).first()[0]: many} if many else {}
    parts = []
    for k, n in sizes.items():
        own = candidates.filter(F.size("cand") == k)
        if k:
            parts.append(trie_counts(own, horizontal) if n * (k + 1) * 24 <= TRIE_BYTES else offered_counts(own, horizontal))
    if not parts:
        return candidates.select("cand", F.lit(0).cast("long").alias("count"))
    hits = reduce(DataFrame.unionByName, parts)
    return candidates.join(hits, "cand", "left").select("cand", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def trie_counts(candidates: DataFrame, horizontal: DataFrame) -> DataFrame:
    """cand and count for candidates of one size, few enough for every task, without those that no transaction holds."""
    spark = candidates.sparkSession
    importable(spark)
    held = candidates.toArrow().column("cand").combine_chunks()
    kind = candidates.schema["cand"].dataType.simpleString()
    if not len(held):
        return spark.createDataFrame([], f"cand {kind}, count long")
    flat = held.flatten()
    # numbers in the order of the items, so that paths ascend as transactions do
    items = pc.unique(flat)
    items = items.take(pc.sort_indices(items))
    own = trie(pc.index_in(flat, value_set=items).to_numpy().astype(np.int64).reshape(len(held), -1))
    sent = spark.sparkContext.broadcast((own, items, held))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, items, held = sent.value
        total = np.zeros(len(held), np.int64)
        for batch in batches:
            lists = batch.column("items")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            number = pc.fill_null(pc.index_in(lists.flatten(), value_set=items), -1).to_numpy()
            known = number >= 0  # other items are in no candidate
            row = np.repeat(np.arange(len(sizes)), sizes)[known]
            number = number[known].astype(np.int64)
            order = np.lexsort((number, row))
            row, number = row[order], number[order]
            ends = np.searchsorted(row, np.arange(len(sizes)), side="right")
            a = 0
            while a < len(ends):  # whole transactions, some thousand items at a time
                begin = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, begin + WALK_ITEMS, side="right")))
                n, _ = count_transactions(t, number[begin : ends[b - 1]], ends[a:b] - begin, len(items))
                total[t.order] += n
                a = b
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["i", "n"])

    sums = horizontal.select("items").mapInArrow(walk, "i long, n long").groupBy("i").agg(F.sum("n").alias("count"))
    names = spark.createDataFrame(pa.table({"i": pa.array(np.arange(len(held)), pa.int64()), "cand": held}))
    return names.select("i", F.col("cand").cast(kind).alias("cand")).join(sums, "i").select("cand", "count")


def offered_counts(candidates: DataFrame, horizontal: DataFrame) -> DataFrame:
    """The same by a join: a candidate is offered to each transaction that has its first item, and tested there."""
    first = candidates.filter(F.size("cand") > 0).select("cand", F.get("cand", F.lit(0)).alias("item"), F.slice("cand", 2, 1_000_000).alias("rest"))
    offers = horizontal.select(F.explode("items").alias("item"), "items").join(first, "item")
    return offers.filter(F.forall("rest", lambda x: F.array_contains("items", x))).groupBy("cand").agg(F.count("*").alias("count"))


def conjunction_support(matrix: DataFrame, itemsets: list[list[str]]) -> DataFrame:
    """itemset and support: the mean of the conjunction of one-hot columns; one pass for all itemsets."""

    def all_of(s: list[str]):
        hit = F.lit(True)
        for i in s:
            hit = hit & (F.col(f"`{i}`") == 1)
        return hit.cast("int")

    means = matrix.agg(*[F.avg(all_of(s)).alias(f"s{i}") for i, s in enumerate(itemsets)])
    return means.select(F.explode(F.array(*[F.struct(F.lit(",".join(s)).alias("itemset"), F.col(f"s{i}").alias("support")) for i, s in enumerate(itemsets)])).alias("x")).select("x.*")


def worker_counts(assigned: DataFrame, bitmaps: DataFrame, least: int, processors: int = 1) -> DataFrame:
    """For candidates with a proc_id: how many each processor counted, and how many of them are frequent."""
    counts = placed_counts(assigned, bitmaps, processors).filter("cand IS NOT NULL").filter(F.col("count") >= least)
    frequent = counts.groupBy("proc_id").agg(F.count("*").alias("f"))
    each = assigned.groupBy("proc_id").agg(F.count("*").alias("intersections"))
    return each.join(frequent, "proc_id", "left").select("proc_id", "intersections", F.coalesce("f", F.lit(0)).alias("frequent"))
