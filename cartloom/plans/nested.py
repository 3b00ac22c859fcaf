"""Several parts of a relation mined in one run: samples nested by hash order, each with its own top items.

Every row (order, item) has a bit for each part that it belongs to. An order holds an itemset in the
parts whose bit all its rows have, so an occurrence carries the AND of its rows' bits and an
itemset's count is a vector, with one number for each part. A level is counted once for all parts.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom import schema as S
from cartloom.operators import candidates as C
from cartloom.operators.support import min_count, near
from cartloom.sources import basket as B
from cartloom.sources.shared import observed, written

MOST_PARTS = 62


def _bit(bits: str, i: int) -> Column:
    return F.shiftright(F.col(bits), i).bitwiseAND(F.lit(1).cast("long"))


def _mask(flags: Iterable[Column]) -> Column:
    """Bit i is set where flag i is true."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(x, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, x in enumerate(flags)])


def nested_samples(orders: DataFrame, sizes: list[int | None], seed: int) -> DataFrame:
    """order_id and bits: bit i for the orders of sample_orders(orders, sizes[i], seed). None: all orders.

    They are nested by hash order, so each size is drawn from the next larger one.
    """
    rows, parts = written(orders.select("order_id").na.drop().distinct(), "nested-orders"), []
    for i, n in sorted(enumerate(sizes), key=lambda x: (x[1] is not None, -(x[1] or 0))):
        if n is not None:
            rows = written(B.sample_orders(rows, n, seed), "nested-sample")
        parts.append(rows.select("order_id", F.lit(1 << i).cast("long").alias("bit")))
    return reduce(DataFrame.unionByName, parts).groupBy("order_id").agg(F.bit_or("bit").alias("bits"))


def nested_rows(orders: DataFrame, lines: DataFrame, products: DataFrame, sizes: list[tuple[int | None, int | None]], seed: int = S.MiningConfig.seed) -> DataFrame:
    """order_id, item (a product's name) and bits, each pair once: bit i where load_basket keeps the row with sizes[i] = (sample size, number of items)."""
    if not 0 < len(sizes) <= MOST_PARTS:
        raise ValueError(f"1 to {MOST_PARTS} sizes, not {len(sizes)}")
    samples = written(nested_samples(orders, [n for n, _ in sizes], seed), "nested-samples")
    if all(n is not None for n, _ in sizes):  # else every order is in a part
        lines = B.keep_sampled(lines, samples)
    basket = B.build_basket(orders, lines, products).join(samples, "order_id")
    basket = written(basket.select("order_id", F.col("product_name").alias("item"), "bits").na.drop(), "nested-basket")
    rows = written(basket.groupBy("item").agg(*[F.sum(_bit("bits", i)).alias(f"n{i}") for i in range(len(sizes))]), "nested-popularity")
    # the top items of each part, ties to the lesser name; their numbers are the parts' limits
    kept = []
    for i, (_, most) in enumerate(sizes):
        own = rows.filter(F.col(f"n{i}") > 0)
        kept.append((own.orderBy(F.desc(f"n{i}"), "item").limit(most) if most else own).select("item", F.lit(1 << i).cast("long").alias("own")))
    items = written(reduce(DataFrame.unionByName, kept).groupBy("item").agg(F.bit_or("own").alias("own")), "nested-items")
    return basket.join(items, "item").select("order_id", "item", F.col("bits").bitwiseAND(F.col("own")).alias("bits")).filter("bits <> 0").distinct()


def mine_nested(rows: DataFrame, parts: int, min_support: float, threshold: str = "floor", max_k: int | None = None) -> tuple[DataFrame, list[int]]:
    """Itemsets of rows (order_id, item, bits) that are frequent in any of the parts: k, itemset (sorted), counts (one for each part); and the parts' numbers of orders.

    In each part an itemset's count is that of mine over the rows with the part's bit, and all itemsets that mine
    finds there are among the result. Repeated rows count once if their bits agree; rows without bits are in no part,
    a part without rows has 0 orders. Counts below a part's threshold are exact too.
    """
    held: list[DataFrame] = []
    try:
        return _mine_nested(rows, parts, min_support, threshold, max_k, held)
    finally:
        for df in held:
            df.unpersist()


def _mine_nested(rows, parts, min_support, threshold, max_k, held):
    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def orders_of(pairs: DataFrame) -> DataFrame:
        return keep(pairs.groupBy("order_id").agg(F.array_sort(F.collect_set(F.struct("item", "bits"))).alias("items")))

    def frequent(k: int, counted: DataFrame) -> tuple[DataFrame, int]:
        """The itemsets with a part that they are frequent in, as a table, with these parts' bits, and their number."""
        live = _mask(F.get("counts", F.lit(i)) >= n for i, n in enumerate(least))
        level = counted.select(F.lit(k).alias("k"), "itemset", "counts", live.alias("live")).filter("live <> 0")
        level, seen = observed(level, "nested-level", {"n": F.count(F.lit(1))})
        return level, seen["n"]

    vector = lambda bits: F.array(*[F.sum(_bit(bits, i)) for i in range(parts)]).alias("counts")
    whole = orders_of(rows.filter("bits <> 0"))
    held_in = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["bits"])).alias("bits")
    totals = [n or 0 for n in whole.select(held_in).agg(*[F.sum(_bit("bits", i)).alias(f"n{i}") for i in range(parts)]).first()]
    least = [min_count(min_support, n, threshold) for n in totals]
    each = whole.select("order_id", F.explode("items").alias("x")).select("order_id", "x.item", "x.bits")
    level, found = frequent(1, each.groupBy(F.array("item").alias("itemset")).agg(vector("bits")))
    levels, k = [level], 1
    if found and max_k != 1:
        known = near(level.select(F.get("itemset", F.lit(0)).alias("item"), "live"), found)
        # an item's rows only count on in parts that it is frequent in
        data = orders_of(each.join(known, "item").select("order_id", "item", F.col("bits").bitwiseAND(F.col("live")).alias("bits")).filter("bits <> 0"))
        occurrences = data.select(F.posexplode("items").alias("i", "x"), "items").select(
            F.array("x.item").alias("itemset"), F.col("x.bits").alias("bits"), F.slice("items", F.col("i") + 2, F.size("items")).alias("rest")
        )
    while found and (max_k is None or k < max_k):
        k += 1
        grown = occurrences.filter(F.size("rest") > 0).select("itemset", "bits", "rest", F.posexplode("rest").alias("i", "x"))
        grown = grown.select(
            F.concat("itemset", F.array("x.item")).alias("itemset"), F.col("bits").bitwiseAND(F.col("x.bits")).alias("bits"), F.slice("rest", F.col("i") + 2, F.size("rest")).alias("rest")
        ).filter("bits <> 0")
        if k > 2:
            cands, seen = observed(C.next_candidates(level, k, found), "nested-candidates", {"n": F.count(F.lit(1))})
            if not seen["n"]:
                break
            grown = grown.join(near(cands.withColumnRenamed("cand", "itemset"), seen["n"]), "itemset", "left_semi")
        occurrences = keep(grown)
        level, found = frequent(k, occurrences.groupBy("itemset").agg(vector("bits")))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).drop("live"), totals


def nested_scalability(spark: SparkSession, sf_dir: str, sizes: list[tuple[int | None, int | None]], supports: list[float], max_k: int | None = None) -> DataFrame:
    """sample_size, max_items, min_support and itemsets for each size and support, from one run at the least support.

    The same numbers as sweeps.scalability, which mines each size alone and so has the seconds of each.
    """
    rows = nested_rows(*B.tpch_tables(spark, sf_dir), sizes)
    levels, totals = mine_nested(rows, len(sizes), min(supports), max_k=max_k)
    cells = [(i, n, items, s) for i, (n, items) in enumerate(sizes) for s in supports]
    found = levels.agg(*[F.count(F.when(F.get("counts", F.lit(i)) >= min_count(s, totals[i]), 1)).alias(f"c{j}") for j, (i, _, _, s) in enumerate(cells)])
    row = lambda j, n, items, s: F.struct(F.lit(n).cast("long").alias("sample_size"), F.lit(items).cast("long").alias("max_items"), F.lit(float(s)).alias("min_support"), F.col(f"c{j}").alias("itemsets"))
    return found.select(F.inline(F.array(*[row(j, n, items, s) for j, (_, n, items, s) in enumerate(cells)])))
