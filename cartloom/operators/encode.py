"""Encodings of a basket: horizontal, vertical (arrays and bitmaps) and one-hot, and their statistics.

All take distinct pairs (order_id, item) unless they say otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartloom.operators.ranks import median
from cartloom.sources.shared import written


def transactions(pairs: DataFrame) -> DataFrame:
    """order_id and its sorted items."""
    return pairs.groupBy("order_id").agg(F.array_sort(F.collect_set("item")).alias("items"))


def held_orders(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders with their items, held until the caller unpersists them, and distinct pairs from them that lie by order: for several miners of the same pairs."""
    whole = transactions(pairs).persist(StorageLevel.MEMORY_AND_DISK)
    return whole, whole.select("order_id", F.explode_outer("items").alias("item"))


def tid_lists(pairs: DataFrame) -> DataFrame:
    """item and its sorted order ids. An item's list is one value; bitmaps keep a popular item in parts."""
    return pairs.groupBy("item").agg(F.array_sort(F.collect_set("order_id")).alias("tids"))


def tid_bitmaps(pairs: DataFrame) -> DataFrame:
    """item, bucket and a bitmap of 32768 order ids. Order ids must not be negative."""
    return pairs.groupBy("item", F.bitmap_bucket_number("order_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("order_id")).alias("bm"))


def basket_matrix(pairs: DataFrame, items: list) -> DataFrame:
    """order_id and a byte for each of the given items: for small domains alone, as it has a column for each. Rows may repeat.

    An order is a bit for each item in one aggregate, combined before the only shuffle.
    """
    bits = [reduce(lambda other, i: F.when(F.col("item") == items[i], F.lit(1 << i % 62)).otherwise(other), range(k, min(k + 62, len(items))), F.lit(0)).cast("long") for k in range(0, len(items), 62)]
    orders = pairs.groupBy("order_id").agg(*[F.bit_or(x).alias(f"_bits{k}") for k, x in enumerate(bits or [F.lit(0)])])
    return orders.select("order_id", *[F.shiftright(F.col(f"_bits{k // 62}"), k % 62).bitwiseAND(F.lit(1)).cast("byte").alias(str(i)) for k, i in enumerate(items)])


def count_orders(pairs: DataFrame) -> int:
    """N: the distinct orders that still have an item."""
    return pairs.agg(F.countDistinct("order_id")).first()[0]


def singleton_support(pairs: DataFrame) -> DataFrame:
    """item, count and support (0 without orders)."""
    n = pairs.agg(F.countDistinct("order_id").alias("n"))
    counts = pairs.groupBy("item").agg(F.count("*").alias("count"))
    return counts.crossJoin(n).select("item", "count", F.when(F.col("n") > 0, F.col("count") / F.col("n")).otherwise(0.0).alias("support"))


def dataset_statistics(basket: DataFrame) -> DataFrame:
    """Records, orders, users, products and records for each order of a basket relation."""
    return basket.agg(
        F.count("*").alias("records"), F.countDistinct("order_id").alias("unique_orders"), F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("product_id").alias("unique_products"), F.countDistinct("product_name").alias("unique_names"),
        F.try_divide(F.count("*"), F.countDistinct("order_id")).alias("avg_items_per_order"),
    )


def tid_statistics(pairs: DataFrame) -> DataFrame:
    """Mean, exact median, least, largest and population deviation of the items' counts; one row, of nulls and 0 items if there are no pairs."""
    c = written(pairs.groupBy("item").agg(F.count("*").alias("v")), "item-counts")
    return c.agg(
        F.count("*").alias("items"), F.avg("v").alias("mean_len"), F.lit(median(c)).cast("double").alias("median_len"), F.min("v").alias("min_len"),
        F.max("v").alias("max_len"), F.stddev_pop("v").alias("std_len"),
    )


def matrix_density(pairs: DataFrame) -> DataFrame:
    """Share of ones of the one-hot matrix, and its size in GiB at a byte for each cell."""
    # an aggregate for each column: distinct counts of two at once would make three rows of each
    items = pairs.groupBy("item").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ones"), F.count("item").alias("items"))
    c = items.crossJoin(pairs.agg(F.countDistinct("order_id").alias("orders")))  # a row on each side
    cells = F.col("orders").cast("double") * F.col("items")
    return c.select("orders", "items", "ones", F.when(cells > 0, F.col("ones") / cells).otherwise(0.0).alias("density"), (cells / 2**30).alias("gib"))
