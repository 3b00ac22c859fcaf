"""From order lines to the basket relation: scans, samples, joins and the top-item filter."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartloom import schema as S
from cartloom.operators.ranks import least_by_digest
from cartloom.sources.shared import exists


def read_csv(spark: SparkSession, path: str, kind) -> DataFrame:
    """A CSV file with a header, in a given schema; no inference pass over the data."""
    return spark.read.schema(kind).option("header", True).csv(path)


#: Fixed names of configuration documents: section -> key -> field. None: a text or a switch of output, read by no one.
CONFIG_KEYS = {
    "dataset": {"sample_size": "sample_size", "max_items": "max_items", "chunk_size": "chunk_size", "random_seed": "seed"},
    "mining_parameters": {"support_thresholds": "min_supports", "min_confidence": "min_confidence", "min_lift": "min_lift"},
    "output": {"results_directory": "results_directory", "save_individual_results": None, "save_comparison_summary": None, "generate_speedup_metrics": None},
}
ALGORITHM_KEYS = {"enabled": "enabled", "strategies": "strategies", "num_processors": "processors", "num_workers": "processors", "max_k": "max_k", "timeout": "timeout", "name": None, "method": None}
ALGORITHMS = ("traditional", "naive_parallel", "wdpa", "ye_parallel")


def parse_config(document: dict) -> S.MiningConfig:
    """A configuration document: sections (see CONFIG_KEYS) and algorithms, or fields of MiningConfig at the top.

    Keys that start with _, and description, are comments. Any other unknown key raises ValueError.
    """

    def keys_of(section: dict, known: dict, where: str) -> dict:
        own = {k: v for k, v in section.items() if not k.startswith("_") and k != "description"}
        if unknown := sorted(set(own) - set(known)):
            raise ValueError(f"unknown keys in {where}: {', '.join(unknown)}")
        return {known[k]: tuple(v) if isinstance(v, list) else v for k, v in own.items() if known[k]}

    sections = {k: document[k] for k in (*CONFIG_KEYS, "algorithms") if k in document}
    flat = {k: k for k in S.MiningConfig.__dataclass_fields__ if k != "algorithms"}
    fields = keys_of({k: v for k, v in document.items() if k not in sections}, flat, "the document")
    for name, known in CONFIG_KEYS.items():
        fields |= keys_of(sections.get(name, {}), known, name)
    algorithms = []
    for name, section in keys_of(sections.get("algorithms", {}), {x: x for x in ALGORITHMS}, "algorithms").items():
        own = keys_of(section, ALGORITHM_KEYS, name)
        if not isinstance(own.get("processors", ()), tuple):
            own["processors"] = (own["processors"],)
        algorithms.append(S.Algorithm(name, **own))
    return S.MiningConfig(**fields, algorithms=tuple(algorithms))


def load_config(spark: SparkSession, path: str) -> S.MiningConfig:
    """A configuration document of a file; see parse_config."""
    return parse_config(json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())))


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Result rows of runs from JSON files, with the file each came from: a file is an array of rows, or rows one after another.

    Malformed rows are left out (an array that isn't well formed as a whole), and so are paths that don't exist.
    """
    kind, bad = T.StructType([*S.RUNS.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}
    parts = [spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("source_file")) for path in paths if exists(spark, path)]
    if not parts:
        return spark.createDataFrame([], S.RUNS).withColumn("source_file", F.lit(None).cast("string"))
    files = union_chunks(*parts)
    is_array = F.col("value").rlike(r"^\s*\[")
    # no string of a JSON text has a line break in it, so rows are cut between } and {
    rows = files.filter(~is_array).select("source_file", F.explode(F.split("value", r"(?<=\})\s*\n\s*(?=\{)")).alias("value"))
    single = rows.filter(F.length(F.trim("value")) > 0).select("source_file", F.from_json("value", kind, bad).alias("r"))
    listed = files.filter(is_array).select("source_file", F.explode(F.from_json("value", T.ArrayType(kind), bad)).alias("r"))
    return single.unionByName(listed).filter("r._bad IS NULL").select(*[f"r.{c}" for c in S.RUNS.names], "source_file")


def _listing(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")


def latest_file(spark: SparkSession, pattern: str) -> DataFrame:
    """The path of the newest file of a pattern."""
    return _listing(spark, pattern).agg(F.max_by("path", "modificationTime").alias("path"))


def run_folders(spark: SparkSession, pattern: str) -> DataFrame:
    """The folders that the files of a pattern lie in, in order."""
    return _listing(spark, pattern).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")).distinct().orderBy("folder")


def tpch_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """orders, order lines and products from the driver's tables."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"))
    return orders, lines, parts


def item_rows(spark: SparkSession, sf_dir: str, column: str = "p_type") -> DataFrame:
    """(order_id, item), a row for each line, with an attribute of the part as the item: for miners, which group by order anyway."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("p_partkey"))
    if column == "l_partkey":
        return lines.select("order_id", F.col("p_partkey").alias("item")).na.drop()
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", column)
    return lines.join(parts, "p_partkey").select("order_id", F.col(column).alias("item")).na.drop()


def item_pairs(spark: SparkSession, sf_dir: str, column: str = "p_type") -> DataFrame:
    """Distinct (order_id, item) with an attribute of the part as the item."""
    return item_rows(spark, sf_dir, column).distinct()


def distinct_pairs(basket: DataFrame, order_col: str = "order_id", item_col: str = "product_id") -> DataFrame:
    """(order_id, item), each once; rows with a null in either are no part of a basket."""
    return basket.select(F.col(order_col).alias("order_id"), F.col(item_col).alias("item")).na.drop().distinct()


def build_basket(orders: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines with their user and product name: one row for each line; Spark picks the join by size."""
    return lines.join(products, "product_id").join(orders, "order_id").select("order_id", "user_id", "product_id", "product_name")


def hash_order(column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))


def sample_orders(orders: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n orders (all, if there are fewer), the same on every run: those with the least seeded hash."""
    return least_by_digest(orders.select("order_id").na.drop().distinct(), hash_order("order_id", seed), ["order_id"], n)


def keep_sampled(lines: DataFrame, sample: DataFrame) -> DataFrame:
    return lines.join(sample, "order_id", "left_semi")


def item_popularity(basket: DataFrame, item_col: str = "product_name") -> DataFrame:
    """Rows (not distinct orders) for each item."""
    return basket.filter(F.col(item_col).isNotNull()).groupBy(item_col).agg(F.count("*").alias("n_rows"))


def top_items(basket: DataFrame, n: int, item_col: str = "product_name") -> DataFrame:
    """The n most popular items; ties go to the lesser name."""
    return item_popularity(basket, item_col).orderBy(F.desc("n_rows"), F.asc(item_col)).limit(n)


def keep_top_items(basket: DataFrame, n: int | None, item_col: str = "product_name") -> DataFrame:
    """Rows of the n most popular items; None or 0: all rows. With n items or fewer this keeps all, so nothing is counted first."""
    if not n:
        return basket
    kept = top_items(basket, n, item_col).select(item_col)
    return basket.join(F.broadcast(kept) if n <= 100_000 else kept, item_col, "left_semi").select(basket.columns)


def dedup_products(products: DataFrame) -> DataFrame:
    """Distinct pairs of product and name."""
    return products.dropDuplicates(["product_id", "product_name"])


def name_dictionary(products: DataFrame) -> DataFrame:
    """name -> id; of several ids the largest, as the last one written."""
    return products.groupBy("product_name").agg(F.max("product_id").alias("product_id"))


def early_stop_scan(rows: DataFrame, order: list[str], keep: Column, chunk_size: int, sample_size: int | None) -> DataFrame:
    """The rows that a reader in chunks keeps that stops once it has 2 * sample_size filtered rows; whole chunks are kept.

    order must be total. The table is neither shuffled nor kept: three scans take the place of the last
    row that is wanted (a top-n of the order columns alone), how many rows there are up to it, and
    what its chunk holds behind it.
    """
    kept = rows.filter(keep)
    if sample_size is None:
        return kept
    place, wanted = F.struct(*order), 2 * sample_size
    top = kept.select(place.alias("p")).orderBy("p").limit(wanted).agg(F.count("*").alias("n"), F.max("p").alias("p")).first()
    if top.n < wanted:
        return kept
    if not wanted:
        return rows.limit(0)
    last = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, top.p, strict=True)])
    behind = -rows.filter(place <= last).count() % chunk_size
    return kept.filter(place <= last).unionByName(rows.filter(place > last).orderBy(*order).limit(behind).filter(keep))


def union_chunks(*chunks: DataFrame) -> DataFrame:
    out = chunks[0]
    for chunk in chunks[1:]:
        out = out.unionByName(chunk)
    return out


def load_basket(orders: DataFrame, lines: DataFrame, products: DataFrame, config: S.MiningConfig) -> DataFrame:
    """The basket relation of a configuration: sample, semi join before the joins, then the top items."""
    if config.sample_size:
        lines = keep_sampled(lines, sample_orders(orders, config.sample_size, config.seed))
    return keep_top_items(build_basket(orders, lines, products), config.max_items)
