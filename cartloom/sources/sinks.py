"""Sinks for itemsets, rules, indexes and reports."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartloom.functions.metrics import summary_rows
from cartloom.sources.shared import exists


def write_analysis(results: DataFrame, folder: str, tag: str = "", suffix: str = "") -> str:
    """All results as JSON rows with their nested types."""
    path = f"{folder}/{tag + '_' if tag else ''}complete_analysis{suffix}.json"
    results.write.mode("overwrite").json(path)
    return path


def write_by_support(results: DataFrame, folder: str) -> None:
    results.write.mode("overwrite").partitionBy("min_support").json(folder)


def write_summary(results: DataFrame, folder: str) -> None:
    """min_support and the numbers of itemsets and rules alone."""
    results.select("min_support", "frequent_itemsets_count", "rules_count").write.mode("overwrite").json(folder)


def write_scalability(spark, rows: list[dict], path: str) -> None:
    """The rows of plans.sweeps.scalability as JSON."""
    spark.createDataFrame(rows, "sample_size long, max_items long, min_support double, itemsets long, seconds double, status string").coalesce(1).write.mode("overwrite").json(path)


def write_benchmark(results: DataFrame, config, orders: int, items: int, folder: str) -> None:
    """A benchmark's folder: results as typed JSON rows, its configuration and size, and the summary of its runs."""
    results.write.mode("overwrite").json(f"{folder}/benchmark_results.json")
    about = results.sparkSession.createDataFrame([(json.dumps(asdict(config)), orders, items)], "config string, orders long, items long")
    about.withColumn("written_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").json(f"{folder}/metadata.json")
    summary_rows(results).write.mode("overwrite").json(f"{folder}/summary.json")


def preview(rows: DataFrame, n: int = 5) -> str:
    """The first n rows as a text table, as a console shows them."""
    shown = rows.limit(n).collect()
    cells = [rows.columns, *[[", ".join(map(str, x)) if isinstance(x, list) else str(x) for x in r] for r in shown]]
    width = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in cells)


def append_json(rows: DataFrame, folder: str, run: str | None = None) -> str:
    """Append rows as one run; gives its id. A run that was committed before, under the same id, is not written again, and one that
    broke off is replaced, so a caller that tries again with its id appends once. Read with read_appended."""
    stamped = rows.withColumn("written_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    return _append(rows.sparkSession, folder, run, lambda path: stamped.write.mode("overwrite").json(path))


def append_log(lines: DataFrame, folder: str, run: str | None = None) -> str:
    """The same for text lines."""
    text = lines.select(F.col(lines.columns[0]).cast("string").alias("value"))
    return _append(lines.sparkSession, folder, run, lambda path: text.write.mode("overwrite").text(path))


def _append(spark, folder: str, run: str | None, write) -> str:
    run = run or uuid.uuid4().hex
    if not exists(spark, f"{folder}/commits/run={run}/_SUCCESS"):
        write(f"{folder}/runs/run={run}")
        spark.createDataFrame([(run,)], "id string").coalesce(1).write.mode("overwrite").json(f"{folder}/commits/run={run}")
    return run


def committed_runs(spark, folder: str) -> list[str]:
    """The folders of the runs that were appended in whole: a name for each run."""
    if not exists(spark, f"{folder}/commits"):
        return []
    return [f"{folder}/runs/run={r.id}" for r in spark.read.schema("id string").json(f"{folder}/commits/*").distinct().orderBy("id").collect()]


def read_appended(spark, folder: str, schema: str) -> DataFrame:
    """The rows of all committed runs, each once; of text lines if schema is "value string"."""
    paths = committed_runs(spark, folder)
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.text(paths) if schema == "value string" else spark.read.schema(schema).json(paths)


def write_report(lines: DataFrame, folder: str) -> None:
    """A text report, its lines in the order of column n; a report is a few lines for each run."""
    lines.orderBy("n").coalesce(1).select("value").write.mode("overwrite").text(folder)


def save_index(vertical: DataFrame, path: str, buckets: int | None = None) -> None:
    """A vertical index (item, ...) as files bucketed by item; see read_index."""
    spark = vertical.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"cartloom_index_{uuid.uuid4().hex}"
    vertical.repartition(n, "item").write.format("parquet").mode("overwrite").option("path", f"{path}/rows").bucketBy(n, "item").sortBy("item").saveAsTable(name)
    spark.createDataFrame([(n, vertical.schema.json())], "buckets int, kind string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def read_index(spark, path: str) -> DataFrame:
    """An index as a bucketed table, so that a join or grouping by item finds its rows dealt by item and doesn't shuffle them."""
    about = spark.read.schema("buckets int, kind string").json(f"{path}/about").first()
    kind = StructType.fromJson(json.loads(about.kind))
    name = f"cartloom_index_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (item) SORTED BY (item) INTO {about.buckets} BUCKETS LOCATION '{path}/rows'")
    return spark.table(name)


def fingerprint(rows: DataFrame) -> str:
    """A digest of all rows in any order, repeated ones counted: their number, and sum and xor of two hashes of each."""
    h = [F.xxhash64(F.lit(seed), *rows.columns) for seed in (1, 2)]
    wide = lambda x: F.sum(x.cast("decimal(38,0)"))
    r = rows.agg(F.count("*"), wide(h[0]), F.bit_xor(h[0]), wide(h[1]), F.bit_xor(h[1])).first()
    return hashlib.md5("|".join([*rows.columns, *map(str, r)]).encode()).hexdigest()


def index_key(spark, sample_size: int | None, max_items: int | None, seed: int, data: DataFrame | str) -> str:
    """A name for a cached index, of its parameters and of the rows that it is made from (or their fingerprint)."""
    print_ = data if isinstance(data, str) else fingerprint(data)
    return hashlib.md5("_".join(map(str, (sample_size, max_items, seed, print_))).encode()).hexdigest()[:8]


def cached_index(spark, root: str, key: str, build) -> DataFrame:
    """The index under a key; it is built and saved if it isn't there. With a key of index_key over the input, changed data has another one."""
    path = f"{root}/tid-{key}"
    if not exists(spark, f"{path}/about/_SUCCESS"):
        save_index(build(), path)
    return read_index(spark, path)


def next_run_folder(spark, root: str, sample_size: int) -> str:
    """The first unused name {root}/benchmark_{thousands}k_{number}."""
    n = 1
    while exists(spark, name := f"{root}/benchmark_{sample_size // 1000}k_{n:03d}"):
        n += 1
    return name
