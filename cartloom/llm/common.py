"""What the operators of this subpackage share: tables, the shared folder, links between groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cartloom.sources.shared import free_name, importable, scratch, shared_root, written

__all__ = ["bucket_links", "column", "components", "file_system", "free_name", "importable", "in_blocks", "joined_components", "prepare", "scratch", "shared_root", "table", "text_blocks", "texts", "written"]

def prepare(spark: SparkSession) -> None:
    """Python workers can import this package, and get rows in small batches, as texts can be long, unless the session has a size of its own."""
    importable(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) in (None, "10000"):  # unset, or the default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI and the path in it, for use in a task."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def texts(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list[pa.RecordBatch], list[str]]]:
    """Batches that have a column text, gathered to blocks of about so many characters; null texts are empty."""
    held: list[pa.RecordBatch] = []
    got: list[str] = []
    n = 0
    for batch in batches:
        new = [x or "" for x in batch.column("text").to_pylist()]
        held.append(batch)
        got += new
        n += sum(map(len, new))
        if n >= chars:
            yield held, got
            held, got, n = [], [], 0
    if held:
        yield held, got


def text_blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list[pa.RecordBatch], pa.Array]]:
    """The same with the texts as one Arrow array, of about so many bytes."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.column("text").nbytes
        if n >= chars:
            yield held, joined_texts(held)
            held, n = [], 0
    if held:
        yield held, joined_texts(held)


def joined_texts(held: list[pa.RecordBatch]) -> pa.Array:
    return pa.concat_arrays([b.column("text").cast(pa.large_string()) for b in held]).fill_null("")


def column(held: list[pa.RecordBatch], name: str) -> pa.ChunkedArray:
    return pa.chunked_array([b.column(name) for b in held])


def in_blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """rows, of which n_bytes tells the size, as a table with two more columns: block, some megabytes of rows, and no, the place in it.

    The table is bucketed by block and named cartloom_blocks_*; its files are in the shared folder. What
    is grouped by block later meets the rows where they lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks, numbers = [], []
            for x in batch.column("n_bytes").to_pylist():
                if n and size + x > block_bytes:
                    block, n, size = block + 1, 0, 0
                blocks.append(block)
                numbers.append(n)
                n, size = n + 1, size + x
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(numbers, pa.int32()), *batch.columns], ["block", "no", *batch.schema.names])

    spark = rows.sparkSession
    kinds = StructType([StructField("block", LongType()), StructField("no", IntegerType()), *rows.schema.fields])
    name, n = f"cartloom_blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.mapInArrow(run, kinds).write.format("parquet").option("path", scratch(spark, "text-blocks")).bucketBy(n, "block").sortBy("block").saveAsTable(name)
    return spark.table(name)


def bucket_links(buckets: DataFrame, key: str, node: str) -> DataFrame:
    """Pairs (a, b) of each node and the least node of each of its buckets, b < a, each pair once.

    Linear in the rows: a bucket of n nodes gives n - 1 pairs, never all pairs.
    """
    # Both sides of the join are tables, so that a bucket with very many nodes can be split among tasks.
    least = written(buckets.groupBy(key).agg(F.min(node).alias("b"), F.max(node).alias("_max")).filter("b < _max").drop("_max"), "bucket-least")
    return buckets.join(least, key).filter(F.col(node) > F.col("b")).select(F.col(node).alias("a"), "b").distinct()


def components(links: DataFrame, name: str, rounds: int = 40) -> DataFrame:
    """Connected components of links (a, b): rows (node, root), root being the least node, for nodes with a link.

    Alternating large-star and small-star steps. A step takes the least neighbour of each node (an
    aggregate that is combined before the shuffle) and joins it back. Links and least neighbours are
    tables in the shared folder: adaptive execution splits the links of a hub among tasks, as nothing
    but the join needs them together.
    """
    spark = links.sparkSession

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    seen = print_of(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
        # large star: each larger neighbour of u is linked with the least of u's neighbourhood
        large = edges.join(least, edges.b == least.u).select("a", F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: the smaller neighbours of u, and u, are linked with the least of them
        low = written(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), f"{name}-low")
        step = large.join(low, large.a == low.u)
        small = step.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = written(small.filter("a <> b").distinct(), name)
        now = print_of(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components of {name}: no end after {rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def joined_components(roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """roots (see components) after further links: only the components that these join are worked on, each as one node."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b"))
    moves = written(components(between, name).select(F.col("node").alias("was"), F.col("root").alias("now")), f"{name}-moves")
    moved = roots.join(moves, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
    single = moves.join(roots.select(F.col("node").alias("was")), "was", "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))
    return written(moved.union(single), f"{name}-roots")
