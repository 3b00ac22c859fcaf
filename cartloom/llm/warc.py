"""WARC fixity: Merkle trees over records in the order of their offsets, compared from the root down.

A leaf is the hash of a record's offset, length and SHA-256; a node is the hash of the FAN nodes below
it, in order, and so of an unbroken range of offsets. Trees are tables in the shared folder, a folder
for each level. An audit joins the roots of two replicas, and on each further level only the
children of nodes that differ, down to the records; in the ranges that differ records are aligned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartloom.llm.common import scratch, written
from cartloom.operators.running import running_sums

FAN = 16
#: Up to so many archives with differences are named in a scan's filter; beyond, the level is joined with the suspect nodes alone.
MOST_LISTED = 1000
ARCHIVE_PAGES = 1000


def warc_record(page_id: Column, url: Column, body: Column) -> Column:
    """A response record as text; nulls are empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def archives(pages: DataFrame, archive_pages: int = ARCHIVE_PAGES) -> DataFrame:
    """pages (page_id, url, html) as records: archive, page_id, record.

    An archive holds archive_pages successive page numbers; pages without a number are archive -1.
    """
    return pages.select(F.coalesce(F.expr(f"page_id div {archive_pages}"), F.lit(-1)).alias("archive"), "page_id", warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def manifest(records: DataFrame) -> DataFrame:
    """archive, pos, page_id, offset, length, digest: the records (archive, page_id, record) in the order that they lie in.

    Only digests are shuffled. Order: page_id, nulls first, then digest, so repeated rows have places of their own. Places and
    offsets are running sums over ranges of that order, so an archive of very many records is split among tasks.
    """
    each = records.select("archive", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    order = [F.col("archive"), F.asc_nulls_first("page_id"), F.col("digest"), F.col("length")]
    placed = written(running_sums(each, order, {"pos": F.lit(1), "offset": F.col("length")}), "manifest")
    first = placed.groupBy("archive").agg(F.min("pos").alias("_pos"), F.min("offset").alias("_offset"))
    return placed.join(first, "archive").select("archive", (F.col("pos") - F.col("_pos")).alias("pos"), "page_id", (F.col("offset") - F.col("_offset")).alias("offset"), "length", "digest")


def build_tree(places: DataFrame, fan: int = FAN) -> str:
    """Write the tree over a manifest; the folder has level=0 (records) to the roots, and "height", and is returned.

    No records give a tree of one empty level. Level 0 also keeps the manifest's columns. Each group has at most fan rows. Each level is ordered
    by archive, so that a reader of few archives skips most of its files.
    """
    spark = places.sparkSession
    folder = scratch(spark, "merkle")
    leaf = F.sha2(F.concat_ws("|", F.col("offset").cast("string"), F.col("length").cast("string"), "digest"), 256)
    rows, level = places.select("archive", F.col("pos").alias("node"), "page_id", "offset", "length", "digest", leaf.alias("hash")), 0
    top = None
    while True:
        rows.repartitionByRange("archive", "node").sortWithinPartitions("archive", "node").write.parquet(f"{folder}/level={level}")
        below = spark.read.parquet(f"{folder}/level={level}").select("archive", "node", "hash", "offset", "length")
        top = below.agg(F.max("node")).first()[0] or 0 if top is None else top // fan
        if top == 0:
            break
        up = below.groupBy("archive", F.expr(f"node div {fan}").alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("c"), F.min("offset").alias("offset"), F.sum("length").alias("length")
        )
        level += 1
        rows = up.select("archive", F.col("up").alias("node"), F.sha2(F.concat(F.col("offset").cast("string"), F.lit("|"), F.array_join("c.hash", "|")), 256).alias("hash"), "offset", "length")
    spark.createDataFrame([(level,)], "height int").coalesce(1).write.parquet(f"{folder}/height")
    return folder


def tree_height(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/height").first().height


def _level(spark: SparkSession, folder: str, level: int, suspect: DataFrame | None, archives: list[int] | None, fan: int) -> DataFrame:
    """A level's nodes, below suspect ones only. archives, if given, holds theirs, and the scan skips what is outside of them."""
    rows = spark.read.parquet(f"{folder}/level={level}")
    if suspect is None:
        return rows
    if archives is not None:
        rows = rows.filter(F.col("archive").isin(archives))
    return rows.withColumn("up", F.expr(f"node div {fan}")).join(suspect, ["archive", "up"], "left_semi").drop("up")


def audit(spark: SparkSession, tree: str, replica: str, fan: int = FAN, moved: bool = False) -> DataFrame:
    """Records that differ between two trees: archive, pos, page_id, offset, length, status, digest, replica_digest.

    Trees that are equal give no rows and are read at their roots alone; a level is read only below
    nodes that differ. A root of the lower tree is compared with the same range of the higher.

    A record that is lost or added shifts those behind it, so in the ranges that differ records are
    aligned: by page_id and digest first (the same record at another offset: status moved, left out
    unless asked for), then what is left by page_id. status: altered, missing (in the replica) or added.
    pos and offset are the place in the tree, for added records in the replica. Records without page_id are aligned like those
    of one page_id; of repeated rows the first ones are matched, and those that are left are missing or added. An empty tree has all of
    the other's records as added or missing; two empty ones give no rows.
    """
    height = min(tree_height(spark, tree), tree_height(spark, replica))
    suspect, archives = None, None
    for level in range(height, 0, -1):
        mine, other = (_level(spark, f, level, suspect, archives, fan).select("archive", "node", F.col("hash").alias(c)) for f, c in ((tree, "a"), (replica, "b")))
        differ = mine.join(other, ["archive", "node"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
        suspect = written(differ.select("archive", F.col("node").alias("up")), "merkle-suspect")
        found = [r.archive for r in suspect.select("archive").distinct().limit(MOST_LISTED + 1).collect()]
        archives = found if len(found) <= MOST_LISTED else None
        if not found:
            break
    columns = ("archive", "node", "page_id", "offset", "length", "digest", "hash")
    mine, other = (_level(spark, f, 0, suspect, archives, fan).select(*columns) for f in (tree, replica))
    # leaves that are equal at their place are done
    place = ["archive", "node", "hash"]
    left, right = written(mine.join(other.select(place), place, "left_anti"), "merkle-left"), written(other.join(mine.select(place), place, "left_anti"), "merkle-right")

    def nth(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("node")))

    def aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        a, b = nth(a, keys).alias("a"), nth(b, keys).alias("b")
        same = F.lit(True)
        for k in [*keys, "nth"]:
            same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        return a.join(b, same, "full").select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"))

    exact = written(aligned(left, right, ["archive", "page_id", "digest"]), "merkle-aligned")
    both = F.col("a.node").isNotNull() & F.col("b.node").isNotNull()
    rest = exact.filter(~both)
    by_page = aligned(rest.filter("a.node IS NOT NULL").select("a.*").drop("nth"), rest.filter("b.node IS NOT NULL").select("b.*").drop("nth"), ["archive", "page_id"])
    status = F.when(F.col("b.node").isNull(), "missing").when(F.col("a.node").isNull(), "added").otherwise("altered")
    out = by_page.withColumn("status", status)
    if moved:
        out = out.unionByName(exact.filter(both).withColumn("status", F.lit("moved")))
    of = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
    return out.select(
        of("archive").alias("archive"), of("node").alias("pos"), of("page_id").alias("page_id"), of("offset").alias("offset"), of("length").alias("length"),
        "status", F.col("a.digest").alias("digest"), F.col("b.digest").alias("replica_digest"),
    )
