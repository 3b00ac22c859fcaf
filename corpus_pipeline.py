"""A corpus from raw documents to packed training sequences, in five stages; each stage's rows are a table.

quality rules -> line dedup -> near-duplicates -> pseudonyms -> packing. All stages but the last
return the columns of documents; n_chars follows the text. Null texts fail the quality rules; the other
stages keep them, and rows without doc_id too. Repeated rows are copies. Further columns stay as they
are, whatever their names. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm import line_dedup, minhash, packing, pii, quality
from cartloom.llm.common import free_name, prepare, table, written
from cartloom.llm.queries import pseudonym_key, tokenizer_file


def _as_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars counted anew where it is one."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The text goes through the rules and comes back, so nothing is joined."""
    prepare(spark)
    return quality.kept_documents(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines."""
    prepare(spark)
    return _as_documents(line_dedup.drop_repeated_lines(docs), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the least doc_id. Rows without doc_id stay."""
    prepare(spark)
    d, t, n, s, key = (free_name(docs.columns, x) for x in ("_d", "_t", "_n", "_s", "_th"))
    classes = written(minhash.near_duplicates(docs), "near-classes")
    stay = classes.filter(F.col("doc_id") == F.col("class_id")).groupBy(F.col("doc_id").alias(d), F.col("th").alias(t)).agg(F.count("*").alias(n))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    kept = keyed.join(stay.hint("shuffle_hash"), (F.col("doc_id") == F.col(d)) & (F.col(key) == F.col(t)))
    # Rows that share the doc_id of a class: one of them stays. These are few, if any, and are sorted alone.
    several = written(stay.groupBy(d).agg(F.sum(n).alias("n")).filter("n > 1").select(F.col(d).alias(s)), "near-repeated")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    unnamed = docs.filter("doc_id IS NULL")
    if several.isEmpty():
        return kept.select(columns).unionByName(unnamed)
    own = F.col("doc_id") == F.col(s)
    single, repeated = kept.join(several, own, "left_anti"), kept.join(several, own, "left_semi").dropDuplicates(["doc_id"])
    return single.select(columns).unionByName(repeated.select(columns)).unionByName(unnamed)


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data as pseudonyms."""
    return _as_documents(pii.pseudonymise(docs, pseudonym_key(spark)), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences."""
    prepare(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near-duplicates", near_duplicate_stage),
    ("pseudonyms", pseudonym_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: zstandard frames, darts and tokenizers have no SQL, so the stages are tested against brute force.
ORACLE_SQL: str | None = None
