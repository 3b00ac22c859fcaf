"""The queries of this subpackage: each applies an operator, with its production parameters, to a whole table."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.llm.common import scratch, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as pictures, with the class of their copies. The tables have no media column, so the pictures are rendered, those with odd numbers as edited copies."""
    from cartloom.llm.media import image_copies, rendered

    return image_copies(rendered(table(spark, sf_dir, "embeddings")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as token files and read them back: doc_id, start, n_tokens, ids_crc32, bytes."""
    from cartloom.llm.token_files import read_token_files, write_token_files

    folder = scratch(spark, "token-files")
    dictionary, _ = write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), folder)
    return read_token_files(spark, folder, dictionary, ids=False)


#: Used where the session has no key of its own; it is public, so pseudonyms made with it can be undone.
PUBLIC_KEY = "cartloom-pseudonyms-1"


def pseudonym_key(spark: SparkSession) -> str:
    """The secret of the pseudonyms: spark.cartloom.pseudonym.key of the session, or $CARTLOOM_PSEUDONYM_KEY."""
    key = spark.conf.get("spark.cartloom.pseudonym.key", None) or os.environ.get("CARTLOOM_PSEUDONYM_KEY")
    if not key:
        warnings.warn("no spark.cartloom.pseudonym.key is set: pseudonyms are made with a public key", stacklevel=2)
    return key or PUBLIC_KEY


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data as pseudonyms: doc_id, text, n_found."""
    from cartloom.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonym_key(spark))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens, a row for each piece."""
    from cartloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later copies of repeated runs of lines: doc_id, text, n_deleted."""
    from cartloom.llm.line_dedup import drop_repeated_lines

    return drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded by the pair occurrence index."""
    from cartloom.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


#: Pages in an archive of op7.
OP7_PAGES = 100


def damaged_replica(pages: DataFrame) -> DataFrame:
    """The records of pages as a replica that has lost bits: a byte of about one in 64 records; by the archive's number modulo
    three the last record, one in the middle, which shifts all behind it, or none but one that is there twice."""
    from cartloom.llm.warc import archives

    own = archives(pages, OP7_PAGES)
    digest, kind, place = F.md5(F.col("page_id").cast("string")), F.col("archive") % 3, F.col("page_id") % OP7_PAGES
    flipped = own.withColumn("record", F.when(digest.startswith("0") & F.substring(digest, 2, 1).isin("0", "1", "2", "3"), F.concat(F.lit("w"), F.expr("substring(record, 2)"))).otherwise(F.col("record")))
    last = own.groupBy("archive").agg(F.max("page_id").alias("page_id")).filter(kind == 0)
    times = F.when((kind == 1) & (place == OP7_PAGES // 2), 0).when((kind == 2) & (place == OP7_PAGES // 4), 2).otherwise(1)
    copies = flipped.join(last, ["archive", "page_id"], "left_anti").withColumn("_n", F.explode(F.array_repeat(F.lit(0), times)))
    return copies.drop("_n")


def op7_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, and a damaged replica of them: the records that the audit finds, shifted ones among them."""
    from cartloom.llm.warc import archives, audit, build_tree, manifest

    pages = table(spark, sf_dir, "pages")
    return audit(spark, build_tree(manifest(archives(pages, OP7_PAGES))), build_tree(manifest(damaged_replica(pages))), moved=True)


OP7_SQL = f"""
WITH records AS (
  SELECT coalesce(page_id // {OP7_PAGES}, -1) AS archive, page_id,
    concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', coalesce(page_id::VARCHAR, ''),
      '>', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, ''))::VARCHAR,
      chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record
  FROM pages),
placed AS (
  SELECT archive, page_id, record, strlen(record) AS length, sha256(record) AS digest FROM records),
ordered AS (
  SELECT *, row_number() OVER w - 1 AS pos, archive % 3 AS kind, page_id % {OP7_PAGES} AS place,
    sum(length) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, digest, length ROWS UNBOUNDED PRECEDING) - length AS offset_,
    max(page_id) OVER (PARTITION BY archive) AS final,
    coalesce(md5(page_id::VARCHAR) LIKE '00%' OR md5(page_id::VARCHAR) LIKE '01%' OR md5(page_id::VARCHAR) LIKE '02%' OR md5(page_id::VARCHAR) LIKE '03%', false) AS hit
  FROM placed WINDOW w AS (PARTITION BY archive ORDER BY page_id NULLS FIRST, digest, length)),
known AS (
  SELECT *, coalesce((kind = 0 AND page_id = final) OR (kind = 1 AND place = {OP7_PAGES // 2}), false) AS lost, coalesce(kind = 2 AND place = {OP7_PAGES // 4}, false) AS twice,
    CASE WHEN hit THEN sha256('w' || substr(record, 2)) ELSE digest END AS other,
    coalesce((kind = 1 AND place > {OP7_PAGES // 2}) OR (kind = 2 AND place > {OP7_PAGES // 4}), false) AS shifted
  FROM ordered)
SELECT archive::BIGINT AS archive, pos::BIGINT AS pos, page_id, offset_::BIGINT AS "offset", length::BIGINT AS length,
  CASE WHEN lost THEN 'missing' WHEN hit THEN 'altered' ELSE 'moved' END AS status, digest, CASE WHEN lost THEN NULL ELSE other END AS replica_digest
FROM known WHERE lost OR hit OR shifted
UNION ALL
SELECT archive::BIGINT, pos + 1, page_id, (offset_ + length)::BIGINT, length::BIGINT, 'added', NULL, other FROM known WHERE twice
"""


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; only labels of rows that aren't held out are learned from."""
    from cartloom.llm.toxicity import fit, held_out, toxic_passages

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    found = toxic_passages(docs, model)
    best = F.array_max(F.transform("segments", lambda x: F.struct(x["score"], x["first"], x["last"])))
    found = found.withColumn("n_segments", F.size("segments").cast("long")).withColumn("best_from", best["first"]).withColumn("best_to", best["last"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence", "n_segments", "best_from", "best_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, compression ratios and verdict for all documents."""
    from cartloom.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of the quality rules alone, which SQL has too."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_BASE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS MATERIALIZED (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
windows AS (SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
again AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(a.n, 0)::BIGINT AS n_repeat_words FROM words LEFT JOIN lines l USING (rid) LEFT JOIN again a USING (rid))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
"""


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document with its near-duplicate class; kept: it is the one that stays."""
    from cartloom.llm.minhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op11_pivot_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    from cartloom.llm.phrases import phrases

    return phrases(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS MATERIALIZED (
  SELECT lang, array_to_string(g, ' ') AS phrase, len(g) AS size, count(*)::BIGINT AS f
  FROM (SELECT lang, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k)))
  GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[:k], ' ') AS left_, array_to_string(w[k + 1:], ' ') AS right_, w
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM grams WHERE size > 1)),
scores AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score, k
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = left_ JOIN grams y ON y.lang = c.lang AND y.phrase = right_),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, w, f, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(2, size)) AS m FROM grams WHERE size > 2))
  GROUP BY ALL),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM best LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that a smaller doc_id has in a string of 50: how many go, in how many spans, and a digest of what stays."""
    from cartloom.llm.suffix_dedup import drop_repeated_bytes

    found = drop_repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Texts as hexadecimal digits, two for a byte.
OP12_SQL = """
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS MATERIALIZED (SELECT *, length(h) // 2 AS n FROM texts),
windows AS MATERIALIZED (SELECT rid, doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM (SELECT rid, doc_id, h, unnest(range(0, n - 49)) AS p FROM sized WHERE n >= 50)),
least AS MATERIALIZED (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING count(*) > 1),
hit AS MATERIALIZED (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS q FROM windows JOIN least USING (w) WHERE doc_id > first),
grouped AS (SELECT rid, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY p) AS g FROM hit),
spans AS MATERIALIZED (SELECT rid, min(p) AS a, max(p) + 50 AS b FROM grouped GROUP BY rid, g),
gaps AS (
  SELECT rid, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY rid ORDER BY a)
  UNION ALL SELECT rid, max(b), NULL FROM spans GROUP BY rid),
kept AS (
  SELECT rid, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS h FROM gaps JOIN sized USING (rid) GROUP BY rid),
totals AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, s.h))) AS kept_sha256
FROM sized s LEFT JOIN totals USING (rid) LEFT JOIN kept k USING (rid)
"""


def op13_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in eight clusters after ten rounds."""
    from cartloom.llm.kmeans import clusters

    return clusters(table(spark, sf_dir, "embeddings"))


def _op13_sql(k: int = 8, rounds: int = 10) -> str:
    """Plain k-means, a pair of tables for each round."""
    parts = ["""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", f"""
c0 AS MATERIALIZED (
  SELECT r - 1 AS c, q FROM (SELECT q, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR) NULLS LAST, q) AS r FROM kept) WHERE r <= {k})"""]  # fmt: skip
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT rid, vec_id, q, c, d FROM (
    SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS place FROM (
      SELECT v.rid, v.vec_id, v.q, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM kept v, c{i} c))
  WHERE place = 1)""")
        if i < rounds:
            parts.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.q, o.q) AS q FROM c{i} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS q
    FROM (SELECT c, j, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{i}) GROUP BY c, j)
    GROUP BY c) n ON n.c = o.c)""")
    return ",".join(parts) + f"""
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_image_copies": op1_image_copies,
    "op2_token_files": op2_token_files,
    "op3_pii_pseudonyms": op3_pii_pseudonyms,
    "op4_packing": op4_packing,
    "op10_dart_minhash": op10_dart_minhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_merkle_fixity": op7_merkle_fixity,
    "op8_toxic_segments": op8_toxic_segments,
    "op9_quality_rules": op9_quality_rules,
    "quality_base_counts": quality_base_counts,
    "op11_pivot_phrases": op11_pivot_phrases,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_elkan_clusters": op13_elkan_clusters,
}

ORACLE_SQL: dict[str, str] = {"op7_merkle_fixity": OP7_SQL, "quality_base_counts": QUALITY_BASE_SQL, "op11_pivot_phrases": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_elkan_clusters": _op13_sql()}
