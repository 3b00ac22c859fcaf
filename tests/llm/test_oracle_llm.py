"""The training-data queries that have SQL against DuckDB, and texts of over a megabyte."""

import hashlib
import random

import duckdb
import pytest

from cartloom.llm import bpe, minhash, packing, quality, token_files, toxicity
from cartloom.llm.common import scratch
from cartloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=repr) and got


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(23)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    big = " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(190_000))
    assert len(big) > 1_000_000
    return [(1, big), (2, "short text"), (3, big[:600_000] + " changed " + big[600_000:]), (4, None), (5, "x" * 1_100_000)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def library(name):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(tokenizer_file(name))
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_megabytes_of_token_files(spark, long_texts):
    encode, folder = library("byte_bpe_50k.json"), scratch(spark, "files")
    rows = long_texts[:4]
    dictionary, _ = token_files.write_token_files(docs(spark, rows), tokenizer_file("byte_bpe_50k.json"), folder)
    got = {r.doc_id: r.n_tokens for r in token_files.read_token_files(spark, folder, dictionary, ids=False).collect()}
    assert got == {i: len(encode(t)) + 1 for i, t in rows}


def test_megabytes_of_packing(spark, long_texts):
    encode, rows = library("word_bpe_49k.json"), long_texts[:4]
    pieces = packing.pack(docs(spark, rows), tokenizer_file("word_bpe_49k.json")).collect()
    for i, t in rows:
        own = sorted((p.start, p.length) for p in pieces if p.doc_id == i)
        total = len(encode(t)) + 1
        assert own[0][0] == 0 and sum(n for _, n in own) == total and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    used = {}
    for p in pieces:
        used[p.sequence_id] = used.get(p.sequence_id, 0) + p.length
    assert max(used.values()) <= 4096


def test_megabytes_of_bpe(spark, long_texts):
    encode, rows = library("byte_bpe_50k.json"), long_texts[:4]
    got = {r.doc_id: r for r in bpe.round_trip(docs(spark, rows), tokenizer_file("byte_bpe_50k.json")).collect()}
    for i, t in rows:
        assert got[i].n_tokens == len(encode(t)) and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_megabytes_of_quality(spark, long_texts):
    got = {r.doc_id: r for r in quality.quality_rules(docs(spark, long_texts)).collect()}
    assert got[1].n_words == len(long_texts[0][1].split()) and not got[1].base_failed
    assert not got[5].kept and not got[4].kept


def test_megabytes_of_near_duplicates(spark, long_texts):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, long_texts)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_megabytes_of_toxicity(spark, long_texts):
    model = toxicity.Model({"vilest": 5.0}, -0.5, 1.0, 0.1, (-3.0, 1.0))
    toxic = long_texts[0][1] + " vilest vilest vilest vilest" + long_texts[0][1][:1000]
    got = {r.doc_id: len(r.segments) for r in toxicity.toxic_passages(docs(spark, [*long_texts, (9, toxic)]), model).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 9: 1}


def test_stronger_evidence_never_ties(spark):
    """Scores grow with every further toxic passage."""
    model = toxicity.Model({"vilest": 5.0}, -0.5, 1.0, 0.1, (-9.0, 1.0))
    rows = [(n, ("calm " * 60 + "vilest vilest vilest ") * n) for n in (1, 5, 20, 80, 300)]
    got = sorted((r.doc_id, r.score) for r in toxicity.toxic_passages(docs(spark, rows), model).collect())
    assert all(a < b for (_, a), (_, b) in zip(got, got[1:]))
