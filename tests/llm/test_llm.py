"""The operators of the training-data subpackage against brute force, round trips and edges."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from cartloom.llm import bpe, line_dedup, media, minhash, packing, pii, quality, token_files, toxicity, warc
from cartloom.llm.common import components, prepare, scratch
from cartloom.llm.queries import PUBLIC_KEY, QUERIES, damaged_replica, tokenizer_file
from cartloom.llm.tokens import ChunkEncoder

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "a\n \nb", "x <|endoftext|> y", "it's 's", "é è́x", "１２ ① Ⅷ", "a\tb", "aaaaaaaa aaaa", "😀 汉字", "\x85 \x85"]


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows and an extra column with a clashing name."""
    rng = random.Random(5)
    long = "\n".join(words(rng, 12) for _ in range(900))
    rows = [(1, None), (2, ""), (3, "one"), (None, "no number " * 9), (4, long), (5, long), (5, long), (6, "a b c d e f"), (6, "g h i j k l"), (None, None)]
    return docs_of(spark, rows).withColumn("node", F.lit("x")).withColumn("key", F.lit(1)).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.mark.parametrize("name, keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunk_encoder_equals_library(name, keeps):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice([" ", "\n", "\t", "a", "the", "'s", "é", "1", "!", " ", "<|endoftext|>", "᠎"]) for _ in range(rng.randrange(1, 20))) for _ in range(500)]
    e = ChunkEncoder(tokenizer_file(name), keeps, limit=200)
    for part in (texts[:100], texts[100:300], texts[300:], []):
        ids, n = e.encode(part)
        want = [x.ids for x in e.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])][: len(part)] == want


def test_other_tokenizers_are_refused(tmp_path):
    import json
    from pathlib import Path

    spec = json.loads(Path(tokenizer_file("byte_bpe_50k.json")).read_text())
    for i, change in enumerate(({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]})):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(spec | change))
        for made in (lambda p: ChunkEncoder(p, True), bpe.PairIndexBPE):
            with pytest.raises(ValueError):
                made(str(path))
    with pytest.raises(ValueError):
        ChunkEncoder(tokenizer_file("byte_bpe_50k.json"), False)


def test_pair_index_bpe_equals_library():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), bpe.PairIndexBPE(tokenizer_file("byte_bpe_50k.json"), limit=100)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice([" ", "\n", "a", "aa", "the", "ing", "'ll", "ß", "0", ".", "　", "<|endoftext|>", "\U0001f600"]) for _ in range(rng.randrange(1, 25))) for _ in range(500)]
    for part in (texts[:200], texts[200:]):
        ids, n = e.encode(part)
        for text, own, x in zip(part, np.split(ids, np.cumsum(n)[:-1]), t.encode_batch(part, add_special_tokens=False), strict=True):
            assert list(own) == x.ids
            assert e.decode_bytes(own).decode() == t.decode(x.ids, skip_special_tokens=False) == text


def test_bpe_round_trip(spark, edge, empty):
    rows = bpe.round_trip(edge, tokenizer_file("byte_bpe_50k.json")).collect()
    assert len(rows) == edge.count() and all(r.same for r in rows)
    assert {r.decoded_sha256 for r in rows if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.round_trip(empty, tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_token_files(spark, edge, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    folder = scratch(spark, "tok")
    dictionary, report = token_files.write_token_files(edge, tokenizer_file("byte_bpe_50k.json"), folder, shard_docs=3, shard_bytes=2000)
    files = report.orderBy("shard", "part").collect()
    assert sum(r.docs for r in files) == edge.count() and len(files) > 1
    for docs in (1, 2, 100):
        got = token_files.read_token_files(spark, folder, dictionary, docs=docs).orderBy("start").collect()
        assert [r.start for r in got] == [sum(len(x.ids) for x in got[:i]) for i in range(len(got))]
        ids = [r.doc_id for r in got]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(ids) == edge.count()
        want = Counter((r.doc_id, tuple([*t.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in edge.collect())
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    one = files[-1]
    alone = token_files.read_document(folder, f"shard-{one.shard:08d}-{one.part:06d}.tok", 6, dictionary)
    assert {tuple(x) for x in alone} <= {tuple(r.ids) for r in got if r.doc_id == 6} and alone
    with pytest.raises(ValueError):
        token_files.read_document(folder, f"shard-{one.shard:08d}-{one.part:06d}.tok", 6, b"other" * 99)
    dictionary, report = token_files.write_token_files(empty, tokenizer_file("byte_bpe_50k.json"), folder + "-e")
    assert dictionary == b"" and report.count() == 0


def test_first_fit_decreasing_equals_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 200):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free, want = [], np.zeros(n, int)
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            b = next((j for j, f in enumerate(free) if f >= sizes[i]), len(free))
            if b == len(free):
                free.append(100)
            free[b] -= sizes[i]
            want[i] = b
        assert (bins == want).all()
        for b in set(bins):
            spans = sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b))
            assert [s for s, _ in spans] == list(np.cumsum([0, *(z for _, z in spans)])[:-1])
    with pytest.raises(ValueError):
        packing.first_fit_decreasing(np.array([101]), 100)


def test_pairs_of_a_unit_are_not_held():
    """2,000 documents of as many components make 2 million pairs: they leave one document's at a time."""
    import tracemalloc

    from cartloom.llm.minhash import pairs_of_unit

    n = 2_000
    node, ten, zero = np.arange(n), np.full(n, 10), np.zeros(n, np.int64)
    tracemalloc.start()
    pairs = sum(len(a) for a, _ in pairs_of_unit(node, node, ten, ten, zero, np.zeros((n, 8), np.uint64), 0.8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs >= n * (n - 1) // 2 and peak < 4_000_000
    

def test_chunks_go_with_their_task():
    """A worker's encoder holds no chunks after a task of packing, ended or not: the next task can be of another operator."""
    from cartloom.llm import tokens

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", "other words"])], ["doc_id", "text"])
    for whole in (True, False):
        rows = packing._pieces(tokenizer_file("word_bpe_49k.json"), 2, 16)(iter([batch]))
        assert next(rows).num_rows == 2
        held = tokens._held[tokenizer_file("word_bpe_49k.json"), False]
        assert len(held.index) and len(held.units)
        list(rows) if whole else rows.close()
        assert not len(held.index) and not len(held.units) and not len(held.flat)


def test_byte_level_words_are_encoded_once(monkeypatch):
    """Chunks of the same words with other punctuation, line ends and apostrophes: the library gets each distinct word once; ids equal the library's."""
    held = ChunkEncoder(tokenizer_file("byte_bpe_50k.json"), True, limit=3_000)
    given = []
    for name in ("encode_each", "encode_words"):
        plain = getattr(held, name)
        monkeypatch.setattr(held, name, lambda strings, plain=plain: given.extend(strings) or plain(strings))
    ends = ["", ",", ".", "!?", "\n", "\n\nand", "'s", "'S", "-2", "\r\n\t", "÷²", "ª", "\x0b", "<", "<|endoftext|>", "’"]
    texts = [" ".join(f"wørd{chr(97 + i % 7)}é{e}" for e in ends) + " " * (i % 3) for i in range(40)] + ["", " ", "\n", " \n x", "x  y", "'"]
    ids, lengths = held.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [x.ids for x in held.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert given.count(" wørdaé") == 1 and " wørdaé," not in given and " wørdaé\n" not in given


def test_plain_texts_are_split_without_chunks():
    """Random texts of all kinds of characters, plain ones and others in a block: ids equal the library's; plain ones add no chunk, only words."""
    rng = random.Random(8)
    plain = ["a", "Zq", "é", "ÿß", "7", "42", ".", "!?", " ", "  ", "\n", "\t", "\r\n", "-", "À"]
    texts = ["", " ", "\n", "a ", " \n x", "a  b", "a \n", "\n\n a"] + ["".join(rng.choices(plain, k=rng.randrange(30))) for _ in range(3_000)]
    mixed = ["".join(rng.choices([*plain, "'s", "'", "×", "<", "<|endoftext|>", "“", "\x0b", "\xa0", "字"], k=rng.randrange(30))) for _ in range(2_000)]
    held = ChunkEncoder(tokenizer_file("byte_bpe_50k.json"), True)
    for own in (texts, [x for pair in zip(texts, mixed) for x in pair], mixed, ["", ""]):
        want = [x.ids for x in held.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
        for given in (own, pa.array(["zz", *own], pa.large_string())[1:]):
            ids, lengths = held.encode(given)
            assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
        assert own is not texts or not len(held.index) and len(held.units)


def test_packing_encodes_each_word_once(monkeypatch):
    """The same words in another case and with other punctuation cost the library nothing more, and ids are those of whole texts."""
    held = ChunkEncoder(tokenizer_file("word_bpe_49k.json"), False, limit=500)
    whole = held.tokenizer
    sent = []

    class Counted:
        def encode_batch_fast(self, strings, **more):
            sent.append(sum(map(len, strings)))
            return whole.encode_batch_fast(strings, **more)

    monkeypatch.setattr(held, "tokenizer", Counted())
    held.encode([" ".join(f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10))])
    first = sum(sent)
    held.encode([" ".join(f"Wort{chr(97 + i)}{chr(97 + j)}," for i in range(20) for j in range(10)), "WORTAA! Wortab\n(wortac)"])
    assert first and sum(sent) - first < first / 20
    rng = np.random.default_rng(8)
    chars = [*map(chr, range(0x20, 0x17F)), *"\t\n\r\x0b\x1c\x1f\x85\u00a0\u0301\u2028\u212aſΣς²½٣🙂\0", "'s", "'ll", "<|endoftext|>", "E\u0301", " ", " ", "ÉÀ"]
    texts = ["".join(chars[i] for i in rng.integers(0, len(chars), rng.integers(0, 50))) for _ in range(3000)]
    for at in range(0, len(texts), 300):
        own = texts[at : at + 300]
        ids, sizes = held.encode(own)
        want = [x.ids for x in whole.encode_batch_fast(own, add_special_tokens=False)]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_packing(spark, edge, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    rows = packing.pack(edge, tokenizer_file("word_bpe_49k.json"), group_pieces=4).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    want = Counter()
    for r in edge.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 4096):
            p = ids[s : s + 4096]
            want[r.doc_id, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    assert packing.pack(empty, tokenizer_file("word_bpe_49k.json")).count() == 0


def brute_quality(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(*(w[i:] for i in range(5)), strict=False))
    c, hit, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if c[g] > 1:
            hit.update(range(i, i + 5))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_quality_rules(spark, edge, empty):
    rng = random.Random(7)
    noise = "".join(chr(rng.randrange(33, 0x3000)) + (" " if i % 9 == 0 else "") for i in range(6000))
    extra = docs_of(spark, [(10, "a b #c\n\n x\vx \n x\n x"), (11, "ha " * 3000), (12, noise), (13, words(rng, 9000, 9000)), (14, " ".join(f"q{i}" for i in range(20)) * 2)])
    rows = edge.select(extra.columns).unionByName(extra)
    got = quality.quality_rules(rows).collect()
    want = Counter((r.doc_id, *brute_quality(r.text or "")) for r in rows.collect())
    assert Counter(tuple(r)[:7] for r in got) == want
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[11] and kept[13] and not kept[1]
    assert quality.kept_documents(rows).count() == sum(r.kept for r in got)
    assert quality.quality_rules(empty).count() == 0
    assert quality.in_band(3000, 2.0, 2.0, 2.0) and not quality.in_band(3000, 1.1, 1.1, 1.1) and not quality.in_band(9000, 2.5, 2.5, 9.0)


def test_quality_rules_reject_base64_in_any_chunk():
    import base64

    import zstandard

    squeeze, rng = zstandard.ZstdCompressor(level=3), random.Random(12)
    prose = "".join(f"{w} " for w in words(rng, 20_000, 3000).split())
    code = base64.b64encode(rng.randbytes(6000)).decode()
    coded = " ".join(code[i : i + 76] for i in range(0, len(code), 76))
    assert quality.verdict(prose[:8186], squeeze, {})
    assert not quality.verdict(prose[:4096] + coded[:4090], squeeze, {})
    assert not quality.verdict(prose[: 4096 * 8] + coded[:4096] + prose[:8192], squeeze, {})


def test_quality_bands_of_the_corpus(spark):
    """Texts of half as many kinds of words as the others are out of the corpus's bands, though in the general ones; quantiles by NumPy."""
    rng = random.Random(17)
    rows = [(i, words(rng, rng.randrange(900, 1400), 5000)) for i in range(300)] + [(1000 + i, words(rng, rng.randrange(1000, 1300), 150)) for i in range(12)]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    assert all(got[i].kept for i in range(300)) and not any(got[1000 + i].kept or got[1000 + i].base_failed for i in range(12))
    assert {r.doc_id for r in quality.kept_documents(docs).collect()} == set(range(300))
    limits = quality.corpus_limits(quality.measures(docs))
    assert len(limits) >= 3
    quartiles = {}
    for band, measure in limits:
        of = [getattr(got[i], measure) for i, t in rows if not got[i].base_failed and (band == -1 and len(t) >= 4096 or band >= 0 and quality.band_of(len(t)) == band)]
        quartiles[band, measure] = len(of), [sorted(of)[math.ceil(q * len(of)) - 1] for q in (0.25, 0.5, 0.75)]
    for (band, measure), found in limits.items():
        near = [(n / 8 ** abs(b - band), q) for (b, m), (n, q) in quartiles.items() if m == measure]
        total = sum(w for w, _ in near)
        a, m, b = (sum(w * q[i] for w, q in near) / total for i in range(3))
        half = max(6 * (b - a) / 1.349, 0.05 * m) * (1 + 3 / total**0.5)
        assert found == pytest.approx((m - half, m + half)), (band, measure)
    plain = {i: quality.verdict(t, zstandard.ZstdCompressor(level=3), limits) for i, t in rows}
    assert plain == {i: r.kept for i, r in got.items()}


@pytest.mark.parametrize("others", [1, 20, 99, 100, 101])
def test_quality_does_not_turn_on_a_number(spark, others):
    """A text of few kinds of words goes, and a plain one stays, however many others have its length."""
    rng = random.Random(19)
    of = lambda kinds, n: words(rng, n, kinds)
    rows = [(i, of(5000, rng.randrange(900, 1400))) for i in range(400)] + [(1000 + i, of(5000, 4000)) for i in range(others)]
    rows += [(1, of(5000, 4000)), (2000, of(60, 4000)), (2001, of(5000, 9000))]
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs_of(spark, rows)).collect()}
    assert not got.pop(2000) and all(got.values())


def test_half_overlapping_chunks():
    """Noise that lies half in one chunk and half in the next is seen."""
    import base64

    import zstandard

    squeeze, rng = zstandard.ZstdCompressor(level=3), random.Random(13)
    prose = "".join(f"{w} " for w in words(rng, 30_000, 3000).split())
    coded = base64.b64encode(rng.randbytes(6000)).decode()[:4096]
    for shift in range(0, 4096, 512):
        assert not quality.verdict(prose[: 8192 + shift] + coded + prose[: 20_000], squeeze, {}), shift


def brute_lines(docs, least):
    """Text and deleted lines by comparing all starts: docs is a list of (key, text) in order."""
    lines = [[(j, x, len(x.encode().split())) for j, x in enumerate((t or "").split("\n"))] for _, t in docs]
    seqs = [[x for x in own if x[2]] for own in lines]
    starts = [(d, i) for d, s in enumerate(seqs) for i in range(len(s))]
    gone = [set() for _ in docs]
    for n, (d, i) in enumerate(starts):
        best = 0
        for e, j in starts[:n]:
            k = 0
            while i + k < len(seqs[d]) and j + k < len(seqs[e]) and seqs[d][i + k][1] == seqs[e][j + k][1]:
                k += 1
            best = max(best, k)
        if best and sum(x[2] for x in seqs[d][i : i + best]) >= least:
            gone[d].update(range(seqs[d][i][0], seqs[d][i + best - 1][0] + 1))
    return ["\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in g) for (_, t), g in zip(docs, gone, strict=True)]


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(12)] + [""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(40)] + [(40, "\n".join(["x y z"] * 20))]
    rows[7] = (7, rows[3][1])
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs_of(spark, rows), min_words=8).collect()}
    assert [got[i] for i, _ in rows] == brute_lines(rows, 8)


def test_line_dedup_of_copies_inside_longer_runs(spark):
    """Few kinds of lines and longer runs, so that suffixes have neighbours of all kinds."""
    rng = random.Random(21)
    for least in (3, 9):
        pool = ["a b", "c", "d e f"]
        rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))) for i in range(25)]
        got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs_of(spark, rows), min_words=least).collect()}
        assert [got[i] for i, _ in rows] == brute_lines(rows, least)


def test_line_dedup_of_very_long_common_runs(spark):
    """Two unequal documents with 20,000 lines in common, and one line 20,000 times: content is compared once, not at each line."""
    rng = random.Random(13)
    common = [words(rng, 6, 10**6) for _ in range(20_000)]
    rows = [(1, "\n".join(["first of all here", *common, "x y z one end"])), (2, "\n".join(["x y z one end", *common, "first of all here"])), (3, "\n".join(["same line a b c"] * 20_000))]
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.drop_repeated_lines(docs_of(spark, rows).repartition(3)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("x y z one end\nfirst of all here", 20_000)
    assert got[3] == ("same line a b c", 19_999)


def test_line_dedup_clashing_names(spark):
    text = "\n".join(f"{i} a b c d e f g h i" for i in range(9))
    docs = docs_of(spark, [(1, text), (2, text)])
    for c in ("_th", "_d", "_t", "_runs", "_mask", "_kept", "n_deleted"):
        docs = docs.withColumn(c, F.lit(c))
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_deleted_1"]
    assert all(r[c] == c for r in out.collect() for c in ("_th", "_d", "_t", "_runs", "_mask", "_kept", "n_deleted"))
    assert {r.doc_id: r.n_deleted_1 for r in out.collect()} == {1: 0, 2: 9}


def test_earlier_prefixes():
    s = [3, 1, 3, 1, 3]
    order = sorted(range(5), key=lambda i: s[i:])
    lcps = [0] + [line_dedup.common_prefix(np.array(s[a:]), np.array(s[b:])) for a, b in zip(order, order[1:], strict=False)]
    assert dict(zip(order, line_dedup.earlier_prefixes(order, lcps), strict=True)) == {0: 0, 1: 0, 2: 3, 3: 2, 4: 1}


def left_pairs_of(spark, texts, root_of, unit_rows):
    """Pairs of the last join if all texts are of one bucket, and the similarities of all pairs of two components, by brute force."""
    docs = docs_of(spark, list(enumerate(texts)))
    regions = minhash.regions_of(docs, docs.select("doc_id"))
    sets = {r.node: set(r.units) for r in regions.collect()}
    hashes = minhash.WordHashes()
    number = {frozenset(minhash.unit_regions(t.encode().split(), hashes).view(np.int64).tolist()): i for i, t in enumerate(texts)}
    root = {node: root_of(number[frozenset(x)]) for node, x in sets.items()}
    roots = spark.createDataFrame(list(root.items()), "node long, root long")
    buckets = regions.select("node", F.lit(1).alias("key"))
    found = minhash.left_pairs(buckets, roots, regions, spark.createDataFrame([], "a long, b long"), 0.8, unit_rows)
    got = {(r.a, r.b) for r in found.collect()}
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if b < a and root[a] != root[b]}
    return got, likeness


def test_last_join_of_near_duplicates_in_blocks(spark):
    """Units dealt to blocks lose no link, whatever the size of the blocks."""
    rng = random.Random(31)
    base = words(rng, 90, 10**6).split()

    def edited(n):
        text = list(base)
        for _ in range(n):
            text[rng.randrange(len(text))] = words(rng, 1, 10**6)
        return " ".join(text[: rng.randrange(80, 91)])

    texts = [edited(rng.randrange(4)) for _ in range(80)]
    for unit_rows in (3, 16, minhash.UNIT_ROWS):
        got, likeness = left_pairs_of(spark, texts, lambda i: i, unit_rows)
        links = {x for x, v in likeness.items() if v >= 0.8}
        assert len(links) > 100 and links <= got <= set(likeness)


def test_last_join_leaves_out_families_below_the_threshold(spark):
    """Two families of texts whose likeness is just under 0.8: the marks rule their pairs out before these leave the task."""
    rng = random.Random(37)
    common, own = words(rng, 260, 10**6).split(), [words(rng, 40, 10**6).split() for _ in range(2)]
    texts = [" ".join(common[:100] + own[i % 2] + common[100:] + [words(rng, 1, 10**6)]) for i in range(80)]
    got, likeness = left_pairs_of(spark, texts, lambda i: i % 2, 32)
    assert len(likeness) == 1600 and all(0.7 < v < 0.8 for v in likeness.values())
    assert len(got) < 160


def test_scan_of_ranges_equals_scan_of_whole_clusters():
    """Open intervals at the ends of ranges are joined, and few rows stay open."""
    names = ("part", "cluster", "rank", "doc_id", "th", "k", "sid", "i", "need", "low", "n")
    rng = random.Random(5)
    for trial in range(150):
        alphabet = rng.choice(("ab", "abc"))
        texts = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(1, 60))})
        places = rng.sample(range(1000), len(texts)) if trial % 3 else sorted(rng.sample(range(1000), len(texts)), reverse=trial % 2)
        need = 1
        lows = [0] + [len(os.path.commonprefix(x)) for x in zip(texts, texts[1:], strict=False)]
        cuts = sorted(rng.randrange(len(texts) + 1) for _ in range(rng.randrange(0, 6)))
        rows = [(sum(c <= n for c in cuts), ord(x[0]), n, p, 0, 0, p, 0, need, low, 0) for n, (x, p, low) in enumerate(zip(texts, places, lows, strict=True))]

        def scanned(rows, whole):
            batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[a : a + 7]]) for a in range(0, len(rows), 7)]
            return [r for b in line_dedup.scan_ranges(whole)(batches) for r in b.to_pylist()]

        first = scanned(rows, False)
        left = sorted((r for r in first if r["open"]), key=lambda r: r["rank"])
        second = scanned([(0, *(r[c] for c in names[1:])) for r in left], True)
        assert not any(r["open"] for r in second)
        got = {r["sid"]: r["n"] for r in [*first, *second] if not r["open"]}
        assert len(got) == sum(not r["open"] for r in [*first, *second])
        want = line_dedup.earlier_prefixes(places, lows)
        assert got == {p: n for p, n in zip(places, want, strict=True) if n >= need}
        assert len(left) <= (len(cuts) + 1) * 2 * 9


def test_line_dedup_of_a_run_with_very_many_continuations(spark):
    """One run that all documents begin with: its suffixes are in all ranges, none of which has most of them."""
    rng = random.Random(17)
    head = [words(rng, 9, 10**6) for _ in range(3)]
    pool = [words(rng, 9, 10**6) for _ in range(5)]
    rows = [(i, "\n".join(head + [rng.choice(pool) for _ in range(rng.randrange(1, 6))])) for i in range(400)]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs_of(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == brute_lines(rows, line_dedup.MIN_WORDS)
    suffixes = spark.range(4000).selectExpr(
        "IF(id % 10 = 0, id, 7) cluster", "id rank", "id sid", "0 i", "id doc_id", "0L th", "0 k", "3 need", "4 reach", "CAST(NULL AS BIGINT) prev"
    ).withColumn("i", F.col("i").cast("int"))
    placed = line_dedup.neighbours_in_order(suffixes)
    assert placed.count() == 4000 and placed.filter("cluster = 7 AND p_sid IS NULL").count() == 1
    assert placed.filter("p_sid IS NOT NULL").filter("compare").count() == 3599
    assert max(r["count"] for r in placed.groupBy("part").count().collect()) < 0.45 * 4000  # of four ranges


def test_line_dedup_edges(spark, edge, empty):
    got = line_dedup.drop_repeated_lines(edge)
    assert got.columns == [*edge.columns, "n_deleted"] and got.count() == edge.count()
    assert {(r.text, r.n_deleted) for r in got.collect() if r.doc_id == 5} == {("", 900)}
    assert [r.text for r in got.collect() if r.doc_id == 1] == [None]
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def brute_classes(docs, threshold=0.8):
    bag, root = {}, {i: i for i, _ in docs}
    for i, t in docs:
        w = (t or "").split()
        bag[i] = Counter(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else Counter([tuple(w)])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, _ in docs:
        for j, _ in docs:
            if j < i and sum((bag[i] & bag[j]).values()) >= threshold * sum((bag[i] | bag[j]).values()):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in docs}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    docs, n = [], 0
    for _ in range(14):
        base = words(rng, rng.choice([6, 40, 150, 300]), 900).split()
        for e in range(rng.randrange(1, 6)):
            own = list(base)
            for _ in range(e):
                own[rng.randrange(len(own))] = f"e{rng.randrange(999)}"
            docs.append((n, " ".join(own)))
            n += 1
    docs += [(n, "two words"), (n + 1, "two  words"), (n + 2, ""), (n + 3, None), (n + 4, "ab " * 50), (n + 5, "ab " * 55)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(spark, docs)).collect()}
    assert got == brute_classes(docs)


def template_family(n):
    """Documents of 600 shared and 100 own shingles, 0.75 alike; from document n on, one for every second of them that is just over 0.8 alike to it alone."""
    rng = random.Random(6)
    shared = [f"t{i}" for i in range(604)]
    own = [[f"o{rng.randrange(10**9)}" for _ in range(100)] for _ in range(n)]
    pairs = [(d, n + k) for k, d in enumerate(range(0, n, 2))]
    twins = [own[d][:24] + [f"p{rng.randrange(10**9)}" for _ in range(76)] for d, _ in pairs]
    return [(i, " ".join(shared + x)) for i, x in enumerate(own + twins)], pairs


def test_near_duplicates_in_a_template_family(spark):
    docs, pairs = template_family(300)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs_of(spark, docs)).collect()}
    assert got == {i: i for i, _ in docs} | {b: a for a, b in pairs}


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    x, y = a[:250], a[50:]
    same = np.mean([(minhash.dart_minhash(minhash.mix(x ^ np.uint64(s))) == minhash.dart_minhash(minhash.mix(y ^ np.uint64(s)))).mean() for s in range(30)])
    assert abs(same - 200 / 300) < 0.03
    assert len(minhash.dart_minhash(a[:1])) == minhash.K


def test_near_duplicate_edges(spark, edge, empty):
    got = minhash.near_duplicates(edge).collect()
    assert len(got) == edge.count() and {r.class_id for r in got if r.doc_id in (4, 5)} == {4}
    assert all(r.class_id is None for r in got if r.doc_id is None)
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    text = "card 4845168114407329 and 4845 1681 1440 7329, not 1234567812345678; mail Ann.b7@x.example.com; call +1 (017) 555-7713 161.17.88.162 or 999.1.1.1 on 2024-02-29, 30/01/1999, 2023-02-30 SSN 123-45-6789"
    rows = docs_of(spark, [(1, text), (2, text), (3, None), (4, ""), (5, "no numbers"), (6, "5 apples")])
    got = {r.doc_id: r for r in pii.pseudonymise(rows, PUBLIC_KEY).collect()}
    new = got[1].text
    assert got[2].text == new and got[3].text is None and (got[5].text, got[6].text) == ("no numbers", "5 apples") and got[6].n_found == 0
    assert got[1].n_found == 8
    for old in ("4845168114407329", "Ann.b7", "555-7713", "161.17.88.162", "2024-02-29", "30/01/1999", "123-45-6789"):
        assert old not in new
    for same in ("1234567812345678", "999.1.1.1", "2023-02-30", "@x.example.com", "+1 ("):
        assert same in new
    import re

    a, b = re.search(r"card (\d{16}) and ([\d ]{19}),", new).groups()
    assert b.replace(" ", "") == a and luhn(a)
    other = pii.pseudonymise(rows, "other key").filter("doc_id = 1").first().text
    assert other != new
    assert pii.pseudonymise(rows.limit(0), PUBLIC_KEY).count() == 0
    assert pii.pseudonymise(rows, PUBLIC_KEY).columns == [*rows.columns, "n_found"]


def test_pseudonyms_are_permutations(spark):
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert digits.select(pii.permuted_digits("k", F.col("d"), F.lit("t")).alias("x")).distinct().count() == 1000
    days = spark.range(pii.ERA).select(F.date_format(F.date_add(F.lit("1901-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    got = days.select(pii.date("k", F.col("d")).alias("x")).distinct()
    assert got.count() == pii.ERA and got.agg(F.min("x"), F.max("x")).first()[:] == ("1901-01-01", "1928-12-31")
    two = spark.range(676).select(F.concat(F.char((F.col("id") % 26 + 97).cast("long")), F.char((F.col("id") / 26 + 97).cast("long"))).alias("d"))
    assert two.select(pii.letters("k", F.col("d"), pii.LOWER, "t").alias("x")).distinct().count() == 676


def brute_segments(scores):
    """Maximal segments by their definition: the best segment, then those left and right of it."""
    best, at = 0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best + 1e-12 or (at and abs(s - best) <= 1e-12 and j - i < at[1] - at[0]):
                best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    return [(a, b) for a, b in brute_segments(scores[:i])] + [(i, j - 1)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


def test_maximal_segments_equal_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        scores = [rng.choice([-1.0, -1.0, -1.0, -3.3, 2.37, 0.91, 4.13]) for _ in range(rng.randrange(1, 25))]
        at = np.array([i for i, s in enumerate(scores) if s != -1], int)
        got = toxicity.maximal_segments(at, np.array([scores[i] for i in at]), -1.0)
        assert sorted((i, j) for _, i, j in got) == sorted(brute_segments(scores))


def test_toxicity(spark, edge, empty):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        w = words(rng, rng.randrange(20, 200)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(len(w) // 10 + 1):
                w.insert(rng.randrange(len(w)), rng.choice(["vilest", "vilely", "grubbo"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    table = docs_of(spark, docs)
    rows = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, rows.filter(~toxicity.held_out(F.col("doc_id"))))
    assert model.other < 0 < model.decay and model.weights[1] > 0
    got = {r.doc_id: r for r in toxicity.toxic_passages(table, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i].score >= 0.7) == bool(dict(labels)[i]) for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score < 0.5 for r in toxicity.toxic_passages(edge, model).collect())
    assert toxicity.toxic_passages(empty, model).count() == 0
    assert toxicity.fit(table, rows.limit(0)).tokens == {}


def test_toxicity_odds_equal_brute_force(spark):
    """Scores of both signs, by the formula on plain counts; clean words that toxic documents avoid score below 0."""
    import math

    rng = random.Random(31)
    docs = [(i, " ".join([*words(rng, 30).split(), *(["vilest"] if i % 3 == 0 else ["please", "thanks"])])) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = toxicity.fit(docs_of(spark, docs), labels)
    sets = [(i % 3 == 0, set().union(*map(toxicity.stems, toxicity.WORD.findall(t)))) for i, t in docs]
    n1, n0, want = 100, 200, {}
    for token in set().union(*(x for _, x in sets)):
        c1, c0 = sum(y and token in x for y, x in sets), sum(not y and token in x for y, x in sets)
        a = toxicity.PRIOR * (c1 + c0) / 300
        odds = math.log((c1 + a) / (n1 + toxicity.PRIOR - c1 - a)) - math.log((c0 + a) / (n0 + toxicity.PRIOR - c0 - a))
        z = odds / math.sqrt(1 / (c1 + a) + 1 / (c0 + a))
        if (c1 >= 8 and z >= 4 and odds >= 1.5) or (c1 + c0 >= 8 and z <= -4):
            want[token] = odds
    assert got.tokens == pytest.approx(want) and got.tokens["please"] < 0 < got.tokens["vilest"]


def test_extreme_value_calibration():
    """lambda is a root of the moment equation, and E is the number of chance segments in random clean words."""
    rng = np.random.default_rng(2)
    scores, rates, other = np.array([2.0, -1.0]), np.array([0.02, 0.1]), -0.2
    decay = toxicity.root_decay(scores, rates, other)
    assert abs((rates * np.exp(decay * scores)).sum() + 0.88 * np.exp(decay * other) - 1) < 1e-6
    found, words_ = [], 0
    for _ in range(400):
        drawn = rng.choice(3, 1000, p=[0.02, 0.1, 0.88])
        at = np.flatnonzero(drawn < 2)
        found += [round(s, 1) for s, _, _ in toxicity.maximal_segments(at, scores[drawn[at]], other)]
        words_ += 1000
    values, counts = np.unique(found, return_counts=True)
    factor = toxicity.tail_factor(values, counts, words_, decay)
    high = np.quantile(found, 0.99)
    assert 0.5 < (np.array(found) >= high).sum() / (factor * words_ * np.exp(-decay * high)) < 2


def test_toxic_passages_lists_all_segments(spark):
    model = toxicity.Model({"vilest": 5.0, "mild": 0.5}, -0.5, 1.0, 0.1, (-3.0, 1.0))
    calm = ["calm"] * 100
    rows = docs_of(spark, [(1, " ".join([*calm, *["vilest"] * 3, *calm, *["vilest"] * 2, *calm])), (2, "mild words"), (3, None)])
    got = {r.doc_id: [(x.first, x.last) for x in r.segments] for r in toxicity.toxic_passages(rows, model).collect()}
    assert got == {1: [(100, 102), (203, 204)], 2: [], 3: []}


def pages_of(spark, n, skip=()):
    return spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(n) if i not in skip], "page_id long, url string, html string")


def test_fixity(spark):
    pages = pages_of(spark, 1100).union(spark.createDataFrame([(None, None, None), (7, "http://x/7", "<p>7</p>"), (7, "http://x/7", "<p>7</p>")], "page_id long, url string, html string")).withColumn("archive", F.lit(3))
    tree = warc.build_tree(warc.manifest(warc.archives(pages, 500)), 4)
    assert warc.audit(spark, tree, tree, 4).count() == 0
    broken = warc.archives(pages, 500).withColumn("record", F.when(F.col("page_id").isin(3, 777), F.translate("record", "W", "w")).otherwise(F.col("record")))
    found = warc.audit(spark, tree, warc.build_tree(warc.manifest(broken), 4), 4).collect()
    assert {(r.page_id, r.status) for r in found} == {(3, "altered"), (777, "altered")}
    short = warc.archives(pages, 500).filter("page_id IS NULL OR page_id <> 1099")
    found = warc.audit(spark, tree, warc.build_tree(warc.manifest(short), 4), 4).collect()
    assert [(r.page_id, r.status) for r in found] == [(1099, "missing")]
    gap = warc.archives(pages, 500).filter("page_id IS NULL OR page_id NOT IN (20, 600)")
    replica = warc.build_tree(warc.manifest(gap), 4)
    found = warc.audit(spark, tree, replica, 4).collect()
    assert {(r.page_id, r.status) for r in found} == {(20, "missing"), (600, "missing")} and all(r.replica_digest is None for r in found)
    assert {(r.page_id, r.status) for r in warc.audit(spark, replica, tree, 4).collect()} == {(20, "added"), (600, "added")}
    assert warc.audit(spark, tree, replica, 4, moved=True).filter("status = 'moved'").count() == 479 + 399  # all behind in these archives
    none = warc.build_tree(warc.manifest(warc.archives(pages.limit(0))))
    assert warc.audit(spark, none, none).count() == 0
    assert damaged_replica(pages).count() <= pages.count()


def canvas_views(n):
    rng = np.random.default_rng(0)
    noise = media.box(media.box(rng.normal(size=(n, 96, 96)), 2), 2)
    noise = (noise - noise.mean((1, 2), keepdims=True)) / noise.std((1, 2), keepdims=True)
    cut = lambda t, l, g, b: np.clip(np.rint(noise[:, t : t + 64, l : l + 64] * g + b), 0, 255).astype(np.uint8)
    return cut(16, 16, 45, 128), cut(6, 10, 35, 150), cut(24, 22, 45, 120)


def test_image_copies(spark):
    a, b, c = canvas_views(12)
    rows = [(i, a[i].tobytes()) for i in range(12)] + [(100 + i, b[i].tobytes()) for i in range(6)] + [(200 + i, c[i].tobytes()) for i in range(3)]
    rows += [(300, a[0].tobytes()), (400, None), (401, bytes(4096)), (402, b"short"), (None, a[1].tobytes())]
    got = {r.vec_id: r.class_id for r in media.image_copies(spark.createDataFrame(rows, "vec_id long, image binary")).collect()}
    for i in range(12):
        assert got[i] == i
    assert [got[100 + i] for i in range(6)] == list(range(6)) and [got[200 + i] for i in range(3)] == [0, 1, 2]
    assert got[300] == 0 and got[None] == 1 and got[400] == 400 and got[401] == 401 and got[402] == 402
    assert media.image_copies(spark.createDataFrame([], "vec_id long, image binary")).count() == 0


def edited_views(n, copies, seed=1):
    """Base images of n canvases, and cropped, noisy, turned and rescaled views of the first ones, all by bilinear samples."""
    rng = np.random.default_rng(seed)
    c = media.box(media.box(rng.normal(size=(n, 112, 112)), 2), 2)
    c = (c - c.mean((1, 2), keepdims=True)) / c.std((1, 2), keepdims=True)
    grid = np.arange(64) - 31.5
    yy, xx = np.meshgrid(grid, grid, indexing="ij")

    def view(x, angle=0.0, zoom=1.0, cy=56, cx=56, noise=0.0, gain=45, light=128):
        y, z = cy + (yy * np.cos(angle) - xx * np.sin(angle)) / zoom, cx + (yy * np.sin(angle) + xx * np.cos(angle)) / zoom
        i, j = y.astype(int), z.astype(int)
        a, b = y - i, z - j
        got = (x[:, i, j] * (1 - a) + x[:, i + 1, j] * a) * (1 - b) + (x[:, i, j + 1] * (1 - a) + x[:, i + 1, j + 1] * a) * b
        return np.clip(np.rint((got + rng.normal(size=got.shape) * noise) * gain + light), 0, 255).astype(np.uint8)

    few = c[:copies]
    return view(c), [view(few, cy=50, cx=48, noise=0.1, gain=38, light=140), view(few, noise=0.2), view(few, angle=0.35, noise=0.05), view(few, zoom=0.8, noise=0.05)]


@pytest.mark.parametrize("n", [60, 3000])
def test_recall_of_edited_images(spark, n):
    """The same keys at each size: at least 0.9 of the edited pairs that consensus accepts are found, of each kind, and hardly any other."""
    base, views = edited_views(n, 40)
    rows = [(i, x.tobytes()) for i, x in enumerate(base)] + [((k + 1) * 10**6 + i, x.tobytes()) for k, v in enumerate(views) for i, x in enumerate(v)]
    path = scratch(spark, "views")
    spark.createDataFrame(rows, "vec_id long, image binary").write.parquet(path)
    got = {r.vec_id: r.class_id for r in media.image_copies(spark.read.parquet(path)).collect()}
    own = media.features(base[:40])
    for k, v in enumerate(views):
        links = [i for i, f in enumerate(media.features(v)) if media.consensus(own[i], f) >= media.LEAST_INLIERS]
        assert len(links) >= 30 and sum(got[(k + 1) * 10**6 + i] == got[i] for i in links) >= 0.9 * len(links)
    assert sum(got[i] != i for i in range(n)) <= 3


def test_images_of_several_shapes(spark):
    """A crop of other dimensions is found; bytes that don't fit their shape are copies of equal ones alone."""
    rng = np.random.default_rng(5)
    big = media.box(media.box(rng.normal(size=(3, 100, 120)), 2), 2)
    big = np.clip(np.rint(big / big.std() * 45 + 128), 0, 255).astype(np.uint8)
    rows = [(i, x.tobytes(), 100, 120, "k") for i, x in enumerate(big)] + [(10 + i, x[10:90, 20:100].copy().tobytes(), 80, 80, "k") for i, x in enumerate(big)]
    rows += [(20, b"abc", 80, 80, "k"), (21, b"abc", None, 80, "k"), (22, big[0].tobytes(), 120, 100, "k"), (23, b"abc", 80, 80, None)]
    got = {r.vec_id: r.class_id for r in media.image_copies(spark.createDataFrame(rows, "vec_id long, image binary, height int, width int, key string")).collect()}
    assert [got[10 + i] for i in range(3)] == [0, 1, 2] and (got[20], got[21], got[22], got[23]) == (20, 21, 22, 20)


def test_cells_of_a_bucket():
    """Each descriptor joins the nearest earlier leader; blocks and large sets of leaders give what a plain loop gives."""
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**63, (40, 4)).astype(np.uint64)
    bits = np.array([centres[rng.integers(40)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (rng.integers(1, 9), 4)).astype(np.uint64), axis=0) for _ in range(700)])
    leaders, want = [], []
    for i, x in enumerate(bits):
        d = [int(np.bitwise_count(x ^ bits[j]).sum()) for j in leaders]
        want.append(leaders[int(np.argmin(d))] if d and min(d) <= media.CELL_DISTANCE else i)
        leaders += [i] * (want[-1] == i)
    for block in (1, 64, 256, 1000):
        got, far = media.cells(bits, block)
        assert (far <= media.CELL_DISTANCE).all() and set(got[got != np.arange(len(got))]) <= set(np.flatnonzero(got == np.arange(len(got))))
    assert (media.cells(bits, 1)[0] == want).all()


def test_rendering(spark):
    """Rows 2 n and 2 n + 1 share a canvas of both vectors; null and repeated rows, rows without vec_id."""
    rows = [(1, [0.5] * 8), (2, None), (3, []), (None, [0.1] * 8), (4, [1.0] + [0.0] * 7), (5, [0.0] * 7 + [1.0]), (-2, [0.3] * 8), (-1, None), (4, [2.0] * 8)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<float>, album string")
    got = media.rendered(df).collect()
    by_id = {r.vec_id: r.image for r in got}
    assert len(got) == len(rows) and by_id[2] is None and by_id[3] is None and all(len(by_id[i]) == 4096 for i in (1, 4, 5, None, -2, -1))
    assert len({r.image for r in got if r.vec_id == 4}) == 1  # the least embedding counts
    assert by_id[1] != by_id[None] and by_id[4] != by_id[5] and by_id[-2] != by_id[-1]
    assert {r.vec_id: r.image for r in media.rendered(df.repartition(3)).collect()} == by_id
    assert media.rendered(df.limit(0)).count() == 0


def test_op1_finds_the_edited_views(spark):
    """On the table: of all edited pictures, and of those that consensus accepts, at least 0.9 are in the class of their canvas; no class has two canvases."""
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {r.vec_id: r.class_id for r in QUERIES["op1_image_copies"](spark, SF).collect()}
    assert len(got) == vectors.count() and all(c >> 1 == v >> 1 for v, c in got.items())
    pictures = {r.vec_id: np.frombuffer(r.image, np.uint8).reshape(64, 64) for r in media.rendered(vectors).collect()}
    ids = sorted(v for v in pictures if v & 1 and v - 1 in pictures)
    odd, even = (media.features(np.stack([pictures[v - shift] for v in ids])) for shift in (0, 1))
    accepted = [v for v, x, y in zip(ids, odd, even, strict=True) if media.consensus(x, y) >= media.LEAST_INLIERS]
    assert sum(got[v] == v - 1 for v in ids) >= 0.9 * len(ids)
    assert sum(got[v] == v - 1 for v in accepted) >= 0.9 * len(accepted)


def test_counts_of_keys(spark):
    """Keys that several images have, and hot ones with their images, as counted plainly; several batches and slots."""
    rng = np.random.default_rng(4)
    few = rng.integers(0, 2**63, (5, 4)).astype(np.uint64)
    rows = [(i, np.concatenate([few[rng.integers(0, 5, 3)], rng.integers(0, 2**63, (2, 4)).astype(np.uint64)])) for i in range(60)]
    found = spark.createDataFrame([(i, x.tobytes()) for i, x in rows] + [(99, b"")], "node long, bits binary").repartition(4)
    seen = {}
    for i, x in rows:
        for key in set(media.table_keys(x).ravel().tolist()):
            seen.setdefault(key, set()).add(i)
    got = media.key_counts(found, 10).collect()
    common = {r.slot * media.SLOT + int(k) for r in got for k in np.flatnonzero(np.unpackbits(np.frombuffer(r.common, np.uint8)))}
    assert common == {k for k, v in seen.items() if len(v) > 1}
    assert {k: n for r in got for k, n in zip(r.hot, r.images, strict=True)} == {k: len(v) for k, v in seen.items() if len(v) > 10}
    bits = np.zeros((media.TABLES << media.KEY_BITS) // 8, np.uint8)
    for k in common:
        bits[k >> 3] |= 1 << (7 - (k & 7))
    kept = {(r.key, r.node) for r in media.bucket_rows(found, bits).collect()}
    assert kept == {(k, i) for k in common for i in seen[k]}


def test_hot_buckets_are_split(spark, monkeypatch):
    """Buckets cut to many parts, and leaders to many blocks, give the classes that whole buckets give; no task gets over a part."""
    rng = np.random.default_rng(6)
    base = canvas_views(4)[0].astype(float)
    rows = [(i, np.clip(np.rint(base[i % 4] + rng.normal(0, 3, (64, 64))), 0, 255).astype(np.uint8).tobytes()) for i in range(160)]
    path = scratch(spark, "hot-images")
    spark.createDataFrame(rows, "vec_id long, image binary").write.parquet(path)
    images = spark.read.parquet(path)
    plain = {r.vec_id: r.class_id for r in media.image_copies(images).collect()}
    sizes, whole = [], media.celled

    def watched(rows, bits_too=False):
        sizes.append(rows.groupBy("key", "part").count().agg(F.max("count")).first()[0] or 0)
        return whole(rows, bits_too)

    monkeypatch.setattr(media, "celled", watched)
    monkeypatch.setattr(media, "BUCKET_ROWS", 8)
    assert {r.vec_id: r.class_id for r in media.image_copies(images).collect()} == plain == {i: i % 4 for i in range(160)}
    assert len(sizes) == 2 and max(sizes) <= 24


@pytest.mark.parametrize("limit", [media.BUCKET_ROWS, 6])
def test_images_are_compared_beyond_the_leaders_of_their_cells(spark, monkeypatch, limit):
    """All images have like descriptors, so one leads all cells, but it has another geometry: the others are only found with each other."""
    rng = np.random.default_rng(12)
    images = spark.createDataFrame([(i, bytes([i]) * 4096) for i in range(12)], "vec_id long, image binary")
    nodes = [r.node for r in images.select(F.xxhash64("image", F.lit(media.SIDE), F.lit(media.SIDE)).alias("node")).orderBy("node").collect()]
    ids = {r.node: r.vec_id for r in images.select("vec_id", F.xxhash64("image", F.lit(media.SIDE), F.lit(media.SIDE)).alias("node")).collect()}
    places = [np.stack([rng.uniform(0, 64, 12), rng.uniform(0, 64, 12), np.ones(12), rng.uniform(-3, 3, 12)], 1).astype("<f2") for _ in nodes]
    bits = rng.integers(0, 2**63, (12, 4)).astype(np.uint64)
    for x, y in ((8, 3), (9, 6), (10, 3), (11, 3)):  # in the order of nodes: copies by geometry
        places[x] = places[y]
    rows = [(n, x.tobytes(), bits.tobytes()) for n, x in zip(nodes, places, strict=True)]
    monkeypatch.setattr(media, "image_features", lambda _: spark.createDataFrame(rows, "node long, spots binary, bits binary"))
    monkeypatch.setattr(media, "BUCKET_ROWS", limit)
    got = {r.vec_id: r.class_id for r in media.image_copies(images).collect()}
    classes = [[3, 8, 10, 11], [6, 9], *([x] for x in (0, 1, 2, 4, 5, 7))]
    assert got == {ids[nodes[i]]: min(ids[nodes[j]] for j in own) for own in classes for i in own}


def test_image_pairs_move_features_once_a_block(spark, monkeypatch):
    """All pairs of 60 images: each image's features go to a tile once, with every pair of it, however many pairs there are."""
    rng = np.random.default_rng(3)
    rows = [(n, rng.uniform(0, 64, (12, 4)).astype("<f2").tobytes(), rng.integers(0, 2**63, (12, 4)).astype(np.uint64).tobytes()) for n in range(60)]
    rows[41] = (41, *rows[7][1:])
    found = spark.createDataFrame(rows, "node long, spots binary, bits binary")
    pairs = spark.createDataFrame([(a, b) for a in range(60) for b in range(a)], "a long, b long")
    monkeypatch.setattr(media, "MATCHED_BYTES", 60 * 12 * 40 // 4)
    dealt = media.tiles(pairs, found).collect()
    held = {(r.tile, r.a): (bytes(r.spots), bytes(r.bits)) for r in dealt if r.b is None}
    assert held == {k: rows[k[1]][1:] for k in held} and len(held) == sum(r.b is None for r in dealt) <= 60 * 4
    assert sorted((r.a, r.b) for r in dealt if r.b is not None) == [(a, b) for a in range(60) for b in range(a)]
    assert all((r.tile, x) in held for r in dealt if r.b is not None for x in (r.a, r.b))
    got = {(r.a, r.b): r.inliers for r in media.matched(pairs, found).collect()}
    assert len(got) == 60 * 59 // 2 and [p for p, n in got.items() if n >= media.LEAST_INLIERS] == [(41, 7)]


def test_image_meetings_are_whole(spark, monkeypatch):
    """Meetings passed on a few at a time are those of all descriptors of a bucket within the distance, of two roots."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (3, 4)).astype(np.uint64)
    bits = [base[i % 3] ^ np.array([1 << int(rng.integers(0, 60)), 0, 0, 0], np.uint64) for i in range(90)]
    rows = [(i % 2, i % 40, i % 40 // 4, x.tobytes()) for i, x in enumerate(bits)]
    want = Counter()
    for i, x in enumerate(rows):
        for j, y in enumerate(rows[:i]):
            far = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            if x[0] == y[0] and x[2] != y[2] and far <= media.CELL_DISTANCE:
                want[max(x[1], y[1]), min(x[1], y[1]), far] += 1
    monkeypatch.setattr(media, "HELD_MEETINGS", 50)
    got = media.between_classes(spark.createDataFrame(rows, "key long, node long, root long, d binary"), None)
    assert Counter((r.a, r.b, r.far) for r in got.collect()) == want and want


def test_images_alike_by_chance_are_no_pairs(spark):
    """40 images have the same descriptors, so all 780 pairs of them meet; only those whose corners lie alike are left to compare, one turned and made larger among them."""
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2**63, (12, 4)).astype(np.uint64)
    spots = [np.stack([rng.uniform(0, 64, 12), rng.uniform(0, 64, 12), np.ones(12), rng.uniform(-3, 3, 12)], 1) for _ in range(40)]
    spots[30], spots[31] = spots[4], spots[7].copy()
    turned = (spots[7][:, 0] + 1j * spots[7][:, 1]) * 1.5 * np.exp(0.4j)
    spots[31][:, 0], spots[31][:, 1], spots[31][:, 2], spots[31][:, 3] = turned.real, turned.imag, 1.5, spots[7][:, 3] + 0.4
    found = spark.createDataFrame([(i, i, x.astype("<f2").tobytes(), bits.tobytes()) for i, x in enumerate(spots)], "node long, root long, spots binary, bits binary")
    rows = media.bucket_rows(found, np.full((media.TABLES << media.KEY_BITS) // 8, 255, np.uint8))
    met = media.between_classes(rows, None).select("a", "b").distinct().collect()
    assert sorted((r.a, r.b) for r in met) == [(30, 4), (31, 7)]


def test_image_copies_leave_no_shuffle_files(spark):
    """The shuffles of jobs that end in tables go with these jobs; the setting is as before then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    had = files()
    views = canvas_views(12)
    rows = [(100 * k + i, v[i].tobytes()) for k, v in enumerate(views) for i in range(6)]
    media.image_copies(spark.createDataFrame(rows, "vec_id long, image binary"))  # its last step is not run
    assert files() <= had and spark.conf.get(name, None) == before


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        path = scratch(spark, "stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before and docs.count() > 0
        assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0 or name == "quality rules"
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.count()


CLASHES = ("_d", "_t", "_n", "_s", "_th", "_found", "_new", "_between", "_mask", "_kept", "n_found", "n_deleted", "node", "key", "class_id", "start")


@pytest.mark.parametrize("at", range(5))
def test_pipeline_stages_on_edges(spark, edge, empty, at):
    """Each stage on nulls, empty and long texts, ties, repeated rows and clashing names, and on no rows at all."""
    name, stage = corpus_pipeline.STAGES[at]
    docs = edge.drop("node", "key")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(c))
    path = scratch(spark, "stage-in")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    got = stage(spark, docs, SF)
    rows = got.collect()
    if name == "packing":
        assert len(rows) >= docs.count()
        assert stage(spark, empty, SF).count() == 0
        return
    assert got.columns == docs.columns and all(r[c] == c for r in rows for c in CLASHES)
    ids = Counter(r.doc_id for r in rows)
    want = {"quality rules": set(), "line dedup": {1, 2, 3, 4, 5, 6, None}, "near-duplicates": {1, 3, 4, 6, None}, "pseudonyms": {1, 2, 3, 4, 5, 6, None}}[name]
    assert set(ids) >= want and (name != "quality rules" or not set(ids) & {1, 2, 3, 6})
    assert (ids[5], ids[6]) == {"quality rules": (2, 0), "line dedup": (2, 2), "near-duplicates": (0, 2), "pseudonyms": (2, 2)}[name] or name == "near-duplicates" and ids[5] == 0
    assert stage(spark, empty, SF).count() == 0 and stage(spark, empty, SF).columns == empty.columns


def test_near_duplicate_stage_keeps_one(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = docs_of(spark, [(3, text), (2, text), (2, text), (9, "other words here now again"), (None, text), (None, None)])
    got = corpus_pipeline.near_duplicate_stage(spark, rows, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 2), (False, 9), (True, 0), (True, 0)]


@pytest.mark.parametrize("name", ["op2_token_files", "op4_packing", "op6_bpe_round_trip", "op9_quality_rules", "op3_pii_pseudonyms", "op8_toxic_segments"])
def test_queries_cover_all_documents(spark, name):
    want = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()} == want


def test_calibration_counts_scores_in_the_tasks(spark, monkeypatch):
    """A row for each score of a task, not for each scored word; the chance rates are those of all words."""
    words = ["awful", "vile", "nasty", "table", "river", "stone"]
    docs = spark.createDataFrame([(i, " ".join([*(words[:3] * 40 if i % 2 else words[3:] * 40), str(i)])) for i in range(600)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))

    def none(*_):
        raise AssertionError("a row for each word")

    seen, root = [], toxicity.root_decay
    monkeypatch.setattr(toxicity.F, "explode", none)
    monkeypatch.setattr(toxicity, "root_decay", lambda scores, rates, other: seen.append((scores, rates)) or root(scores, rates, other))
    model = toxicity.fit(docs, labels)
    scores, rates = seen[0]
    clean = {round(toxicity.WordScores(model.tokens)[w], 2) for w in words[3:]}
    assert sum(r for s, r in zip(scores, rates, strict=True) if s in clean) == pytest.approx(1, abs=0.01)
