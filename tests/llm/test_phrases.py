"""Phrase mining against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cartloom.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, top):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3, 4):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        cands = [p for p, a in f.items() if len(p) > 1 and a >= least]
        most = Counter()
        for q in cands:
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    most[q[i : i + m]] = max(most[q[i : i + m]], f[q])
        found = []
        for p in cands:
            if 100 * most[p] >= 80 * f[p]:
                continue
            score, _, l, r = min((2000000 * f[p] // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p], l, r, total[lang], score))
        out += [(lang, i + 1, x[2].decode(), *x[3:]) for i, x in enumerate(sorted(found)[:top])]
    return sorted(out)


def sample():
    rng = random.Random(7)
    words = ["the", "The", "of", "a", "é", "日本", "new", "york", "x"] + [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for _ in range(250):
        text = "".join(rng.choices(words, weights)[0] + rng.choices([" ", "  ", "\t", ", ", ".", "\n", " "], [80, 5, 5, 4, 2, 2, 1])[0] for _ in range(rng.randint(0, 90)))
        rows.append((text + rng.choice(["", " new york city hall", " a a a a a a a"]), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), ("single", "fr"), ("the the the the", None)] + [rows[0]] * 3


@pytest.mark.parametrize("block_bytes, pivot_rows, least, top", [(1 << 20, 200_000, 5, 2000), (2000, 40, 5, 2000), (2000, 40, 3, 7)])
def test_equals_brute_force(spark, monkeypatch, block_bytes, pivot_rows, least, top):
    """In one block, and in many with split pivots."""
    monkeypatch.setattr(phrases, "PIVOT_ROWS", pivot_rows)
    rows = sample()
    found = phrases.phrases(spark.createDataFrame(rows, "text string, lang string"), least, top, block_bytes)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect())) == plain(rows, least, top)


def test_no_documents(spark):
    assert phrases.phrases(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_other_columns(spark):
    rows = [("big red dog " * 40, "en", "x", 1)]
    found = phrases.phrases(spark.createDataFrame(rows, "text string, lang string, word string, id int"), 30)
    assert sorted(map(tuple, found.collect())) == plain([r[:2] for r in rows], 30, 2000)


@pytest.mark.parametrize("kind", [np.int32, np.int64])
def test_pivot_owns_each_occurrence_once(kind):
    """Fragments give each n-gram of frequent words exactly as often as it is there, whatever repeats."""
    rng = np.random.default_rng(1)
    end = phrases.rare(np.dtype(kind))
    ids = rng.choice([0, 1, 2, 3, 9, end], 3000, p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05]).astype(kind)
    rows, n = phrases.fragments(ids)
    grams, f = phrases.owned_ngrams(rows, n)
    got = {tuple(int(x) for x in g if x >= 0): int(c) for g, c in zip(grams, f, strict=True)}
    want = Counter()
    for k in (2, 3, 4):
        for i in range(len(ids) - k + 1):
            w = ids[i : i + k]
            if (w != end).all():
                want[tuple(w.tolist())] += 1
    assert got == want


def test_megabyte_text(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee."]) for _ in range(350_000)), "en"), ("aa bb", "en")]
    found = phrases.phrases(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(map(tuple, found.collect())) == plain(rows, 30, 2000)
