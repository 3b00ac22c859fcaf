"""Suffix-array dedup and centroid clustering against brute force."""

import hashlib
import random

import numpy as np
import pytest

from cartloom.llm import kmeans, suffix_dedup

DOCS = "doc_id long, text string"


def cut(rows):
    """Brute force: doc_id, n_bytes, spans and kept of each row, in order."""
    least = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        if d is not None:
            for i in range(len(b) - 49):
                least[b[i : i + 50]] = min(d, least.get(b[i : i + 50], d))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - 49):
                if least[b[i : i + 50]] < d:
                    gone[i : i + 50] = b"\x01" * 50
        spans = []
        for i, g in enumerate(gone):
            if g and (i == 0 or not gone[i - 1]):
                spans.append([i, i + 1])
            elif g:
                spans[-1][1] = i + 1
        out.append((d, len(b), tuple(map(tuple, spans)), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def run_cut(spark, rows, block_bytes):
    found = suffix_dedup.drop_repeated_bytes(spark.createDataFrame(rows, DOCS), block_bytes).collect()
    return [(r.doc_id, r.n_bytes, tuple((s["first"], s["end"]) for s in r.spans), bytes(r.kept)) for r in found]


def sample(seed=1):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passages = [word(rng.randint(50, 300)) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [word(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            parts += [p[a : len(p) - rng.randint(0, 20)], word(rng.randint(0, 60))]
        rows.append((rng.randint(0, 500), "".join(parts)))
    rows += [(900 + i, rows[i][1]) for i in range(5)]  # whole copies
    rows += [(rows[3][0], rows[3][1]), (rows[4][0], rows[5][1]), (None, rows[6][1]), (7, None), (8, ""), (None, None)]
    rows += [(1000 + i, "x" * (45 + i)) for i in range(12)] + [(2000, "ab" * 400), (2001, "b" + "ab" * 300), (2002, "a" * 700)]
    return rows


@pytest.mark.parametrize("block_bytes, large", [(1 << 20, 20_000), (1500, 20_000), (1500, 2)])
def test_bytes_equal_brute_force(spark, monkeypatch, block_bytes, large):
    """In one block, in many, and with buckets that are cut to single windows."""
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    rows = sample()
    assert sorted(run_cut(spark, rows, block_bytes), key=repr) == sorted(cut(rows), key=repr)


def test_long_text_in_pieces(monkeypatch):
    """A text is hashed in pieces; runs are those of the whole."""
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 6000).astype(np.uint8)
    ends = np.array([10, 10, 2500, 2549, 6000])

    def windows():
        start, size, bucket, of = suffix_dedup.window_runs(raw, ends)
        assert (size <= suffix_dedup.RUN).all() and len(of) == len(start)
        return {(int(s) + j, int(b), int(o)) for s, n, b, o in zip(start, size, bucket, of, strict=True) for j in range(n)}

    whole = windows()
    assert {w[0] for w in whole} == {i for a, b in [(10, 2500), (2549, 6000)] for i in range(a, b - 49)}
    monkeypatch.setattr(suffix_dedup, "_PIECE", 777)
    assert windows() == whole


def test_sorted_windows():
    """Order and ties of suffixes by 50 bytes, in texts that are mostly ties."""
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 76))) for _ in range(150)]
    texts += [b"q" + t[:60].ljust(50, b"z") for t in texts[:60]] + [b"a" * 70] * 3
    raw = b"".join(texts)
    base = np.cumsum([0] + [len(t) for t in texts])
    starts = np.array([b + i for b, t in zip(base, texts) for i in range(len(t) - 49)])
    order, same = suffix_dedup.sorted_windows(np.frombuffer(raw, np.uint8), starts)
    got = [raw[s : s + 50] for s in starts[order]]
    assert got == sorted(got)
    assert same.tolist() == [i > 0 and got[i] == got[i - 1] for i in range(len(got))]


def test_megabyte_text(spark):
    rng = random.Random(5)
    big = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    rows = [(1, big), (2, "front " + big[400_000:] + " back"), (3, big)]
    assert sorted(run_cut(spark, rows, 1 << 20)) == sorted(cut(rows))


def test_no_documents(spark):
    assert run_cut(spark, [], 1 << 20) == []


# clustering ------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>"


def plain(rows, k, dims, rounds):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "z", r[1]))
    c = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        at = [near(q)[1] for _, q in kept]
        c = [[sum(col) // len(col) for col in zip(*own)] if (own := [q for (_, q), a in zip(kept, at) if a == j]) else c[j] for j in range(len(c))]
    out = [(i, near(q)[1], near(q)[0]) for i, q in kept]
    inertia = lambda j: sum(d for _, a, d in out if j is None or a == j)
    return [(i, a, d, inertia(a), inertia(None), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for i, a, d in out]


def run_clusters(spark, rows, dims, k=8, rounds=10):
    found = kmeans.clusters(spark.createDataFrame(rows, VECTORS), k=k, dims=dims, rounds=rounds)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_clusters_equal_plain(spark):
    """Grids with very many ties, copies, short and broken vectors."""
    rng = random.Random(2)
    rows = [(i, [rng.randint(-3, 3) / 1024 for _ in range(4)]) for i in range(300)]
    rows += [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300, 500)] + [(5, [0.0] * 4)] * 3
    rows += [(600, None), (601, [1.0]), (602, [None, 1.0, 1.0, 1.0]), (603, [float("nan")] * 4), (604, [float("inf")] * 4), (None, [0.5] * 4), (605, [])]
    assert run_clusters(spark, rows, 4) == sorted(plain(rows, 8, 4, 10), key=repr)


def test_few_vectors(spark):
    assert run_clusters(spark, [], 3) == []
    rows = [(1, [0.25, -0.25, 0.1]), (2, [0.25, -0.25, 0.1]), (3, [1.0, 2.0, 3.0])]
    assert run_clusters(spark, rows, 3) == sorted(plain(rows, 8, 3, 10), key=repr)


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        run_clusters(spark, [(1, [1e30, 0.0])], 2)


def test_bounds_hold():
    """After every step the bounds enclose the true distances, and few distances are computed."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 40, (300, 8)) for m in (0, 900, -900, 2000)]).astype(np.int64)
    c = x[[0, 350, 700, 1000]]
    cluster, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros((len(x), 4))
    for _ in range(5):
        computed = kmeans.assign(x, c, cluster, upper, lower)
        d2 = np.stack([kmeans.squared(x, y) for y in c], 1)
        assert (cluster == d2.argmin(1)).all()
        assert (upper >= np.sqrt(d2[np.arange(len(x)), cluster])).all() and (lower <= np.sqrt(d2)).all()
        new = np.stack([x[cluster == j].sum(0) // (cluster == j).sum() for j in range(4)])
        moved = np.sqrt(kmeans.squared(new, c)) * (1 + 2.0**-50)
        upper, lower, c = (upper + moved[cluster]) * (1 + 2.0**-50), np.maximum(0, lower - moved - lower * 2.0**-50), new
    assert computed < len(x)
