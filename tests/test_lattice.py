"""The candidate trie and the counts made with it, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartloom.operators import candidates as C
from cartloom.operators import encode as E
from cartloom.operators import lattice as L
from cartloom.operators import support as U
from cartloom.plans import mine as M

ORDERS = {o: sorted(random.Random(o).sample(range(14), random.Random(o).randint(1, 9))) for o in range(0, 900, 3)}


def rows_of(k, n, seed=1, universe=14):
    rng = random.Random(seed)
    return np.array(sorted({tuple(sorted(rng.sample(range(universe), k))) for _ in range(n)}))[::-1].copy()


def bits_of(universe=14, width=900):
    bits = np.zeros((universe + 1, -(-width // 64) * 64), np.uint8)
    for o, items in ORDERS.items():
        bits[items, o] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


@pytest.mark.parametrize("k, leaves", [(1, 1024), (2, 1024), (3, 7), (4, 5)])
def test_bitmaps(monkeypatch, k, leaves):
    """Counts are right in blocks of any size, also with positions left out."""
    monkeypatch.setattr(L, "LEAVES", leaves)
    rows = rows_of(k, 200)
    want = [sum(set(r) <= set(x) for x in ORDERS.values()) for r in rows.tolist()]
    t = L.trie(rows)
    for bits in (bits_of(), L.squeezed(bits_of(), 10**6)):
        counts, _ = L.count_bitmaps(t, bits)
        assert counts.tolist() == [want[i] for i in t.order]
    assert L.squeezed(bits_of(), 10**6).shape[1] < bits_of().shape[1]


def test_one_and_for_each_candidate():
    """Four items: an AND for each candidate, and one for each distinct prefix; none below an empty one."""
    rows = rows_of(4, 2000)
    t, bits = L.trie(rows), bits_of()
    _, work = L.count_bitmaps(t, bits)
    prefixes = len(np.unique(rows[:, :3], axis=0)) + len(np.unique(rows[:, :2], axis=0))
    assert len(rows) * 0.9 < work <= len(rows) + prefixes
    bits[3] = 0
    _, less = L.count_bitmaps(t, bits)
    assert less < work


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_transactions(k):
    rows = rows_of(k, 200)
    t = L.trie(rows)
    lists = list(ORDERS.values())
    counts, _ = L.count_transactions(t, np.concatenate(lists), np.cumsum([len(x) for x in lists]), 14)
    assert counts.tolist() == [sum(set(rows[i]) <= set(x) for x in lists) for i in t.order]


def test_empty():
    t = L.trie(np.zeros((0, 3), np.int64))
    assert L.count_bitmaps(t, bits_of())[0].tolist() == []
    assert L.count_transactions(t, np.array([1, 2]), np.array([2]), 14)[0].tolist() == []


def test_products():
    bits = bits_of()[:14]
    total = L.pair_products(bits[:5], bits[5:])
    assert total.tolist() == [[sum(a in x and b in x for x in ORDERS.values()) for b in range(5, 14)] for a in range(5)]


def pairs_of(spark):
    return spark.createDataFrame([(o * 1000, i) for o, items in ORDERS.items() for i in items], "order_id long, item long")


@pytest.mark.parametrize("how", [{"counting": "matrix"}, {"counting": "bitmap", "processors": 1}, {"counting": "bitmap", "processors": 3}, {"counting": "containment"}])
def test_miners_over_many_blocks(spark, monkeypatch, how):
    """Several buckets of orders, blocks of candidates, of columns and of pairs, and joins where a trie is too large."""
    monkeypatch.setattr(U, "BLOCK_CANDIDATES", 40)
    monkeypatch.setattr(U, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(C, "PAIR_BLOCK", 3)
    monkeypatch.setattr(U, "TRIE_BYTES", 20_000)
    rows = {(r.k, tuple(r.itemset), r["count"]) for r in M.mine(pairs_of(spark), 0.05, **how).collect()}
    assert rows == {(r.k, tuple(r.itemset), r["count"]) for r in M.mine(pairs_of(spark), 0.05).collect()}
    assert max(k for k, _, _ in rows) >= 4


def test_counters_come_with_the_level(spark):
    work = {}
    M.mine(pairs_of(spark), 0.05, counting="bitmap", processors=1, work=work)
    found = {r.k: r.n for r in M.mine(pairs_of(spark), 0.05).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert {k: w.frequent for k, w in work.items()} == {k: n for k, n in found.items() if k > 1}
    assert work[2].candidates == found[1] * (found[1] - 1) // 2 and all(w.candidates >= w.frequent and w.seconds > 0 for w in work.values())
    assert work[2].intersections >= work[2].candidates


def test_nothing_stays_cached(spark):
    """Also if a run fails in a level."""
    jsc = spark.sparkContext._jsc.sc()
    before = jsc.getPersistentRDDs().size()
    M.mine(pairs_of(spark), 0.2)
    broken = pairs_of(spark).withColumn("item", F.when(F.col("order_id") == 6000, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("item")))
    with pytest.raises(Exception, match="broken"):
        M.mine(broken, 0.2)
    assert jsc.getPersistentRDDs().size() == before


def test_worker_counts(spark):
    cands = C.candidate_pairs(M.frequent_items(pairs_of(spark), 0.05))
    assigned = cands.withColumn("proc_id", F.pmod(F.xxhash64("cand"), F.lit(3)))
    rows = U.worker_counts(assigned, E.tid_bitmaps(pairs_of(spark)), 40, 3).collect()
    assert sum(r.intersections for r in rows) == 91
    assert sum(r.frequent for r in rows) == M.mine(pairs_of(spark), 40 / 300, max_k=2).filter("k = 2").count()
