"""Ranks by refined histograms, rules of large itemsets, appends that survive a retry, and the bucketed index."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cartloom.functions.scalars import memory_gib
from cartloom.operators import encode as E
from cartloom.operators import ranks as K
from cartloom.operators import rules as A
from cartloom.sources import basket as B
from cartloom.sources import sinks as S


@pytest.mark.parametrize("values", [[5], [1, 1, 1, 2], [-(2**62), 0, 2**62, 7], list(range(-500, 500)), [random.Random(1).randint(0, 10**12) for _ in range(997)]])
def test_ranks(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    at = sorted({0, len(values) // 2, len(values) - 1})
    assert K.ranked_values(rows, at) == [sorted(values)[r] for r in at]
    ordered, n = sorted(values), len(values)
    assert K.median(rows) == (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def test_ranks_of_nothing(spark):
    rows = spark.createDataFrame([], "v long")
    assert K.median(rows) is None
    with pytest.raises(ValueError):
        K.ranked_values(rows, [0])
    empty = E.tid_statistics(spark.createDataFrame([], "order_id long, item long")).first()
    assert (empty["items"], empty["median_len"]) == (0, None)


@pytest.mark.parametrize("few", [10_000, 3])
@pytest.mark.parametrize("n", [0, 1, 17, 500, 999, 1000, 2000])
def test_sample_is_the_least_hashes(spark, monkeypatch, n, few):
    monkeypatch.setattr(K, "FEW", few)
    orders = spark.range(1000).withColumnRenamed("id", "order_id")
    want = {r.order_id for r in orders.orderBy(B.hash_order("order_id", 42), "order_id").limit(n).collect()}
    assert {r.order_id for r in B.sample_orders(orders, n).collect()} == want and len(want) == min(n, 1000)


def test_samples_are_nested(spark):
    orders = spark.range(3000).withColumnRenamed("id", "order_id")
    small, large = ({r.order_id for r in B.sample_orders(orders, n).collect()} for n in (200, 900))
    assert small < large


def rule_set(rows):
    return {(tuple(r.antecedent), tuple(r.consequent), round(r.confidence, 9), round(r.lift, 9)) for r in rows.collect()}


@pytest.mark.parametrize("metric, least, floor", [("lift", 0.0, 0.0), ("lift", 1.1, 0.4), ("confidence", 0.7, 0.0), ("support", 0.1, 0.5)])
def test_grown_rules_equal_all_splits(spark, monkeypatch, metric, least, floor):
    rng = random.Random(3)
    orders = [set(rng.sample(range(7), rng.randint(3, 7))) for _ in range(80)]
    sets = []
    for k in range(1, 6):
        sets += [(k, list(c), sum(set(c) <= o for o in orders) / 80) for c in combinations(range(7), k) if any(set(c) <= o for o in orders)]
    rows = spark.createDataFrame(sets, "k int, itemset array<long>, support double").persist()
    want = rule_set(A.association_rules(rows, metric, least, floor))
    monkeypatch.setattr(A, "SPLIT_ITEMS", 1)
    assert rule_set(A.association_rules(rows, metric, least, floor)) == want and want


def test_rules_of_25_items(spark):
    """33 million splits, of which few can be rules: consequents with item 0 alone reach a confidence of 0.9."""
    whole = list(range(25))
    sets = [(25, whole, 0.5)] + [(1, [i], 0.6) for i in whole]
    for i in whole:  # without i
        sets.append((24, [x for x in whole if x != i], 0.52 if i < 3 else 0.7))
    for a, b in combinations(whole, 2):
        sets.append((23, [x for x in whole if x not in (a, b)], 0.54 if b < 3 else 0.8))
    sets.append((22, whole[3:], 0.9))
    sets += [(2, list(c), 0.55) for c in combinations(range(3), 2)] + [(3, [0, 1, 2], 0.52)]
    rows = spark.createDataFrame(sets, "k int, itemset array<long>, support double")
    found = [r for r in A.association_rules(rows, "confidence", 0.9).collect() if len(r.antecedent) + len(r.consequent) == 25]
    assert {tuple(r.consequent) for r in found} == {(0,), (1,), (2,), (0, 1), (0, 2), (1, 2)}
    assert all(r.confidence >= 0.9 and sorted(r.antecedent + r.consequent) == whole for r in found)


def test_append_survives_a_retry(spark, tmp_path):
    rows, folder, kind = spark.range(3).withColumn("x", F.lit("a")), str(tmp_path / "log"), "id long, x string"
    S.append_json(rows, folder, "first")
    S.append_json(rows, folder, "first")  # tried again after an answer was lost
    broken = rows.withColumn("x", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        S.append_json(broken, folder, "second")
    assert S.read_appended(spark, folder, kind).count() == 3 and len(S.committed_runs(spark, folder)) == 1
    S.append_json(rows, folder, "second")
    S.append_json(rows, folder)
    assert S.read_appended(spark, folder, kind).count() == 9
    # rows that were written but not committed aren't read
    rows.write.json(f"{folder}/runs/run=third")
    assert S.read_appended(spark, folder, kind).count() == 9
    assert S.read_appended(spark, str(tmp_path / "none"), kind).count() == 0


def test_changed_data_miss_the_cache(spark, tmp_path):
    one = spark.createDataFrame([(1, 2), (1, 3)], "order_id long, item long")
    same = spark.createDataFrame([(1, 3), (1, 2)], "order_id long, item long").repartition(2)
    others = [one.union(one), one.filter("item = 2"), one.withColumn("item", F.col("item") + 1)]
    key = lambda rows: S.index_key(spark, None, None, 42, rows)
    assert key(one) == key(same) and len({key(x) for x in (one, *others)}) == 4
    made = []
    build = lambda rows: lambda: made.append(1) or E.tid_lists(rows)
    for rows in (one, same, others[1], one):
        assert S.cached_index(spark, str(tmp_path), key(rows), build(rows)).count() == rows.select("item").distinct().count()
    assert len(made) == 2


def test_index_joins_without_an_exchange(spark, tmp_path):
    pairs = spark.range(2000).select(F.col("id").alias("order_id"), (F.col("id") % 37).alias("item"))
    index = S.cached_index(spark, str(tmp_path), S.index_key(spark, None, None, 42, pairs), lambda: E.tid_lists(pairs))
    asked = spark.range(30).select(F.col("id").alias("item")).hint("merge")
    plan = asked.join(index, "item")._jdf.queryExecution().executedPlan().toString()
    side = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(side) == 1 and "Bucketed: true" in plan, plan
    assert asked.join(index, "item").count() == 30


def test_memory_messages(spark):
    said = {"needs (12.5 GiB)": 12.5, "size=3 MiB": 3 / 1024, "1.5GB.": 1.5, "[512 mb]": 0.5, "no size of 12": None, "GiB 3": None, "": None, None: None, "12 of 7,5 GiB": 5.0}
    rows = spark.createDataFrame([(k,) for k in said], "k string")
    assert {r.k: r.g for r in rows.select("k", memory_gib(F.col("k")).alias("g")).collect()} == said
