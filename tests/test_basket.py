"""The five-order demo, cross-checks between the miners, properties and edges."""

import json
import random
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cartloom import schema as S
from cartloom.functions import metrics as R
from cartloom.functions.scalars import memory_gib, parse_run_key
from cartloom.operators import candidates as C
from cartloom.operators import distribute as D
from cartloom.operators import encode as E
from cartloom.operators import rules as A
from cartloom.operators import support as U
from cartloom.operators.running import numbered, running_sums
from cartloom.plans import mine as M
from cartloom.plans.benchmark import run_benchmark
from cartloom.plans.sweeps import run_grid, scalability, timed
from cartloom.sources import basket as B
from cartloom.sources import sinks as K

DEMO = {1: (1, 3, 4, 7), 2: (1, 6), 3: (1, 2, 3, 4), 4: (1, 3), 5: (3, 4, 7)}
FREQUENT = {(1,): 4, (3,): 4, (4,): 3, (7,): 2, (1, 3): 3, (3, 4): 3, (1, 4): 2, (3, 7): 2, (4, 7): 2, (1, 3, 4): 2, (3, 4, 7): 2}


def pairs_of(spark, orders):
    return spark.createDataFrame([(o, i) for o, items in orders.items() for i in items], "order_id long, item long")


def sets(df):
    return {tuple(r["itemset"]): r["count"] for r in df.collect()}


def brute(orders, least, max_k=None):
    items = sorted({i for x in orders.values() for i in x})
    out = {}
    for k in range(1, (max_k or len(items)) + 1):
        new = {c: n for c in combinations(items, k) if (n := sum(set(c) <= set(x) for x in orders.values())) >= least}
        if not new:
            break
        out |= new
    return out


@pytest.fixture(scope="module")
def demo(spark):
    return pairs_of(spark, DEMO).persist()


@pytest.mark.parametrize("how", [{"counting": "extension"}, {"counting": "containment"}, *({"counting": "bitmap", "strategy": s, "processors": 3} for s in D.STRATEGIES)])
def test_demo_itemsets(demo, how):
    assert sets(M.mine(demo, 0.4, **how)) == FREQUENT


def test_thresholds(demo):
    assert set(sets(M.mine(demo, 0.5))) == set(FREQUENT)
    assert set(sets(M.mine(demo, 0.5, "fraction"))) == {(1,), (3,), (4,), (1, 3), (3, 4)}
    assert sets(M.mine_fpgrowth(demo, 0.5)) == sets(M.mine(demo, 0.5, "fraction"))
    assert sets(M.mine_fpgrowth(demo, 0.5, "floor")) == FREQUENT
    assert [U.min_count(0.29, 100), U.min_count(0.001, 10), U.min_count(0.001, 10, strict=True), U.min_count(0.5, 5, "fraction")] == [28, 1, 0, 3]
    with pytest.raises(ValueError):
        U.min_count(0.1, 5, "ceiling")


def test_presets_and_depth(demo):
    assert sets(M.mine_preset(demo, "ye", 0.4)) == FREQUENT
    assert max(map(len, sets(M.mine(demo, 0.4, max_k=1)))) == 1
    with pytest.raises(ValueError):
        M.mine(demo, 0.4, strategy="XX")
    with pytest.raises(ValueError):
        M.mine(demo, 0.4, counting="guess")


def test_strict_floor_keeps_candidates_without_orders(spark):
    got = sets(M.mine(pairs_of(spark, {1: (1,), 2: (2,)}), 0.1, counting="bitmap", strict=True))
    assert got == {(1,): 1, (2,): 1, (1, 2): 0}


def test_weights_and_distributions(spark, demo):
    counts = demo.groupBy("item").count().filter("count >= 2")
    f1 = M.frequent_items(demo, 0.4)
    rows = D.weighted(D.indexed(C.candidate_pairs(f1), counts), counts).persist()
    assert [(tuple(r.cand), r.weight) for r in rows.orderBy("idx").collect()] == [((1, 3), 16), ((1, 4), 12), ((1, 7), 8), ((3, 4), 12), ((3, 7), 8), ((4, 7), 6)]
    want = {
        "BL": [[(1, 3), (1, 4)], [(1, 7), (3, 4)], [(3, 7), (4, 7)]],
        "CL": [[(1, 3), (3, 4)], [(1, 4), (3, 7)], [(1, 7), (4, 7)]],
        "BWT": [[(1, 3), (1, 4)], [(1, 7), (3, 4), (3, 7)], [(4, 7)]],
        "CWT": [[(1, 3), (1, 7)], [(1, 4), (3, 7)], [(3, 4), (4, 7)]],
    }
    for name, parts in want.items():
        got = [[], [], []]
        for r in D.distribute(rows, name, 3).collect():
            got[r.proc_id].append(tuple(r.cand))
        assert [sorted(x) for x in got] == parts, name
    assert {r.proc_id for r in D.distribute(rows, "BL", 10).collect()} == {9}
    assert {r.candidates for r in D.processor_load(spark, D.distribute(rows, "BL", 10), 10).collect()} == {0, 6}
    in_place = D.placed(D.distribute(rows, "CL", 3), 3).select((F.spark_partition_id() == F.col("proc_id")).alias("x"))
    assert all(r.x for r in in_place.collect())
    assert D.chunked(rows, 4, 6).agg(F.countDistinct("chunk")).first()[0] == 6
    assert D.ceil_chunked(rows, 4, 6).agg(F.countDistinct("chunk")).first()[0] == 3


def test_rules(demo):
    sets_ = M.mine(demo, 0.4).persist()
    rules = A.association_rules(sets_, least=0.0)
    assert rules.count() == 22
    kept = A.association_rules(sets_)
    assert kept.count() == 16
    best = A.top_rules(kept, 1).first()
    assert (list(best.antecedent), list(best.consequent), round(best.lift, 6)) == ([3, 4], [7], 1.666667)
    with pytest.raises(ValueError):
        A.association_rules(sets_, "leverage")


def test_support_of_given_itemsets(spark, demo):
    cands = spark.createDataFrame([([1, 3, 4],), ([1, 7],), ([3, 4, 7],), ([6, 7],), ([99],), ([1, 99],)], "cand array<long>")
    want = {(1, 3, 4): 2, (1, 7): 1, (3, 4, 7): 2, (6, 7): 0, (99,): 0, (1, 99): 0}
    for got in (U.array_support(cands, E.tid_lists(demo)), U.bitmap_support(cands, E.tid_bitmaps(demo)), U.containment_support(cands, E.transactions(demo))):
        assert {tuple(r.cand): r["count"] for r in got.collect()} == want
    empty = spark.createDataFrame([([],)], "cand array<long>")
    assert U.array_support(empty, E.tid_lists(demo)).first()["count"] == 0


def test_prune(spark):
    f2 = spark.createDataFrame([([1, 2],), ([1, 3],), ([2, 3],), ([1, 4],)], "itemset array<long>")
    assert sorted(tuple(r.cand) for r in C.candidate_join(f2, 3).collect()) == [(1, 2, 3), (1, 2, 4), (1, 3, 4)]
    assert [tuple(r.cand) for r in C.next_candidates(f2, 3).collect()] == [(1, 2, 3)]
    assert C.lattice_size(5) == 10


orders = st.dictionaries(st.integers(1, 8), st.lists(st.integers(1, 5), min_size=1, max_size=6), min_size=1, max_size=8)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(orders, st.sampled_from([0.2, 0.34, 0.5, 1.0]))
def test_miners_equal_brute_force(spark, x, support):
    rows = pairs_of(spark, x)
    want = brute(x, max(1, int(support * len(x))))
    for counting in ("extension", "bitmap"):
        got = sets(M.mine(rows, support, counting=counting))
        assert got == want
        assert all(got[s] >= n for c, n in got.items() for s in combinations(c, len(c) - 1) if s)
    assert set(sets(M.mine(rows, support, "fraction"))) <= set(want)


def test_edges(spark):
    none = spark.createDataFrame([], "order_id long, item long")
    assert M.mine(none, 0.5).count() == 0
    assert sets(M.mine(pairs_of(spark, {1: (5,)}), 1.0)) == {(5,): 1}
    assert sets(M.mine(pairs_of(spark, {1: (1, 1, 2), 2: (1, 2, 2)}), 1.0)) == {(1,): 2, (2,): 2, (1, 2): 2}
    nulls = spark.createDataFrame([(1, None), (None, 2), (1, 3)], "order_id long, item long")
    assert [tuple(r) for r in B.distinct_pairs(nulls, item_col="item").collect()] == [(1, 3)]
    assert E.matrix_density(none).first().density == 0.0


def test_samples_and_top_items(spark):
    orders_ = spark.createDataFrame([(i, i) for i in range(100)], S.ORDERS)
    a = {r.order_id for r in B.sample_orders(orders_, 10).collect()}
    assert len(a) == 10 and a == {r.order_id for r in B.sample_orders(orders_.repartition(7), 10).collect()}
    assert B.sample_orders(orders_, 1000).count() == 100
    rows = spark.createDataFrame([("b",), ("a",), ("a",), ("c",), (None,)], "product_name string")
    assert [r.product_name for r in B.top_items(rows, 2).collect()] == ["a", "b"]
    assert B.keep_top_items(rows, None).count() == 5 and B.keep_top_items(rows, 2).count() == 3


def test_early_stop(spark):
    rows = spark.createDataFrame([(i,) for i in range(100)], "i long")
    even = F.col("i") % 2 == 0
    assert B.early_stop_scan(rows, ["i"], even, 10, None).count() == 50
    assert sorted(r.i for r in B.early_stop_scan(rows, ["i"], even, 10, 4).collect()) == list(range(0, 20, 2))
    assert sorted(r.i for r in B.early_stop_scan(rows, ["i"], even, 10, 5).collect()) == list(range(0, 20, 2))  # the last row of a chunk
    assert B.early_stop_scan(rows, ["i"], even, 10, 0).count() == 0 and B.early_stop_scan(rows, ["i"], even, 10, 26).count() == 50
    pairs = spark.createDataFrame([(i % 7 if i % 7 else None, i) for i in range(60)], "a long, i long")
    by_hand = sorted(((r.a, r.i) for r in pairs.collect()), key=lambda x: (x[0] is not None, x))
    for n in (1, 4, 9):
        kept = [i for i, x in enumerate(by_hand) if x[1] % 2 == 0]
        end = (kept[2 * n - 1] // 8 + 1) * 8
        assert sorted((r.a or 0, r.i) for r in B.early_stop_scan(pairs, ["a", "i"], even, 8, n).collect()) == sorted((by_hand[i][0] or 0, by_hand[i][1]) for i in kept if i < end)


def test_statistics(spark, demo):
    s = E.tid_statistics(demo).first()
    assert (s["items"], s.min_len, s.max_len, s.median_len) == (6, 1, 4, 2.5)
    assert {r["item"]: r["support"] for r in E.singleton_support(demo).collect()}[7] == 0.4
    m = E.basket_matrix(demo, [1, 3, 9]).orderBy("order_id").collect()
    assert [tuple(r)[1:] for r in m] == [(1, 1, 0), (1, 0, 0), (1, 1, 0), (1, 1, 0), (0, 1, 0)]


def test_scalars(spark):
    a, b = parse_run_key(F.col("k"))
    rows = spark.createDataFrame([("wdpa_CWT_8p",), ("wdpa_BL",), ("1.5 GiB",), ("512 MiB",)], "k string")
    got = [tuple(r) for r in rows.select(a.alias("a"), b.alias("b"), memory_gib(F.col("k")).alias("g")).collect()]
    assert got == [("CWT", 8, None), (None, None, None), (None, None, 1.5), (None, None, 0.5)]


def test_csv_config_sinks_and_cache(spark, tmp_path):
    (tmp_path / "products.csv").write_text("product_id,product_name\n1,x\n2,y\n")
    assert B.read_csv(spark, str(tmp_path / "products.csv"), S.PRODUCTS).count() == 2
    (tmp_path / "config.json").write_text('{"sample_size": 5, "min_supports": [0.5], "_comment": 1}')
    config = B.load_config(spark, str(tmp_path / "config.json"))
    assert (config.sample_size, config.min_supports, config.max_k) == (5, (0.5,), 5)
    results = spark.createDataFrame([(0.1, 3, 2), (0.2, 1, 0)], "min_support double, frequent_itemsets_count long, rules_count long")
    path = K.write_analysis(results, str(tmp_path), "t")
    assert spark.read.json(path).count() == 2
    K.write_by_support(results, str(tmp_path / "by"))
    K.write_summary(results, str(tmp_path / "sum"))
    K.append_json(results, str(tmp_path / "log"))
    K.append_json(results, str(tmp_path / "log"))
    kind = "min_support double, frequent_itemsets_count long, rules_count long"
    assert K.read_appended(spark, str(tmp_path / "log"), kind).count() == 4
    assert K.next_run_folder(spark, str(tmp_path), 150_000).endswith("benchmark_150k_001")
    key = K.index_key(spark, 1, 2, 3, "abc")
    made = []
    build = lambda: made.append(1) or E.tid_lists(pairs_of(spark, DEMO))
    for _ in range(2):
        assert K.cached_index(spark, str(tmp_path), key, build).count() == 6
    assert len(key) == 8 and len(made) == 1
    assert B.latest_file(spark, str(tmp_path / "*.json")).count() == 1
    assert B.run_folders(spark, str(tmp_path / "by/*/*.json")).count() == 2


def test_grid_and_timeout(spark, demo):
    got = run_grid(spark, demo, [0.4], ["CL", "CWT"], [2]).collect()
    assert [r.itemsets for r in got] == [11, 11] and {r.status for r in got} == {"success"}
    assert timed(spark, lambda: 1 // 0)[0].startswith("error")

    def slow():
        return spark.range(1 << 42).filter("sha2(cast(id as string), 256) = 'a'").count()

    status, seconds, _ = timed(spark, slow, 2)
    assert status == "timeout" and seconds < 60


def test_detailed_report(spark, tmp_path):
    lines = R.detailed_report(R.published_runs(spark), R.published_levels(spark), list(R.PROCESSORS))
    got = [r.value for r in lines.orderBy("n").collect()]
    assert len(got) == 7 + 4 * 20 + 20 + 4 + 5
    assert got[0].startswith("Computation time") and any("13.38" in x and "3.96" in x for x in got)
    K.write_report(lines, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == got


def test_scalability(spark):
    got = scalability(spark, "/root/testdata/sf0.001", [(300, 10)], [0.1, 0.2])
    assert [r["status"] for r in got] == ["success", "success"] and got[0]["itemsets"] >= got[1]["itemsets"]


def test_nested_config(spark, tmp_path):
    document = {
        "description": "x", "dataset": {"sample_size": 77, "max_items": 5, "chunk_size": 9, "random_seed": 3, "_comment": "y"},
        "algorithms": {"traditional": {"enabled": False, "name": "t", "method": "m"}, "wdpa": {"enabled": True, "strategies": ["BL", "CWT"], "num_processors": [1, 2], "max_k": 4}, "naive_parallel": {"enabled": True, "num_workers": 8, "timeout": 60, "_warning": "z"}},
        "mining_parameters": {"support_thresholds": [0.3], "min_confidence": 0.6, "min_lift": 1.2}, "output": {"results_directory": "r", "save_individual_results": True},
    }
    (tmp_path / "c.json").write_text(json.dumps(document))
    c = B.load_config(spark, str(tmp_path / "c.json"))
    assert (c.sample_size, c.max_items, c.chunk_size, c.seed, c.min_supports, c.min_confidence, c.min_lift, c.results_directory) == (77, 5, 9, 3, (0.3,), 0.6, 1.2, "r")
    assert c.algorithms[1:] == (S.Algorithm("wdpa", True, ("BL", "CWT"), (1, 2), 4), S.Algorithm("naive_parallel", True, (), (8,), None, 60)) and not c.algorithms[0].enabled
    for section, key in (("dataset", "size"), ("algorithms", "other"), ("mining_parameters", "support")):
        with pytest.raises(ValueError, match=key):
            B.parse_config(document | {section: document[section] | {key: {}}})
    with pytest.raises(ValueError, match="extra"):
        B.parse_config(document | {"extra": 1})


def test_benchmark_run(spark, demo, tmp_path):
    wdpa = S.Algorithm("wdpa", True, ("BL",), (2, 1, 4), 5)
    config = S.MiningConfig(min_supports=(0.4,), algorithms=(S.Algorithm("traditional", True), S.Algorithm("naive_parallel", True, (), (3,)), wdpa, S.Algorithm("ye_parallel", True, (), (1, 2), 5)))
    got = run_benchmark(spark, demo, config)
    rows = got.collect()
    assert [(r.algorithm, r.processors, r.status, r.baseline) for r in rows] == [
        ("traditional", 1, "success", None), ("naive_parallel", 3, "success", "traditional"), ("wdpa", 2, "success", "traditional"), ("wdpa", 1, "success", "wdpa BL 1p"),
        ("wdpa", 4, "success", "wdpa BL 1p"), ("ye_parallel", 1, "success", "traditional"), ("ye_parallel", 2, "success", "traditional"),
    ]
    assert [r.itemsets for r in rows[2:]] == [11] * 5 and all(0 < r.computation_time < r.total_time for r in rows[2:5])
    assert rows[4].speedup == pytest.approx(rows[3].computation_time / rows[4].computation_time) and rows[4].efficiency == pytest.approx(rows[4].speedup / 4)
    assert R.overhead(got.filter("algorithm = 'wdpa'")).filter("overhead_pct > 0").count() == 3
    off = run_benchmark(spark, demo, S.MiningConfig(min_supports=(0.4,), algorithms=(S.Algorithm("wdpa"), S.Algorithm("ye_parallel", True, (), (2,), 5))))
    assert [(r.algorithm, r.baseline) for r in off.collect()] == [("ye_parallel", None)]
    K.write_benchmark(got, config, 5, 6, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/benchmark_results.json")).count() == 7
    assert json.loads(spark.read.json(str(tmp_path / "run/metadata.json")).first().config)["min_supports"] == [0.4]
    K.write_scalability(spark, [{"sample_size": 3, "max_items": 2, "min_support": 0.1, "itemsets": 4, "seconds": 0.5, "status": "success"}], str(tmp_path / "scal"))
    assert spark.read.json(str(tmp_path / "scal")).first().itemsets == 4
    assert B.read_results(spark, str(tmp_path / "run/benchmark_results.json/*.json")).count() == 7


def test_benchmark_runs_every_miner_at_any_size(spark):
    # a byte for each cell would take 10.1 GiB, the pair table more; the items -2 and -1 are in every order
    wide = spark.range(104_000).selectExpr("id order_id", "explode(array(-2L, -1L, id)) item")
    config = S.MiningConfig(min_supports=(0.4,), algorithms=(S.Algorithm("traditional", True), S.Algorithm("naive_parallel", True, (), (2,)), S.Algorithm("ye_parallel", True, (), (2,), 5)))
    got = [(r.algorithm, r.status, r.itemsets, r.baseline) for r in run_benchmark(spark, wide, config).collect()]
    assert got == [("traditional", "success", 3, None), ("naive_parallel", "success", 3, "traditional"), ("ye_parallel", "success", 3, "traditional")]


def test_results_of_any_layout(spark, tmp_path):
    row = {"support": 0.1, "algorithm": "wdpa", "strategy": "BL }\n{ x", "processors": 2, "total_time": 1.5, "status": "success", "more": [1]}
    (tmp_path / "pretty.json").write_text(json.dumps(row, indent=2))
    (tmp_path / "array.json").write_text("\n " + json.dumps([row, row], indent=1))
    (tmp_path / "rows.json").write_text("\n".join([json.dumps(row), '{"support": "much"}', json.dumps(row), '{"support": 0.1', ""]))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "broken.json").write_text('[{"support": 0.1}, {"supp')
    got = B.read_results(spark, str(tmp_path / "*.json"), str(tmp_path / "absent"), str(tmp_path / "absent*"))
    assert sorted(r.source_file.rsplit("/", 1)[1] for r in got.collect()) == ["array.json", "array.json", "pretty.json", "rows.json", "rows.json"]
    assert {(r.strategy, r.processors, r.itemsets) for r in got.collect()} == {("BL }\n{ x", 2, None)}
    assert B.read_results(spark, str(tmp_path / "absent")).columns == got.columns
    assert B.read_results(spark, str(tmp_path / "absent")).count() == 0


def test_difference_join(spark):
    frequent = spark.createDataFrame([([1, 2],), ([1, 3],), ([2, 3],), ([3, 4],)], "itemset array<long>")
    got = {tuple(r.cand) for r in C.difference_join(frequent, 3).collect()}
    assert got == {(1, 2, 3), (1, 3, 4), (2, 3, 4)} and C.difference_join(frequent, 3).count() == 3
    pruned = lambda x: {tuple(r.cand) for r in C.prune(x, frequent, 3).collect()}
    assert pruned(C.difference_join(frequent, 3)) == pruned(C.candidate_join(frequent, 3)) == {(1, 2, 3)}


def test_scaling_summary_and_preview(spark):
    runs = spark.createDataFrame([(0.1, "wdpa", "CWT", 2, 120.0, 1.0, 5, "success"), (0.1, "wdpa", "CWT", 8, 60.0, 1.0, 5, "success"), (0.1, "wdpa", "CWT", 1, 1.0, 1.0, 0, "timeout")], S.RUNS)
    lines = [r.value for r in R.scaling_summary(runs).orderBy("n").collect()]
    assert len(lines) == 5 and lines[2].split() == ["2", "2.00", "1.00x", "50.0%"] and lines[3].split() == ["8", "1.00", "2.00x", "25.0%"] and lines[4] == "fastest: 8 processors, 1.00 minutes, 2.00x"
    assert K.preview(spark.createDataFrame([([1, 2], 0.5), ([3], 1.0)], "itemset array<int>, support double"), 1) == "itemset  support\n1, 2     0.5"


def test_running_sums_and_numbers_over_partitions(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 101).alias("w")).repartition(7)
    got = running_sums(rows, [F.desc("w"), F.asc("id")], {"before": F.col("w"), "r": F.lit(1)}).collect()
    total = 0
    for i, r in enumerate(sorted(got, key=lambda r: (-r.w, r.id))):
        assert (r.r, r.before) == (i, total)
        total += r.w
    assert [r.n for r in numbered(rows, [F.col("id")], "n").orderBy("id").collect()] == list(range(1000))
    assert [r.n for r in numbered(rows, [F.col("id")], "n", 1000).orderBy("id").collect()] == list(range(1000))


def test_block_by_weight_equals_a_fold(spark):
    rng = random.Random(3)
    for p, weights in ((3, [rng.randrange(50) for _ in range(60)]), (5, [0] * 7), (4, [100, 1, 1]), (6, [])):
        rows = spark.createDataFrame([(i, [i], w) for i, w in enumerate(weights)], "idx long, cand array<long>, weight long")
        used, proc, want = 0, 0, {}
        for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
            want[i] = proc
            used += weights[i]
            if used >= sum(weights) / p and proc < p - 1:
                used, proc = 0, proc + 1
        assert {r.idx: r.proc_id for r in D.block_by_weight(rows, p).collect()} == want


def test_placed_support(spark, demo):
    cands = spark.createDataFrame([(0, [1, 3], 0), (1, [3, 4], 1), (2, [1, 6], 0), (3, [6, 7], 1), (4, [1, 99], 1)], "idx long, cand array<long>, proc_id long")
    got = {tuple(r.cand): r["count"] for r in U.placed_support(cands, E.tid_bitmaps(demo)).collect()}
    assert got == {(1, 3): 3, (3, 4): 3, (1, 6): 1, (6, 7): 0, (1, 99): 0}


def test_rules_of_large_itemsets(spark):
    """No size raises; a split whose sides aren't known is no rule, those that are known are found."""
    whole = list(range(21))
    sets = [(21, whole, 0.5)]
    kind = "k int, itemset array<long>, support double"
    assert A.association_rules(spark.createDataFrame(sets, kind)).count() == 0
    sets += [(20, whole[1:], 0.5), (1, [0], 0.8)]
    rules = A.association_rules(spark.createDataFrame(sets, kind)).collect()
    assert [(list(r.antecedent), list(r.consequent), r.confidence, r.lift) for r in rules] == [(whole[1:], [0], 1.0, 1.25)]


def test_one_hot_rows_take_one_aggregate(spark):
    """No pairs are grouped on the way to the matrix; repeated rows, more items than a long has bits, unknown and null ones."""
    rows = [(o, i) for o in range(1, 9) for i in range(1, 140) if (o * i) % 7 < 2] * 2 + [(9, 500), (10, None)]
    wide = E.basket_matrix(spark.createDataFrame(rows, "order_id long, item long"), list(range(1, 140)))
    want = {o: [int((o, i) in set(rows)) for i in range(1, 140)] for o in range(1, 11)}
    assert {r[0]: list(r[1:]) for r in wide.collect()} == want
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_fpgrowth_groups_orders_once(spark, demo, tmp_path):
    """Its itemsets are a table: reading them doesn't group the orders again, and repeated rows count once."""
    found = M.mine_fpgrowth(demo.unionByName(demo), 0.5, "floor")
    assert sets(found) == FREQUENT
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "RDD" not in plan


def test_runs_share_held_orders(spark, demo):
    """Pairs held by order are the distinct ones, orders of nulls stay, and miners group them without a shuffle; the density makes no copies of rows."""
    rows = demo.unionByName(demo).unionByName(spark.createDataFrame([(99, None)], demo.schema))
    whole, pairs = E.held_orders(rows)
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in rows.collect()} and pairs.count() == rows.distinct().count()
    assert "Exchange" not in E.transactions(pairs)._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0].split("InMemoryRelation")[0]
    whole.unpersist()
    density = E.matrix_density(demo)
    assert "Expand" not in density._jdf.queryExecution().optimizedPlan().toString()
    got, pairs = density.first(), {tuple(r) for r in demo.collect()}
    assert (got.orders, got["items"], got.ones) == (len({o for o, _ in pairs}), len({i for _, i in pairs}), len(pairs))
    assert E.matrix_density(demo.limit(0)).first().ones == 0
