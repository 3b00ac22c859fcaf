"""Queries whose rows go through a sink or a sweep and come back, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom import catalog as Q
from cartloom import schema as T
from cartloom.catalog import query
from cartloom.functions import metrics as R
from cartloom.operators import candidates as C
from cartloom.operators import encode as E
from cartloom.operators import rules as A
from cartloom.plans import mine as M
from cartloom.plans import sweeps
from cartloom.plans.benchmark import run_benchmark
from cartloom.plans.nested import nested_scalability
from cartloom.sources import basket as B
from cartloom.sources import sinks as K
from cartloom.sources.shared import scratch

TYPE_PAIRS = Q.mine_sql("p_type", 0.1, 6)
NAMES = Q.mine_sql("p_name", 0.003, 1)


def _types(spark: SparkSession, sf: str) -> DataFrame:
    return Q.frequent_itemsets_type_rows(spark, sf)


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return Q._text(M.frequent_items(B.item_pairs(spark, sf, "p_name"), 0.003))


def _read_itemsets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("k int, itemset string, count long, support double").json(path)


# Scans ----------------------------------------------------------------------------------------------
@query(f"WITH {Q.BASKET} SELECT * FROM basket")
def csv_scans(spark, sf):
    """Orders, lines and products from CSV files with headers."""

    def through_csv(df, name, kind):
        path = scratch(spark, f"csv-{name}")
        df.select(kind.names).write.option("header", True).csv(path)
        return B.read_csv(spark, path, kind)

    orders, lines, products = B.tpch_tables(spark, sf)
    return B.build_basket(through_csv(orders, "orders", T.ORDERS), through_csv(lines, "lines", T.ORDER_LINES), through_csv(products, "products", T.PRODUCTS))


@query(
    f"SELECT f.kind, support, algorithm, strategy, processors::INT processors, total_time, computation_time::DOUBLE computation_time, itemsets::BIGINT itemsets, status FROM {Q.TRIED_SQL}, (SELECT unnest(['array', 'rows']) kind) f"
)
def results_scan(spark, sf):
    """Runs from a file of rows and from a file that is an array; a further file isn't there."""
    runs, root = Q._tried(spark, sf), scratch(spark, "results")
    runs.coalesce(1).write.json(f"{root}/rows")
    runs.agg(F.to_json(F.collect_list(F.struct(*runs.columns))).alias("value")).coalesce(1).write.text(f"{root}/array")
    found = B.read_results(spark, f"{root}/rows", f"{root}/array", f"{root}/none")
    return found.select(F.regexp_extract("source_file", "/(rows|array)/[^/]*$", 1).alias("kind"), *runs.columns)


@query(f"SELECT folder, n, latest FROM (VALUES ('benchmark_150k_001', false), ('benchmark_150k_002', true)) t(folder, latest), (SELECT count(*) n FROM {Q.TRIED_SQL})")
def run_folders(spark, sf):
    """Two runs in numbered folders: which there are, and which is the latest."""
    root = scratch(spark, "runs")
    for _ in range(2):
        Q._tried(spark, sf).coalesce(1).write.json(K.next_run_folder(spark, root, 150_000))
    name = lambda c: F.regexp_extract(c, r"([^/]+)/?$", 1)
    files = f"{root}/*/part-*.json"
    latest = B.latest_file(spark, files).select(name(F.regexp_replace("path", "/[^/]*$", "")).alias("folder"), F.lit(True).alias("latest"))
    rows = B.read_results(spark, f"{root}/*").groupBy(F.regexp_extract("source_file", "([^/]+)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("n"))
    folders = B.run_folders(spark, files).select(name(F.col("folder")).alias("folder"))
    return folders.join(rows, "folder", "left").join(latest, "folder", "left").select("folder", "n", F.coalesce("latest", F.lit(False)).alias("latest"))


# Sinks ----------------------------------------------------------------------------------------------
@query(TYPE_PAIRS)
def analysis_json(spark, sf):
    path = K.write_analysis(Q._text(_types(spark, sf)), scratch(spark, "analysis"), "types")
    return _read_itemsets(spark, path)


@query(f"SELECT 0.1::DOUBLE min_support, * FROM ({TYPE_PAIRS}) UNION ALL SELECT 0.2::DOUBLE, * FROM ({Q.mine_sql('p_type', 0.2, 6)})")
def support_folders(spark, sf):
    """Itemsets in a folder for each support."""
    folder = scratch(spark, "supports")
    K.write_by_support(Q._text(M.support_sweep(Q._type_rows(spark, sf), [0.1, 0.2], max_k=None)), folder)
    found = spark.read.schema("k int, itemset string, count long, support double, min_support double").json(folder)
    return found.select("min_support", "k", "itemset", "count", "support")


@query(f"SELECT 0.1::DOUBLE min_support, count(*) frequent_itemsets_count, sum((1::BIGINT << k) - 2)::BIGINT rules_count FROM ({TYPE_PAIRS})")
def summary_json(spark, sf):
    """Numbers of itemsets and of all their rules."""
    itemsets, folder = _types(spark, sf), scratch(spark, "summary")
    rules = A.association_rules(itemsets, "lift", 0.0).agg(F.count("*").alias("rules_count"))
    counts = itemsets.agg(F.count("*").alias("frequent_itemsets_count"))
    K.write_summary(counts.crossJoin(rules).withColumn("min_support", F.lit(0.1)), folder)  # a row on each side
    return spark.read.schema("min_support double, frequent_itemsets_count long, rules_count long").json(folder)


@query(f"SELECT * FROM ({NAMES}) UNION ALL SELECT * FROM ({NAMES})")
def appended_json(spark, sf):
    """The same results appended twice."""
    folder = scratch(spark, "experiments")
    for _ in range(2):
        K.append_json(_names(spark, sf), folder)
    return K.read_appended(spark, folder, "k int, itemset string, count long, support double")


@query(f"SELECT itemset || ': ' || count AS value FROM ({NAMES}) UNION ALL SELECT 'done'")
def appended_log(spark, sf):
    folder = scratch(spark, "log")
    K.append_log(_names(spark, sf).select(F.concat("itemset", F.lit(": "), "count")), folder)
    K.append_log(spark.createDataFrame([("done",)], "line string"), folder)
    return K.read_appended(spark, folder, "value string")


@query(f"""WITH {Q.BASED} SELECT printf('%8.4f', support) || '  ' || rpad(strategy, 5, ' ') || printf('%4d', processors) || printf('%10.2f', computation_time) || printf('%8.2f', base / computation_time) AS value FROM based""")
def text_report(spark, sf):
    folder = scratch(spark, "report")
    K.write_report(R.report_lines(Q._runs(spark, sf)), folder)
    return spark.read.text(folder)


@query(f"WITH {Q.pairs_sql('p_type')} SELECT i item, string_agg(o::VARCHAR, ',' ORDER BY o) tids FROM pairs GROUP BY 1")
def cached_index(spark, sf):
    """The vertical index, built for the first call and found by the second."""
    root, pairs = scratch(spark, "indexes"), Q._type_pairs(spark, sf)
    key = K.index_key(spark, None, None, Q.SEED, pairs)
    K.cached_index(spark, root, key, lambda: E.tid_lists(pairs))

    def absent() -> DataFrame:
        raise RuntimeError("the index was not saved")

    return Q._text(K.cached_index(spark, root, key, absent), "tids", "tids")


# Candidates by set difference -----------------------------------------------------------------------
@query(f"""WITH {Q.pairs_sql('p_brand')}, {Q.F2}, unions AS (SELECT list_sort(list_distinct([a.i1, a.i2, b.i1, b.i2])) x FROM f2 a JOIN f2 b ON a.i1 < b.i1 OR (a.i1 = b.i1 AND a.i2 < b.i2))
SELECT DISTINCT array_to_string(x, ',') itemset FROM unions WHERE len(x) = 3""")
def difference_join(spark, sf):
    return Q._text(C.difference_join(Q._brand_f2(spark, sf), 3), "cand")


# Sweeps and the benchmark ---------------------------------------------------------------------------
def _found(threshold: str, most: int) -> str:
    return f"(SELECT count(*) FROM ({Q.mine_sql('p_type', 0.1, most, threshold)}))"


@query(f"SELECT 0.1::DOUBLE support, s.strategy, p.processors::INT processors, {_found('floor', 5)}::BIGINT itemsets, 'success' status FROM (SELECT unnest(['BL', 'CWT']) strategy) s, (SELECT unnest([1, 4]) processors) p")
def processor_sweep(spark, sf):
    return sweeps.run_grid(spark, Q._type_pairs(spark, sf), [0.1], ["BL", "CWT"], [1, 4]).select("support", "strategy", "processors", "itemsets", "status")


SIZES, SUPPORTS = ((500, 10), (2000, 20)), (0.02, 0.05)


def _scaled(n: int, items: int, support: float) -> str:
    sampled = f"SELECT order_id FROM (SELECT DISTINCT o_orderkey order_id FROM orders) ORDER BY md5('{T.MiningConfig.seed}:' || order_id::VARCHAR), order_id LIMIT {n}"
    sample = f"{Q.BASKET}, part_basket AS (SELECT * FROM basket WHERE order_id IN ({sampled})), top AS (SELECT product_name FROM part_basket GROUP BY 1 ORDER BY count(*) DESC, product_name LIMIT {items})"
    pairs = "pairs AS (SELECT DISTINCT order_id o, product_name i FROM part_basket WHERE product_name IN (SELECT product_name FROM top)), total AS (SELECT count(DISTINCT o) n FROM pairs)"
    levels = " UNION ALL ".join(Q.level_sql(k, Q.least_sql(support)) for k in range(1, 5))
    return f"SELECT {n}::BIGINT sample_size, {items}::BIGINT max_items, {support}::DOUBLE min_support, count(*) itemsets, 'success' status FROM (WITH {sample}, {pairs} {levels})"


@query(" UNION ALL ".join(_scaled(n, items, s) for n, items in SIZES for s in SUPPORTS))
def scalability_sweep(spark, sf):
    path = scratch(spark, "scalability")
    K.write_scalability(spark, sweeps.scalability(spark, sf, SIZES, SUPPORTS), path)
    return spark.read.schema("sample_size long, max_items long, min_support double, itemsets long, status string").json(path)


@query(" UNION ALL ".join(f"SELECT sample_size, max_items, min_support, itemsets FROM ({_scaled(n, items, s)})" for n, items in SIZES for s in SUPPORTS))
def scalability_nested(spark, sf):
    """All sizes and supports from one run: samples nested by hash order, counts as vectors."""
    return nested_scalability(spark, sf, list(SIZES), list(SUPPORTS))


WDPA = "wdpa CWT 1p"


@query(f"""SELECT 0.1::DOUBLE support, algorithm, strategy, processors::INT processors, CASE WHEN dense THEN {_found('fraction', 6)} ELSE {_found('floor', 5)} END::BIGINT itemsets, 'success' status, baseline
FROM (VALUES ('traditional', NULL, 1, true, NULL), ('naive_parallel', NULL, 2, true, 'traditional'), ('wdpa', 'CWT', 1, false, '{WDPA}'), ('wdpa', 'CWT', 4, false, '{WDPA}'), ('ye_parallel', NULL, 2, false, 'traditional')) t(algorithm, strategy, processors, dense, baseline)""")
def benchmark_run(spark, sf):
    """The miners that a configuration document switches on, written and read back."""
    config = B.parse_config({
        "mining_parameters": {"support_thresholds": [0.1]},
        "algorithms": {"traditional": {"enabled": True}, "naive_parallel": {"enabled": True, "num_workers": 2}, "wdpa": {"enabled": True, "strategies": ["CWT"], "num_processors": [1, 4], "max_k": 5}, "ye_parallel": {"enabled": True, "num_processors": [2], "max_k": 5}},
    })
    pairs, folder = Q._type_pairs(spark, sf), scratch(spark, "benchmark")
    size = E.matrix_density(pairs).first()
    K.write_benchmark(run_benchmark(spark, pairs, config), config, size.orders, size["items"], folder)
    found = spark.read.schema(T.BENCHMARK).json(f"{folder}/benchmark_results.json")
    return found.select("support", "algorithm", "strategy", "processors", "itemsets", "status", "baseline")
