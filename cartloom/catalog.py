"""The queries of the basket engine over the driver's tables, each with the SQL that gives the same rows.

Orders are l_orderkey, products l_partkey, users o_custkey and names p_name; p_type and p_brand are
further item domains. Itemsets are written as texts, items joined by commas.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.functions import metrics as R
from cartloom.functions.scalars import memory_gib, parse_run_key
from cartloom.operators import candidates as C
from cartloom.operators import distribute as D
from cartloom.operators import encode as E
from cartloom.operators import rules as A
from cartloom.operators import support as S
from cartloom.operators.running import numbered
from cartloom.plans import mine as M
from cartloom.sources import basket as B
from cartloom.sources.shared import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SAMPLE, TOP, SEED = 5000, 20, 42
TYPES = ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _text(df: DataFrame, column: str = "itemset", name: str = "itemset") -> DataFrame:
    return df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), ",")).withColumnRenamed(column, name)


def _basket(spark: SparkSession, sf: str) -> DataFrame:
    return B.build_basket(*B.tpch_tables(spark, sf))


# SQL pieces -----------------------------------------------------------------------------------------
BASKET = "basket AS (SELECT l_orderkey order_id, o_custkey user_id, l_partkey product_id, p_name product_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"


def pairs_sql(column: str) -> str:
    return f"pairs AS (SELECT DISTINCT l_orderkey o, {column} i FROM lineitem JOIN part ON l_partkey = p_partkey), total AS (SELECT count(DISTINCT o) n FROM pairs)"


def least_sql(support: float, threshold: str = "floor") -> str:
    """The condition on count(*) c."""
    if threshold == "fraction":
        return f"c::DOUBLE / n >= {support}::DOUBLE"
    return f"c >= greatest(1, floor({support}::DOUBLE * n)::BIGINT)"


def level_sql(k: int, condition: str) -> str:
    """Itemsets of k items by k - 1 self-joins."""
    joins = "".join(f" JOIN pairs b{j} ON b{j}.o = b1.o AND b{j}.i > b{j - 1}.i" for j in range(2, k + 1))
    items = ", ".join(f"b{j}.i::VARCHAR" for j in range(1, k + 1))
    return f"SELECT {k} k, concat_ws(',', {items}) itemset, c count, c::DOUBLE / n support FROM (SELECT {', '.join(f'b{j}.i i{j}' for j in range(1, k + 1))}, count(*) c FROM pairs b1{joins} GROUP BY ALL), total WHERE {condition}".replace(
        items, ", ".join(f"i{j}::VARCHAR" for j in range(1, k + 1))
    )


def mine_sql(column: str, support: float, depth: int, threshold: str = "floor") -> str:
    return f"WITH {pairs_sql(column)} " + " UNION ALL ".join(level_sql(k, least_sql(support, threshold)) for k in range(1, depth + 1))


# Basket ---------------------------------------------------------------------------------------------
@query(f"WITH {BASKET} SELECT * FROM basket")
def basket_join(spark, sf):
    return _basket(spark, sf)


SAMPLED = f"sampled AS (SELECT order_id FROM (SELECT DISTINCT o_orderkey order_id FROM orders) ORDER BY md5('{SEED}:' || order_id::VARCHAR), order_id LIMIT {SAMPLE})"


@query(f"WITH {SAMPLED} SELECT order_id FROM sampled")
def sample_orders(spark, sf):
    return B.sample_orders(B.tpch_tables(spark, sf)[0], SAMPLE, SEED)


@query(f"WITH {BASKET}, {SAMPLED} SELECT * FROM basket WHERE order_id IN (SELECT order_id FROM sampled)")
def basket_sampled(spark, sf):
    orders, lines, parts = B.tpch_tables(spark, sf)
    return B.build_basket(orders, B.keep_sampled(lines, B.sample_orders(orders, SAMPLE, SEED)), parts)


POPULAR = "popular AS (SELECT product_name, count(*) n_rows FROM basket GROUP BY 1)"


@query(f"WITH {BASKET}, {POPULAR} SELECT * FROM popular")
def item_popularity(spark, sf):
    return B.item_popularity(_basket(spark, sf))


@query(f"WITH {BASKET}, {POPULAR} SELECT * FROM popular ORDER BY n_rows DESC, product_name LIMIT {TOP}")
def top_items(spark, sf):
    return B.top_items(_basket(spark, sf), TOP)


@query(f"WITH {BASKET}, {POPULAR} SELECT * FROM basket WHERE product_name IN (SELECT product_name FROM popular ORDER BY n_rows DESC, product_name LIMIT {TOP})")
def basket_top_items(spark, sf):
    return B.keep_top_items(_basket(spark, sf), TOP)


CHUNK, WANTED = 500, 2000


@query(f"""WITH numbered AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1) // {CHUNK} chunk FROM lineitem),
kept AS (SELECT * FROM numbered WHERE l_quantity > 25), counts AS (SELECT chunk, count(*) n FROM kept GROUP BY 1),
done AS (SELECT chunk, coalesce(sum(n) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM counts)
SELECT l_orderkey order_id, l_linenumber line, l_partkey product_id FROM kept WHERE chunk IN (SELECT chunk FROM done WHERE before < {2 * WANTED})""")
def early_stop_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product_id"), "l_quantity")
    return B.early_stop_scan(rows, ["order_id", "line", "product_id", "l_quantity"], F.col("l_quantity") > 25, CHUNK, WANTED).drop("l_quantity")


@query("SELECT p_name product_name, max(p_partkey) product_id, count(DISTINCT p_partkey) n_ids FROM part GROUP BY 1")
def dedup_products(spark, sf):
    products = B.dedup_products(B.tpch_tables(spark, sf)[2])
    return B.name_dictionary(products).join(products.groupBy("product_name").agg(F.count("*").alias("n_ids")), "product_name")


@query("SELECT l_orderkey order_id, l_partkey product_id FROM lineitem")
def union_chunks(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), "l_linenumber")
    n = F.col("l_linenumber")
    return B.union_chunks(*[lines.filter(c).drop("l_linenumber") for c in (n <= 2, (n > 2) & (n <= 4), n > 4)])


# Encodings and statistics ---------------------------------------------------------------------------
def _type_pairs(spark, sf):
    return B.item_pairs(spark, sf, "p_type")


def _type_rows(spark, sf):
    return B.item_rows(spark, sf, "p_type")


@query(f"WITH {pairs_sql('p_type')} SELECT i item, string_agg(o::VARCHAR, ',' ORDER BY o) tids FROM pairs GROUP BY 1")
def tid_lists(spark, sf):
    return _text(E.tid_lists(_type_pairs(spark, sf)), "tids", "tids")


@query("SELECT l_orderkey order_id, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) items FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1")
def transactions(spark, sf):
    return _text(E.transactions(B.item_pairs(spark, sf, "l_partkey")), "items", "items")


@query(f"WITH {pairs_sql('p_type')} SELECT o order_id, " + ", ".join(f"max((i = '{t}')::INT)::TINYINT \"{t}\"" for t in TYPES) + " FROM pairs GROUP BY 1")
def basket_matrix(spark, sf):
    return E.basket_matrix(_type_rows(spark, sf), list(TYPES))


@query(f"""WITH {BASKET} SELECT count(*) records, count(DISTINCT order_id) unique_orders, count(DISTINCT user_id) unique_users, count(DISTINCT product_id) unique_products,
count(DISTINCT product_name) unique_names, count(*)::DOUBLE / count(DISTINCT order_id) avg_items_per_order FROM basket""")
def dataset_statistics(spark, sf):
    return E.dataset_statistics(_basket(spark, sf))


@query("""WITH c AS (SELECT l_partkey, count(DISTINCT l_orderkey) c FROM lineitem GROUP BY 1)
SELECT count(*) items, round(avg(c), 6) mean_len, median(c) median_len, min(c) min_len, max(c) max_len, round(stddev_pop(c), 6) std_len FROM c""")
def tid_statistics(spark, sf):
    return E.tid_statistics(B.item_pairs(spark, sf, "l_partkey")).withColumn("mean_len", F.round("mean_len", 6)).withColumn("std_len", F.round("std_len", 6))


@query(f"WITH {pairs_sql('p_name')} SELECT count(DISTINCT o) orders, count(DISTINCT i) items, count(*) ones, count(*)::DOUBLE / (count(DISTINCT o)::DOUBLE * count(DISTINCT i)) density, count(DISTINCT o)::DOUBLE * count(DISTINCT i) / 1073741824 gib FROM pairs")
def matrix_density(spark, sf):
    return E.matrix_density(B.item_pairs(spark, sf, "p_name"))


@query(f"WITH {pairs_sql('p_name')} SELECT i item, count(*) count, count(*)::DOUBLE / any_value(n) support FROM pairs, total GROUP BY 1")
def singleton_support(spark, sf):
    return E.singleton_support(B.item_pairs(spark, sf, "p_name"))


# Support and candidates -----------------------------------------------------------------------------
GIVEN = (("ECONOMY", "PROMO"), ("LARGE", "MEDIUM", "SMALL"), ("ECONOMY", "NONE"), ("STANDARD",), ("ECONOMY", "LARGE", "PROMO", "SMALL"))


def _given(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(list(x),) for x in GIVEN], "cand array<string>")


GIVEN_SQL = f"WITH {pairs_sql('p_type')} " + " UNION ALL ".join(
    f"SELECT '{','.join(x)}' itemset, (SELECT count(*) FROM (SELECT o FROM pairs WHERE i IN ({', '.join(repr(y) for y in x)}) GROUP BY o HAVING count(*) = {len(x)})) count" for x in GIVEN
)


@query(GIVEN_SQL)
def itemset_support_array(spark, sf):
    return _text(S.array_support(_given(spark), E.tid_lists(_type_pairs(spark, sf))), "cand")


@query(GIVEN_SQL)
def itemset_support_bitmap(spark, sf):
    return _text(S.bitmap_support(_given(spark), E.tid_bitmaps(_type_pairs(spark, sf))), "cand")


@query(GIVEN_SQL)
def containment_counts(spark, sf):
    return _text(S.containment_support(_given(spark), E.transactions(_type_pairs(spark, sf))), "cand")


KNOWN = [list(x) for x in GIVEN if "NONE" not in x]


@query(
    f"WITH {pairs_sql('p_type')} "
    + " UNION ALL ".join(f"SELECT '{','.join(x)}' itemset, (SELECT count(*) FROM (SELECT o FROM pairs WHERE i IN ({', '.join(repr(y) for y in x)}) GROUP BY o HAVING count(*) = {len(x)}))::DOUBLE / n support FROM total" for x in KNOWN)
)
def conjunction_support(spark, sf):
    return S.conjunction_support(E.basket_matrix(_type_rows(spark, sf), list(TYPES)), KNOWN)


BRAND = 0.02
F1 = f"f1 AS (SELECT i, c FROM (SELECT i, count(*) c FROM pairs GROUP BY 1), total WHERE {least_sql(BRAND)})"


def _brand_pairs(spark, sf):
    return B.item_pairs(spark, sf, "p_brand")


def _brand_rows(spark, sf):
    return B.item_rows(spark, sf, "p_brand")


@query(f"WITH {pairs_sql('p_brand')}, {F1} SELECT concat_ws(',', a.i, b.i) itemset FROM f1 a JOIN f1 b ON a.i < b.i")
def candidate_pairs(spark, sf):
    return _text(C.candidate_pairs(M.frequent_items(_brand_pairs(spark, sf), BRAND)), "cand")


F2 = f"f2 AS (SELECT i1, i2 FROM (SELECT b1.i i1, b2.i i2, count(*) c FROM pairs b1 JOIN pairs b2 ON b1.o = b2.o AND b1.i < b2.i GROUP BY ALL), total WHERE {least_sql(BRAND)})"


def _brand_f2(spark, sf):
    return M.mine(_brand_rows(spark, sf), BRAND, max_k=2).filter("k = 2")


@query(f"WITH {pairs_sql('p_brand')}, {F2} SELECT concat_ws(',', a.i1, a.i2, b.i2) itemset FROM f2 a JOIN f2 b ON a.i1 = b.i1 AND a.i2 < b.i2")
def candidate_join(spark, sf):
    return _text(C.candidate_join(_brand_f2(spark, sf), 3), "cand")


C3 = "c3 AS (SELECT a.i1, a.i2, b.i2 i3 FROM f2 a JOIN f2 b ON a.i1 = b.i1 AND a.i2 < b.i2 JOIN f2 c ON c.i1 = a.i2 AND c.i2 = b.i2)"


@query(f"WITH {pairs_sql('p_brand')}, {F2}, {C3} SELECT concat_ws(',', i1, i2, i3) itemset FROM c3")
def candidate_prune(spark, sf):
    f2 = _brand_f2(spark, sf)
    return _text(C.prune(C.candidate_join(f2, 3), f2, 3), "cand")


@query(f"WITH {pairs_sql('p_brand')}, {F1} SELECT (count(*) * (count(*) - 1)) // 2 lattice_size FROM f1")
def lattice_size(spark, sf):
    return M.frequent_items(_brand_pairs(spark, sf), BRAND).agg(F.count("*").alias("n")).select(F.expr("(n * (n - 1)) div 2").alias("lattice_size"))


# Miners ---------------------------------------------------------------------------------------------
def frequent_itemsets_type_rows(spark: SparkSession, sf: str) -> DataFrame:
    return M.mine_preset(_type_rows(spark, sf), "tid", 0.1)


@query(mine_sql("p_type", 0.1, 6))
def frequent_itemsets_type(spark, sf):
    return _text(frequent_itemsets_type_rows(spark, sf))


@query(mine_sql("p_name", 0.003, 1))
def freq_items_floor(spark, sf):
    return _text(M.frequent_items(B.item_pairs(spark, sf, "p_name"), 0.003).orderBy(F.desc("count"), "itemset"))


@query(mine_sql("p_name", 0.003, 1, "fraction"))
def freq_items_fraction(spark, sf):
    return _text(M.frequent_items(B.item_pairs(spark, sf, "p_name"), 0.003, "fraction"))


@query(mine_sql("p_name", 0.00001, 1))
def freq_items_min1(spark, sf):
    return _text(M.frequent_items(B.item_pairs(spark, sf, "p_name"), 0.00001, "floor_min1"))


@query(mine_sql("p_name", 0.003, 3))
def mine_tid(spark, sf):
    return _text(M.mine_preset(B.item_rows(spark, sf, "p_name"), "tid", 0.003, max_k=3))


def _wdpa(strategy: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _text(M.mine_preset(_brand_rows(spark, sf), "wdpa", BRAND, strategy=strategy, processors=4))

    run.__name__ = f"mine_wdpa_{strategy.lower()}"
    return run


for _s in D.STRATEGIES:
    query(mine_sql("p_brand", BRAND, 4))(_wdpa(_s))


@query(mine_sql("p_brand", BRAND, 4, "fraction"))
def mine_naive(spark, sf):
    return _text(M.mine_preset(_brand_rows(spark, sf), "naive", BRAND))


@query(mine_sql("p_type", 0.05, 5))
def mine_ye(spark, sf):
    return _text(M.mine_preset(_type_rows(spark, sf), "ye", 0.05))


@query(mine_sql("p_brand", BRAND, 4, "fraction"))
def mine_fpgrowth(spark, sf):
    return _text(M.mine_fpgrowth(_brand_rows(spark, sf), BRAND))


@query(mine_sql("p_brand", BRAND, 4))
def mine_fpgrowth_floor(spark, sf):
    return _text(M.mine_fpgrowth(_brand_rows(spark, sf), BRAND, "floor"))


@query(f"SELECT k, count(*) itemsets FROM ({mine_sql('p_type', 0.05, 6)}) GROUP BY 1")
def itemsets_per_level(spark, sf):
    return M.itemsets_per_level(M.mine_preset(_type_rows(spark, sf), "tid", 0.05))


SWEEP = (0.05, 0.1, 0.2)


@query(" UNION ALL ".join(f"SELECT {s}::DOUBLE min_support, * FROM ({mine_sql('p_type', s, 5)})" for s in SWEEP))
def support_sweep(spark, sf):
    return _text(M.support_sweep(_type_pairs(spark, sf), list(SWEEP)))


# Distribution ---------------------------------------------------------------------------------------
P = 4
CANDS = f"""WITH {pairs_sql("p_brand")}, {F1}, ranked AS (SELECT i, c, row_number() OVER (ORDER BY c DESC, i) r FROM f1),
cands AS (SELECT row_number() OVER (ORDER BY least(a.r, b.r), greatest(a.r, b.r)) - 1 idx, concat_ws(',', a.i, b.i) itemset, a.c * b.c weight FROM ranked a JOIN ranked b ON a.i < b.i),
size AS (SELECT count(*) m, sum(weight) w FROM cands)"""


def _weighted(spark, sf):
    f1 = written(M.frequent_items(_brand_pairs(spark, sf), BRAND), "frequent-items")
    counts = f1.select(F.get("itemset", F.lit(0)).alias("item"), "count")
    return D.weighted(D.indexed(C.candidate_pairs(f1), counts), counts)


@query(f"{CANDS} SELECT idx, itemset, weight::BIGINT weight FROM cands")
def candidate_weights(spark, sf):
    return _text(_weighted(spark, sf), "cand")


BWT = f"""{CANDS}, s AS (SELECT *, row_number() OVER (ORDER BY weight DESC, idx) rk FROM cands)""".replace("WITH ", "WITH RECURSIVE ", 1) + f""",
fold AS (SELECT 0::BIGINT rk, 0::BIGINT used, 0::BIGINT proc, 0::HUGEINT run UNION ALL
  SELECT s.rk, x.proc, CASE WHEN x.total >= (SELECT w FROM size)::DOUBLE / {P} AND x.proc < {P - 1} THEN x.proc + 1 ELSE x.proc END, CASE WHEN x.total >= (SELECT w FROM size)::DOUBLE / {P} AND x.proc < {P - 1} THEN 0 ELSE x.total END
  FROM (SELECT f.rk + 1 rk, f.proc, f.run + s0.weight total FROM fold f JOIN s s0 ON s0.rk = f.rk + 1) x JOIN s ON s.rk = x.rk)"""
ASSIGNED = {
    "BL": f"{CANDS} SELECT idx, itemset, weight::BIGINT weight, CASE WHEN m < {P} THEN {P - 1} ELSE least(idx // greatest(m // {P}, 1), {P - 1}) END::BIGINT proc_id FROM cands, size",
    "CL": f"{CANDS} SELECT idx, itemset, weight::BIGINT weight, (idx % {P})::BIGINT proc_id FROM cands",
    "BWT": f"{BWT} SELECT s.idx, s.itemset, s.weight::BIGINT weight, f.used proc_id FROM s JOIN fold f ON f.rk = s.rk",
    "CWT": f"{CANDS} SELECT idx, itemset, weight::BIGINT weight, ((row_number() OVER (ORDER BY weight DESC, idx) - 1) % {P})::BIGINT proc_id FROM cands",
}


def _distribute(strategy: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _text(D.distribute(_weighted(spark, sf), strategy, P), "cand")

    run.__name__ = f"distribute_{strategy.lower()}"
    return run


for _s in D.STRATEGIES:
    query(ASSIGNED[_s])(_distribute(_s))


@query(f"SELECT r.range proc_id, count(a.idx) candidates, coalesce(sum(a.weight), 0)::BIGINT weight FROM range({P}) r LEFT JOIN ({ASSIGNED['CWT']}) a ON a.proc_id = r.range GROUP BY 1")
def processor_load(spark, sf):
    return D.processor_load(spark, D.distribute(_weighted(spark, sf), "CWT", P), P)


@query(f"""SELECT a.proc_id, count(*) intersections, sum((f.itemset IS NOT NULL)::BIGINT)::BIGINT frequent FROM ({ASSIGNED["CWT"]}) a
LEFT JOIN (SELECT itemset FROM ({mine_sql("p_brand", BRAND, 2)}) WHERE k = 2) f USING (itemset) GROUP BY 1""")
def worker_intersections(spark, sf):
    pairs = _brand_pairs(spark, sf)
    least = S.min_count(BRAND, E.count_orders(pairs))
    return S.worker_counts(D.distribute(_weighted(spark, sf), "CWT", P), E.tid_bitmaps(pairs), least)


@query(f"{CANDS} SELECT idx, itemset, idx // greatest(1, m // {P}) chunk FROM cands, size")
def chunk_candidates(spark, sf):
    rows = written(_weighted(spark, sf), "weighted")
    return _text(D.chunked(rows.select("idx", "cand"), P, rows.count()), "cand")


@query(f"WITH t AS (SELECT DISTINCT l_orderkey order_id FROM lineitem), n AS (SELECT count(*) n FROM t), r AS (SELECT order_id, row_number() OVER (ORDER BY order_id) - 1 idx FROM t) SELECT chunk, count(*) transactions FROM (SELECT idx // greatest(1, (n + {P} - 1) // {P}) chunk FROM r, n) GROUP BY 1")
def chunk_transactions(spark, sf):
    orders = B.tpch_tables(spark, sf)[1].select("order_id").distinct()
    return D.ceil_chunked(numbered(orders, [F.col("order_id")], "idx"), P, orders.count()).groupBy("chunk").agg(F.count("*").alias("transactions"))


# Rules ----------------------------------------------------------------------------------------------
RULES = f"""WITH fi AS ({mine_sql("p_type", 0.1, 5)}), sets AS (SELECT *, string_split(itemset, ',') items FROM fi),
splits AS (SELECT s.*, unnest(range(1, (1::BIGINT << k) - 1)) m FROM sets s WHERE k >= 2),
sides AS (SELECT support, array_to_string(list_filter(items, lambda x, j: ((m >> (j - 1)::BIGINT) & 1) = 1), ',') antecedent, array_to_string(list_filter(items, lambda x, j: ((m >> (j - 1)::BIGINT) & 1) = 0), ',') consequent FROM splits),
rules AS (SELECT s.antecedent, s.consequent, a.support antecedent_support, c.support consequent_support, s.support, s.support / a.support confidence, s.support / a.support / c.support lift
FROM sides s JOIN fi a ON a.itemset = s.antecedent JOIN fi c ON c.itemset = s.consequent)"""


def _rules(spark, sf, metric="lift", least=0.0):
    return A.association_rules(frequent_itemsets_type_rows(spark, sf), metric, least)


def _rule_text(df: DataFrame) -> DataFrame:
    return _text(_text(df, "antecedent", "antecedent"), "consequent", "consequent")


@query(f"{RULES} SELECT * FROM rules")
def association_rules(spark, sf):
    return _rule_text(_rules(spark, sf))


@query(f"{RULES} SELECT * FROM rules WHERE lift >= 0.9")
def rules_by_lift(spark, sf):
    return _rule_text(A.sorted_rules(_rules(spark, sf, "lift", 0.9)))


@query(f"{RULES} SELECT antecedent, consequent, round(lift, 9) lift FROM rules ORDER BY round(lift, 9) DESC, round(support, 9) DESC, string_split(antecedent, ','), string_split(consequent, ',') LIMIT 5")
def top_rules(spark, sf):
    return _rule_text(A.top_rules(_rules(spark, sf))).select("antecedent", "consequent", F.round("lift", 9).alias("lift"))


@query(f"{RULES} SELECT * FROM rules WHERE confidence >= 0.5")
def rules_by_confidence(spark, sf):
    return _rule_text(_rules(spark, sf, "confidence", 0.5))


# Reports over a log of runs ---------------------------------------------------------------------------
#: The lines are read as a log: each is a measurement of a run, whose parameters its numbers tell; a run's times are
#: whole hundredths, so both engines have the same doubles.
LOG_SUPPORTS, LOG_STRATEGIES, LOG_PROCESSORS = (0.001, 0.0015, 0.002, 0.003), ("BL", "CL", "BWT", "CWT"), (1, 2, 4, 8, 16)


def _pick_sql(values: tuple, number: str, kind: str) -> str:
    return f"CASE ({number}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v!r}{kind}" for i, v in enumerate(values)) + " END"


def log_sql(where: str = "true") -> str:
    return f"""(SELECT support, strategy, processors, computation_time, computation_time + extra AS total_time FROM (
  SELECT {_pick_sql(LOG_SUPPORTS, "l_suppkey", "::DOUBLE")} AS support, {_pick_sql(LOG_STRATEGIES, "l_partkey", "")} AS strategy, {_pick_sql(LOG_PROCESSORS, "l_orderkey", "::INT")} AS processors,
    ((sum(round(l_extendedprice * 100)::BIGINT)::BIGINT // count(*)) % 50000 + 100) / 100.0::DOUBLE AS computation_time, (sum(l_quantity::BIGINT)::BIGINT // count(*))::DOUBLE AS extra
  FROM lineitem WHERE {where} GROUP BY ALL))"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet")


def run_log(lines: DataFrame, *more: str) -> DataFrame:
    """support, strategy, processors, computation_time and total_time of the runs of a log, and of each of further columns."""

    def pick(values: tuple, number: str):
        return F.element_at(F.array(*map(F.lit, values)), (F.col(number) % len(values) + 1).cast("int"))

    keyed = lines.select(
        *more, pick(LOG_SUPPORTS, "l_suppkey").alias("support"), pick(LOG_STRATEGIES, "l_partkey").alias("strategy"), pick(LOG_PROCESSORS, "l_orderkey").alias("processors"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("quantity"),
    )
    sums = keyed.groupBy(*more, "support", "strategy", "processors").agg(F.sum("cents").alias("c"), F.sum("quantity").alias("q"), F.count("*").alias("n"))
    time = F.expr("((c div n) % 50000 + 100) / 100.0D")
    return sums.select(*more, "support", "strategy", "processors", time.alias("computation_time"), (time + F.expr("cast(q div n as double)")).alias("total_time"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return run_log(_lines(spark, sf))


RUNS = log_sql()
BASED = f"runs AS {RUNS}, based AS (SELECT r.*, b.computation_time base FROM runs r LEFT JOIN runs b ON b.support = r.support AND b.strategy = r.strategy AND b.processors = 1)"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""WITH {BASED} SELECT support, strategy, processors, base baseline_time, computation_time parallel_time, round(base / computation_time, 6) speedup, round(base / computation_time / processors, 6) efficiency,
round(base - computation_time, 6) time_saved, round((base - computation_time) / base * 100, 6) percent_faster FROM based""")
def speedup_metrics(spark, sf):
    return _rounded(R.speedup_metrics(_runs(spark, sf)))


@query(f"WITH {BASED} SELECT support, strategy, processors, round(greatest(0, (total_time - computation_time) / total_time * 100), 4) overhead_pct FROM based")
def overhead_pct(spark, sf):
    return _rounded(R.overhead(_runs(spark, sf)), 4)


def _table(value: str, average: bool = False) -> str:
    cols = ", ".join(f"round(max(CASE WHEN processors = {p} THEN {value} END), 4) p{p}" for p in R.PROCESSORS)
    return f"WITH {BASED} SELECT support, strategy, {cols}" + (f", round(avg({value}), 4) avg" if average else "") + " FROM based GROUP BY 1, 2"


@query(_table("computation_time"))
def time_table(spark, sf):
    return _rounded(R.by_processors(_runs(spark, sf), "computation_time", list(R.PROCESSORS)), 4)


@query(_table("base / computation_time"))
def speedup_table(spark, sf):
    return _rounded(R.by_processors(R.speedup_metrics(_runs(spark, sf)), "speedup", list(R.PROCESSORS)), 4)


@query(_table("base / computation_time / processors * 100", True))
def efficiency_table(spark, sf):
    m = R.speedup_metrics(_runs(spark, sf)).withColumn("e", F.col("efficiency") * 100)
    return _rounded(R.by_processors(m, "e", list(R.PROCESSORS), True), 4)


@query(_table("greatest(0, (total_time - computation_time) / total_time * 100)"))
def overhead_table(spark, sf):
    return _rounded(R.by_processors(R.overhead(_runs(spark, sf)), "overhead_pct", list(R.PROCESSORS)), 4)


LEVEL_ROWS = " UNION ALL ".join(f"SELECT {s}::DOUBLE AS support, k, count(*) AS itemsets FROM ({mine_sql('p_type', s, 5)}) GROUP BY k" for s in SWEEP)


@query(f"SELECT support, sum(itemsets)::BIGINT total, max(CASE WHEN itemsets > 0 THEN k END) max_k, {', '.join(f'max(CASE WHEN k = {k} THEN itemsets END)::BIGINT l{k}' for k in range(1, 5))} FROM ({LEVEL_ROWS}) GROUP BY 1")
def levels_table(spark, sf):
    rows = M.support_sweep(_type_pairs(spark, sf), list(SWEEP)).groupBy(F.col("min_support").alias("support"), "k").agg(F.count("*").alias("itemsets"))
    return rows.groupBy("support").agg(
        F.sum("itemsets").alias("total"), F.max(F.when(F.col("itemsets") > 0, F.col("k"))).alias("max_k"), *[F.max(F.when(F.col("k") == k, F.col("itemsets"))).alias(f"l{k}") for k in range(1, 5)]
    )


@query(f"""WITH {BASED}, m AS (SELECT strategy, base / computation_time speedup, base / computation_time / processors efficiency FROM based)
SELECT strategy, round(avg(speedup), 6) avg_speedup, round(min(speedup), 6) min_speedup, round(max(speedup), 6) max_speedup, round(avg(efficiency), 6) avg_efficiency, round(min(efficiency), 6) min_efficiency, round(max(efficiency), 6) max_efficiency FROM m GROUP BY 1""")
def strategy_averages(spark, sf):
    return _rounded(R.strategy_averages(_runs(spark, sf)))


@query(f"WITH runs AS {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY support ORDER BY computation_time, list_position(['BL', 'CL', 'BWT', 'CWT'], strategy)) x FROM runs WHERE processors = 16) SELECT support, strategy, computation_time FROM r WHERE x = 1")
def best_config(spark, sf):
    return R.best_config(_runs(spark, sf))


@query(f"WITH runs AS {RUNS}, m AS (SELECT strategy, processors, avg(computation_time) mean_time FROM runs GROUP BY 1, 2) SELECT m.strategy, m.processors, round(m.mean_time, 6) mean_time, round(b.mean_time / m.mean_time, 6) speedup FROM m JOIN m b ON b.strategy = m.strategy AND b.processors = 1")
def speedup_of_means(spark, sf):
    return _rounded(R.speedup_of_means(_runs(spark, sf)))


NAIVE = f"(SELECT support, max(total_time) * 16 AS total_time FROM {RUNS} GROUP BY 1)"


@query(f"SELECT round(a, 6) wdpa_avg, round(b, 6) naive_avg, round(b / a, 6) ratio FROM (SELECT avg(computation_time) a FROM {RUNS}), (SELECT avg(total_time) b FROM {NAIVE})")
def wdpa_vs_naive(spark, sf):
    return _rounded(R.against_naive(_runs(spark, sf), _runs(spark, sf).groupBy("support").agg((F.max("total_time") * 16).alias("total_time"))))


@query(f"WITH {BASED} SELECT processors, round(avg(base / computation_time / processors), 6) mean_efficiency FROM based GROUP BY 1")
def mean_efficiency(spark, sf):
    return _rounded(R.mean_efficiency(_runs(spark, sf)))


@query(f"SELECT support, strategy, processors, computation_time, total_time FROM {RUNS} WHERE processors = 16")
def max_processor_view(spark, sf):
    return R.at_most_processors(_runs(spark, sf)).select("support", "strategy", "processors", "computation_time", "total_time")


SIZES = (2, 4, 7)
SIZED = " UNION ALL ".join(f"SELECT {n}::INT AS dataset_size, * FROM {log_sql(f'l_linenumber <= {n}')}" for n in SIZES)


@query(f"""WITH sized AS (SELECT * FROM ({SIZED}) WHERE abs(support - 0.002::DOUBLE) < 0.00001::DOUBLE)
SELECT dataset_size, strategy, processors, computation_time, round(computation_time / first_value(computation_time) OVER (PARTITION BY strategy, processors ORDER BY dataset_size), 4) growth FROM sized""")
def cross_run_scaling(spark, sf):
    """Runs of three logs, of lines up to a number, which is the size."""
    sizes = F.filter(F.array(*map(F.lit, SIZES)), lambda n: F.col("l_linenumber") <= n)
    logs = run_log(_lines(spark, sf).withColumn("dataset_size", F.explode(sizes)), "dataset_size")
    return R.cross_run_scaling(logs, 0.002).withColumn("growth", F.round("growth", 4))


@query(f"""SELECT support, strategy, processors, total_time, round(first_value(total_time) OVER w / total_time, 6) speedup, round(first_value(total_time) OVER w / total_time / processors, 6) efficiency
FROM {RUNS} WHERE processors >= 2 WINDOW w AS (PARTITION BY support, strategy ORDER BY processors)""")
def scaling_vs_lowest(spark, sf):
    return _rounded(R.scaling_vs_lowest(_runs(spark, sf).filter("processors >= 2")))


@query(f"SELECT * FROM {RUNS} WHERE processors IN (1, 4, 16) AND (abs(support - 0.001::DOUBLE) < 0.00001::DOUBLE OR abs(support - 0.003::DOUBLE) < 0.00001::DOUBLE)")
def results_filter(spark, sf):
    return R.filter_results(_runs(spark, sf), [1, 4, 16], [0.001, 0.003])


KEYS = """SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'wdpa_' || p_type || '_' || p_size::VARCHAR || 'p' WHEN 1 THEN 'wdpa_' || p_type WHEN 2 THEN p_name WHEN 3 THEN 'needs (' || p_size::VARCHAR || '.5 GiB) of memory'
  WHEN 4 THEN 'size=' || p_size::VARCHAR || ' MiB' ELSE 'limit ' || p_size::VARCHAR || 'GB, used ' || (p_size + 1)::VARCHAR || 'GB' END AS k FROM part"""


@query(f"""SELECT k AS key, nullif(regexp_extract(k, '^wdpa_([^_]+)_(\\d+)p$', 1), '') strategy, nullif(regexp_extract(k, '^wdpa_([^_]+)_(\\d+)p$', 2), '')::INT processors,
CASE WHEN k LIKE '%GiB%' OR k LIKE '%GB%' THEN regexp_extract(k, '([0-9.]+) ?G', 1)::DOUBLE WHEN k LIKE '%MiB%' THEN regexp_extract(k, '([0-9.]+) MiB', 1)::DOUBLE / 1024 END gib FROM ({KEYS})""")
def parse_result_key(spark, sf):
    """Keys and messages made of the parts' types, names and sizes."""
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    made = F.when(kind == 0, F.concat(F.lit("wdpa_"), "p_type", F.lit("_"), size, F.lit("p"))).when(kind == 1, F.concat(F.lit("wdpa_"), "p_type")).when(kind == 2, F.col("p_name"))
    made = made.when(kind == 3, F.concat(F.lit("needs ("), size, F.lit(".5 GiB) of memory"))).when(kind == 4, F.concat(F.lit("size="), size, F.lit(" MiB")))
    made = made.otherwise(F.concat(F.lit("limit "), size, F.lit("GB, used "), (F.col("p_size") + 1).cast("string"), F.lit("GB")))
    keys = spark.read.parquet(f"{sf}/part.parquet").select(made.alias("key")).distinct()
    strategy, processors = parse_run_key(F.col("key"))
    return keys.select("key", strategy.alias("strategy"), processors.alias("processors"), memory_gib(F.col("key")).alias("gib"))


@query("""WITH s AS (SELECT count(DISTINCT l_orderkey) orders, count(DISTINCT l_partkey) items FROM lineitem), g AS (SELECT *, items::DOUBLE * (items - 1) / 2 * orders / 1073741824 pair_gib, orders::DOUBLE * items / 1073741824 matrix_gib FROM s)
SELECT orders, items, round(pair_gib, 6) pair_gib, round(matrix_gib, 6) matrix_gib, CASE WHEN pair_gib > 8.0 THEN 'skipped_memory_error' ELSE 'success' END traditional_status, CASE WHEN matrix_gib > 10.0 THEN 'skipped_memory' ELSE 'success' END naive_status FROM g""")
def memory_admission(spark, sf):
    return _rounded(R.memory_admission(E.matrix_density(B.item_pairs(spark, sf, "l_partkey")).select("orders", "items")))


# Runs, all kinds of statuses --------------------------------------------------------------------------
TRIED_SQL = f"""(SELECT {_pick_sql((0.1, 0.2), "s", "::DOUBLE")} AS support, {_pick_sql(("wdpa", "naive_parallel", "ye_parallel"), "k", "")} AS algorithm, CASE WHEN k % 3 = 0 THEN 'BL' END AS strategy, {_pick_sql(LOG_PROCESSORS, "k", "::INT")} AS processors,
  t / 100.0::DOUBLE AS total_time, CASE WHEN k % 2 = 0 THEN t / 200.0::DOUBLE END AS computation_time, itemsets, {_pick_sql(("timeout", "success", "success"), "k + s", "")} AS status
  FROM (SELECT l_linenumber AS k, l_suppkey % 4 AS s, count(*) AS itemsets, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT // count(*) AS t FROM lineitem GROUP BY ALL))"""


def _tried(spark, sf):
    """A run for each line number and quarter of the suppliers: of all miners, with and without computation times, some timed out."""
    pick = lambda values, number: F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))
    k, s = F.col("k"), F.col("s")
    sums = _lines(spark, sf).groupBy(F.col("l_linenumber").alias("k"), (F.col("l_suppkey") % 4).alias("s")).agg(F.count("*").alias("itemsets"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("c"))
    t = F.expr("c div itemsets")
    return sums.select(
        pick((0.1, 0.2), s).alias("support"), pick(("wdpa", "naive_parallel", "ye_parallel"), k).alias("algorithm"), F.when(k % 3 == 0, F.lit("BL")).alias("strategy"), pick(LOG_PROCESSORS, k).alias("processors"),
        (t / 100.0).alias("total_time"), F.when(k % 2 == 0, t / 200.0).alias("computation_time"), "itemsets", pick(("timeout", "success", "success"), k + s).alias("status"),
    )


@query(f"SELECT support, algorithm, strategy, processors::INT processors, total_time, computation_time::DOUBLE computation_time, itemsets::BIGINT itemsets, status FROM {TRIED_SQL} WHERE status = 'success'")
def successful_runs(spark, sf):
    return R.successful(_tried(spark, sf))


@query(f"SELECT support, algorithm, processors::INT processors, coalesce(computation_time::DOUBLE, total_time) computation_time, total_time FROM {TRIED_SQL}")
def computation_fallback(spark, sf):
    return R.with_computation(_tried(spark, sf)).select("support", "algorithm", "processors", "computation_time", "total_time")


@query(f"SELECT 'support' kind, support::VARCHAR AS key FROM {TRIED_SQL} UNION SELECT 'strategy', strategy FROM {TRIED_SQL} WHERE strategy IS NOT NULL UNION SELECT 'processors', processors::VARCHAR FROM {TRIED_SQL}")
def run_keys(spark, sf):
    return R.run_keys(_tried(spark, sf))


@query(f"SELECT algorithm, strategy, processors::INT processors, count(*) runs, count(*) FILTER (status = 'success') successes, round(avg(total_time) FILTER (status = 'success'), 6) mean_time, max(itemsets)::BIGINT most_itemsets FROM {TRIED_SQL} GROUP BY ALL")
def summary_rows(spark, sf):
    return _rounded(R.summary_rows(_tried(spark, sf)))


@query(f"SELECT row_number() OVER (ORDER BY k, count DESC, string_split(itemset, ',')) n, * FROM ({mine_sql('p_type', 0.1, 5)})")
def sorted_levels(spark, sf):
    found = M.sorted_itemsets(M.mine_preset(_type_pairs(spark, sf), "wdpa", 0.1))
    return _text(numbered(found, [F.col("k"), F.desc("count"), F.col("itemset")], "n").withColumn("n", F.col("n") + 1))
