"""Parts of a relation mined in one run, against the miner on each part."""

import random

import pytest
from pyspark.sql import functions as F

from cartloom.operators.support import min_count
from cartloom.plans import nested as N
from cartloom.plans.mine import mine
from cartloom.sources import basket as B

KIND = "order_id long, item long, bits long"


@pytest.mark.parametrize("seed, support, max_k", [(1, 0.05, None), (2, 0.2, None), (3, 0.02, 3), (4, 0.1, 1)])
def test_parts_equal_the_miner_on_each(spark, seed, support, max_k):
    """Parts that aren't nested at all, with items and orders that only some have."""
    rng = random.Random(seed)
    rows = [(o, i, rng.choice([0, 1, 2, 3, 7, 7, 7])) for o in range(120) for i in rng.sample(range(9), rng.randint(1, 7))]
    df = spark.createDataFrame(rows + rows[:20], KIND)
    found, totals = N.mine_nested(df, 4, support, max_k=max_k)
    got = found.collect()
    assert len({tuple(r.itemset) for r in got}) == len(got) and totals[3] == 0
    for part in range(3):
        own = df.filter(F.col("bits").bitwiseAND(1 << part) != 0).select("order_id", "item")
        assert totals[part] == own.select("order_id").distinct().count()
        want = {tuple(r.itemset): r["count"] for r in mine(own, support, max_k=max_k).collect()}
        least = min_count(support, totals[part])
        assert {tuple(r.itemset): r.counts[part] for r in got if r.counts[part] >= least} == want


def test_no_rows(spark):
    for rows in ([], [(1, 2, 0)]):
        found, totals = N.mine_nested(spark.createDataFrame(rows, KIND), 2, 0.1)
        assert found.count() == 0 and totals == [0, 0]


def test_nested_samples(spark):
    """Each size's orders are those of its own sample; sizes in any order, equal ones, larger ones than the table, and all orders."""
    orders = spark.range(500).withColumnRenamed("id", "order_id")
    sizes = [40, 7, None, 900, 40, 0]
    got = {r.order_id: r.bits for r in N.nested_samples(orders, sizes, 3).collect()}
    for i, n in enumerate(sizes):
        want = {r.order_id for r in (orders if n is None else B.sample_orders(orders, n, 3)).collect()}
        assert {o for o, b in got.items() if b >> i & 1} == want
    with pytest.raises(ValueError):
        N.nested_rows(orders, orders, orders, [])


def test_rows_equal_each_basket(spark):
    """Each part's rows are those of the basket that its size gives by itself, without a limit of items too."""
    tables = B.tpch_tables(spark, "/root/testdata/sf0.001")
    sizes = [(300, 10), (60, None), (None, 15)]
    rows = N.nested_rows(*tables, sizes).collect()
    assert len({(r.order_id, r.item) for r in rows}) == len(rows)
    for i, (n, items) in enumerate(sizes):
        want = B.distinct_pairs(B.load_basket(*tables, B.S.MiningConfig(sample_size=n, max_items=items)), item_col="product_name").collect()
        assert {(r.order_id, r.item) for r in rows if r.bits >> i & 1} == {(r.order_id, r.item) for r in want}
