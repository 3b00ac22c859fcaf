"""Schemas of the basket model, and the names of a basket's columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LONG, STRING = T.LongType(), T.StringType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


ORDERS = _struct(order_id=LONG, user_id=LONG)
ORDER_LINES = _struct(order_id=LONG, product_id=LONG)
PRODUCTS = _struct(product_id=LONG, product_name=STRING)
BASKET = _struct(order_id=LONG, user_id=LONG, product_id=LONG, product_name=STRING)
ITEMSETS = _struct(k=T.IntegerType(), itemset=T.ArrayType(LONG, False), count=LONG, support=T.DoubleType())
RUNS = _struct(
    support=T.DoubleType(), algorithm=STRING, strategy=STRING, processors=T.IntegerType(),
    total_time=T.DoubleType(), computation_time=T.DoubleType(), itemsets=LONG, status=STRING,
)
#: Rows of a benchmark: runs with what their speedup is measured against, and the candidates and ANDs of their levels; null where there is nothing.
#: baseline names the run and so the time: "wdpa S 1p" is a computation time, the others are total times.
BENCHMARK = T.StructType([*RUNS.fields, *_struct(baseline=STRING, speedup=T.DoubleType(), efficiency=T.DoubleType(), candidates=LONG, intersections=LONG).fields])


@dataclass(frozen=True)
class BasketSpec:
    """Which columns of a basket hold the order, the item and the user."""

    order_col: str = "order_id"
    item_col: str = "product_id"
    user_col: str = "user_id"
    name_col: str = "product_name"


@dataclass(frozen=True)
class Algorithm:
    """A miner of a benchmark: traditional, naive_parallel, wdpa or ye_parallel."""

    name: str
    enabled: bool = False
    strategies: tuple[str, ...] = ()
    processors: tuple[int, ...] = (1,)
    max_k: int | None = None
    timeout: float | None = None


@dataclass(frozen=True)
class MiningConfig:
    """Parameters of a run. threshold: floor, floor_min1 or fraction; max_k: None for no limit."""

    sample_size: int | None = 150_000
    max_items: int | None = 10_000
    seed: int = 42
    min_supports: tuple[float, ...] = (0.0015, 0.002)
    processors: tuple[int, ...] = (1, 2, 4, 8, 16)
    strategies: tuple[str, ...] = ("BL", "CL", "BWT", "CWT")
    threshold: str = "floor"
    max_k: int | None = 5
    min_confidence: float = 0.5
    min_lift: float = 1.0
    chunk_size: int = 5000
    algorithms: tuple[Algorithm, ...] = ()
    results_directory: str = "results/benchmark"
