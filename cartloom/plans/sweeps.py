"""Sweeps over supports, sizes and processors, with a status for each cell and a real timeout."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from cartloom import schema as S
from cartloom.operators import encode as E
from cartloom.plans.mine import Work, mine
from cartloom.sources import basket as B


def timed(spark: SparkSession, job: Callable[[], int], timeout: float | None = None) -> tuple[str, float, int]:
    """Status (success, timeout, memory_error, error: ...), seconds and the job's number. A job that is too slow is cancelled on the cluster."""
    tag, began = f"cartloom-{uuid.uuid4().hex}", time.perf_counter()
    late = threading.Event()

    def cancel() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout, cancel) if timeout else None
    spark.sparkContext.addJobTag(tag)
    try:
        if timer:
            timer.start()
        n, status = job(), "success"
    except Exception as e:
        memory = isinstance(e, MemoryError) or "OutOfMemoryError" in str(e)
        n, status = 0, "timeout" if late.is_set() else "memory_error" if memory else f"error: {type(e).__name__}"
    finally:
        if timer:
            timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    return status, time.perf_counter() - began, n


def run_grid(spark: SparkSession, pairs: DataFrame, supports: Iterable[float], strategies: Iterable[str], processors: Iterable[int], max_k: int | None = 5, timeout: float | None = None) -> DataFrame:
    """A row of schema.RUNS for each cell of the grid, mined with bitmaps; computation time is that of the levels. An error in a cell is its status."""
    rows = []
    whole, pairs = E.held_orders(pairs)
    for s in supports:
        for strategy in strategies:
            for p in processors:
                work: dict[int, Work] = {}
                status, seconds, n = timed(spark, lambda s=s, strategy=strategy, p=p, work=work: mine(pairs, s, max_k=max_k, counting="bitmap", strategy=strategy, processors=p, work=work).count(), timeout)
                rows.append((float(s), "wdpa", strategy, p, seconds, sum(w.seconds for w in work.values()), n, status))
    whole.unpersist()
    return spark.createDataFrame(rows, S.RUNS)


def scalability(spark: SparkSession, sf_dir: str, sizes: Iterable[tuple[int, int]], supports: Iterable[float]) -> list[dict]:
    """For each (sample size, number of items) and support: orders kept, itemsets, seconds and status."""
    out = []
    for n, items in sizes:
        config = S.MiningConfig(sample_size=n, max_items=items)
        pairs = B.distinct_pairs(B.load_basket(*B.tpch_tables(spark, sf_dir), config), item_col="product_name").persist()
        for s in supports:
            status, seconds, found = timed(spark, lambda pairs=pairs, s=s: mine(pairs, s).count())
            out.append({"sample_size": n, "max_items": items, "min_support": s, "itemsets": found, "seconds": seconds, "status": status})
        pairs.unpersist()
    return out
