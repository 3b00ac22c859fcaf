"""A benchmark as one call: the miners that a configuration switches on, at each support, with statuses and speedups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartloom import schema as S
from cartloom.operators import encode as E
from cartloom.plans.mine import PRESETS, Work, mine, mine_fpgrowth
from cartloom.plans.sweeps import timed

DEFAULT = (S.Algorithm("wdpa", True, ("BL", "CL", "BWT", "CWT"), (1, 2, 4, 8, 16), 5),)


def run_benchmark(spark: SparkSession, pairs: DataFrame, config: S.MiningConfig) -> DataFrame:
    """Rows of schema.BENCHMARK for pairs (order_id, item), a row for each run, in the order of supports and miners.

    The orders are grouped once and held for all runs. Every miner is run whatever the size of the basket, as none has a dense table in memory. A run's total time
    is its wall clock, its computation time that of its levels from 2 on, candidates and counts (the total for
    miners without levels of their own); candidates and intersections are the levels' own counters. A speedup is measured against the same strategy on one processor by
    computation time, else against the traditional miner, else the naive one, whichever succeeded.
    """
    whole, pairs = E.held_orders(pairs)
    try:
        return _run(spark, pairs, config)
    finally:
        whole.unpersist()


def _run(spark: SparkSession, pairs: DataFrame, config: S.MiningConfig) -> DataFrame:
    algorithms = {a.name: a for a in config.algorithms or DEFAULT if a.enabled}
    rows = []
    for support in config.min_supports:
        general: tuple[str, float] | None = None

        def add(name: str, strategy: str | None, p: int, job, timeout: float | None = None, work: dict | None = None, base: tuple[str, float] | None = None, support=support) -> tuple:
            status, seconds, n = timed(spark, job, timeout)
            computation = sum(w.seconds for w in work.values()) if work else seconds
            speedup = base[1] / computation if base and status == "success" and computation > 0 else None
            counters = (sum(w.candidates for w in work.values()), sum(w.intersections for w in work.values())) if work else (None, None)
            rows.append((float(support), name, strategy, p, seconds, computation, n, status, base[0] if speedup else None, speedup, speedup / p if speedup else None, *counters))
            return status, seconds, computation

        if a := algorithms.get("traditional"):
            status, seconds, _ = add("traditional", None, 1, lambda s=support: mine_fpgrowth(pairs, s).count(), a.timeout)
            general = ("traditional", seconds) if status == "success" else None
        if a := algorithms.get("naive_parallel"):
            p = a.processors[0]
            status, seconds, _ = add("naive_parallel", None, p, lambda s=support: mine(pairs, s, **PRESETS["naive"]).count(), a.timeout, base=general)
            general = general or (("naive_parallel", seconds) if status == "success" else None)
        if a := algorithms.get("wdpa"):
            for strategy in a.strategies:
                own = None
                for p in a.processors:
                    work: dict[int, Work] = {}
                    job = lambda s=support, strategy=strategy, p=p, work=work, k=a.max_k: mine(pairs, s, max_k=k, counting="bitmap", strategy=strategy, processors=p, work=work).count()
                    base = own or (general if p > 1 else None)
                    status, _, computation = add("wdpa", strategy, p, job, timeout=a.timeout, work=work, base=base)
                    if p == 1 and status == "success":
                        own = (f"wdpa {strategy} 1p", computation)
                        rows[-1] = (*rows[-1][:8], own[0], 1.0, 1.0, *rows[-1][11:])
        if a := algorithms.get("ye_parallel"):
            for p in a.processors:
                add("ye_parallel", None, p, lambda s=support, k=a.max_k: mine(pairs, s, **(PRESETS["ye"] | {"max_k": k})).count(), timeout=a.timeout, base=general)
    return spark.createDataFrame(rows, S.BENCHMARK)
