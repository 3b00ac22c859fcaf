"""Reports over runs: rows (support, strategy, processors, computation_time, total_time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartloom.functions.scalars import near, overhead_percent, safe_divide

ORDER = ("BL", "CL", "BWT", "CWT")


def successful(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'success'")


def with_computation(runs: DataFrame) -> DataFrame:
    """Runs whose missing computation time is their total time."""
    return runs.withColumn("computation_time", F.coalesce("computation_time", "total_time"))


def run_keys(runs: DataFrame) -> DataFrame:
    """The distinct supports, strategies and processors of runs: kind and key, as texts."""
    each = [runs.select(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in ("support", "strategy", "processors")]
    return each[0].union(each[1]).union(each[2]).filter("key IS NOT NULL").distinct()


def summary_rows(runs: DataFrame) -> DataFrame:
    """A row for each algorithm, strategy and number of processors: how many runs and successes, mean time of these, most itemsets."""
    ok = F.col("status") == "success"
    return runs.groupBy("algorithm", "strategy", "processors").agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("successes"), F.avg(F.when(ok, F.col("total_time"))).alias("mean_time"), F.max("itemsets").alias("most_itemsets")
    )


def scaling_summary(runs: DataFrame, title: str = "Processor scaling") -> DataFrame:
    """A text report of the successful runs of one strategy and support, by processors, against the fewest: n and value."""
    good = scaling_vs_lowest(successful(runs))
    line = lambda *x: F.format_string("%-12s %14s %10s %12s", *x)
    body = good.select(
        (F.row_number().over(Window.partitionBy("support", "strategy").orderBy("processors")) + 2).alias("n"),
        line(F.col("processors").cast("string"), F.format_number(F.col("total_time") / 60, 2), F.format_string("%.2fx", "speedup"), F.format_string("%.1f%%", F.col("efficiency") * 100)).alias("value"),
    )
    head = runs.sparkSession.createDataFrame([(1, title), (2, "%-12s %14s %10s %12s" % ("processors", "minutes", "speedup", "efficiency"))], "n int, value string")
    best = good.agg(F.min(F.struct("total_time", "processors", "speedup")).alias("b")).filter("b IS NOT NULL")
    foot = best.select(F.lit(1_000_000).alias("n"), F.format_string("fastest: %d processors, %.2f minutes, %.2fx", "b.processors", F.col("b.total_time") / 60, "b.speedup").alias("value"))
    return head.union(body).union(foot)


def with_baseline(runs: DataFrame) -> DataFrame:
    """Each run with the computation time of its own one-processor run, null if there is none."""
    base = runs.filter("processors = 1").select("support", "strategy", F.col("computation_time").alias("baseline_time"))
    return runs.join(base, ["support", "strategy"], "left")


def speedup_metrics(runs: DataFrame) -> DataFrame:
    """speedup, efficiency, time_saved and percent_faster against the run's baseline; 0 where there is none."""
    x, base = F.col("computation_time"), F.coalesce("baseline_time", F.lit(0.0))
    speedup = safe_divide(base, x)
    return with_baseline(runs).select(
        "support", "strategy", "processors", base.alias("baseline_time"), x.alias("parallel_time"), speedup.alias("speedup"),
        (speedup / F.col("processors")).alias("efficiency"), (base - x).alias("time_saved"), (safe_divide(base - x, base) * 100).alias("percent_faster"),
    )


def overhead(runs: DataFrame) -> DataFrame:
    return runs.select("support", "strategy", "processors", overhead_percent(F.col("total_time"), F.col("computation_time")).alias("overhead_pct"))


def by_processors(rows: DataFrame, value: str, processors: list[int], average: bool = False) -> DataFrame:
    """A column p{n} for each number of processors; optionally the mean of them."""
    wide = rows.groupBy("support", "strategy").pivot("processors", processors).agg(F.first(value))
    out = wide.select("support", "strategy", *[F.col(f"`{p}`").alias(f"p{p}") for p in processors])
    return out.withColumn("avg", sum(F.col(f"p{p}") for p in processors) / len(processors)) if average else out


def strategy_averages(runs: DataFrame) -> DataFrame:
    """Mean, least and largest speedup and efficiency of each strategy over supports and processors; only positive values count."""
    m = speedup_metrics(runs).filter("speedup > 0")
    return m.groupBy("strategy").agg(*[f(c).alias(f"{n}_{c}") for c in ("speedup", "efficiency") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])


def at_most_processors(runs: DataFrame) -> DataFrame:
    """The runs with the largest number of processors of their support and strategy."""
    most = runs.groupBy("support", "strategy").agg(F.max("processors").alias("processors"))
    return runs.join(most, ["support", "strategy", "processors"], "left_semi")


def best_config(runs: DataFrame) -> DataFrame:
    """The fastest strategy of each support at its largest number of processors; ties go to the first of ORDER."""
    most = runs.groupBy("support").agg(F.max("processors").alias("processors"))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("strategy"))
    return runs.join(most, ["support", "processors"], "left_semi").groupBy("support").agg(
        F.min_by("strategy", F.struct("computation_time", rank)).alias("strategy"), F.min("computation_time").alias("computation_time")
    )


def speedup_of_means(runs: DataFrame) -> DataFrame:
    """The ratio of mean times over supports, which isn't the mean of ratios."""
    means = runs.groupBy("strategy", "processors").agg(F.avg("computation_time").alias("mean_time"))
    base = means.filter("processors = 1").select("strategy", F.col("mean_time").alias("base"))
    return means.join(base, "strategy").select("strategy", "processors", "mean_time", safe_divide(F.col("base"), F.col("mean_time")).alias("speedup"))


def against_naive(runs: DataFrame, naive: DataFrame) -> DataFrame:
    """Mean times of all runs and of the naive miner (support, total_time), and their ratio."""
    a = runs.agg(F.avg("computation_time").alias("wdpa_avg"))
    b = naive.agg(F.avg("total_time").alias("naive_avg"))
    return a.crossJoin(b).select("wdpa_avg", "naive_avg", safe_divide(F.col("naive_avg"), F.col("wdpa_avg")).alias("ratio"))


def mean_efficiency(runs: DataFrame) -> DataFrame:
    return speedup_metrics(runs).filter("efficiency > 0").groupBy("processors").agg(F.avg("efficiency").alias("mean_efficiency"))


def cross_run_scaling(runs: DataFrame, support: float) -> DataFrame:
    """Time by dataset size, strategy and processors at one support (within a tolerance), with the ratio to the smallest size; needs two sizes or more."""
    at = runs.filter(near(F.col("support"), F.lit(support)))
    several = at.agg(F.countDistinct("dataset_size").alias("n")).filter("n >= 2")
    first = F.first("computation_time").over(Window.partitionBy("strategy", "processors").orderBy("dataset_size"))
    kept = at.join(several, how="left_semi")
    return kept.select("dataset_size", "strategy", "processors", "computation_time", safe_divide(F.col("computation_time"), first).alias("growth"))


def scaling_vs_lowest(runs: DataFrame) -> DataFrame:
    """Speedup against the lowest number of processors that was run; efficiency is still for each processor."""
    first = F.first("total_time").over(Window.partitionBy("support", "strategy").orderBy("processors"))
    speedup = safe_divide(first, F.col("total_time"))
    return runs.select("support", "strategy", "processors", "total_time", speedup.alias("speedup"), (speedup / F.col("processors")).alias("efficiency"))


def filter_results(runs: DataFrame, processors: list[int], supports: list[float]) -> DataFrame:
    wanted = F.lit(False)
    for s in supports:
        wanted = wanted | near(F.col("support"), F.lit(s))
    return runs.filter(F.col("processors").isin(processors) & wanted)


def memory_admission(sizes: DataFrame, pair_limit: float = 8.0, matrix_limit: float = 10.0) -> DataFrame:
    """orders and items of a basket, GiB of the pair table and of the matrix, and whether a dense miner would run."""
    pairs = F.col("items").cast("double") * (F.col("items") - 1) / 2 * F.col("orders") / 2**30
    cells = F.col("orders").cast("double") * F.col("items") / 2**30
    return sizes.select(
        "orders", "items", pairs.alias("pair_gib"), cells.alias("matrix_gib"),
        # fixed values: the names of these statuses
        F.when(pairs > pair_limit, "skipped_memory_error").otherwise("success").alias("traditional_status"),
        F.when(cells > matrix_limit, "skipped_memory").otherwise("success").alias("naive_status"),
    )


def report_lines(runs: DataFrame) -> DataFrame:
    """A fixed-width text report: n and value."""
    m = speedup_metrics(runs)
    text = F.concat(F.lpad(F.format_number("support", 4), 8, " "), F.lit("  "), F.rpad("strategy", 5, " "), F.lpad(F.col("processors").cast("string"), 4, " "), F.lpad(F.format_number("parallel_time", 2), 10, " "), F.lpad(F.format_number("speedup", 2), 8, " "))
    return m.select(F.row_number().over(Window.orderBy("support", "strategy", "processors")).alias("n"), text.alias("value"))


def detailed_report(runs: DataFrame, levels: DataFrame, processors: list[int]) -> DataFrame:
    """The five tables of a detailed summary, with averages and best configurations, as lines: n and value.

    runs (support, strategy, processors, computation_time, total_time), levels (support, k, itemsets).
    A report has a line for each support and strategy, so its lines are numbered in one task.
    """
    m = speedup_metrics(runs).withColumn("percent", F.col("efficiency") * 100)
    wide = [
        ("1 Computation time (s)", by_processors(runs, "computation_time", processors)),
        ("2 Speedup", by_processors(m, "speedup", processors)),
        ("3 Efficiency (%)", by_processors(m, "percent", processors)),
        ("4 Overhead (%)", by_processors(overhead(runs), "overhead_pct", processors)),
    ]
    head = "".join(f"{f'{p}p':>10}" for p in processors)
    cell = lambda c: F.lpad(F.coalesce(F.format_number(c, 2), F.lit("-")), 10, " ")
    key = [F.lpad(F.format_number("support", 4), 8, " "), F.lit("  "), F.rpad("strategy", 6, " ")]
    parts = [t.select(F.lit(title).alias("section"), F.col("support"), F.col("strategy"), F.concat(*key, *[cell(f"p{p}") for p in processors]).alias("value")) for title, t in wide]
    parts.append(levels.select(F.lit("5 Itemsets by level"), "support", F.format_string("%02d", "k"), F.concat(key[0], F.lit("  k="), F.col("k").cast("string"), F.lpad(F.format_number("itemsets", 0), 10, " "))))
    averages = strategy_averages(runs)
    parts.append(averages.select(F.lit("6 Averages"), F.lit(0.0), "strategy", F.concat(F.rpad("strategy", 6, " "), *[cell(f"{n}_speedup") for n in ("avg", "min", "max")])))
    parts.append(best_config(runs).select(F.lit("7 Best at most processors"), "support", "strategy", F.concat(*key, cell("computation_time"))))
    spark = runs.sparkSession
    titles = spark.createDataFrame([(t, -1.0, "", t[2:] + (head if t[0] in "1234" else "")) for t in ("1 Computation time (s)", "2 Speedup", "3 Efficiency (%)", "4 Overhead (%)", "5 Itemsets by level", "6 Averages", "7 Best at most processors")], "section string, support double, strategy string, value string")
    lines = titles
    for part in parts:
        lines = lines.union(part)
    return lines.select(F.row_number().over(Window.orderBy("section", "support", "strategy")).alias("n"), "value")


#: Published computation times (s) for 1, 2, 4, 8 and 16 processors, and their overhead (%).
PROCESSORS = (1, 2, 4, 8, 16)
PUBLISHED_TIMES = {
    (0.0008, "BL"): (13.38, 13.56, 9.29, 5.93, 3.96), (0.0008, "CL"): (13.67, 9.99, 6.48, 7.77, 4.95),
    (0.0008, "BWT"): (13.54, 13.47, 10.30, 7.99, 6.23), (0.0008, "CWT"): (14.34, 10.61, 7.10, 5.41, 5.71),
    (0.001, "BL"): (8.87, 8.23, 4.77, 3.34, 2.68), (0.001, "CL"): (8.15, 7.64, 4.23, 3.21, 2.81),
    (0.001, "BWT"): (8.53, 9.87, 6.61, 5.02, 3.93), (0.001, "CWT"): (8.55, 7.44, 4.47, 3.57, 3.35),
    (0.0015, "BL"): (4.85, 5.87, 2.71, 2.01, 1.77), (0.0015, "CL"): (4.65, 3.37, 2.46, 1.68, 1.66),
    (0.0015, "BWT"): (4.97, 4.81, 3.40, 2.50, 2.02), (0.0015, "CWT"): (4.89, 3.48, 2.30, 1.80, 1.75),
    (0.002, "BL"): (4.46, 4.36, 1.81, 1.33, 1.24), (0.002, "CL"): (3.13, 2.30, 1.47, 1.11, 1.22),
    (0.002, "BWT"): (3.28, 4.77, 2.30, 1.65, 1.35), (0.002, "CWT"): (3.30, 2.30, 1.50, 1.14, 1.17),
    (0.003, "BL"): (2.70, 1.35, 0.95, 0.86, 0.76), (0.003, "CL"): (1.62, 1.18, 0.74, 0.65, 0.72),
    (0.003, "BWT"): (1.70, 1.70, 1.16, 0.96, 0.81), (0.003, "CWT"): (1.71, 1.12, 0.73, 0.66, 0.74),
}
PUBLISHED_OVERHEAD = {
    (0.0008, "BL"): (57.7, 50.3, 60.4, 69.9, 77.8), (0.0008, "CL"): (51.5, 61.1, 69.1, 66.0, 76.8),
    (0.0008, "BWT"): (58.8, 60.5, 64.7, 70.7, 76.1), (0.0008, "CWT"): (58.7, 63.9, 74.6, 79.0, 79.0),
    (0.001, "BL"): (52.8, 42.7, 57.4, 63.8, 71.8), (0.001, "CL"): (43.9, 46.6, 60.1, 70.0, 71.0),
    (0.001, "BWT"): (56.8, 50.4, 61.5, 66.7, 74.2), (0.001, "CWT"): (55.0, 58.1, 70.9, 74.8, 77.3),
    (0.0015, "BL"): (63.2, 19.8, 38.2, 50.7, 48.9), (0.0015, "CL"): (25.9, 37.2, 43.9, 51.1, 58.8),
    (0.0015, "BWT"): (43.2, 43.7, 54.3, 56.8, 67.4), (0.0015, "CWT"): (42.4, 47.1, 65.5, 65.0, 70.8),
    (0.002, "BL"): (32.5, 38.5, 31.3, 40.4, 48.2), (0.002, "CL"): (23.9, 28.0, 31.1, 52.5, 53.1),
    (0.002, "BWT"): (33.7, 28.4, 46.8, 52.8, 61.1), (0.002, "CWT"): (38.2, 44.1, 50.8, 64.6, 67.4),
    (0.003, "BL"): (13.9, 62.5, 12.2, 34.4, 43.2), (0.003, "CL"): (15.8, 21.2, 34.3, 40.9, 46.1),
    (0.003, "BWT"): (23.4, 30.7, 41.4, 40.0, 62.0), (0.003, "CWT"): (23.8, 31.5, 52.0, 56.7, 52.6),
}
NAIVE_TIMES = {0.0008: 2695.3553, 0.001: 1690.8218, 0.0015: 797.0670, 0.002: 438.7325, 0.003: 203.2878}
LEVELS = {0.0008: (2289, 2836, 448, 2), 0.001: (1807, 1976, 241, 2), 0.0015: (1172, 976, 64, 0), 0.002: (848, 590, 25, 0), 0.003: (519, 282, 7, 0)}


def published_rows() -> list[tuple]:
    """(support, strategy, processors, computation_time, total_time); totals follow from the overhead."""
    return [
        (s, name, p, t, round(t / (1 - o / 100), 6))
        for (s, name), times in PUBLISHED_TIMES.items()
        for p, t, o in zip(PROCESSORS, times, PUBLISHED_OVERHEAD[s, name], strict=True)
    ]


def published_runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(published_rows(), "support double, strategy string, processors int, computation_time double, total_time double")


def published_naive(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NAIVE_TIMES.items()), "support double, total_time double")


def published_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, k + 1, n) for s, ns in LEVELS.items() for k, n in enumerate(ns)], "support double, k int, itemsets long")
