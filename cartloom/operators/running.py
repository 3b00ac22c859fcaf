"""Row numbers and running sums over a total order, without a task that sees all rows.

Rows are range-partitioned and written with the number of their partition; a sum for each partition,
a few rows, shifts what is counted inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.sources.shared import free_name, written


def running_sums(rows: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """rows with a column for each of values: its sum over all rows before, by order, which must be total. Nulls count 0."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, base = free_name(rows.columns, "_part"), free_name(rows.columns, "_base")
    own = {name: free_name([*rows.columns, part, base], f"_{name}_value") for name in values}
    keyed = rows.withColumns({own[name]: F.coalesce(x.cast("long"), F.lit(0)) for name, x in values.items()})
    placed = written(keyed.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "running")
    totals = placed.groupBy(part).agg(*[F.sum(x).alias(x) for x in own.values()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = totals.select(part, F.struct(*[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in own.values()]).alias(base))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(bases), part)
    sums = [(F.col(base)[x] + F.coalesce(F.sum(x).over(inside), F.lit(0))).cast("long").alias(name) for name, x in own.items()]
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c not in values], *sums)


#: Up to so many rows, if their number is known, are numbered in one task.
ONE_TASK = 100_000


def numbered(rows: DataFrame, order: list[Column], name: str, known: int | None = None) -> DataFrame:
    """rows with their number in order, from 0. known: how many rows there are, if that is known."""
    if known is not None and known <= ONE_TASK:
        return rows.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    return running_sums(rows, order, {name: F.lit(1)})
