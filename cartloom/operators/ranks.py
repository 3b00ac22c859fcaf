"""Rows and values by rank, from histograms that are refined, so that no task sorts or holds all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a histogram, and rows of a cell that are sorted instead of being cut on.
CELLS, FEW = 4096, 10_000


def ranked_values(values: DataFrame, ranks: list[int]) -> list[int]:
    """The values of column v (long, no nulls) at ranks (from 0, in ascending order): exact, by histograms of its range.

    Each pass cuts the range that holds a rank to one of CELLS cells, so there are six at most, and a pass brings a row for each
    cell to the driver.
    """
    size = values.agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).first()
    if any(not 0 <= r < size.n for r in ranks):
        raise ValueError(f"no such rank among {size.n}")
    # a rank -> its range and how many values lie before it
    state = {r: (size.a, size.b, 0) for r in ranks}
    while open_ := {x for x in state.values() if x[0] < x[1]}:
        for low, high, before in open_:
            width = -(-(high - low + 1) // CELLS)
            cell = F.floor((F.col("v").cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("long")
            counts = values.filter(F.col("v").between(low, high)).groupBy(cell.alias("c")).count().collect()
            for r in [r for r, x in state.items() if x == (low, high, before)]:
                done = before
                for c in sorted(counts, key=lambda x: x.c):
                    if done + c["count"] > r:
                        state[r] = (low + c.c * width, min(high, low + (c.c + 1) * width - 1), done)
                        break
                    done += c["count"]
    return [state[r][0] for r in ranks]


def median(values: DataFrame) -> float | None:
    """The exact median of column v: of an even number the mean of the two in the middle; None without values."""
    n = values.count()
    if not n:
        return None
    a, b = ranked_values(values, [(n - 1) // 2, n // 2])
    return (a + b) / 2


def least_by_digest(rows: DataFrame, digest: Column, order: list[str], n: int) -> DataFrame:
    """The n rows with the least digest (hexadecimal text, evenly spread), ties by order: exactly n, or all if there are fewer.

    Histograms of the digest's first letters find the cell in which the n-th row is; rows before the cell are taken by a
    filter, and the cell alone is sorted once it has FEW rows.
    """
    prefix, wanted = "", n
    cut = F.lit(False)
    while True:
        inside = digest.startswith(prefix) if prefix else F.lit(True)
        size = len(prefix) + 3
        counts = rows.filter(inside).groupBy(F.substring(digest, 1, size).alias("c")).count().collect()
        cell = None
        for c in sorted(counts, key=lambda x: x.c):
            if c["count"] > wanted:
                cell = c
                break
            wanted -= c["count"]
        if cell is None:
            return rows.filter(cut | inside)  # all that the cell has
        cut = cut | (inside & (F.substring(digest, 1, size) < cell.c))
        prefix = cell.c
        if cell["count"] <= FEW or size >= 32:
            break
    whole = rows.filter(cut)
    if not wanted:
        return whole
    last = rows.filter(digest.startswith(prefix)).withColumn("_place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(digest, *order))).filter(F.col("_place") <= wanted).drop("_place")
    return whole.unionByName(last)
