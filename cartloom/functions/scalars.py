"""Scalar functions of the reports, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(x: Column, y: Column) -> Column:
    """x / y, 0 where y isn't positive."""
    return F.when(y > 0, x / y).otherwise(0.0)


def overhead_percent(total: Column, computation: Column) -> Column:
    return F.greatest(F.lit(0.0), safe_divide(total - computation, total) * 100)


def parse_run_key(key: Column) -> tuple[Column, Column]:
    """Strategy and processors of a key like wdpa_CWT_8p; null for others."""
    shape = r"^wdpa_([^_]+)_(\d+)p$"
    hit = key.rlike(shape)
    return F.when(hit, F.regexp_extract(key, shape, 1)), F.when(hit, F.regexp_extract(key, shape, 2).cast("int"))


#: Units of memory sizes in messages, in GiB; decimal ones are taken for binary ones.
UNITS = {"gib": 1.0, "gb": 1.0, "mib": 1 / 1024, "mb": 1 / 1024}


def memory_gib(text: Column) -> Column:
    """The first memory size of a message, in GiB; null without one. A size is a number, then a unit, with or without a space, and any signs around them."""
    parted = F.regexp_replace(F.regexp_replace(F.lower(text), "[^0-9a-z.]+", " "), "([0-9])([a-z])", "$1 $2")
    words = F.transform(F.split(parted, " +"), lambda w: F.trim(w, F.lit(".")))
    factor = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    pairs = F.transform(words, lambda w, i: F.struct(F.get(words, i - 1).try_cast("double").alias("size"), factor[w].alias("unit")))
    hit = F.get(F.filter(pairs, lambda p: p["size"].isNotNull() & p["unit"].isNotNull()), F.lit(0))
    return hit["size"] * hit["unit"]


def near(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    return F.abs(a - b) < F.lit(tolerance)
