"""Tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import itertools
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession


#: The folders that were made where no shared one is set, by application.
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own on a local master; executors elsewhere couldn't see it, so that raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own.get(spark.sparkContext.applicationId)
    if not root:
        root = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="cartloom-")
        atexit.register(shutil.rmtree, root, True)
    return root.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Python workers can import this package."""
    here, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))


def free_name(taken: list[str], name: str) -> str:
    """name, or the first of name_1, name_2, ... that no column has; case doesn't tell names apart."""
    used = {x.lower() for x in taken}
    return next(x for x in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))) if x.lower() not in used)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name, or any of this pattern."""
    try:
        spark.read.text(path).schema  # noqa: B018  (resolves the path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each job in here go when it ends, not when the driver's memory is cleaned: for jobs whose results are tables."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def observed(df: DataFrame, name: str, metrics: dict[str, Column], keep: Column | None = None) -> tuple[DataFrame, dict]:
    """df as a table, without the rows that keep rules out, and the metrics of all its rows, from the job that writes it."""
    watch = Observation()
    rows = df.observe(watch, *[x.alias(n) for n, x in metrics.items()])
    table = written(rows if keep is None else rows.filter(keep), name)
    return table, watch.get
