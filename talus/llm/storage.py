"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset a temporary one, in local sessions only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
        app = spark.sparkContext.applicationId
        at = _LOCAL.setdefault(app, _LOCAL.get(app) or "file://" + tempfile.mkdtemp(prefix="talus-"))
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/talus-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, stay: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and lost executors cost a re-read. With
    stay it outlives the scratch() it is written in."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    if not stay:
        for made in _SCOPES[-1:]:
            made.append(path)
    return out


def release(df: DataFrame) -> None:
    """Remove a table that keep() wrote, once nothing lazy reads it any more."""
    _remove(df.sparkSession, df.kept_at)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that keep() writes within are removed at the end, but those of keep() with ``stay``. What is computed within
    must be done by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)
