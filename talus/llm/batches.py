"""Adding columns that a function computes from Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in an Arrow batch: whole texts travel in them, so fewer than Spark's default are held at a time.
ROWS_A_BATCH = 3000
_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded to ROWS_A_BATCH rows (a smaller setting stays)."""
    now = int(df.sparkSession.conf.get(_CONF))
    if now <= 0 or now > ROWS_A_BATCH:
        df.sparkSession.conf.set(_CONF, str(ROWS_A_BATCH))
    return df


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """run, with the memory that a task has freed given back to the system when the task ends. Spark reuses Python workers, and
    without this each keeps the most it ever needed while later stages need theirs."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return tidied


Compute = Callable[[pa.RecordBatch], list[pa.Array]]


def add_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Compute], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with further columns. make() runs once in each task and returns a function from a batch to the new arrays, in
    the order of fields; the batch has df's columns under their own names. An old column of the same name (compared
    without case) is replaced. Columns in drop are read but not returned.
    """
    new = {f.name.lower() for f in fields}
    old = [(i, f) for i, f in enumerate(df.schema.fields) if f.name.lower() not in new and f.name not in drop]
    schema = T.StructType([f for _, f in old] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(i) for i, _ in old] + compute(batch), names=names)
        del compute

    return bound_batches(df).mapInArrow(tidy(run), schema)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def shield(df: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """df with all columns but the needed ones under neutral names, so that they clash with no name of an operator's own."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    return df.select(*(F.col(q).alias(c if c in needed else f"_x{k}") for k, (c, q) in enumerate(zip(df.columns, quoted, strict=True))))


def restore(out: DataFrame, df: DataFrame, needed: tuple[str, ...], added: tuple[str, ...] = (), gone: tuple[str, ...] = ()) -> DataFrame:
    """The columns of df under their names again, but those that are gone or that the added ones replace, then the added ones."""
    new = {a.lower() for a in (*added, *gone)}
    old = [F.col(c if c in needed else f"_x{k}").alias(c) for k, c in enumerate(df.columns) if c.lower() not in new]
    return out.select(*old, *added)
