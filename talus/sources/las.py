"""LAS point clouds (versions 1.0 to 1.4, all point formats): tasks read ranges of records of a fixed length. LAZ is packed and
needs a library that is not here."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from talus.sources.ranges import Reader

#: Records that are read at once, and records for one task.
BATCH, TASK = 1 << 17, 1 << 20


def heading(file: Reader) -> dict:
    """Where records start, how long they are, how many there are, their format, and the scales and offsets of coordinates."""
    raw = file.read(0, 227)
    if raw[:4] != b"LASF":
        raise ValueError("this is no LAS file")
    version = raw[24], raw[25]
    start, (kind, length, count) = struct.unpack_from("<I", raw, 96)[0], struct.unpack_from("<BHI", raw, 104)
    if kind & 0x80:
        raise NotImplementedError("packed points (LAZ) are not read")
    if version >= (1, 4) and struct.unpack_from("<H", raw, 94)[0] >= 255:
        count = struct.unpack("<Q", file.read(247, 8))[0] or count
    return {"start": start, "format": kind, "length": length, "count": count, "scale": struct.unpack_from("<3d", raw, 131), "offset": struct.unpack_from("<3d", raw, 155)}


def record(kind: int, length: int) -> np.dtype:
    """The fields that are read of a record. From format 6 on a byte holds the returns and the class stands a byte later."""
    late = kind >= 6
    names = ["X", "Y", "Z", "intensity", "returns", "classification"]
    return np.dtype({"names": names, "formats": ["<i4", "<i4", "<i4", "<u2", "u1", "u1"], "offsets": [0, 4, 8, 12, 14, 16 if late else 15], "itemsize": length})


def read(spark: SparkSession, path: str) -> DataFrame:
    """pid (number of the record), x, y, z, intensity, return_number and classification."""
    with Reader(path) as file:
        head = heading(file)
    dtype, count = record(head["format"], head["length"]), head["count"]
    late = head["format"] >= 6
    chunks = -(-count // BATCH)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Reader(path) as file:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    first, n = k * BATCH, min(BATCH, count - k * BATCH)
                    found = np.frombuffer(file.read(head["start"] + first * dtype.itemsize, n * dtype.itemsize), dtype)
                    xyz = [found[c] * s + o for c, s, o in zip("XYZ", head["scale"], head["offset"], strict=True)]
                    returns, kinds = found["returns"] & (15 if late else 7), found["classification"] & (255 if late else 31)
                    arrays = [np.arange(first, first + n), *xyz, found["intensity"].astype(np.int32), returns.astype(np.int32), kinds.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["pid", "x", "y", "z", "intensity", "return_number", "classification"])

    tasks = max(1, -(-count // TASK))
    return spark.range(0, chunks, 1, tasks).mapInArrow(points, "pid long, x double, y double, z double, intensity int, return_number int, classification int")
