"""Outlines and points from shapefiles and GeoJSON, and masks of the cells that outlines cover.

Outlines are a table of rings: (shape INT, ring INT, x ARRAY<DOUBLE>, y ARRAY<DOUBLE>); holes are rings too, as a place is
inside where it lies in an odd number of a shape's rings. Readers go through a file in one task; attributes (.dbf) of
shapefiles are not read, properties of GeoJSON are kept as JSON text.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.grid import KEY, Grid
from talus.sources.ranges import Reader

ENDINGS = (".shp", ".geojson")
_SHAPE = "shape int, ring int, x array<double>, y array<double>, z array<double>, properties string"


def _shapefile(file: Reader) -> Iterator[tuple]:
    """(shape, ring, x, y, z, properties) for each ring, or point, of a shapefile."""
    place, number = 100, 0
    while place + 8 <= file.size:
        length = struct.unpack(">ii", file.read(place, 8))[1] * 2
        raw = file.read(place + 8, length)
        place, number = place + 8 + length, number + 1
        kind = struct.unpack_from("<i", raw)[0]
        if kind in (1, 11, 21):
            x, y = struct.unpack_from("<2d", raw, 4)
            yield number - 1, 0, [x], [y], [struct.unpack_from("<d", raw, 20)[0] if kind == 11 else None], None
        elif kind in (5, 15, 25):
            rings, n = struct.unpack_from("<2i", raw, 36)
            starts = [*struct.unpack_from(f"<{rings}i", raw, 44), n]
            flat = struct.unpack_from(f"<{2 * n}d", raw, 44 + 4 * rings)
            for k in range(rings):
                a, b = starts[k], starts[k + 1]
                yield number - 1, k, list(flat[2 * a : 2 * b : 2]), list(flat[2 * a + 1 : 2 * b : 2]), None, None
        elif kind:
            raise NotImplementedError(f"shapes of type {kind} are not read: points and polygons are")


def _geojson(file: Reader) -> Iterator[tuple]:
    """The same of GeoJSON; members of collections count as one shape."""
    whole = json.loads(file.read(0, file.size))
    features = whole["features"] if whole.get("type") == "FeatureCollection" else [whole]
    for number, feature in enumerate(features):
        feature = feature if feature.get("type") == "Feature" else {"geometry": feature}
        said = json.dumps(feature.get("properties") or {})
        waiting, ring = [feature.get("geometry")], 0
        while waiting:
            form = waiting.pop(0) or {}
            kind, at = form.get("type"), form.get("coordinates")
            if kind == "GeometryCollection":
                waiting += form["geometries"]
                continue
            if kind in ("Point", "MultiPoint"):
                rings = [[p] for p in ([at] if kind == "Point" else at)]
            elif kind in ("Polygon", "MultiPolygon"):
                rings = at if kind == "Polygon" else [r for p in at for r in p]
            elif kind is None:
                rings = []
            else:
                raise NotImplementedError(f"geometries of type {kind} are not read: points and polygons are")
            for r in rings:
                yield number, ring, [float(p[0]) for p in r], [float(p[1]) for p in r], [float(p[2]) if len(p) > 2 else None for p in r], said
                ring += 1


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shape, ring, x, y, z, properties) of a file."""
    parse = _shapefile if path.lower().endswith(".shp") else _geojson

    def rings(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shape", "ring", "x", "y", "z", "properties"]
        types = [pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * 3, pa.string()]
        held, corners = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

        with Reader(path) as file:
            for row in parse(file):
                held.append(row)
                corners += len(row[2])
                if corners > 1 << 17:
                    yield batch()
                    held, corners = [], 0
        if held:
            yield batch()

    return spark.range(0, 1, 1, 1).mapInArrow(rings, _SHAPE)


def read_points(spark: SparkSession, path: str, data_column: str = "z") -> DataFrame:
    """pid, x, y and z of a file of points; with another data column than z, that property of GeoJSON."""
    df = read(spark, path).where("size(x) = 1")
    z = F.col("z")[0] if data_column == "z" else F.get_json_object("properties", f"$.{data_column}").cast("double")
    return df.select(F.struct("shape", "ring").alias("pid"), F.col("x")[0].alias("x"), F.col("y")[0].alias("y"), z.alias("z"))


def cells_within(rings: DataFrame, grid: Grid) -> DataFrame:
    """row, col and shape of the cells whose middle lies in a shape. Each side of a ring is spread to the rows it crosses;
    the crossings of a row, sorted, pair up to runs of columns. Sides hold their upper end and not their lower one, and runs
    their left end and not their right one, so shapes that touch share no cell. The grid must have a height and a width, and its
    cells must lie along the axes."""
    a, b, c, d, e, f = grid.transform
    if b or d or grid.height is None or grid.width is None:
        raise ValueError("outlines need a grid along the axes, of known height and width")
    whole = rings.where("size(x) > 2").select(
        "shape",
        F.posexplode(F.transform("x", lambda v: (v - c) / a - 0.5)).alias("k", "c0"),
        "x",
        "y",
    )
    # The corner that follows, counted from 1; the last is followed by the first.
    after = F.when(F.col("k") + 1 < F.size("x"), F.col("k") + 2).otherwise(F.lit(1))
    row_of = lambda v: (v - f) / e - 0.5
    sides = whole.select("shape", "c0", ((F.element_at("x", after) - c) / a - 0.5).alias("c1"), row_of(F.element_at("y", F.col("k") + 1)).alias("r0"), row_of(F.element_at("y", after)).alias("r1"))
    sides = sides.where("r0 != r1")
    first = F.greatest(F.ceil(F.least("r0", "r1")), F.lit(0)).cast("int")
    last = F.least(F.ceil(F.greatest("r0", "r1")) - 1, F.lit(grid.height - 1)).cast("int")
    spread = sides.withColumns({"_a": first, "_b": last}).where("_a <= _b").withColumn("row", F.explode(F.sequence("_a", "_b")))
    at = F.col("c0") + (F.col("row") - F.col("r0")) * (F.col("c1") - F.col("c0")) / (F.col("r1") - F.col("r0"))
    w = Window.partitionBy("shape", "row").orderBy("at")
    paired = spread.select("shape", "row", at.alias("at")).select("shape", "row", "at", F.lead("at").over(w).alias("to"), F.row_number().over(w).alias("n")).where("n % 2 = 1 and to is not null")
    left, right = F.greatest(F.ceil("at"), F.lit(0)).cast("int"), F.least(F.ceil("to") - 1, F.lit(grid.width - 1)).cast("int")
    runs = paired.select("shape", "row", left.alias("_a"), right.alias("_b")).where("_a <= _b")
    return runs.select("row", F.explode(F.sequence("_a", "_b")).alias("col"), "shape")


def mask(rings: DataFrame, grid: Grid) -> DataFrame:
    """The cells that any outline covers."""
    return cells_within(rings, grid).select(*KEY).distinct()
