"""Readers and writers of rasters and points: Parquet, CSV, ASCII grids and XYZ text. GeoTIFF, LAS and outlines have modules
of their own, which ``open_raster`` and ``open_points`` call by a file's ending."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.grid import Grid, clean
from talus.sources import geotiff, las, outlines

TIFF = (".tif", ".tiff")


def open_raster(spark: SparkSession, path: str, grid: Grid | None = None, downsample: int = 1, nodata: float | None = None) -> tuple[DataFrame, Grid]:
    """A raster and its grid from any format that is known: GeoTIFF, or one of read_raster()."""
    if not path.lower().endswith(TIFF):
        return read_raster(spark, path, grid, downsample, nodata)
    df, found = geotiff.read(spark, path, grid or Grid())
    return _thinned(df.withColumn("z", clean(F.col("z"), found.nodata if nodata is None else nodata)), found, downsample)


def _thinned(df: DataFrame, grid: Grid, downsample: int) -> tuple[DataFrame, Grid]:
    if downsample <= 1:
        return df, grid
    from talus.grid import downsample as thin

    a, b, c, d, e, f = grid.transform
    size = {k: v and -(-v // downsample) for k, v in (("height", grid.height), ("width", grid.width))}
    return thin(df, downsample), replace(grid, transform=(a * downsample, b * downsample, c, d * downsample, e * downsample, f), **size)


def read_raster(spark: SparkSession, path: str, grid: Grid | None = None, downsample: int = 1, nodata: float | None = None) -> tuple[DataFrame, Grid]:
    """A raster and its grid from what Spark's own readers read. Formats by ending: .parquet and .csv with row, col, z; .asc."""
    grid = grid or Grid()
    nodata = grid.nodata if nodata is None else nodata
    if path.lower().endswith((*TIFF, ".vrt")):
        raise NotImplementedError("GeoTIFF is read by open_raster(); virtual rasters are not read")
    if path.endswith(".asc"):
        df, grid = _ascii(spark, path, grid)
        nodata = grid.nodata
    elif path.endswith(".csv"):
        df = spark.read.csv(path, header=True, schema="row int, col int, z double")
    else:
        df = spark.read.parquet(path)
    bands = [c for c in df.columns if c not in ("row", "col")]
    if "z" not in bands:
        raise ValueError("a raster has the columns row, col and z")
    if any(c.startswith("band") for c in bands):
        raise ValueError("a raster has one band")
    df = df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), clean(F.col("z"), nodata).alias("z"))
    return _thinned(df, grid, downsample)


def _ascii(spark: SparkSession, path: str, grid: Grid) -> tuple[DataFrame, Grid]:
    """An ASCII grid: six lines of heading, then rows of numbers. Lines are numbered by Spark's text reader, whose files hold
    one raster; only the heading comes to the driver."""
    lines = spark.read.text(path, wholetext=True)
    text = lines.select(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s*\n\s*").alias("lines"))
    head = {k.lower(): float(v) for k, v in (line.split()[:2] for line in text.select(F.slice("lines", 1, 6).alias("h")).first()["h"])}
    size, nrows = head["cellsize"], int(head["nrows"])
    west = head.get("xllcorner", head.get("xllcenter", 0.0) - size / 2)
    south = head.get("yllcorner", head.get("yllcenter", 0.0) - size / 2)
    grid = replace(grid, height=nrows, width=int(head["ncols"]), transform=(size, 0.0, west, 0.0, -size, south + nrows * size), nodata=head.get("nodata_value"))
    rows = text.select(F.posexplode(F.slice("lines", 7, 2**31 - 8)).alias("row", "line"))
    cells = rows.select("row", F.posexplode(F.split("line", r"\s+")).alias("col", "z"))
    return cells.select("row", "col", F.col("z").cast("double").alias("z")), grid


def write_raster(df: DataFrame, path: str, grid: Grid | None = None) -> None:
    """Parquet sorted by row and column (readers prune by both), CSV, or for rasters that one task can write a GeoTIFF or an
    ASCII grid."""
    cells = df.select("row", "col", "z")
    if path.lower().endswith(TIFF):
        geotiff.write(cells, path, grid or Grid())
        return
    if path.endswith(".csv"):
        cells.write.mode("overwrite").csv(path, header=True)
    elif path.endswith(".asc"):
        _write_ascii(cells, path, grid or Grid())
    else:
        cells.repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)


def _write_ascii(df: DataFrame, path: str, grid: Grid) -> None:
    size, nodata = grid.resolution, -9999.0 if grid.nodata is None else grid.nodata
    n = df.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")).first()
    _, _, west, _, _, north = grid.transform
    head = f"ncols {n.w}\nnrows {n.h}\nxllcorner {west}\nyllcorner {north - n.h * size}\ncellsize {size}\nNODATA_value {nodata}"
    full = df.sparkSession.range(n.h).select(F.col("id").cast("int").alias("row")).crossJoin(df.sparkSession.range(n.w).select(F.col("id").cast("int").alias("col")))
    cells = full.join(df, ["row", "col"], "left").select("row", "col", F.coalesce("z", F.lit(nodata)).alias("z"))
    lines = cells.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "z"))), lambda c: c["z"].cast("string")), " ").alias("value"))
    heading = df.sparkSession.createDataFrame([(-1, head)], "row int, value string")
    heading.union(lines).coalesce(1).sortWithinPartitions("row").select("value").write.mode("overwrite").text(path)


def open_points(spark: SparkSession, path: str, data_column: str = "z") -> DataFrame:
    """Points from any format that is known: LAS, shapefiles and GeoJSON of points, or one of read_points()."""
    if path.lower().endswith(".las"):
        df = las.read(spark, path)
        df = df if data_column == "z" else df.drop("z").withColumnRenamed(data_column, "z")
        return df.withColumn("z", clean(F.col("z")))
    if path.lower().endswith(outlines.ENDINGS):
        return outlines.read_points(spark, path, data_column).withColumn("z", clean(F.col("z")))
    return read_points(spark, path, data_column)


def read_points(spark: SparkSession, path: str, data_column: str = "z") -> DataFrame:
    """Points pid, x, y, z and other columns, from Parquet, CSV or XYZ text (x y z, parted by white space)."""
    if path.endswith((".las", ".laz", ".gpkg", ".shp")):
        raise NotImplementedError("LAS and shapefiles are read by open_points(); LAZ and GeoPackage need libraries that are not here")
    if path.endswith(".xyz"):
        parts = F.split(F.trim("value"), r"\s+")
        df = spark.read.text(path).where("trim(value) != ''").select(*(parts[k].cast("double").alias(n) for k, n in enumerate(("x", "y", "z"))))
    elif path.endswith(".csv"):
        df = spark.read.csv(path, header=True, inferSchema=False)
        df = df.select(*(F.col(c).cast("double").alias(c) if c in ("x", "y", data_column) else F.col(c) for c in df.columns))
    else:
        df = spark.read.parquet(path)
    df = df.withColumnRenamed(data_column, "z").withColumn("z", clean(F.col("z")))
    return df if "pid" in df.columns else df.withColumn("pid", F.xxhash64("x", "y", "z"))


def write_statistics(row: DataFrame, path: str) -> None:
    """One row of statistics as CSV."""
    row.coalesce(1).write.mode("overwrite").csv(path, header=True)
