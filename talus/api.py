"""Objects over cells and points: a raster, a point cloud, and what can be done with them by name."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus import grid as G
from talus.grid import KEY, Grid
from talus.operators import geostat, masks, resample, stats, terrain, vertical
from talus.sources import files


@dataclass(frozen=True)
class Raster:
    """A surface of heights: cells (row, col, z) and their grid."""

    df: DataFrame
    grid: Grid = Grid()

    @classmethod
    def open(cls, spark: SparkSession, path: str, grid: Grid | None = None, vcrs=None, downsample: int = 1, nodata: float | None = None, product: str | None = None) -> Raster:
        """A raster file; the vertical reference is that of the grid or of its reference, else as given, else of the product."""
        df, grid = files.open_raster(spark, path, grid, downsample, nodata)
        name = grid.vcrs or vertical.of_crs(grid.crs) or (vertical.parse(vcrs) if vcrs is not None else vertical.of_product(product))
        return cls(df, grid.with_vcrs(name))

    @classmethod
    def from_array(cls, spark: SparkSession, values, grid: Grid = Grid(), nodata: float | None = None) -> Raster:
        array = np.asarray(np.ma.filled(np.ma.asarray(values, float), np.nan))
        return cls(G.from_array(spark, array, nodata), replace(grid, height=array.shape[0], width=array.shape[1]))

    def copy(self, df: DataFrame | None = None) -> Raster:
        return Raster(self.df if df is None else df, self.grid)

    def info(self, with_stats: bool = False) -> str:
        lines = [f"{k}: {v}" for k, v in vars(self.grid).items()]
        if with_stats:
            lines += [f"{k}: {v}" for k, v in self.stats().items()]
        return "\n".join(lines)

    def to_array(self, height: int | None = None, width: int | None = None) -> np.ndarray:
        """The array of a small raster."""
        return G.to_array(self.df, height or self.grid.height, width or self.grid.width)

    def __sub__(self, other: Raster) -> DataFrame:
        return G.subtract(self.df, other.df)

    def crop(self, row0: int, row1: int, col0: int, col1: int) -> Raster:
        return self.copy(G.crop(self.df, row0, row1, col0, col1))

    def intersection(self, other: Raster) -> tuple[float, float, float, float] | None:
        """West, south, east and north of what both rasters reach over; None if they don't meet."""
        return self.grid.sized(self.df).intersection(other.grid.sized(other.df))

    def crop_to(self, bounds: tuple[float, float, float, float]) -> Raster:
        """The cells that bounds touch, by their old numbers."""
        return self.crop(*self.grid.window(bounds))

    def translate(self, dx: float, dy: float) -> Raster:
        return Raster(self.df, self.grid.moved(dx, dy))

    def reproject(self, like: Raster, method: str = "linear") -> Raster:
        return Raster(resample.reproject(self.df, self.grid, like.grid, like.df.select(*KEY), method), like.grid.with_vcrs(self.grid.vcrs))

    def set_mask(self, mask: DataFrame) -> Raster:
        return self.copy(masks.set_mask(self.df, mask))

    def set_nodata(self, value: float) -> Raster:
        return Raster(self.df.withColumn("z", G.clean(F.col("z"), value)), replace(self.grid, nodata=value))

    def interp_points(self, points: DataFrame, method: str = "linear") -> DataFrame:
        """points (pid, x, y, ...) with the raster's height as z_raster."""
        prow, pcol = self.grid.place(F.col("x"), F.col("y"))
        return resample.interp(points.withColumns({"_pr": prow, "_pc": pcol}), self.df, {"z_raster": "z"}, "_pr", "_pc", method).drop("_pr", "_pc")

    def to_points(self, n: float = 1, seed: int = 42, skip_missing: bool = True) -> PointCloud:
        return PointCloud(resample.to_points(self.df, self.grid, n, seed, skip_missing), self.grid.crs, self.grid.vcrs)

    def stats(self, names: list[str] | None = None) -> dict:
        return stats.statistics(self.df, "z", names).first().asDict()

    def proximity(self, targets: DataFrame, radius: int) -> DataFrame:
        return masks.proximity(self.df, targets, radius)

    def get_terrain_attribute(self, attributes, **options) -> DataFrame:
        return terrain.terrain_attributes(self.df, attributes, self.grid.resolution, **options)

    def set_vcrs(self, vcrs) -> Raster:
        return Raster(self.df, self.grid.with_vcrs(vertical.parse(vcrs)))

    def to_vcrs(self, target, geoids: dict, source=None) -> Raster:
        return Raster(*vertical.to_vcrs(self.df, self.grid, target, geoids, source))

    @property
    def ccrs(self) -> str | None:
        return vertical.compound_name(self.grid.crs, self.grid.vcrs)

    def coregister_3d(self, reference: Raster, method, inlier: DataFrame | None = None) -> tuple[Raster, object]:
        """The raster aligned to a reference, and the fitted model."""
        there = self if self.grid.transform == reference.grid.transform else self.reproject(reference)
        df, fit = method.fit_and_apply(reference.df, there.df, reference.grid, inlier)
        return Raster(df, reference.grid.with_vcrs(self.grid.vcrs)), fit

    def estimate_uncertainty(
        self, other: Raster, stable: DataFrame | None = None, approach: str = "H2022", precision_of_other: str = "finer", models=("gaussian", "spherical"), estimator: str = "dowd", subsample: int = 1000, bins: int = 10, seed: int = 42
    ) -> tuple[DataFrame, list[dict]]:
        """An error for each cell (row, col, sigma), and the models of how errors correlate in space.

        H2022: errors vary with slope and largest curvature, and correlate over two ranges. R2009: one error, correlated.
        Basic: one error, uncorrelated over a cell. If the other surface is as precise, the difference counts by the root of two.
        """
        if approach not in ("H2022", "R2009", "Basic"):
            raise ValueError("the approach is H2022, R2009 or Basic")
        if precision_of_other not in ("finer", "same"):
            raise ValueError("the other surface is finer or the same")
        scale = np.sqrt(2) if precision_of_other == "same" else 1.0
        dh = (other - self).withColumn("dh", F.col("dh") / float(scale))
        ground = masks.include(dh, stable) if stable is not None else dh
        spread = float(stats.nmad(ground, "dh").first()["nmad"])
        if approach == "H2022":
            names = ["slope", "max_curvature"]
            cells = self.get_terrain_attribute(names).withColumn("max_curvature", F.abs("max_curvature"))
            known = ground.join(cells, KEY).dropna()
            edges = {}
            for n in names:
                q = stats.quantiles(known, [], n, {f"q{k}": k / bins for k in range(bins + 1)}).first()
                edges[n] = sorted({float(q[f"q{k}"]) for k in range(bins + 1)})
            table = stats.nd_binning(known, "dh", edges).toPandas()
            f = stats.BinInterpolator(table, names, "nmad", 30)
            z, factor = stats.two_step_standardization(known, "dh", f.column())
            f.grid = f.grid * factor
            sigma = cells.select(*KEY, F.when(F.col("slope").isNotNull() & F.col("max_curvature").isNotNull(), f.column()).alias("sigma"))
        else:
            z = ground.withColumn("z", F.col("dh") / spread)
            sigma = self.df.select(*KEY, F.lit(spread).alias("sigma"))
        if approach == "Basic":
            return sigma, [{"model": "spherical", "range": self.grid.resolution, "psill": 1.0}]
        points = z.where("z is not null").select(F.struct(*KEY).alias("pid"), self.grid.x(F.col("row"), F.col("col")).alias("x"), self.grid.y(F.col("row"), F.col("col")).alias("y"), "z")
        ends = points.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
        v = geostat.variogram(points, geostat.lag_edges(self.grid.resolution, float(np.hypot(*ends))), estimator, subsample, seed=seed).toPandas()
        return sigma, geostat.fit_models(list(models[:1]) if approach == "R2009" else list(models), v)

    def write(self, path: str) -> None:
        files.write_raster(self.df, path, self.grid)


def _attribute(name: str):
    def method(self: Raster, **options) -> DataFrame:
        return self.get_terrain_attribute(name, **options)

    method.__doc__ = f"row, col, {name}."
    return method


for _name in terrain.ALL:
    setattr(Raster, _name, _attribute(_name))


@dataclass(frozen=True)
class PointCloud:
    """Points of heights: (pid, x, y, z) and other columns."""

    df: DataFrame
    crs: str | None = None
    vcrs: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, data_column: str = "z", crs: str | None = None, vcrs=None) -> PointCloud:
        return cls(files.open_points(spark, path, data_column), crs, None if vcrs is None else vertical.parse(vcrs))

    @classmethod
    def from_arrays(cls, spark: SparkSession, x, y, z, crs: str | None = None) -> PointCloud:
        rows = [(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(x, y, z, strict=True))]
        df = spark.createDataFrame(rows, "pid long, x double, y double, z double")
        return cls(df.withColumn("z", G.clean(F.col("z"))), crs)

    def copy(self, df: DataFrame | None = None) -> PointCloud:
        return PointCloud(self.df if df is None else df, self.crs, self.vcrs)

    def crop(self, x0: float, x1: float, y0: float, y1: float) -> PointCloud:
        return self.copy(self.df.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)))

    def subsample(self, n: float, seed: int = 42) -> PointCloud:
        return self.copy(masks.sample(self.df, n, seed, ["pid"]))

    def set_vcrs(self, vcrs) -> PointCloud:
        return PointCloud(self.df, self.crs, vertical.parse(vcrs))

    def to_vcrs(self, target, geoids: dict, source=None) -> PointCloud:
        source = source or self.vcrs
        if source is None:
            raise ValueError("the points have no vertical reference: name their source")
        return PointCloud(vertical.to_vcrs_points(self.df, source, target, geoids), self.crs, vertical.parse(target))

    def grid(self, grid: Grid, radius: float = 1.5) -> Raster:
        return Raster(resample.grid_points(self.df, grid, radius), grid)

    def coregister_3d(self, reference: Raster, method, inlier: DataFrame | None = None) -> tuple[PointCloud, object]:
        """The points moved onto a reference, and the fitted model."""
        fit = method.fit_points(reference.df, self.df, reference.grid, inlier)
        return self.copy(fit.apply_points(self.df)), fit
