"""Vertical references: names, products, and conversion between ellipsoid and geoid heights with an undulation grid.

A geoid grid is a raster of undulations N (height of the geoid over the ellipsoid): ellipsoid height = geoid height + N. No
grids are downloaded; they are given as tables.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.grid import Grid
from talus.operators.resample import interp

# Vertical references of elevation products, and names of references.
PRODUCTS = {
    "ArcticDEM/REMA/EarthDEM": "Ellipsoid",
    "TDM1": "Ellipsoid",
    "NASADEM-HGTS": "Ellipsoid",
    "AW3D30": "EGM96",
    "SRTMv4.1": "EGM96",
    "ASTGTM2": "EGM96",
    "ASTGTM3": "EGM96",
    "NASADEM-HGT": "EGM96",
    "COPDEM": "EGM08",
}
EPSG = {5773: "EGM96", 3855: "EGM08"}
# EPSG codes of references of three dimensions, whose heights are over the ellipsoid.
SPATIAL = (4979, 4978, 7912, 9754, 7664, 7789, 9989)
GRIDS = {"EGM96": "us_nga_egm96_15.tif", "EGM08": "us_nga_egm08_25.tif"}


def of_product(product: str | None) -> str | None:
    return PRODUCTS.get(product) if product else None


def parse(reference) -> str:
    """The name of a reference given by name (in any case), EPSG code or grid file."""
    if isinstance(reference, int):
        if reference not in EPSG:
            raise ValueError(f"EPSG:{reference} is no known vertical reference")
        return EPSG[reference]
    if not isinstance(reference, str):
        raise TypeError("a vertical reference is a name, an EPSG code or a grid file")
    for name in ("Ellipsoid", "EGM96", "EGM08"):
        if reference.lower() == name.lower():
            return name
    if reference.lower().startswith("epsg:"):
        return parse(int(reference[5:]))
    if reference.endswith((".tif", ".json", ".parquet", ".pol")):
        return reference
    raise ValueError(f"unknown vertical reference {reference}")


def of_crs(crs: str | None) -> str | None:
    """The vertical part of a reference: of a compound of codes (EPSG:32633+5773), of well-known text with a vertical system,
    or the ellipsoid for references of three dimensions. None for references without heights."""
    if not crs:
        return None
    text = crs.strip()
    codes = re.fullmatch(r"(?i)epsg:(\d+)(?:\s*\+\s*(?:epsg:)?(\d+))?", text)
    if codes:
        return parse(int(codes[2])) if codes[2] else "Ellipsoid" if int(codes[1]) in SPATIAL else EPSG.get(int(codes[1]))
    part = re.search(r'(?i)\b(?:VERT_CS|VERTCRS|VERTICALCRS)\s*\[\s*"([^"]*)"(.*)$', text, re.DOTALL)
    if part:
        known = [int(n) for n in re.findall(r'(?i)(?:AUTHORITY|ID)\s*\[\s*"EPSG"\s*,\s*"?(\d+)', part[2]) if int(n) in EPSG]
        if known:
            return EPSG[known[-1]]
        name = part[1].upper()
        for said, reference in (("EGM96", "EGM96"), ("EGM2008", "EGM08"), ("EGM08", "EGM08"), ("ELLIPSOID", "Ellipsoid")):
            if said in name:
                return reference
        raise ValueError(f"unknown vertical reference {part[1]}")
    if re.search(r'(?i)AXIS\s*\[\s*"[^"]*ellipsoidal height', text) or re.search(r"(?i)CS\s*\[\s*ellipsoidal\s*,\s*3", text):
        return "Ellipsoid"
    return None


def compound_name(crs: str | None, vcrs: str | None) -> str | None:
    return None if crs is None and vcrs is None else " + ".join(v for v in (crs, vcrs) if v)


def undulation(points: DataFrame, geoid: DataFrame, geoid_grid: Grid) -> DataFrame:
    """points (pid, x, y, ...) with N, interpolated in the geoid's raster."""
    prow, pcol = geoid_grid.place(F.col("x"), F.col("y"))
    return interp(points.withColumns({"_prow": prow, "_pcol": pcol}), geoid, {"N": "z"}, "_prow", "_pcol").drop("_prow", "_pcol")


def to_vcrs_points(points: DataFrame, source: str, target: str, geoids: dict[str, tuple[DataFrame, Grid]]) -> DataFrame:
    """points with z converted between references."""
    source, target = parse(source), parse(target)
    if source == target:
        warnings.warn("source and target reference are the same: heights stay as they are", stacklevel=2)
        return points
    out = points
    for name, sign in ((source, 1.0), (target, -1.0)):
        if name != "Ellipsoid":
            if name not in geoids:
                raise ValueError(f"the undulation grid of {name} is needed")
            out = undulation(out, *geoids[name]).withColumn("z", F.col("z") + sign * F.col("N")).drop("N")
    return out


def to_vcrs(df: DataFrame, grid: Grid, target: str, geoids: dict[str, tuple[DataFrame, Grid]], source: str | None = None) -> tuple[DataFrame, Grid]:
    """A raster with z converted, and its grid with the new reference."""
    source = source or grid.vcrs
    if source is None:
        raise ValueError("the raster has no vertical reference: name its source")
    points = df.select(F.struct("row", "col").alias("pid"), grid.x(F.col("row"), F.col("col")).alias("x"), grid.y(F.col("row"), F.col("col")).alias("y"), "z")
    out = to_vcrs_points(points, source, target, geoids).select("pid.row", "pid.col", "z")
    return out, grid.with_vcrs(parse(target))
