import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.api import PointCloud, Raster
from talus.grid import Grid, to_array
from talus.operators.masks import inside_polygon
from talus.sources import files, geotiff, las, outlines

GRID = Grid(transform=(10.0, 0.0, 500000.0, 0.0, -10.0, 7000000.0), crs="EPSG:32633")


def lzw(data):
    """An encoder of LZW as in TIFF."""
    codes, table, width, before = [(256, 9)], {bytes([k]): k for k in range(256)}, 9, b""
    size = 258
    for k in range(len(data)):
        b = data[k : k + 1]
        if before + b in table:
            before += b
            continue
        codes.append((table[before], width))
        table[before + b] = size
        size += 1
        width = 10 if size == 512 else 11 if size == 1024 else 12 if size == 2048 else width
        if size == 4095:
            codes.append((256, 12))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        before = b
    codes += [(table[before], width), (257, width)]
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def pack_bits(data):
    out = b""
    for k in range(0, len(data), 100):
        part = data[k : k + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(part) > 1 and len(set(part)) == 1 else bytes([len(part) - 1]) + part
    return out


def tiff(a, order="<", tile=None, strip=5, compression=1, predictor=1, point=False):
    """A classic TIFF of an array, in strips or tiles."""
    a = np.asarray(a).astype(a.dtype.newbyteorder(order))
    h, w = a.shape
    parts = []
    if tile:
        full = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), a.dtype)
        full[:h, :w] = a
        parts = [full[r : r + tile, c : c + tile] for r in range(0, h, tile) for c in range(0, w, tile)]
    else:
        parts = [a[r : r + strip] for r in range(0, h, strip)]
    blobs = []
    for p in parts:
        raw = np.ascontiguousarray(p).tobytes()
        if predictor == 2:
            native = p.astype(a.dtype.newbyteorder("=")).view(f"u{a.dtype.itemsize}")
            raw = np.diff(native, axis=1, prepend=native.dtype.type(0)).astype(native.dtype.newbyteorder(order)).tobytes()
        if predictor == 3:
            planes = np.ascontiguousarray(p.astype(a.dtype.newbyteorder(">"))).view(np.uint8).reshape(*p.shape, -1).transpose(0, 2, 1).reshape(p.shape[0], -1)
            raw = np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()
        blobs.append({1: lambda b: b, 5: lzw, 8: zlib.compress, 32773: pack_bits}[compression](raw))
    keys = [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 2 if point else 1, 3072, 0, 1, 32633]
    offset, places = 8, []
    for b in blobs:
        places.append(offset)
        offset += len(b)
    kind = {"f": 3, "i": 2, "u": 1}[a.dtype.kind]
    tags = [(256, "H", [w]), (257, "H", [h]), (258, "H", [a.dtype.itemsize * 8]), (259, "H", [compression]), (277, "H", [1]), (317, "H", [predictor])]
    tags += [(322, "H", [tile]), (323, "H", [tile]), (324, "I", places), (325, "I", [len(b) for b in blobs])] if tile else [(273, "I", places), (278, "H", [strip]), (279, "I", [len(b) for b in blobs])]
    tags += [(339, "H", [kind]), (33550, "d", [10.0, 10.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 500000.0 + 5 * point, 7000000.0 - 5 * point, 0.0]), (34735, "H", keys), (42113, "s", b"-99\0")]
    tags.sort()
    first = offset + 2 + 12 * len(tags) + 4
    body, more = struct.pack(order + "H", len(tags)), b""
    for tag, code, values in tags:
        raw = values if code == "s" else struct.pack(order + code * len(values), *values)
        n = len(values)
        if len(raw) > 4:
            raw, more = struct.pack(order + "I", first + len(more)), more + raw
        body += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[code], n) + raw.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, offset) + b"".join(blobs) + body + b"\0" * 4 + more


@pytest.mark.parametrize(
    "dtype,options",
    [
        ("f4", {}),
        ("f8", {"order": ">", "tile": 16}),
        ("i2", {"compression": 8, "predictor": 2, "tile": 16}),
        ("u2", {"order": ">", "compression": 5, "predictor": 2}),
        ("f4", {"compression": 8, "predictor": 3}),
        ("f4", {"compression": 5, "strip": 40, "order": ">", "predictor": 3}),
        ("u1", {"compression": 32773, "point": True}),
        ("i4", {"compression": 5, "strip": 40}),
    ],
)
def test_tiff_of_other_writers(spark, tmp_path, dtype, options):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 120, (37, 43)).astype(dtype)
    a[20:30] = 7
    if dtype[0] == "f":
        a += a.dtype.type(0.25)
        a[0, 0] = np.nan
    if dtype[0] != "u":
        a[3, 4] = -99
    (tmp_path / "a.tif").write_bytes(tiff(a, **options))
    r = Raster.open(spark, str(tmp_path / "a.tif"))
    want = a.astype(float)
    want[want == -99] = np.nan
    np.testing.assert_array_equal(r.to_array(), want)
    assert r.df.count() == a.size and r.grid.crs == "EPSG:32633" and r.grid.nodata == -99
    assert r.grid.transform == pytest.approx(GRID.transform)
    assert Raster.open(spark, str(tmp_path / "a.tif"), downsample=4).to_array().tolist()[1] == pytest.approx(want[4, ::4].tolist())


def test_lzw_clears_and_grows():
    data = np.random.default_rng(2).integers(0, 256, 20_000).astype(np.uint8).tobytes() + b"a" * 5000
    assert geotiff.unpack_lzw(lzw(data), len(data)) == data


@pytest.mark.parametrize("kind", ["Area", "Point"])
def test_tiff_round_trip(spark, tmp_path, kind):
    from dataclasses import replace

    a = np.add.outer(np.arange(500.0), np.arange(700.0) / 7)
    a[10:400, :] = np.nan  # strips that hold no cell
    path = f"file://{tmp_path}/b.tif"
    r = Raster.from_array(spark, a, replace(GRID, area_or_point=kind, vcrs="EGM96"))
    r.copy(r.df.where("z is not null")).write(path)
    back = Raster.open(spark, path, Grid(area_or_point=kind))
    np.testing.assert_array_equal(back.to_array(), a)
    assert (back.grid.height, back.grid.width, back.grid.crs, back.grid.vcrs) == (500, 700, "EPSG:32633", "EGM96")
    assert back.grid.transform == pytest.approx(GRID.transform)
    assert [p.name for p in tmp_path.iterdir()] == ["b.tif"]
    files.write_raster(r.df.limit(0), f"{tmp_path}/none.tif", replace(GRID, height=3, width=4))
    assert np.isnan(Raster.open(spark, f"{tmp_path}/none.tif").to_array()).all()
    for bad in (r.df.limit(1).union(r.df.limit(1)), r.df.limit(1).withColumn("row", F.lit(900))):
        with pytest.raises(Exception, match="cell"):
            files.write_raster(bad, f"{tmp_path}/bad.tif", r.grid)


def test_tiff_refused(spark, tmp_path):
    good = tiff(np.ones((8, 8), "f4"))
    for name, data, error in (("x", b"nothing here", ValueError), ("y", good[:60], ValueError), ("z", good.replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0)), NotImplementedError)):
        (tmp_path / f"{name}.tif").write_bytes(data)
        with pytest.raises(error):
            Raster.open(spark, str(tmp_path / f"{name}.tif"))


@pytest.mark.parametrize("kind,version", [(1, 2), (6, 4)])
def test_las(spark, tmp_path, monkeypatch, kind, version):
    monkeypatch.setattr(las, "BATCH", 64)
    monkeypatch.setattr(las, "TASK", 100)
    n, start, length = 300, 400, 30 if kind == 6 else 28
    rng = np.random.default_rng(3)
    records = np.zeros(n, las.record(kind, length))
    for c in "XYZ":
        records[c] = rng.integers(-(10**6), 10**6, n)
    records["classification"], records["intensity"], records["returns"] = 2, np.arange(n), 0b10010 if kind < 6 else 0b100010
    head = bytearray(start)
    head[:4], head[24], head[25] = b"LASF", 1, version
    struct.pack_into("<HI", head, 94, 375 if version == 4 else 227, start)
    struct.pack_into("<BHI", head, 104, kind, length, 0 if version == 4 else n)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.001, 500000.0, 7000000.0, 100.0)
    if version == 4:
        struct.pack_into("<Q", head, 247, n)
    (tmp_path / "p.las").write_bytes(bytes(head) + records.tobytes())
    p = PointCloud.open(spark, str(tmp_path / "p.las")).df.orderBy("pid").toPandas()
    assert p.pid.tolist() == list(range(n)) and p.return_number.eq(2).all() and p.classification.eq(2).all()
    np.testing.assert_allclose(p.x, records["X"] * 0.01 + 500000)
    np.testing.assert_allclose(p.z, records["Z"] * 0.001 + 100)
    assert PointCloud.open(spark, str(tmp_path / "p.las"), "intensity").df.agg(F.sum("z")).first()[0] == n * (n - 1) / 2
    head[104] |= 0x80
    (tmp_path / "q.las").write_bytes(bytes(head))
    with pytest.raises(NotImplementedError):
        PointCloud.open(spark, str(tmp_path / "q.las"))


def shapefile(polygons):
    body = b""
    for k, rings in enumerate(polygons):
        xy = [v for r in rings for p in r for v in p]
        starts = np.cumsum([0, *map(len, rings)])[:-1].tolist()
        raw = struct.pack("<i4d", 5, 0, 0, 0, 0) + struct.pack("<2i", len(rings), len(xy) // 2) + struct.pack(f"<{len(rings)}i", *starts) + struct.pack(f"<{len(xy)}d", *xy)
        body += struct.pack(">ii", k + 1, len(raw) // 2) + raw
    return struct.pack(">i20xi", 9994, 50 + len(body) // 2) + struct.pack("<ii8d", 1000, 5, *[0.0] * 8) + body


OUTER = [(3.2, 4.1), (33.3, 6.4), (28.0, 35.0), (12.5, 28.7), (3.2, 4.1)]
HOLE = [(15.0, 12.0), (15.0, 20.0), (22.0, 20.0), (22.0, 12.0), (15.0, 12.0)]
OTHER = [(-5.0, -5.0), (6.0, -5.0), (2.0, 3.0)]


@pytest.mark.parametrize("kind", ["shp", "geojson"])
def test_outlines(spark, tmp_path, kind):
    path = str(tmp_path / f"o.{kind}")
    if kind == "shp":
        (tmp_path / "o.shp").write_bytes(shapefile([[OUTER, HOLE], [OTHER]]))
    else:
        forms = [{"type": "Polygon", "coordinates": [OUTER, HOLE]}, {"type": "GeometryCollection", "geometries": [{"type": "MultiPolygon", "coordinates": [[OTHER]]}]}, None]
        (tmp_path / "o.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": {"h": 1}} for g in forms]}))
    grid = Grid(height=40, width=36, transform=(1.0, 0.0, 0.0, 0.0, -1.0, 40.0))
    rings = outlines.read(spark, path)
    got = {(r.row, r.col, r["shape"]) for r in outlines.cells_within(rings, grid).collect()}
    middles = spark.range(40 * 36).selectExpr("cast(floor(id / 36) as int) row", "cast(id % 36 as int) col").withColumns({"x": F.col("col") + 0.5, "y": 39.5 - F.col("row")})
    inside = lambda ring: {(r.row, r.col) for r in inside_polygon(middles, ring).collect()}
    want = {(r, c, 0) for r, c in inside(OUTER[:-1]) - inside(HOLE[:-1])} | {(r, c, 1) for r, c in inside(OTHER)}
    assert got == want and 300 < len(got) < 800
    assert outlines.mask(rings, grid).count() == len({g[:2] for g in got})
    assert outlines.mask(rings.limit(0), grid).count() == 0


def test_outlines_that_touch_share_no_cell(spark):
    """Borders go through the middles of cells: each cell is in one square of four."""
    squares = [(k, 0, [float(x), x + 2.0, x + 2.0, float(x)], [float(y), float(y), y + 2.0, y + 2.0]) for k, (x, y) in enumerate([(0, 0), (2, 0), (0, 2), (2, 2)])]
    rings = spark.createDataFrame(squares, "shape int, ring int, x array<double>, y array<double>")
    grid = Grid(height=5, width=5, transform=(1.0, 0.0, -0.5, 0.0, -1.0, 4.5))
    cells = outlines.cells_within(rings, grid)
    assert cells.count() == 16 and cells.select("row", "col").distinct().count() == 16
    assert cells.groupBy("shape").count().where("count = 4").count() == 4


def test_points_of_vector_files(spark, tmp_path):
    raw = [struct.pack("<i2d", 1, 1.5 * k, 2.5) for k in range(3)]
    (tmp_path / "p.shp").write_bytes(struct.pack(">i20xi", 9994, 0) + struct.pack("<ii8d", 1000, 1, *[0.0] * 8) + b"".join(struct.pack(">ii", k + 1, len(r) // 2) + r for k, r in enumerate(raw)))
    assert [(r.x, r.y, r.z) for r in PointCloud.open(spark, str(tmp_path / "p.shp")).df.orderBy("x").collect()] == [(0.0, 2.5, None), (1.5, 2.5, None), (3.0, 2.5, None)]
    features = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2, 3]}, "properties": {"h": 7.5}}]
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    for column, want in (("z", 3.0), ("h", 7.5)):
        assert PointCloud.open(spark, str(tmp_path / "p.geojson"), column).df.select("x", "y", "z").collect() == [(1.0, 2.0, want)]


def test_vertical_part_of_references():
    from talus.operators.vertical import of_crs

    wkt1 = 'COMPD_CS["a + b",PROJCS["UTM",AUTHORITY["EPSG","32633"]],VERT_CS["EGM96 height",VERT_DATUM["EGM96 geoid",2005,AUTHORITY["EPSG","5171"]],AUTHORITY["EPSG","5773"]]]'
    wkt2 = 'COMPOUNDCRS["a",PROJCRS["UTM",ID["EPSG",32633]],VERTCRS["EGM2008 height",VDATUM["EGM2008 geoid"]]]'
    spatial = 'GEOGCRS["WGS 84",CS[ellipsoidal,3],AXIS["ellipsoidal height (h)",up]]'
    flat = 'GEOGCRS["WGS 84",CS[ellipsoidal,2]]'
    wanted = {wkt1: "EGM96", wkt2: "EGM08", spatial: "Ellipsoid", flat: None, "EPSG:32633": None, "EPSG:4979": "Ellipsoid", "epsg:32633+3855": "EGM08", None: None, "": None}
    assert {k: of_crs(k) for k in wanted} == wanted
    for bad in ("EPSG:32633+9999", 'VERT_CS["NAVD88 height"]'):
        with pytest.raises(ValueError):
            of_crs(bad)


def test_extents(spark):
    a, b = Grid(height=10, width=20, transform=(1.0, 0.0, 5.0, 0.0, -1.0, 60.0)), Grid(height=4, width=4, transform=(2.0, 0.0, 20.5, 0.0, -2.0, 64.0))
    assert a.bounds == (5.0, 50.0, 25.0, 60.0) and a.intersection(b) == (20.5, 56.0, 25.0, 60.0)
    assert a.intersection(a.moved(20, 0)) is None
    assert a.window((20.5, 56.0, 25.0, 60.0)) == (0, 4, 15, 20)
    r = Raster.from_array(spark, np.ones((10, 20)), a)
    assert Raster(r.df, Grid(transform=a.transform)).intersection(Raster(r.df, Grid(transform=b.transform))) == (20.5, 50.0, 25.0, 60.0)
    assert r.crop_to((20.5, 56.0, 25.0, 60.0)).df.count() == 20
    assert [a.metric_crs(), a.moved(160, -80).metric_crs(), a.moved(0, 30).metric_crs(), a.moved(0, -140).metric_crs()] == ["EPSG:32633", "EPSG:32760", "EPSG:32661", "EPSG:32761"]
    for bad in (lambda: Grid().bounds, lambda: a.intersection(Grid(height=1, width=1, crs="x")), a.moved(1000, 0).metric_crs):
        with pytest.raises(ValueError):
            bad()


def test_jobs_take_outlines_and_tiffs(spark, tmp_path):
    from talus import workflows

    z = np.add.outer(np.sin(np.arange(30) / 4), np.cos(np.arange(30) / 3)) * 10
    for name, v in (("ref", z), ("tba", z - 3)):
        Raster.from_array(spark, v, GRID).write(f"{tmp_path}/{name}.tif")
    square = [(500000.0, 6999700.0), (500000.0, 7000000.0), (500100.0, 7000000.0), (500100.0, 6999700.0)]
    (tmp_path / "ice.shp").write_bytes(shapefile([[square]]))
    Raster.from_array(spark, np.eye(30), GRID).write(f"{tmp_path}/diagonal.tif")
    source = lambda name, **more: {"path_to_elev": f"{tmp_path}/{name}.tif", **more}
    config = {"inputs": {"reference_elev": source("ref", path_to_mask=f"{tmp_path}/ice.shp"), "to_be_aligned_elev": source("tba", path_to_mask=f"{tmp_path}/diagonal.tif"), "path_to_mask": f"{tmp_path}/ice.shp"}, "coregistration": {"step_one": {"method": "VerticalShift"}}, "outputs": {"path": f"file://{tmp_path}/out"}}
    out = workflows.accuracy(spark, config, write=False)
    before = to_array(out["dh_before"].withColumnRenamed("dh", "z"), 30, 30)
    want = np.full((30, 30), 3.0)
    want[:, :10] = np.nan
    want[np.diag_indices(30)] = np.nan
    np.testing.assert_allclose(before, want)
