"""GeoTIFF: a reader whose tasks read blocks by range, and a writer of one plain file.

The driver reads the heading (a few kilobytes); blocks (strips or tiles) are numbered and dealt over tasks, and each task reads
the places of its own blocks and then the blocks. Classic and BigTIFF in either byte order, integers and floats of 8 to 64
bits, plain, Deflate, LZW and PackBits blocks and the three predictors are read. Files of several bands, other compressions and
blocks of over ``MOST_BYTES`` raise. Projections are known by their EPSG codes only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.grid import Grid
from talus.sources.ranges import Reader, writing

#: Bytes of one block at most, once unpacked.
MOST_BYTES = 1 << 28
#: Cells in one batch that leaves a task.
BATCH = 1 << 18
#: Bytes of blocks, unpacked, for one task.
TASK_BYTES = 1 << 26

# Codes of the TIFF 6.0, BigTIFF and GeoTIFF formats.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORMATION, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
RASTER_TYPE_KEY, GEOGRAPHIC_KEY, PROJECTED_KEY, VERTICAL_KEY = 1025, 2048, 3072, 4096
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


@dataclass(frozen=True)
class Heading:
    """What the first directory of a file says. entries: (type, number of values, where they stand) by tag."""

    order: str
    entries: dict[int, tuple[int, int, int]]

    def values(self, file: Reader, tag: int, start: int = 0, n: int | None = None) -> tuple:
        """n values of a tag, or all that follow start; none if the tag is absent."""
        if tag not in self.entries:
            return ()
        kind, count, place = self.entries[tag]
        n = count - start if n is None else n
        code = TYPES[kind]
        if code == "s":
            return (file.read(place, count).rstrip(b"\0 ").decode("latin-1"),)
        size = struct.calcsize("=" + code)
        return struct.unpack(f"{self.order}{code * n}", file.read(place + start * size, n * size))

    def one(self, file: Reader, tag: int, default=None):
        return next(iter(self.values(file, tag)), default)


def heading(file: Reader) -> Heading:
    start = file.read(0, 8)
    if start[:2] not in (b"II", b"MM"):
        raise ValueError("this is no TIFF file")
    order = "<" if start[:2] == b"II" else ">"
    version = struct.unpack(order + "H", start[2:4])[0]
    if version not in (42, 43):
        raise ValueError("this is no TIFF file")
    big = version == 43
    place = struct.unpack(order + "Q", file.read(8, 8))[0] if big else struct.unpack(order + "I", start[4:])[0]
    n = struct.unpack(order + ("Q" if big else "H"), file.read(place, 8 if big else 2))[0]
    size, inline = (20, 8) if big else (12, 4)
    first = place + (8 if big else 2)
    entries = {}
    for k in range(n):
        raw = file.read(first + k * size, size)
        tag, kind = struct.unpack(order + "HH", raw[:4])
        count, where = struct.unpack(order + ("QQ" if big else "II"), raw[4:])
        if kind in TYPES:
            width = count if TYPES[kind] == "s" else count * struct.calcsize("=" + TYPES[kind])
            entries[tag] = (kind, count, first + k * size + size - inline if width <= inline else where)
    return Heading(order, entries)


@dataclass(frozen=True)
class Layout:
    """How the cells of a file lie in its blocks."""

    height: int
    width: int
    rows: int
    cols: int
    dtype: str
    compression: int
    predictor: int
    tiled: bool

    @property
    def across(self) -> int:
        return -(-self.width // self.cols)

    @property
    def blocks(self) -> int:
        return self.across * -(-self.height // self.rows)

    @property
    def block_bytes(self) -> int:
        return self.rows * self.cols * np.dtype(self.dtype).itemsize


def layout(file: Reader, head: Heading) -> Layout:
    get = lambda tag, default=None: head.one(file, tag, default)
    if get(SAMPLES, 1) != 1:
        raise ValueError("a raster has one band")
    height, width, bits = get(HEIGHT), get(WIDTH), get(BITS, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(get(SAMPLE_FORMAT, 1))
    if kind is None or bits not in ((32, 64) if kind == "f" else (8, 16, 32, 64)):
        raise NotImplementedError(f"cells of {bits} bits of format {get(SAMPLE_FORMAT, 1)} are not read")
    compression = get(COMPRESSION, PLAIN)
    if compression not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS):
        raise NotImplementedError(f"compression {compression} is not read")
    tiled = TILE_OFFSETS in head.entries
    rows, cols = (get(TILE_HEIGHT), get(TILE_WIDTH)) if tiled else (min(get(STRIP_ROWS, height), height), width)
    out = Layout(height, width, rows, cols, f"{head.order}{kind}{bits // 8}", compression, get(PREDICTOR, 1), tiled)
    if out.block_bytes > MOST_BYTES:
        raise ValueError(f"a block of {out.block_bytes} bytes is over {MOST_BYTES}: write the file with tiles or smaller strips")
    return out


def georeference(file: Reader, head: Heading, base: Grid, shape: Layout) -> Grid:
    """The grid that the tags tell; what they leave open stays as in base. Transforms are for the upper left corner of the
    first cell, also where heights stand for points (their tie point is the middle of a cell)."""
    values = lambda tag: head.values(file, tag)
    keys = {}
    found = values(GEO_KEYS)
    for k in range(4, len(found) - 3, 4):
        if found[k + 1] == 0:
            keys[found[k]] = found[k + 3]
    point = keys.get(RASTER_TYPE_KEY) == 2
    transform = base.transform
    scale, tie, matrix = values(PIXEL_SCALE), values(TIEPOINT), values(TRANSFORMATION)
    if matrix:
        transform = (matrix[0], matrix[1], matrix[3], matrix[4], matrix[5], matrix[7])
    elif scale and tie:
        transform = (scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1])
    if point and (matrix or (scale and tie)):
        a, b, c, d, e, f = transform
        transform = (a, b, c - (a + b) / 2, d, e, f - (d + e) / 2)
    code = keys.get(PROJECTED_KEY) or keys.get(GEOGRAPHIC_KEY)
    crs = f"EPSG:{code}" if code and code != 32767 else base.crs
    vertical = {5773: "EGM96", 3855: "EGM08"}.get(keys.get(VERTICAL_KEY), base.vcrs)
    text = head.one(file, NODATA)
    nodata = float(text) if text else base.nodata
    return replace(base, height=shape.height, width=shape.width, transform=transform, crs=crs, vcrs=vertical, nodata=nodata)


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits: a byte n below 128 is followed by n + 1 bytes as they are, one above by a byte that stands 257 - n times."""
    out, k = bytearray(), 0
    while k < len(data) and len(out) < size:
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += n + 2
        elif n == 128:
            k += 1
        else:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """LZW as in TIFF: codes of 9 to 12 bits, highest bit first; 256 clears the table and 257 ends."""
    out, table, before = bytearray(), [], b""
    held = bits = 0
    width = 9
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, before, width = list(single), b"", 9
            continue
        if not table:
            table = list(single)
        if code < len(table):
            entry = table[code]
        elif before and code == len(table):
            entry = before + before[:1]
        else:
            raise ValueError("a block of LZW has a code that is not known yet")
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def decode(data: bytes, shape: Layout, rows: int) -> np.ndarray:
    """The cells of a block of so many rows, as doubles."""
    dtype = np.dtype(shape.dtype)
    size = rows * shape.cols * dtype.itemsize
    if shape.compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompressobj().decompress(data, size)
    elif shape.compression == LZW:
        data = unpack_lzw(data, size)
    elif shape.compression == PACKBITS:
        data = unpack_bits(data, size)
    if len(data) < size:
        raise ValueError("a block ends before its cells do")
    if shape.predictor == 3:
        lanes = np.frombuffer(data, np.uint8, size).reshape(rows, dtype.itemsize * shape.cols)
        lanes = np.cumsum(lanes, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, shape.cols)
        cells = np.ascontiguousarray(lanes.transpose(0, 2, 1)).view(dtype.newbyteorder(">"))[..., 0]
    else:
        cells = np.frombuffer(data, dtype, rows * shape.cols).reshape(rows, shape.cols)
        if shape.predictor == 2:
            whole = np.dtype(f"u{dtype.itemsize}")
            cells = np.cumsum(cells.astype(dtype.newbyteorder("=")).view(whole), axis=1, dtype=whole).view(dtype.newbyteorder("="))
    return cells.astype(np.float64)


def read(spark: SparkSession, path: str, base: Grid) -> tuple[DataFrame, Grid]:
    """(row, col, z) of a file, its nodata values still in, and its grid. A block that was never written has no cells."""
    with Reader(path) as file:
        head = heading(file)
        shape = layout(file, head)
        grid = georeference(file, head, base, shape)
    tasks = max(1, min(shape.blocks, -(-shape.blocks * shape.block_bytes // TASK_BYTES)))
    offsets, counts = (TILE_OFFSETS, TILE_COUNTS) if shape.tiled else (STRIP_OFFSETS, STRIP_COUNTS)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Reader(path) as file:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    place, n = head.values(file, offsets, k, 1)[0], head.values(file, counts, k, 1)[0]
                    if not n:
                        continue
                    row0, col0 = k // shape.across * shape.rows, k % shape.across * shape.cols
                    here = min(shape.rows, shape.height - row0)
                    z = decode(file.read(place, n), shape, shape.rows if shape.tiled else here)[:here, : shape.width - col0]
                    step = max(1, BATCH // z.shape[1])
                    for top in range(0, here, step):
                        part = z[top : top + step]
                        r, c = np.indices(part.shape, np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array((r + row0 + top).ravel()), pa.array((c + col0).ravel()), pa.array(part.ravel())], names=["row", "col", "z"])

    return spark.range(0, shape.blocks, 1, tasks).mapInArrow(cells, "row int, col int, z double"), grid


def _directory(grid: Grid, height: int, width: int, nodata: float, strip: int) -> tuple[bytes, int]:
    """The heading of a plain BigTIFF of doubles in strips of so many rows, and where its first strip stands."""
    a, b, c, d, e, f = grid.transform
    if grid.area_or_point == "Point":
        c, f = c + (a + b) / 2, f + (d + e) / 2
    keys = [(1024, 0, 1, 1), (RASTER_TYPE_KEY, 0, 1, 2 if grid.area_or_point == "Point" else 1)]
    code = (grid.crs or "").upper()
    if code.startswith("EPSG:") and code[5:].isdigit():
        geographic = 4000 <= int(code[5:]) < 5000
        keys[0] = (1024, 0, 1, 2 if geographic else 1)
        keys.append((GEOGRAPHIC_KEY if geographic else PROJECTED_KEY, 0, 1, int(code[5:])))
    if grid.vcrs in ("EGM96", "EGM08"):
        keys.append((VERTICAL_KEY, 0, 1, {"EGM96": 5773, "EGM08": 3855}[grid.vcrs]))
    n = -(-height // strip)
    said = repr(float(nodata)).encode() + b"\0"
    flat = [1, 1, 0, len(keys), *(v for key in keys for v in key)]
    sizes = [min(strip, height - k * strip) * width * 8 for k in range(n)]
    matrix = (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    tags = [(WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (64,)), (COMPRESSION, 3, (PLAIN,)), (PHOTOMETRIC, 3, (1,)), (STRIP_OFFSETS, 16, sizes), (SAMPLES, 3, (1,)), (STRIP_ROWS, 4, (strip,))]
    tags += [(STRIP_COUNTS, 16, sizes), (PLANAR, 3, (1,)), (SAMPLE_FORMAT, 3, (3,)), (TRANSFORMATION, 12, matrix), (GEO_KEYS, 3, flat), (NODATA, 2, said)]
    first = 16 + 8 + 20 * len(tags) + 8
    wide = {tag: len(v) * (1 if kind == 2 else struct.calcsize("=" + TYPES[kind])) for tag, kind, v in tags}
    data = first + sum(-(-w // 8) * 8 for w in wide.values() if w > 8)
    body, more = struct.pack("<Q", len(tags)), b""
    for tag, kind, values in tags:
        if tag == STRIP_OFFSETS:
            values = np.cumsum([data, *sizes[:-1]]).tolist()
        raw = values if kind == 2 else struct.pack("<" + TYPES[kind] * len(values), *values)
        if len(raw) > 8:
            place = first + len(more)
            more += raw.ljust(-(-len(raw) // 8) * 8, b"\0")
            raw = struct.pack("<Q", place)
        body += struct.pack("<HHQ", tag, kind, len(values)) + raw.ljust(8, b"\0")
    return b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + body + struct.pack("<Q", 0) + more, data


def write(df: DataFrame, path: str, grid: Grid) -> None:
    """One plain BigTIFF of doubles. One task sorts the cells (on disk where they are many) and streams them in strips of about
    a megabyte; absent and missing cells are nodata. As a file is one task's work, large rasters are better kept as Parquet. A
    cell that stands twice, or outside the grid, raises."""
    nodata = -9999.0 if grid.nodata is None else float(grid.nodata)
    grid = grid.sized(df)
    height, width = grid.height, grid.width
    if not height or not width:
        raise ValueError("a raster without cells needs a grid of known height and width")
    strip = max(1, min(height, (1 << 17) // width))
    start, data = _directory(grid, height, width, nodata, strip)
    if len(start) != data:
        raise RuntimeError("the heading is not as long as was planned")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with writing(path) as out:
            out.write(start)
            block, top, last = np.full((min(strip, height), width), nodata), 0, -1

            def flush() -> None:
                nonlocal block, top
                out.write(block.astype("<f8").tobytes())
                top += len(block)
                block = np.full((max(0, min(strip, height - top)), width), nodata)

            for batch in batches:
                row, col = (batch.column(k).to_numpy().astype(np.int64) for k in (0, 1))
                z = batch.column(2).to_numpy(zero_copy_only=False)
                z = np.where(np.isfinite(z), z, nodata)
                if len(row) and (row.min() < 0 or col.min() < 0 or row.max() >= height or col.max() >= width):
                    raise ValueError("a cell lies outside the grid")
                at = row * width + col
                if (np.diff(np.concatenate([[last], at])) <= 0).any():
                    raise ValueError("a cell stands twice")
                last = at[-1] if len(at) else last
                while len(row):
                    while row[0] >= top + len(block):
                        flush()
                    n = int(np.searchsorted(row, top + len(block)))
                    block[row[:n] - top, col[:n]] = z[:n]
                    row, col, z = row[n:], col[n:], z[n:]
            while len(block):
                flush()
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["done"])

    cells = df.select(F.col("row").cast("int"), F.col("col").cast("int"), F.col("z").cast("double"))
    cells.repartition(1).sortWithinPartitions("row", "col").mapInArrow(save, "done long").collect() or list(save(iter(())))
