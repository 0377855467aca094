"""Terrain attributes of rasters."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.functions import terrain as T
from talus.plans.stencil import halo_tiles, neighbours, separable

ALL = [*T.SURFACE, *T.CURVATURES, *T.WINDOWED, *T.TILED]


def terrain_attributes(
    df: DataFrame,
    attributes: str | list[str],
    resolution: float = 1.0,
    degrees: bool = True,
    surface_fit: str = "Florinsky",
    curv_method: str = "geometric",
    tri_method: str = "Riley",
    window_size: int = 3,
    window_size_fractal: int = 13,
    hillshade_altitude: float = 45.0,
    hillshade_azimuth: float = 315.0,
    hillshade_z_factor: float = 1.0,
    texture_alpha: float = 0.8,
    tile: int = 256,
) -> DataFrame:
    """row, col and one column for each attribute; those of one family come from one plan."""
    names = [attributes] if isinstance(attributes, str) else list(attributes)
    for n in names:
        if n not in ALL:
            raise ValueError(f"unknown attribute {n}; known are {', '.join(ALL)}")
    fit = T.FITS.get(surface_fit.lower().replace("_", ""))
    method, tri = curv_method.lower(), tri_method.capitalize()
    if fit is None:
        raise ValueError(f"surface_fit must be one of {', '.join(T.FITS.values())}")
    if method not in ("geometric", "directional"):
        raise ValueError("curv_method must be geometric or directional")
    curved = [n for n in names if n in T.CURVATURES]
    if fit == "Horn" and curved:
        raise ValueError("Horn's fit has no second derivatives: use ZevenbergThorne or Florinsky for curvatures")
    if window_size % 2 == 0 or window_size_fractal % 2 == 0:
        raise ValueError("windows have an odd size")
    if "fractal_roughness" in names and window_size_fractal < 13:
        if window_size_fractal < 5:
            raise ValueError("fractal roughness needs windows of at least 5")
        warnings.warn("fractal roughness is meant for windows of at least 13", stacklevel=2)
    parts = []
    fitted = [n for n in names if n in T.SURFACE or n in T.CURVATURES]
    if fitted:
        parts.append(_fitted(df, fitted, resolution, degrees, fit, method, hillshade_azimuth, hillshade_altitude, hillshade_z_factor))
    pointwise = [n for n in names if n in ("rugosity", "terrain_ruggedness_index")]
    if "rugosity" in pointwise:
        parts.append(neighbours(df, 1).select("row", "col", F.expr(T.rugosity(resolution)).alias("rugosity")))
    if "terrain_ruggedness_index" in pointwise:
        parts.append(neighbours(df, window_size // 2).select("row", "col", F.expr(T.ruggedness(tri, window_size)).alias("terrain_ruggedness_index")))
    moving = [n for n in names if n in ("topographic_position_index", "roughness")]
    if moving:
        parts.append(_moving(df, moving, window_size))
    if "fractal_roughness" in names:
        parts.append(halo_tiles(df, _fractal(window_size_fractal), window_size_fractal // 2, ["fractal_roughness"], tile))
    if "texture_shading" in names:
        parts.append(texture_shading(df, texture_alpha))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["row", "col"], "full")
    return out.select("row", "col", *names)


def _fitted(df, names, resolution, degrees, fit, method, azimuth, altitude, z_factor) -> DataFrame:
    r = T.radius(fit)
    needed = T.derivatives(fit, resolution)
    if not any(n in T.CURVATURES for n in names):
        needed = {k: needed[k] for k in ("zx", "zy")}
    near = neighbours(df, r)
    # the footprint is the whole window, also where a weight is zero
    strict = near.select("row", "col", *(F.when(F.expr(T.whole(r)).isNotNull(), F.expr(e)).alias(k) for k, e in needed.items()))
    kinds = dict(degrees=degrees, method=method, azimuth=azimuth, altitude=altitude, z_factor=z_factor)
    return strict.select("row", "col", *(F.when(F.col("zx").isNotNull(), F.expr(T.surface(n, **kinds))).alias(n) for n in names))


def _moving(df: DataFrame, names: list[str], w: int) -> DataFrame:
    full = F.col("n") == w * w
    wanted = {"lo": (F.min, "z"), "hi": (F.max, "z")} if "roughness" in names else {}
    if "topographic_position_index" in names:
        wanted["total"] = (F.sum, "z")
    win = separable(df.select("row", "col", "z"), w // 2, wanted)
    value = {
        "topographic_position_index": lambda: F.col("z") - (F.col("total") - F.col("z")) / (w * w - 1),
        "roughness": lambda: F.col("hi") - F.col("lo"),
    }
    return win.select("row", "col", *(F.when(full, value[n]()).alias(n) for n in names))


def _fractal(w: int):
    """Box-counting dimension of each window: the slope of the number of boxes over their size, both as logarithms."""
    half = w // 2
    sizes = [q for q in range(1, half + 1) if half % q == 0]
    x = np.log(sizes)
    x = x - x.mean()

    def kernel(z: np.ndarray) -> dict[str, np.ndarray]:
        windows = sliding_window_view(z, (w, w))
        out = np.full(z.shape, np.nan)
        for i in range(windows.shape[0]):  # one line of windows at a time
            line = windows[i]
            v = np.clip(line - line[:, half : half + 1, half : half + 1], 0, w)
            slope = 0.0
            for q, xq in zip(sizes, x, strict=True):
                m = (w - 1) // q
                boxes = v[:, : m * q, : m * q].reshape(-1, m, q, m, q).max(axis=(2, 4)).sum(axis=(1, 2)) / q
                with np.errstate(divide="ignore", invalid="ignore"):
                    slope = slope + xq * np.log(boxes)
            d = -slope / (x * x).sum()
            out[half + i, half : half + len(d)] = np.where(np.isnan(line).any(axis=(1, 2)) | ~np.isfinite(d), np.nan, d)
        return {"fractal_roughness": out}

    return kernel


def _fft_size(n: int) -> int:
    """A power of two up to 1024, else the next number whose prime factors are 2, 3, 5 and 7."""
    if n <= 1024:
        return 1 << max(0, (n - 1).bit_length())
    while True:
        m = n
        for p in (2, 3, 5, 7):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def texture_array(z: np.ndarray, alpha: float) -> np.ndarray:
    """The fractional Laplacian of a whole array (Brown 2010); missing cells count as the mean and stay missing."""
    if not 0 <= alpha <= 2:
        raise ValueError("alpha must be between 0 and 2")
    bad = np.isnan(z)
    if bad.all():
        return z
    shape = [_fft_size(n) for n in z.shape]
    before = [(s - n) // 2 for s, n in zip(shape, z.shape, strict=True)]
    filled = np.pad(np.where(bad, np.nanmean(z), z), [(b, s - n - b) for b, s, n in zip(before, shape, z.shape, strict=True)], mode="symmetric")
    frequency = np.hypot(np.fft.fftfreq(shape[0])[:, None], np.fft.rfftfreq(shape[1])[None, :])
    frequency[0, 0] = 1.0
    power = frequency**alpha
    if alpha > 0:
        power[0, 0] = 0.0
    back = np.fft.irfft2(np.fft.rfft2(filled) * power, s=shape)
    out = back[before[0] : before[0] + z.shape[0], before[1] : before[1] + z.shape[1]].copy()
    out[bad] = np.nan
    return out


def texture_shading(df: DataFrame, alpha: float = 0.8, most: int | None = None, block: int = 1 << 18) -> DataFrame:
    """row, col, texture_shading. The filter is global: every output depends on every cell. A raster whose padded extent has at
    most ``block`` cells is one group; a larger one is transformed by groups of about ``block`` values, so that the memory of a
    task doesn't grow with it. If ``most`` is given, a raster of more cells (counted over its extent) raises."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["row"] - pdf["row"].min(), pdf["col"] - pdf["col"].min()
        z = np.full((int(i.max()) + 1, int(j.max()) + 1), np.nan)
        z[i, j] = pdf["z"].to_numpy(float)
        return pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "texture_shading": texture_array(z, alpha)[i, j]})

    if not 0 <= alpha <= 2:
        raise ValueError("alpha must be between 0 and 2")
    known = F.avg(F.when(~F.isnan("z"), F.col("z").cast("double")))
    *e, mean = df.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col"), known).first()
    height, width = (0, 0) if e[0] is None else (e[1] - e[0] + 1, e[3] - e[2] + 1)
    if most is not None and height * width > most:
        raise ValueError(f"the raster has more than {most} cells")
    if mean is None:
        return df.select(F.col("row").cast("int"), F.col("col").cast("int"), F.lit(None).cast("double").alias("texture_shading"))
    if _fft_size(height) * _fft_size(width) > block:
        shaded = _texture_by_blocks(df, alpha, (e[0], e[2]), (height, width), mean, block)
    else:
        shaded = df.select("row", "col", "z", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, "row int, col int, texture_shading double")
    return shaded.withColumn("texture_shading", F.when(~F.isnan("texture_shading"), F.col("texture_shading")))


def _texture_by_blocks(df: DataFrame, alpha: float, origin: tuple[int, int], shape: tuple[int, int], mean: float, block: int) -> DataFrame:
    """The filter of texture_array() in three shuffles. With line h = a * steps + b of the longer side (b < steps), all lines of
    one b are transformed over a and along the shorter side; after a turn by exp(-2 pi i b k / size), values of one frequency
    k of a are transformed over b, weighted and taken back; then lines of one b are taken back. Heights are counted from their
    mean, so that what is missing is zero. Which cells there are travels with the values, as bits."""
    (tall, wide), (top, left), (n, w) = (t if shape[0] >= shape[1] else t[::-1] for t in (("row", "col"), origin, shape))
    size, width = _fft_size(n), _fft_size(w)
    before, side = (size - n) // 2, (width - w) // 2
    lines = max(d for d in range(1, min(size, max(1, block // width)) + 1) if size % d == 0)
    steps, waves = size // lines, width // 2 + 1
    # a group of the middle step has all b, span frequencies of a and reach of those along the shorter side
    reach = min(waves, max(1, block // steps))
    span = min(lines, max(1, block // (steps * reach)))
    groups = [(slice(a, min(a + span, lines)), slice(c, min(c + reach, waves))) for a in range(0, lines, span) for c in range(0, waves, reach)]
    lift = mean if alpha == 0 else 0.0

    def turn(b, k, sign: int) -> np.ndarray:
        return np.exp(sign * 2j * np.pi * (b * k % size) / size)

    def packed(batches: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(batches)
        i, j, z = pdf[tall].to_numpy(np.int64) - top, (pdf[wide].to_numpy(np.int64) - left).astype(np.int32), pdf["z"].to_numpy(float)
        first, last = np.flatnonzero(i < before), np.flatnonzero(i >= n - (size - n - before))
        h = np.concatenate([before + i, before - 1 - i[first], before + 2 * n - 1 - i[last]])
        source = np.concatenate([np.arange(len(i)), first, last])
        order = np.argsort(h % steps, kind="stable")
        h, source = h[order], source[order]
        cuts = np.flatnonzero(np.diff(h % steps)) + 1
        cells = zip(np.split((h // steps).astype(np.int32), cuts), np.split(source, cuts), strict=True)
        # bytes of one place stand together, as those that are zero in all heights compress so
        raw = [a.tobytes() + j[at].tobytes() + z[at].view(np.uint8).reshape(-1, 8).T.tobytes() for a, at in cells]
        return pd.DataFrame({"_b": h[np.r_[0, cuts]] % steps, "_cells": raw})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, count = [], 0
        for pdf in batches:
            kept.append(pdf)
            count += len(pdf)
            if count >= block:
                yield packed(kept)
                kept, count = [], 0
        if count:
            yield packed(kept)

    def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(raw) // 16
        i, j = np.frombuffer(raw, np.int32, 2 * k).reshape(2, k)
        return i, j, np.frombuffer(raw, np.uint8, offset=8 * k).reshape(8, k).T.copy().view(float)[:, 0]

    def forward(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(key[0])
        i, j, v = (np.concatenate(x) for x in zip(*map(unpacked, pdf["_cells"]), strict=True))
        valid, h = ~np.isnan(v), i.astype(np.int64) * steps + b
        z = np.zeros((lines, w))
        z[i, j] = np.where(valid, v - mean, 0.0)
        own = (h >= before) & (h < before + n)  # the rest are reflections
        held = np.zeros((2, lines, w), bool)
        held[0, i[own], j[own]] = True
        held[1, i[own], j[own]] = valid[own]
        f = np.fft.fft(np.fft.rfft(np.pad(z, ((0, 0), (side, width - w - side)), mode="symmetric"), axis=1), axis=0)
        f *= turn(b, np.arange(lines), -1)[:, None]
        bits = [np.packbits(held[:, ks]).tobytes() if c.start == 0 else None for ks, c in groups]
        return pd.DataFrame({"_b": b, "_g": range(len(groups)), "_f": [f[g].tobytes() for g in groups], "_held": bits})

    def weigh(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ks, cs = groups[int(key[0])]
        k1, k2 = np.arange(ks.start, ks.stop), np.arange(steps)[:, None]
        f = np.zeros((steps, len(k1), cs.stop - cs.start), complex)
        for b, raw in zip(pdf["_b"], pdf["_f"], strict=True):
            f[b] = np.frombuffer(raw, complex).reshape(f.shape[1:])
        k = k1 + lines * k2
        far = np.where(k < (size + 1) // 2, k, k - size) / size
        f = np.fft.fft(f, axis=0)
        f *= np.hypot(far[:, :, None], np.arange(cs.start, cs.stop) / width) ** alpha
        f = np.fft.ifft(f, axis=0)
        f *= turn(k2, k1, 1)[:, :, None]
        return pd.DataFrame({"_b": pdf["_b"], "_g": pdf["_g"], "_f": [f[b].tobytes() for b in pdf["_b"]], "_held": pdf["_held"]})

    def backward(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f, held = np.empty((lines, waves), complex), np.empty((2, lines, w), bool)
        for g, raw, bits in zip(pdf["_g"], pdf["_f"], pdf["_held"], strict=True):
            ks, cs = groups[g]
            rows = ks.stop - ks.start
            f[ks, cs] = np.frombuffer(raw, complex).reshape(rows, -1)
            if cs.start == 0:
                held[:, ks] = np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * rows * w).reshape(2, rows, w)
        z = np.fft.irfft(np.fft.ifft(f, axis=0), n=width, axis=1)[:, side : side + w]
        i, j = np.nonzero(held[0])
        found = np.where(held[1, i, j], z[i, j] + lift, np.nan)
        return pd.DataFrame({tall: i * steps + int(key[0]) - before + top, wide: j + left, "texture_shading": found})

    dealt = df.select(tall, wide, F.col("z").cast("double").alias("z")).mapInPandas(pack, "_b long, _cells binary")
    spectrum = dealt.groupBy("_b").applyInPandas(forward, "_b long, _g long, _f binary, _held binary")
    weighted = spectrum.groupBy("_g").applyInPandas(weigh, "_b long, _g long, _f binary, _held binary")
    return weighted.groupBy("_b").applyInPandas(backward, f"{tall} int, {wide} int, texture_shading double").select("row", "col", "texture_shading")


def _one(name: str):
    def attribute(df: DataFrame, **options) -> DataFrame:
        return terrain_attributes(df, name, **options)

    attribute.__name__ = name
    attribute.__doc__ = f"row, col, {name}; options as those of terrain_attributes()."
    return attribute


slope, aspect, hillshade = (_one(n) for n in T.SURFACE)
curvature, profile_curvature, tangential_curvature, planform_curvature, flowline_curvature, max_curvature, min_curvature = (_one(n) for n in T.CURVATURES)
topographic_position_index, terrain_ruggedness_index, roughness, rugosity = (_one(n) for n in T.WINDOWED)
fractal_roughness = _one("fractal_roughness")


def mean_filter(df: DataFrame, size: int, shape: str = "circular") -> DataFrame:
    """row, col, mean of the valid cells in a kernel, n valid cells and kernel_size; a square or circular kernel."""
    r = size // 2
    if shape == "square":
        # cells are spread along their rows first, so that a gap in the middle of a window hides nothing
        along = F.explode(F.sequence(F.col("col") - r, F.col("col") + r))
        lines = df.where("z is not null").select("row", along.alias("col"), "z").groupBy("row", "col").agg(F.sum("z").alias("s"), F.count("*").alias("k"))
        down = Window.partitionBy("col").orderBy("row").rangeBetween(-r, r)
        sums = lines.union(df.select("row", "col", F.lit(0.0), F.lit(0))).groupBy("row", "col").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
        win = sums.select("row", "col", F.sum("s").over(down).alias("s"), F.sum("k").over(down).alias("n"))
        out = df.select("row", "col").join(win, ["row", "col"])
        return out.select("row", "col", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("mean"), "n", F.lit(size * size).alias("kernel_size"))
    if shape != "circular":
        raise ValueError("the kernel is square or circular")
    centre = (size - 1) / 2
    cells = [(i, j) for i in range(size) for j in range(size) if (i - centre) ** 2 + (j - centre) ** 2 < (size / 2) ** 2]
    # each row of the kernel is one run of columns
    runs = {i: (min(j for k, j in cells if k == i), max(j for k, j in cells if k == i)) for i in {k for k, _ in cells}}

    def kernel(z: np.ndarray) -> dict[str, np.ndarray]:
        valid = ~np.isnan(z)
        sums, n = np.zeros(z.shape), np.zeros(z.shape)
        for source, into in ((np.where(valid, z, 0.0), sums), (valid.astype(float), n)):
            wide = np.pad(source, size)
            total = np.zeros((wide.shape[0], wide.shape[1] + 1))
            np.cumsum(wide, axis=1, out=total[:, 1:])
            for i, (first, last) in runs.items():
                rows = total[size + i - r : size + i - r + z.shape[0]]
                into += rows[:, size + last - r + 1 :][:, : z.shape[1]] - rows[:, size + first - r :][:, : z.shape[1]]
        with np.errstate(invalid="ignore", divide="ignore"):
            return {"mean": np.where(n > 0, sums / n, np.nan), "n": n}

    out = halo_tiles(df, kernel, r, ["mean", "n"], max(256, size))
    return out.select("row", "col", "mean", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"), F.lit(len(cells)).alias("kernel_size"))


def convolution(df: DataFrame, kernels: dict[str, list[list[float]]], size: int = 256) -> DataFrame:
    """row, col and one column for each kernel: convolution in the mathematical sense (the kernel is turned), missing where
    the window leaves the raster or holds a missing cell."""
    if len({(len(k), len(k[0])) for k in kernels.values()}) != 1:
        raise ValueError("kernels have one shape")
    arrays = {n: np.asarray(k, float)[::-1, ::-1] for n, k in kernels.items()}
    side = next(iter(arrays.values())).shape
    halo = max(side) // 2

    def kernel(z: np.ndarray) -> dict[str, np.ndarray]:
        windows = sliding_window_view(z, side)
        out = {}
        for n, k in arrays.items():
            full = np.full(z.shape, np.nan)
            full[side[0] // 2 : side[0] // 2 + windows.shape[0], side[1] // 2 : side[1] // 2 + windows.shape[1]] = np.einsum("ijkl,kl->ij", windows, k)
            out[n] = full
        return out

    return halo_tiles(df, kernel, halo, list(kernels), size)
