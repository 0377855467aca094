"""Robust fits of polynomials and sums of sines, as aggregates over tables and solves on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.numeric import nelder_mead
from talus.operators.masks import sample
from talus.operators.stats import nmad


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def huber_loss(y: Column, p: Column, delta: float = 1.35) -> Column:
    r = F.abs(y - p)
    return F.sum(F.when(r <= delta, 0.5 * r * r).otherwise(delta * (r - 0.5 * delta)))


def soft_loss(y: Column, p: Column, scale: float = 0.5) -> Column:
    r = (y - p) / scale
    return F.sum(2 * scale * scale * (F.sqrt(1 + r * r) - 1))


LOSSES = {"rmse": rmse, "huber": huber_loss, "soft": soft_loss}


def polynomial_1d(x: Column, coefficients: list[float]) -> Column:
    """Ascending powers, by Horner's rule."""
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + float(c)
    return out


def polynomial_2d(x: Column, y: Column, coefficients: np.ndarray) -> Column:
    """Sum of c[i, j] x^i y^j."""
    return polynomial_1d_of([polynomial_1d(y, list(line)) for line in np.asarray(coefficients, float)], x)


def polynomial_1d_of(parts: list[Column], x: Column) -> Column:
    out = parts[-1]
    for p in reversed(parts[:-1]):
        out = out * x + p
    return out


def sum_of_sines(x: Column, parameters: list[float]) -> Column:
    """Sum of A sin(2 pi x / wavelength + phase) for triples (A, wavelength, phase)."""
    out = F.lit(0.0)
    for k in range(0, len(parameters), 3):
        a, wave, phase = map(float, parameters[k : k + 3])
        out = out + a * F.sin(2 * math.pi / wave * x + phase)
    return out


def gram(df: DataFrame, terms: list[Column], target: Column, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Normal equations of a linear fit, in one pass: sums of products of terms, of terms and the target, and the count."""
    n = len(terms)
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(*(t.cast("double").alias(f"t{k}") for k, t in enumerate(terms)), target.cast("double").alias("y"), w.cast("double").alias("w")).where("y is not null")
    sums = [F.sum(F.col("w") * F.col(f"t{i}") * F.col(f"t{j}")).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    got = rows.agg(*sums, *(F.sum(F.col("w") * F.col(f"t{i}") * F.col("y")).alias(f"b{i}") for i in range(n)), F.count("*").alias("n")).first()
    g = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            g[i, j] = g[j, i] = got[f"g{i}_{j}"] or 0.0
    return g, np.array([got[f"b{i}"] or 0.0 for i in range(n)]), got["n"]


def linear_fit(df: DataFrame, terms: list[Column], target: Column, robust: bool = False, iterations: int = 8, delta: float = 1.35) -> np.ndarray:
    """Coefficients by least squares, or with Huber's weights, which are renewed by further passes."""
    return nested_fits(df, terms, target, [len(terms)], robust, iterations, delta)[0]


def nested_fits(df: DataFrame, terms: list[Column], target: Column, sizes: list[int], robust: bool = False, iterations: int = 8, delta: float = 1.35) -> list[np.ndarray]:
    """The coefficients of linear_fit for the first so many terms, for several sizes at once: one pass gives the normal equations
    of all, and each renewal of Huber's weights takes two passes for all fits that have not settled."""
    g, b, n = gram(df, terms, target)
    if not n:
        raise ValueError("there is no valid value to fit")
    fits = [np.linalg.lstsq(g[:k, :k], b[:k], rcond=None)[0] for k in sizes]
    left = list(range(len(sizes))) if robust else []
    for _ in range(iterations):
        if not left:
            break
        r = {f: F.abs(target - sum((t * float(v) for t, v in zip(terms, fits[f], strict=False)), F.lit(0.0))) for f in left}
        medians = df.where(target.isNotNull()).agg(*(F.percentile_approx(r[f], 0.5, 10000).alias(f"r{f}") for f in left)).first()
        left = [f for f in left if medians[f"r{f}"]]
        if not left:
            break
        scales = {f: medians[f"r{f}"] * 1.4826 for f in left}
        weights = [F.when(r[f] <= delta * scales[f], 1.0).otherwise(delta * scales[f] / r[f]) for f in left]
        for f, (g, b) in zip(list(left), _grams(df, terms, target, weights, [sizes[f] for f in left]), strict=True):
            new = np.linalg.lstsq(g, b, rcond=None)[0]
            if np.allclose(new, fits[f], rtol=1e-6, atol=1e-9):
                left.remove(f)
            fits[f] = new
    return fits


def _grams(df: DataFrame, terms: list[Column], target: Column, weights: list[Column], sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Normal equations under several weights, each of the first so many terms, in one pass."""
    rows = df.select(*(t.cast("double").alias(f"t{k}") for k, t in enumerate(terms)), target.cast("double").alias("y"), *(w.cast("double").alias(f"w{k}") for k, w in enumerate(weights))).where("y is not null")
    sums = [F.sum(F.col(f"w{k}") * F.col(f"t{i}") * F.col(f"t{j}")).alias(f"g{k}_{i}_{j}") for k, n in enumerate(sizes) for i in range(n) for j in range(i, n)]
    got = rows.agg(*sums, *(F.sum(F.col(f"w{k}") * F.col(f"t{i}") * F.col("y")).alias(f"b{k}_{i}") for k, n in enumerate(sizes) for i in range(n))).first()
    out = []
    for k, n in enumerate(sizes):
        g = np.array([[got[f"g{k}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
        out.append((g, np.array([got[f"b{k}_{i}"] or 0.0 for i in range(n)])))
    return out


#: Rows from which subsets are drawn, and subsets, of the estimators by subsets.
POOL, SUBSETS, TRIALS = 20_000, 10_000, 100


def subset_fit(df: DataFrame, terms: list[Column], target: Column, estimator: str, seed: int = 42) -> np.ndarray:
    """Coefficients by fits to random smallest subsets.

    ``ransac``: of 100 such fits the one with the most rows within a threshold (the median absolute deviation of the target)
    wins, and is refitted to those rows; rows are counted for all fits in one pass over all data. ``theil-sen``: the spatial
    median of 10 000 such fits. Subsets are drawn from a sample of at most 20 000 different rows, which is chosen by hash."""
    n = len(terms)
    rows = df.select(*(t.cast("double").alias(f"t{k}") for k, t in enumerate(terms)), target.cast("double").alias("y")).dropna()
    names = [f"t{k}" for k in range(n)]
    # equal rows have one hash, so one of them that repeats often could fill a sample
    pool = sample(rows.distinct(), POOL, seed, [*names, "y"]).toPandas().sort_values([*names, "y"]).to_numpy(float)
    if len(pool) < n:
        raise ValueError("there are fewer different rows than terms")
    rng, found = np.random.default_rng(seed), []
    wanted = TRIALS if estimator == "ransac" else SUBSETS
    for _ in range(4):  # singular subsets are drawn again, a few times
        picks = pool[rng.integers(0, len(pool), (wanted, n))]
        sides = picks[:, :, :n]
        good = np.abs(np.linalg.det(sides)) > 1e-9 * np.maximum(np.prod(np.linalg.norm(sides, axis=2), axis=1), 1e-300)
        found.extend(np.linalg.solve(sides[good], picks[good][:, :, n:])[:, :, 0])
        if len(found) >= wanted:
            break
    if not found:
        return linear_fit(rows, [F.col(t) for t in names], F.col("y"))
    fits = np.array(found[:wanted])
    if estimator == "theil-sen":
        return _spatial_median(fits)
    threshold = float(nmad(rows, "y", nfact=1.0).first()["nmad"]) or 1e-9
    misses = [F.abs(F.col("y") - sum((F.col(t) * float(v) for t, v in zip(names, c, strict=True)), F.lit(0.0))) for c in fits]
    counts = rows.agg(*(F.count_if(m <= threshold).alias(f"n{k}") for k, m in enumerate(misses))).first()
    return linear_fit(rows.where(misses[int(np.argmax(counts))] <= threshold), [F.col(t) for t in names], F.col("y"))


def _spatial_median(points: np.ndarray, most: int = 300) -> np.ndarray:
    """The point with the least sum of distances, by re-weighted means."""
    at = np.median(points, axis=0)
    for _ in range(most):
        w = 1 / np.maximum(np.linalg.norm(points - at, axis=1), 1e-12)
        new = (points * w[:, None]).sum(axis=0) / w.sum()
        if np.allclose(new, at, rtol=1e-10, atol=1e-12):
            return new
        at = new
    return at


def best_order(costs: list[float], margin: float = 20.0) -> int:
    """The first of costs that is within so many percent of the best."""
    best = min(costs)
    return next(k for k, c in enumerate(costs) if c <= best * (1 + margin / 100) + 1e-12)


def fit_polynomial(df: DataFrame, x: str, y: str, max_order: int = 6, loss: str = "soft", margin: float = 20.0, robust: bool = True, estimator: str | None = None) -> tuple[list[float], int]:
    """Coefficients (ascending) and order of the lowest polynomial whose loss is within a margin of the best. Powers are taken
    of x scaled to -1..1, and the costs of all orders come from one pass. The estimator is linear, huber, theil-sen or ransac;
    left out, huber or linear as ``robust`` says."""
    estimator = estimator or ("huber" if robust else "linear")
    if estimator not in ("linear", "huber", "theil-sen", "ransac"):
        raise ValueError("the estimator is linear, huber, theil-sen or ransac")
    ends = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if ends["lo"] is None:
        raise ValueError("there is no valid value to fit")
    centre, half = (ends["lo"] + ends["hi"]) / 2, max((ends["hi"] - ends["lo"]) / 2, 1e-12)
    t = (F.col(x) - centre) / half
    df = df.select(x, y).dropna().persist()
    powers = [F.pow(t, F.lit(k)) if k else F.lit(1.0) for k in range(max_order + 1)]
    by_subsets = estimator in ("theil-sen", "ransac")
    sizes = range(2, max_order + 2)
    fits = [subset_fit(df, powers[:k], F.col(y), estimator) for k in sizes] if by_subsets else nested_fits(df, powers, F.col(y), list(sizes), estimator == "huber")
    cost = df.agg(*(LOSSES[loss](F.col(y), polynomial_1d(t, list(c))).alias(f"c{k}") for k, c in enumerate(fits))).first()
    df.unpersist()
    k = best_order(list(cost), margin)
    scaled = np.polynomial.Polynomial(fits[k], domain=[centre - half, centre + half], window=[-1, 1])
    return [float(v) for v in scaled.convert().coef], k + 1


def fit_sines(bins_x: np.ndarray, bins_y: np.ndarray, max_frequencies: int = 3, seed: int = 42, hops: int = 30, margin: float = 20.0) -> list[float]:
    """Amplitudes, wavelengths and phases of a sum of sines through binned medians, largest first. For given wavelengths the
    rest is linear, so the search hops among wavelengths only, from several starts."""
    good = np.isfinite(bins_y)
    x, y = np.asarray(bins_x, float)[good], np.asarray(bins_y, float)[good]
    if len(x) < 4:
        raise ValueError("too few bins hold values")
    span, gap = np.ptp(x), np.median(np.diff(np.sort(x)))
    rng = np.random.default_rng(seed)

    def solve(waves: np.ndarray) -> tuple[np.ndarray, float]:
        a = np.column_stack([f(2 * np.pi * x / w) for w in waves for f in (np.sin, np.cos)])
        c = np.linalg.lstsq(a, y, rcond=None)[0]
        r = (y - a @ c) / 0.5
        return c, float((0.5 * (np.sqrt(1 + r * r) - 1)).sum())

    found: list[tuple[np.ndarray, float]] = []
    waves = np.zeros(0)
    for n in range(1, max_frequencies + 1):
        best = (None, np.inf)
        for _ in range(hops):
            start = np.concatenate([waves, [math.exp(rng.uniform(math.log(2 * gap), math.log(2 * span)))]])
            logs, cost = nelder_mead(lambda v: solve(np.clip(np.exp(v), 2 * gap, 4 * span))[1], np.log(start), 0.2, 1e-5, 80)
            if cost < best[1]:
                best = (np.clip(np.exp(logs), 2 * gap, 4 * span), cost)
        waves = best[0]
        found.append(best)
        if len(x) < 3 * (n + 1):
            break
    waves = found[best_order([c for _, c in found], margin)][0]
    c, _ = solve(waves)
    triples = [(math.hypot(c[2 * k], c[2 * k + 1]), float(w), math.atan2(c[2 * k + 1], c[2 * k]) % (2 * math.pi)) for k, w in enumerate(waves)]
    return [v for t in sorted(triples, reverse=True) for v in t]
