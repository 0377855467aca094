"""Small solvers on the driver, for inputs that are a few numbers: normal equations, simplex search, robust fits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def nelder_mead(f: Callable[[np.ndarray], float], x0: np.ndarray, step: float = 1.0, tolerance: float = 1e-4, most: int = 120) -> tuple[np.ndarray, float]:
    """Minimum of f by the downhill simplex method."""
    x0 = np.asarray(x0, float)
    simplex = [x0] + [x0 + step * np.eye(len(x0))[k] for k in range(len(x0))]
    values = [f(x) for x in simplex]
    for _ in range(most):
        order = np.argsort(values)
        simplex, values = [simplex[k] for k in order], [values[k] for k in order]
        if max(np.abs(s - simplex[0]).max() for s in simplex[1:]) < tolerance:
            break
        middle = np.mean(simplex[:-1], axis=0)
        mirrored = middle + (middle - simplex[-1])
        v = f(mirrored)
        if v < values[0]:
            far = middle + 2 * (middle - simplex[-1])
            w = f(far)
            simplex[-1], values[-1] = (far, w) if w < v else (mirrored, v)
        elif v < values[-2]:
            simplex[-1], values[-1] = mirrored, v
        else:
            near = middle + 0.5 * ((mirrored if v < values[-1] else simplex[-1]) - middle)
            w = f(near)
            if w < min(v, values[-1]):
                simplex[-1], values[-1] = near, w
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (s - simplex[0]) for s in simplex[1:]]
                values = [values[0]] + [f(s) for s in simplex[1:]]
    best = int(np.argmin(values))
    return simplex[best], float(values[best])


def least_squares(residual: Callable[[np.ndarray], np.ndarray], x0: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 200) -> np.ndarray:
    """Bounded Levenberg-Marquardt with a numerical Jacobian; steps are clipped to the bounds."""
    x, lam = np.clip(np.asarray(x0, float), low, high), 1e-3
    r = residual(x)
    for _ in range(most):
        steps = 1e-6 * np.maximum(np.abs(x), 1e-3)
        steps = np.where(x + steps > high, -steps, steps)
        jac = np.column_stack([(residual(x + d * np.eye(len(x))[k]) - r) / d for k, d in enumerate(steps)])
        gram, grad = jac.T @ jac, jac.T @ r
        while True:
            move = np.linalg.lstsq(gram + lam * np.diag(np.diag(gram) + 1e-12), -grad, rcond=None)[0]
            new = np.clip(x + move, low, high)
            s = residual(new)
            if s @ s < r @ r or lam > 1e10:
                break
            lam *= 4
        if lam > 1e10 or r @ r - s @ s < 1e-14 * (r @ r):
            return new if s @ s < r @ r else x
        x, r, lam = new, s, max(lam / 3, 1e-12)
    return x


def ransac_plane(x: np.ndarray, y: np.ndarray, v: np.ndarray, threshold: float = 0.01, iterations: int = 2000, seed: int = 42) -> tuple[float, float, float]:
    """a, b, c of v = a x + b y + c with the most values within a threshold, refitted to those. Where all x or all y are the
    same, the slope along it is zero."""
    good = np.isfinite(v)
    x, y, v = x[good], y[good], v[good]
    if not len(v):
        raise ValueError("no value is valid")
    use = [k for k, c in enumerate((x, y)) if np.ptp(c) > 0]
    columns = np.column_stack([*(c for k, c in enumerate((x, y)) if k in use), np.ones(len(v))])
    need = columns.shape[1]
    if len(v) <= need:
        best = np.ones(len(v), bool)
    else:
        rng, best = np.random.default_rng(seed), np.zeros(len(v), bool)
        for _ in range(iterations):
            pick = rng.choice(len(v), need, replace=False)
            if np.linalg.matrix_rank(columns[pick]) < need:
                continue
            fit = np.linalg.solve(columns[pick], v[pick])
            near = np.abs(columns @ fit - v) <= threshold
            if near.sum() > best.sum():
                best = near
        if not best.any():
            best = np.ones(len(v), bool)
    fit = np.linalg.lstsq(columns[best], v[best], rcond=None)[0]
    out = [0.0, 0.0, float(fit[-1])]
    for k, value in zip(use, fit, strict=False):
        out[k] = float(value)
    return out[0], out[1], out[2]


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through points, straight at its ends; NaN outside. With fewer than three points a line."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    n = len(x)
    inside = (at >= x[0]) & (at <= x[-1])
    if n < 3:
        return np.where(inside, np.interp(at, x, y), np.nan)
    h = np.diff(x)
    a = np.zeros((n, n))
    b = np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        b[k] = 6 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1])
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t, u = x[k + 1] - at, at - x[k]
    out = (m[k] * t**3 + m[k + 1] * u**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * t + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * u
    return np.where(inside, out, np.nan)


def gauss_legendre(f: Callable[[np.ndarray], np.ndarray], low: float, high: float, pieces: int = 64, order: int = 8) -> float:
    """Integral of a smooth function by composite quadrature."""
    nodes, weights = np.polynomial.legendre.leggauss(order)
    edges = np.linspace(low, high, pieces + 1)
    middle, half = (edges[1:] + edges[:-1]) / 2, np.diff(edges) / 2
    points = middle[:, None] + half[:, None] * nodes
    return float((f(points) * weights * half[:, None]).sum())
