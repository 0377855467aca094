"""Formulas of terrain attributes, as SQL text over neighbour columns.

In a neighbourhood of radius k the cell at row offset i and column offset j (from the upper left) is the column ``z{i}{j}``.
The text is valid in Spark SQL and ANSI SQL alike. Any missing neighbour gives NULL.
"""

from __future__ import annotations

import math

# Kernels of the third-order fit on 5 x 5 cells (Florinsky 2009), as they apply to a window whose first row is
# north. The kernel of q is minus the transpose of that of p, and the kernel of t the transpose of that of r.
FLORINSKY_P = [
    [-31, 44, 0, -44, 31],
    [5, 62, 0, -62, -5],
    [17, 68, 0, -68, -17],
    [5, 62, 0, -62, -5],
    [-31, 44, 0, -44, 31],
]
FLORINSKY_R = [[2, -1, -2, -1, 2]] * 5
FLORINSKY_S = [
    [-4, -2, 0, 2, 4],
    [-2, -1, 0, 1, 2],
    [0, 0, 0, 0, 0],
    [2, 1, 0, -1, -2],
    [4, 2, 0, -2, -4],
]

FITS = {"horn": "Horn", "zevenbergthorne": "ZevenbergThorne", "florinsky": "Florinsky"}
SURFACE = ["slope", "aspect", "hillshade"]
CURVATURES = ["curvature", "profile_curvature", "tangential_curvature", "planform_curvature", "flowline_curvature", "max_curvature", "min_curvature"]
WINDOWED = ["topographic_position_index", "terrain_ruggedness_index", "roughness", "rugosity"]
TILED = ["fractal_roughness", "texture_shading"]


def transpose(kernel: list[list[int]], sign: int = 1) -> list[list[int]]:
    return [[sign * kernel[j][i] for j in range(len(kernel))] for i in range(len(kernel))]


def weighted(kernel: list[list[int]]) -> str:
    """Sum of neighbours times weights."""
    terms = [f"{w:+d} * z{i}{j}" for i, line in enumerate(kernel) for j, w in enumerate(line) if w]
    return "(" + " ".join(terms).lstrip("+") + ")"


def radius(fit: str) -> int:
    return 2 if fit == "Florinsky" else 1


def whole(r: int) -> str:
    """The centre, NULL if any neighbour is missing."""
    cells = [f"z{i}{j}" for i in range(2 * r + 1) for j in range(2 * r + 1)]
    return f"CASE WHEN {' AND '.join(c + ' IS NOT NULL' for c in cells)} THEN z{r}{r} END"


def derivatives(fit: str, res: float) -> dict[str, str]:
    """zx, zy and, where the fit has them, zxx, zyy, zxy."""
    r = float(res)
    if fit == "Horn":
        return {
            "zx": f"(z00 + 2 * z10 + z20 - z02 - 2 * z12 - z22) / {8 * r!r}",
            "zy": f"(z20 + 2 * z21 + z22 - z00 - 2 * z01 - z02) / {8 * r!r}",
        }
    if fit == "ZevenbergThorne":
        return {
            "zx": f"(z10 - z12) / {2 * r!r}",
            "zy": f"(z21 - z01) / {2 * r!r}",
            "zxx": f"(z10 - 2 * z11 + z12) / {r * r!r}",
            "zyy": f"(z01 - 2 * z11 + z21) / {r * r!r}",
            "zxy": f"(z02 - z00 + z20 - z22) / {4 * r * r!r}",
        }
    return {
        "zx": f"{weighted(FLORINSKY_P)} / {420 * r!r}",
        "zy": f"{weighted(transpose(FLORINSKY_P, -1))} / {420 * r!r}",
        "zxx": f"{weighted(FLORINSKY_R)} / {35 * r * r!r}",
        "zyy": f"{weighted(transpose(FLORINSKY_R))} / {35 * r * r!r}",
        "zxy": f"{weighted(FLORINSKY_S)} / {100 * r * r!r}",
    }


G = "(zx * zx + zy * zy)"
TURN = repr(2 * math.pi)
_ASPECT = f"(-atan2(-zx, zy) - floor(-atan2(-zx, zy) / {TURN}) * {TURN})"
_MEAN = "(-((1 + zy * zy) * zxx - 2 * zx * zy * zxy + (1 + zx * zx) * zyy) / (2 * sqrt(power(1 + {g}, 3))))".format(g=G)
_SPREAD = "sqrt(greatest(0.0, {h} * {h} - (zxx * zyy - zxy * zxy) / power(1 + {g}, 2)))".format(h=_MEAN, g=G)


def surface(name: str, degrees: bool = True, method: str = "geometric", azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> str:
    """An attribute of the fitted surface, from the derivatives."""
    directional = method == "directional"
    if name == "slope":
        return f"degrees(atan(sqrt({G})))" if degrees else f"atan(sqrt({G}))"
    if name == "aspect":
        return f"degrees({_ASPECT})" if degrees else _ASPECT
    if name == "hillshade":
        if not 0 <= azimuth <= 360 or not 0 <= altitude <= 90 or not 0 <= z_factor < math.inf:
            raise ValueError("azimuth must be in 0 to 360, altitude in 0 to 90, and the z factor positive")
        alt, az = math.radians(altitude), math.radians(360.0 - azimuth)
        s = f"atan(sqrt({G}))" if z_factor == 1 else f"atan({z_factor!r} * sqrt({G}))"
        shade = f"1.5 + 254.0 * ({math.sin(alt)!r} * cos({s}) + {math.cos(alt)!r} * sin({s}) * sin({az!r} - {_ASPECT}))"
        return f"least(255.0, greatest(0.0, {shade}))"
    if name == "curvature":
        return "-2.0 * (zxx + zyy) * 100"
    flat, nearly = f"{G} = 0", f"{G} < 1e-14"
    along = "(zxx * zx * zx + 2 * zxy * zx * zy + zyy * zy * zy)"
    across = "(zxx * zy * zy - 2 * zxy * zx * zy + zyy * zx * zx)"
    twist = "(zx * zy * (zxx - zyy) - zxy * (zx * zx - zy * zy))"
    value = {
        "profile_curvature": (flat, f"-{along} / {G}" if directional else f"-{along} / ({G} * sqrt(power(1 + {G}, 3)))"),
        "tangential_curvature": (flat, f"-{across} / {G}" if directional else f"-{across} / ({G} * sqrt(1 + {G}))"),
        "planform_curvature": (nearly, f"-{across} / sqrt(power({G}, 3))"),
        "flowline_curvature": (flat, f"{twist} / sqrt(power({G}, 3))") if directional else (nearly, f"{twist} / (sqrt(power({G}, 3)) * sqrt(1 + {G}))"),
        "max_curvature": (flat, "-((zxx + zyy) / 2 - sqrt(power((zxx - zyy) / 2, 2) + zxy * zxy))" if directional else f"{_MEAN} + {_SPREAD}"),
        "min_curvature": (flat, "-((zxx + zyy) / 2 + sqrt(power((zxx - zyy) / 2, 2) + zxy * zxy))" if directional else f"{_MEAN} - {_SPREAD}"),
    }[name]
    return f"CASE WHEN {value[0]} THEN 0.0 ELSE 100 * ({value[1]}) END"


def ruggedness(method: str, w: int) -> str:
    """Terrain ruggedness: the root of squared (Riley) or the mean of absolute (Wilson) differences from the centre."""
    m = w // 2
    cells = [f"z{i}{j}" for i in range(w) for j in range(w) if (i, j) != (m, m)]
    if method == "Riley":
        return "sqrt(" + " + ".join(f"({c} - z{m}{m}) * ({c} - z{m}{m})" for c in cells) + ")"
    if method == "Wilson":
        return "(" + " + ".join(f"abs({c} - z{m}{m})" for c in cells) + f") / {w * w - 1}.0"
    raise ValueError("the ruggedness method is Riley or Wilson")


def _area(a: str, b: str, c: str) -> str:
    """Heron's area from half edges."""
    s = f"(({a} + {b} + {c}) / 2)"
    return f"sqrt({s} * ({s} - {a}) * ({s} - {b}) * ({s} - {c}))"


def rugosity(res: float) -> str:
    """Surface area of eight triangles around the centre over flat area (Jenness 2004)."""
    ring = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]

    def half(p: tuple, q: tuple) -> str:
        flat = res * res * ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)
        return f"(sqrt(power(z{p[0]}{p[1]} - z{q[0]}{q[1]}, 2) + {float(flat)!r}) / 2)"

    triangles = [_area(half((1, 1), p), half((1, 1), q), half(p, q)) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
    return "(" + " + ".join(triangles) + f") / {float(res * res)!r}"
