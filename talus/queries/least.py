"""Least squares in SQL, for checks: terms are made orthogonal one after the other, so no equations need to be solved."""

from __future__ import annotations

from collections.abc import Sequence


def fitted(name: str, source: str, keep: Sequence[str], terms: Sequence[str], target: str, good: str = "true") -> str:
    """Text of common tables, the last of which, ``name``, holds the columns to keep and f, the fit of the target by the terms
    over the rows that are good; all rows of the source get their f."""
    kept = ", ".join(keep)
    n = len(terms)
    first = ", ".join(f"CAST({t} AS DOUBLE) AS t{k}" for k, t in enumerate(terms))
    steps = [f"{name}_0 AS (SELECT {kept}, {first}, CAST({target} AS DOUBLE) AS y, coalesce({good}, false) AND {target} IS NOT NULL AS g, CAST(0 AS DOUBLE) AS f FROM {source})"]
    for k in range(n):
        share = lambda v: f"(sum({v} * t{k}) FILTER (WHERE g) OVER () / sum(t{k} * t{k}) FILTER (WHERE g) OVER ()) * t{k}"  # noqa: E731, B023
        rest = "".join(f", t{j} - {share(f't{j}')} AS t{j}" for j in range(k + 1, n))
        steps.append(f"{name}_{k + 1} AS (SELECT {kept}, y - {share('y')} AS y, f + {share('y')} AS f, g{rest} FROM {name}_{k})")
    steps.append(f"{name} AS (SELECT {kept}, f FROM {name}_{n})")
    return ", ".join(steps)
