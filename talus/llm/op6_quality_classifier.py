"""Quality classifier: a sparse rule ensemble over text statistics.

``statistics`` counts whole texts and divides the counts into rates that don't depend on length. ``fit`` grows shallow
regression trees on residuals (gradient boosting on bounded, seeded subsamples), takes the path to every node as a rule (a
conjunction of thresholds), and weights rules and the rescaled statistics by lasso logistic regression, solved by proximal
gradient steps; most weights become zero. ``score`` compiles what is left into one Spark column expression, so scoring is
arithmetic in generated code.

At most ``max_labelled`` labelled rows are learned from, those that come first by a hash of their id. Labels, lang, source
and doc_id are no inputs. Null texts count as empty. With labels of fewer than two classes every score is 0.5. Labels that
contradict each other for one id count by majority, a tie as 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.batches import add_columns, field
from talus.llm.blocks import blocks
from talus.llm.op8_quality_rules import labelled_sample
from talus.llm.textstats import base_counts, shape_counts

MAX_LABELLED = 20_000
#: Statistics: a count over another count.
RATES = {
    "symbols": ("n_symbols", "n_bytes"),
    "dup_lines": ("n_dup_lines", "n_feeds"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "n_bytes"),
    "digits": ("n_digit", "n_bytes"),
    "punctuation": ("n_punct", "n_bytes"),
    "pipes": ("n_pipe", "n_words"),
    "bangs": ("n_bang", "n_words"),
    "wide": ("n_wide", "word_chars"),
    "feeds": ("n_feeds", "n_words"),
    "capitals": ("n_cap_words", "n_words"),
    "all_caps": ("n_all_caps", "n_words"),
    "short_words": ("n_short_words", "n_words"),
    "long_words": ("n_long_words", "n_words"),
    "again": ("n_again_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
NAMES = (*(f"stat_{k}" for k in RATES), "stat_log_words")


@dataclass(frozen=True)
class Rules:
    """A bias, rules (a weight and terms: statistic, above or not, threshold) and linear terms (weight, low, high)."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[int, bool, float], ...]], ...]
    linear: tuple[tuple[int, float, float, float], ...]


def statistics(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the statistics in NAMES."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        parts = []
        for block in blocks(batch.column("text")):
            c = base_counts(block) | shape_counts(block)
            rates = [np.minimum(c[a] / np.maximum(1, c[b]), 1e3) for a, b in RATES.values()]
            parts.append([*rates, np.log1p(c["n_words"])])
        return [pa.array(np.concatenate(x).astype(float)) for x in zip(*parts, strict=True)]

    return add_columns(docs, [field(n, T.DoubleType()) for n in NAMES], lambda: compute, drop)


def _grow(x: np.ndarray, r: np.ndarray, depth: int, least: int, path: tuple, out: list) -> np.ndarray:
    """A regression tree for r; adds the path of each node to out and returns predictions."""
    if path:
        out.append(path)
    if depth == 0 or len(r) < 2 * least:
        return np.full(len(r), r.mean())
    best = (1e-12, None, None)
    total = r.sum() ** 2 / len(r)
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0.03, 0.97, 24)))
        side = np.searchsorted(cuts, x[:, j], "left")  # x <= cuts[side] from there on
        n = np.cumsum(np.bincount(side, minlength=len(cuts) + 1))[:-1]
        s = np.cumsum(np.bincount(side, r, minlength=len(cuts) + 1))[:-1]
        ok = (n >= least) & (len(r) - n >= least)
        gain = np.where(ok, s * s / np.maximum(1, n) + (r.sum() - s) ** 2 / np.maximum(1, len(r) - n) - total, 0)
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-9:
            best = (gain[k], j, float(cuts[k]))
    if best[1] is None:
        return np.full(len(r), r.mean())
    _, j, cut = best
    above = x[:, j] > cut
    p = np.empty(len(r))
    p[~above] = _grow(x[~above], r[~above], depth - 1, least, (*path, (j, False, cut)), out)
    p[above] = _grow(x[above], r[above], depth - 1, least, (*path, (j, True, cut)), out)
    return p


def _holds(x: np.ndarray, terms: tuple) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, above, cut in terms:
        ok &= (x[:, j] > cut) == above
    return ok


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rows: int = 4000, lasso: float = 2e-3, seed: int = 7) -> Rules:
    """The ensemble for labels y (0 or 1) of rows x; classes weigh the same."""
    if not len(y) or not 0 < y.sum() < len(y):
        return Rules(0.0, (), ())
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    margin, paths = np.zeros(len(y)), []
    for t in range(trees):
        pick = np.sort(rng.choice(len(y), min(rows, len(y)), replace=len(y) < rows, p=weight))
        residual = y[pick] - 1 / (1 + np.exp(-margin[pick]))
        out: list[tuple] = []
        _grow(x[pick], residual, 1 + t % depth, max(5, len(pick) // 100), (), out)
        paths += out
        for terms in out:
            if len(terms) == max(map(len, out)):
                on = _holds(x[pick], terms)
                if on.any():
                    margin[_holds(x, terms)] += 0.5 * residual[on].mean() / 0.25
        margin = np.clip(margin, -8, 8)
    paths = sorted(set(paths), key=lambda p: (len(p), p))
    low, high = np.quantile(x, 0.02, axis=0), np.quantile(x, 0.98, axis=0)
    spread = np.where(high > low, high - low, 1.0)
    features = np.column_stack([*(_holds(x, p) for p in paths), *((np.clip(x, low, high) - low) / spread).T]).astype(float)
    mean = weight @ features
    scale = np.sqrt(weight @ (features - mean) ** 2)
    live = scale > 1e-6
    z = (features[:, live] - mean[live]) / scale[live]
    w, b, v, c, t = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0, 1.0
    power = np.ones(z.shape[1])
    for _ in range(20):
        power = z.T @ (weight * (z @ power))
        size = np.linalg.norm(power)
        power /= size
    step = 1 / (0.25 * max(1.0, size) * 1.05)
    for _ in range(400):  # accelerated proximal gradient
        g = weight * (1 / (1 + np.exp(-np.clip(z @ v + c, -40, 40))) - y)
        w0, b0 = w, b
        w = v - step * (z.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - step * lasso, 0)
        b = c - step * g.sum()
        t0, t = t, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w + (t0 - 1) / t * (w - w0), b + (t0 - 1) / t * (b - b0)
    full = np.zeros(features.shape[1])
    full[live] = w / scale[live]
    bias = b - float(full @ mean)
    n = len(paths)
    rules = tuple((float(full[k]), p) for k, p in enumerate(paths) if full[k])
    linear = tuple((j, float(full[n + j] / spread[j]), float(low[j]), float(high[j])) for j in range(x.shape[1]) if full[n + j])
    return Rules(float(bias), rules, linear)


def fit(docs: DataFrame, labels: DataFrame, where=None, max_labelled: int = MAX_LABELLED) -> Rules:
    """Rules for ``labels.quality``; where restricts the ids that are learned from."""
    sample = statistics(labelled_sample(docs, labels, max_labelled, where), drop=("text",)).toPandas()
    sample = sample.sort_values(["_id", *NAMES])
    return fit_rules(sample[list(NAMES)].to_numpy(float), sample["y"].to_numpy(float))


def score(rules: Rules) -> Column:
    """The probability of label 1, from the statistics."""
    margin = F.lit(rules.bias)
    for weight, terms in rules.rules:
        hold = None
        for j, above, cut in terms:
            term = F.col(NAMES[j]) > cut if above else F.col(NAMES[j]) <= cut
            hold = term if hold is None else hold & term
        margin = margin + F.when(hold, F.lit(weight)).otherwise(F.lit(0.0))
    for j, weight, low, high in rules.linear:
        margin = margin + F.lit(weight) * (F.greatest(F.lit(low), F.least(F.lit(high), F.col(NAMES[j]))) - F.lit(low))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def classify(docs: DataFrame, rules: Rules, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with score and predicted (1 if the score is at least 0.5)."""
    marked = statistics(docs, drop).withColumn("score", score(rules))
    return marked.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(*NAMES)
