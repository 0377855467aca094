"""Quality rules: counts with fixed limits, then a hashed n-gram logistic regression.

``train`` fits the model on at most ``max_labelled`` labelled rows (those that come first by a hash of their id, so the
choice doesn't depend on partitions). Features are relative frequencies of hashed words and of hashed runs of three code
points. A third of the sample is held back to calibrate probabilities (Platt's sigmoid on the margin). ``judge`` scores
whole texts in Arrow batches; nothing is shuffled, and only the weights (two arrays of ``2**bits`` floats) are broadcast.

Null texts are empty texts. Texts of under ``min_words`` words, or with more than ``max_repeat_percent`` % of their words in
repeated 8-word windows, fail the base rules. Where labels hold fewer than two classes there is no model, and the base rules
alone decide. Labels that contradict each other for one id count by majority, a tie as 1; null ids or labels are left out.
Rows that repeat an id are judged one by one; one of them is learned from. Bytes that are no UTF-8 are other bytes to the counts
and U+FFFD to the runs of code points. Columns of the input with the names of results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.batches import add_columns, field, restore, shield
from talus.llm.blocks import Block, blocks, mix, sums
from talus.llm.textstats import BASE, base_counts

MAX_LABELLED = 4000
BITS = 13
KEEP_AT = 0.4


@dataclass(frozen=True)
class Model:
    """Weights by bucket, bias, and the calibration a * margin + b."""

    words: np.ndarray
    grams: np.ndarray
    bias: float
    a: float
    b: float


def word_buckets(block: Block, bits: int = BITS) -> np.ndarray:
    return (block.words >> np.uint64(64 - bits)).astype(np.int64)


def gram_buckets(block: Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of runs of three code points, and their bounds by text (no run crosses texts)."""
    raw = block.data.tobytes()
    try:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
        lead = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum((block.data & 0xC0) != 0x80, out=lead[1:])
        offsets = lead[block.offsets]
    except UnicodeDecodeError:
        texts = [block.text(k).decode("utf-8", "replace") for k in range(len(block))]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    n = np.maximum(0, np.diff(offsets) - 2)
    bounds = np.concatenate([[0], np.cumsum(n)])
    if not bounds[-1]:
        return np.zeros(0, np.int64), bounds
    at = np.arange(bounds[-1]) + np.repeat(offsets[:-1] - bounds[:-1], n)
    key = points[:-2] | (points[1:-1] << np.uint64(21)) | (points[2:] << np.uint64(42))
    return (mix(key[at]) >> np.uint64(64 - bits)).astype(np.int64), bounds


def margins(block: Block, m: Model) -> np.ndarray:
    """Uncalibrated scores of a block whose words are hashed."""
    grams, bounds = gram_buckets(block)
    return (
        m.bias
        + sums(m.words[word_buckets(block)], block.bounds) / np.maximum(1, block.counts)
        + sums(m.grams[grams], bounds) / np.maximum(1, np.diff(bounds))
    )


def probability(margin: np.ndarray, m: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m.a * margin + m.b, -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int, where=None) -> DataFrame:
    """Texts of at most max_labelled labelled ids, one an id, with label y; the ids (bounded by that number) are broadcast. Of
    different texts under one id that with the smallest hash counts."""
    ids = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("y")).where("_id is not null and y is not null")
    if where is not None:
        ids = ids.where(where(F.col("_id")))
    ids = ids.groupBy("_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    found = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(ids), "_id")
    text = F.coalesce("text", F.lit(""))
    return found.groupBy("_id").agg(F.min_by(text, F.xxhash64(text)).alias("text"), F.max("y").alias("y"))


def _features(batch: pa.RecordBatch) -> list[pa.Array]:
    """For each text the buckets that occur (those of runs after those of words) and their relative frequencies."""
    at, value = [], []
    for block in blocks(batch.column("text")):
        block.find_words().hash_words()
        grams, bounds = gram_buckets(block)
        words = word_buckets(block)
        for i in range(len(block)):
            w, g = words[block.bounds[i] : block.bounds[i + 1]], grams[bounds[i] : bounds[i + 1]]
            count = np.concatenate([np.bincount(w, minlength=1 << BITS) / max(1, len(w)), np.bincount(g, minlength=1 << BITS) / max(1, len(g))])
            k = np.flatnonzero(count)
            at.append(k.astype("<u2").tobytes())
            value.append(count[k].astype("<f4").tobytes())
    return [pa.array(at, pa.binary()), pa.array(value, pa.binary())]


def _logistic(row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, size: int, ridge: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on sparse rows by accelerated gradient descent; classes weigh the same."""
    n = len(y)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    scale = 1 / np.sqrt(np.bincount(col, x * x * weight[row], minlength=size) + 1e-8)
    xs = x * scale[col]
    v = np.ones(size)
    for _ in range(8):  # the largest eigenvalue bounds the step
        v /= np.linalg.norm(v)
        v = np.bincount(col, xs * (weight * np.bincount(row, xs * v[col], minlength=n))[row], minlength=size)
    step = 1 / (0.25 * (np.linalg.norm(v) + 1) + ridge)
    w, b = np.zeros(size), 0.0
    pw, pb = w, b
    for t in range(steps):
        k = t / (t + 3)
        ww, bb = w + k * (w - pw), b + k * (b - pb)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, xs * ww[col], minlength=n) + bb, -40, 40)))
        g = weight * (p - y)
        pw, pb = w, b
        w, b = ww - step * (np.bincount(col, xs * g[row], minlength=size) + ridge * ww), bb - step * g.sum()
    return w * scale, b


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """A model of ``labels.quality``, or None where the labelled texts are not of two classes."""
    sample = labelled_sample(docs, labels, max_labelled)
    got = add_columns(sample, [field("at", T.BinaryType()), field("value", T.BinaryType())], lambda: _features, drop=("text",)).toArrow()
    if not got.num_rows:
        return None
    got = got.take(pa.array(np.lexsort((got["y"].to_numpy(), got["_id"].to_numpy()))))  # so that sums don't depend on partitions
    y = got["y"].to_numpy().astype(float)
    hold = mix(got["_id"].to_numpy().astype(np.int64).astype(np.uint64)) % np.uint64(3) == 0
    if not 0 < y[~hold].sum() < (~hold).sum():
        hold = np.zeros(len(y), bool)
    if not 0 < y.sum() < len(y):
        return None
    cols = [np.frombuffer(b, "<u2").astype(np.int64) for b in got["at"].to_pylist()]
    row = np.repeat(np.arange(len(y)), [len(c) for c in cols])
    col, x = np.concatenate(cols), np.concatenate([np.frombuffer(b, "<f4") for b in got["value"].to_pylist()]).astype(float)
    fit = ~hold[row]
    number = np.cumsum(~hold) - 1
    w, bias = _logistic(number[row[fit]], col[fit], x[fit], y[~hold], 2 << BITS, 1e-3)
    m = Model(w[: 1 << BITS], w[1 << BITS :], bias, 1.0, 0.0)
    margin = np.bincount(row, x * w[col], minlength=len(y)) + bias
    use = hold if 0 < y[hold].sum() < hold.sum() else np.ones(len(y), bool)
    return Model(m.words, m.grams, bias, *_platt(margin[use], y[use]))


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid with his smoothed targets, by Newton's method."""
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        d, h = p - t, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(d * s).sum() + 1e-3 * (a - 1), d.sum()])
        q = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(q, g)
        move *= min(1.0, 2 / max(1e-12, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
    return max(a, 1e-3), b


def judge(
    docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT, min_words: int = 20, max_repeat_percent: int = 30, drop: tuple[str, ...] = ()
) -> DataFrame:
    """docs with the base counts, base_failed, quality_p (calibrated; 1 without a model) and kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            parts = []
            for block in blocks(batch.column("text")):
                counts = base_counts(block)
                p = probability(margins(block, m), m) if m else np.ones(len(block))
                parts.append([counts[k] for k in BASE] + [p])
            *counts, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            failed = (counts[0] < min_words) | (100 * counts[4] > max_repeat_percent * counts[0])
            return [*map(pa.array, counts), pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))]

        return compute

    fields = [field(k, T.LongType()) for k in BASE] + [field("base_failed", T.BooleanType()), field("quality_p", T.DoubleType()), field("kept", T.BooleanType())]
    return add_columns(docs, fields, make, drop)


def filter_documents(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns."""
    need = ("doc_id", "text")
    return restore(judge(shield(docs, need), model, keep_at).where("kept"), docs, need)
