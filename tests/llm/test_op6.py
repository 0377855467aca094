import zlib

import numpy as np
import pytest
from common import table

from talus.llm import op6_quality_classifier as op6
from talus.llm import registry


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    up = y == 1
    return (order[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum())


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in registry.op6_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [i for i in labels if i in rows and rows[i].held_out]
    y = np.array([labels[i] for i in held])
    assert auc(np.array([rows[i].score for i in held]), y) > 0.95


def test_compiled_rules_equal_direct_evaluation(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, len(op6.NAMES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] <= 0.7)).astype(float)
    rules = op6.fit_rules(x, y)
    margin = np.full(len(x), rules.bias)
    for w, terms in rules.rules:
        margin += w * op6._holds(x, terms)
    for j, w, low, high in rules.linear:
        margin += w * (np.clip(x[:, j], low, high) - low)
    df = table(spark, x.tolist(), ", ".join(f"{n} double" for n in op6.NAMES))
    got = [r.p for r in df.select(op6.score(rules).alias("p")).collect()]
    assert sorted(got) == pytest.approx(sorted(1 / (1 + np.exp(-margin))))
    assert auc(1 / (1 + np.exp(-margin)), y) > 0.99
    assert 0 < len(rules.rules) < 150


def test_no_labels_nulls_empty_and_clashing_columns(spark):
    docs = table(spark, [(1, None, "s"), (2, "", "s"), (None, "a b", "s"), (2, "x " * 9000, "s")], "doc_id long, text string, score string")
    none = table(spark, [], "doc_id long, quality int, toxic int")
    rules = op6.fit(docs, none)
    assert [r.score for r in op6.classify(docs, rules).collect()] == [0.5] * 4
    labels = table(spark, [(1, 0, 0), (2, 1, 0), (2, None, 0), (None, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert op6.classify(docs, op6.fit(docs, labels)).count() == 4
    assert op6.classify(docs.limit(0), rules).count() == 0


def shapes(text):
    """The further counts of a text, character by character."""
    from common import words

    text = text or ""
    raw, w = text.encode(), words(text)
    ascii_upper = lambda c: "A" <= c <= "Z"
    return {
        "n_bytes": len(raw),
        "n_upper": sum(map(ascii_upper, text)),
        "n_lower": sum("a" <= c <= "z" for c in text),
        "n_digit": sum("0" <= c <= "9" for c in text),
        "n_punct": sum(c in "!\"'(),-./:;?@[]_`{}~\\^+=" for c in text),
        "n_pipe": text.count("|"),
        "n_bang": text.count("!"),
        "n_wide": sum(ord(c) > 127 for c in text),
        "n_feeds": text.count("\n"),
        "n_cap_words": sum(ascii_upper(x[0]) for x in w),
        "n_all_caps": sum(len(x.encode()) > 1 and ascii_upper(x[0]) and ascii_upper(x[1]) for x in w),
        "n_short_words": sum(len(x.encode()) <= 3 for x in w),
        "n_long_words": sum(len(x.encode()) >= 12 for x in w),
        "n_again_words": len(w) - len(set(w)),
    }


def test_statistics_equal_brute_force(spark):
    from common import texts
    from test_op2 import thue_morse
    from test_op8 import brute

    from talus.llm.textstats import BASE

    a, b = thue_morse(1024)
    rows = texts(spark) + [(-1, f"{a} {b} {a}"), (-2, "A"), (-3, None), (-4, "AB aB Ab\n" * 30000), (-5, "é" * 40000)]
    got = {r.doc_id: r for r in op6.statistics(table(spark, rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        c = shapes(text) | dict(zip(BASE, brute(text), strict=True))
        want = [min(c[x] / max(1, c[y]), 1e3) for x, y in op6.RATES.values()] + [np.log1p(c["n_words"])]
        assert [got[i][n] for n in op6.NAMES] == pytest.approx(want), i
