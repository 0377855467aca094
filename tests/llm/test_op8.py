import random
from collections import Counter

import pytest
from common import SF, WORD, table, texts, words

from talus.llm import op8_quality_rules as op8
from talus.llm import registry


def brute(text):
    """The base counts of a text, word by word."""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    twice = {k + x for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for x in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(twice)


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_query_counts_and_base_rules_equal_brute_force(spark):
    want = {i: brute(t) for i, t in texts(spark)}
    for r in registry.op8_quality_rules(spark, SF).collect():
        assert counts(r) == want[r.doc_id]
        n, repeats = want[r.doc_id][0], want[r.doc_id][4]
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.base_failed and r.kept)


def test_the_model_tells_good_from_bad_on_rows_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = op8.train(docs, labels.where("doc_id % 2 = 0"))
    seen = op8.judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    rows = seen.select("kept", "quality", "quality_p").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)
    above = sum((a.quality_p > b.quality_p) + 0.5 * (a.quality_p == b.quality_p) for a in good for b in bad)
    assert above > 0.98 * len(good) * len(bad)


def odd(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, f"{line}\n{line}\n{line}"), (4, "é " * 30000), (None, "#$ <|> & %"), (5, "x" * 50000)]
    return rows, table(spark, [(a, b, "old", 1) for a, b in rows], "doc_id long, text string, kept string, n_words int")


def test_nulls_empty_long_repeats_and_clashing_columns(spark):
    rows, docs = odd(spark)
    out = op8.judge(docs, None).collect()
    assert sorted(map(counts, out)) == sorted(brute(t) for _, t in rows)
    assert all(r.quality_p == 1.0 and r.kept == (not r.base_failed) for r in out)
    kept = op8.filter_documents(docs, None)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, 0), (None, 0, 0)], [(4, 1, 0), (4, 0, 0), (5, 0, 0), (2, 0, 0)]])
def test_few_null_and_contradicting_labels(spark, labels):
    _, docs = odd(spark)
    model = op8.train(docs, table(spark, labels, "doc_id long, quality int, toxic int"))
    assert (model is None) == (len(labels) < 4)
    assert op8.judge(docs, model).count() == 7


def test_empty_table(spark):
    assert op8.judge(table(spark, [], "doc_id long, text string"), None).count() == 0


def test_counts_stand_letters_whose_linear_hashes_meet_and_hashes_that_all_meet(monkeypatch):
    from test_op2 import thue_morse

    from talus.llm import blocks, textstats

    a, b = thue_morse(1024)
    rng = random.Random(2)
    odd = [f"{a}\n{b}", f"{a}\n{b}\n{a}", " ".join([a] * 9 + [b] * 9 + [a] * 9), None, "", "x\n\nx\n x", "é " * 20]
    odd += ["\n".join(" ".join(rng.choice(["ab", "c", "dé", "fghij" * 20]) for _ in range(rng.randrange(12))) for _ in range(30)) for _ in range(20)]
    got = lambda: [tuple(map(int, r)) for blk in blocks.blocks(blocks.pa.array(odd)) for r in zip(*map(textstats.base_counts(blk).get, textstats.BASE), strict=True)]
    want = [brute(t) for t in odd]
    assert got() == want
    monkeypatch.setattr(blocks, "mix", lambda x: x * blocks.np.uint64(0))
    monkeypatch.setattr(blocks.xxhash, "xxh64_intdigest", lambda *_: 0)
    assert got() == want
