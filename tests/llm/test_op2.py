import hashlib
import random

import pytest
from common import table, texts, words

from talus.llm import op2_substring_dedup as op2
from talus.llm import registry


def brute(rows, n=20):
    first = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), (i, k))
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (i, k):
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def variants(seed, docs=120, alphabet=40):
    """Documents from few words: passages shared whole, in part, changed in places, and repeated in one document."""
    rng = random.Random(seed)
    make = lambda n: [f"w{rng.randrange(alphabet)}é" for _ in range(n)]
    passages = [make(rng.choice([19, 20, 21, 26, 40, 90])) for _ in range(8)]
    rows = []
    for i in range(docs):
        w = []
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "changed"
            a = rng.randrange(4)
            w += make(rng.randrange(12)) + p[a : len(p) - rng.randrange(4)]
        rows.append((i * 7 % docs, "".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in w)))
    return rows


def test_query_equals_brute_force(spark):
    assert result(registry.op2_substring_dedup(spark, "/root/testdata/sf0.001")) == brute(texts(spark))


@pytest.mark.parametrize("wide", [2000, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_variants_of_passages(spark, seed, wide):
    rows = variants(seed)
    docs = table(spark, rows, "doc_id long, text string").repartition(3)
    assert result(op2.remove_repeats(docs, wide=wide, digest=True)) == brute(rows)


def test_runs_of_one_word(spark):
    rows = [(1, "a " * 50), (2, "a " * 25 + "b"), (3, "a " * 19), (4, "b " * 20), (5, "b " * 21)]
    assert result(op2.remove_repeats(table(spark, rows, "doc_id long, text string"), digest=True)) == brute(rows)


def test_nulls_empty_repeats_and_clashing_columns(spark):
    long = " ".join(f"x{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "a b"), (4, "y " + long), (5, " a\tb ")]
    docs = table(spark, [(a, b, 7, "z") for a, b in rows], "doc_id long, text string, n_words int, id string")
    got = op2.remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "id", "n_words", "n_removed"]
    found = {(r.doc_id, r.text, r.n_removed) for r in got.collect()}
    assert found == {(1, None, 0), (2, "", 0), (3, long, 0), (None, "a b", 0), (4, "y", 5000), (5, " a\tb ", 0)}


def test_texts_that_share_an_id_or_have_none_are_documents_of_their_own(spark):
    rng = random.Random(9)
    make = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage, a, b, c, d = make(30), make(40), make(40), make(40), make(90)
    rows = [(None, f"{passage} {a}"), (None, f"{b} {passage}"), (None, d), (7, f"{c} {passage}"), (7, d[: len(d) // 2] + " end"), (8, f"{a} new"), (9, f"{make(50)}"), (9, f"{make(50)}")]
    got = {r.text for r in op2.remove_repeats(table(spark, rows, "doc_id long, text string").repartition(3)).collect()}
    kept = [t for t in got if passage in t]
    assert len(kept) == 1 and kept[0] in (rows[0][1], rows[1][1])  # one of the rows without an id keeps the passage
    assert got >= {d, rows[6][1], rows[7][1]}  # no clean word goes
    assert {a, b} & got and c in got and "new" in got


def test_empty_table(spark):
    assert op2.remove_repeats(table(spark, [], "doc_id long, text string"), digest=True).count() == 0


def test_automaton_spans():
    a = op2.SuffixAutomaton()
    a.add(list("abcdefgh"))
    a.add(list("xxabcy"))
    assert a.spans(list("zabcdezcdefgyabcy"), 4) == [(1, 6), (7, 12), (13, 17)]
    assert a.spans(list("zzz"), 1) == []


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_unequal_words_whose_linear_hashes_meet_stay(spark):
    same = " ".join(f"w{k}" for k in range(19))
    for n in (1024, 2048):
        a, b = thue_morse(n)
        rows = [(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"{same} {a}")]
        assert result(op2.remove_repeats(table(spark, rows, "doc_id long, text string"), digest=True)) == brute(rows)


def test_equal_hashes_alone_remove_nothing(monkeypatch):
    """With hashes that all meet, only copies are settled in a task, and what is left goes on to the automata."""
    monkeypatch.setattr(op2, "mix", lambda x: x * op2.np.uint64(0))
    monkeypatch.setattr(op2, "hash_windows", lambda codes, n: op2.np.zeros(max(0, len(codes) - n + 1), op2.np.uint64))
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(30)]
    batch = op2.pa.RecordBatch.from_arrays([op2.pa.array(range(60), op2.pa.int64()), op2.pa.array(texts + texts)], names=["doc_id", "text"])
    rows = [r for out in op2._segments(20, 6)(iter([batch])) for r in out.to_pylist()]
    assert {r["id"] for r in rows if r["anchor"] is None} <= set(range(30, 60))
    assert all(r["anchor"] is not None for r in rows if r["id"] < 30)


def test_the_automaton_decides(monkeypatch):
    """Parts of passages go only by matching statistics: without them they stay."""
    shared = [f"s{k}".encode() for k in range(25)]
    rows = [(1, 1, b" ".join([b"x", *shared, b"y"])), (1, 2, b" ".join([b"p", b"q", *shared, b"r"])), (1, 3, b" ".join([b"p", b"q", *shared, b"r"]))]
    names = ["shard", "id", "first", "last", "words"]
    batch = op2.pa.RecordBatch.from_pylist([dict(zip(names, (s, i, 5, 5 + len(w.split()), w), strict=True)) for s, i, w in rows])
    spans = lambda: [tuple(r.values()) for out in op2._match(20)(iter([batch])) for r in out.to_pylist()]
    assert spans() == [(2, 7, 32), (3, 5, 33)]
    monkeypatch.setattr(op2.SuffixAutomaton, "spans", lambda *_: [])
    assert spans() == [(3, 5, 33)]


def test_a_very_long_text(spark):
    rng = random.Random(6)
    long = " ".join(f"v{rng.randrange(5000)}" for _ in range(400_000))
    rows = [(1, long), (2, long[:500_000]), (3, "x" * 3_000_000), (4, "x" * 3_000_000 + " y")]
    assert result(op2.remove_repeats(table(spark, rows, "doc_id long, text string"), digest=True)) == brute(rows)
