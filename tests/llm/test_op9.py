import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from common import table, texts

from talus.llm import op9_sentencepiece as op9
from talus.llm import registry
from talus.llm.vocabulary import MARK, default_model, load


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=default_model())


def odd_texts(n=400):
    rng = random.Random(5)
    signs = ["a", "e", "t", "h", "in", "ing", "  ", " ", "\n", "é", "日", "q", "the", "ation", "un", "23", ".", "=", "ö", "😀", "\t", "\x00", "ÿ", MARK]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(n)]


def test_query_equals_library(spark, library):
    want = {}
    for i, text in texts(spark):
        ids = np.array(library.encode(text), "<i4")
        want[i] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True)
    got = {r.doc_id: (r.n_pieces, r.ids_sha256, r.round_trip) for r in registry.op9_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_encode_and_decode_odd_texts(spark, library):
    rows = odd_texts() + ["", " ", "the" * 3000, "x y " * 4000]
    docs = table(spark, [*enumerate(rows), (-1, None), (0, rows[0])], "doc_id long, text string")
    ids = op9.encode(docs, default_model())
    for r in ids.collect():
        assert r.ids == (None if r.text is None else library.encode(r.text))
    for r, s in zip(ids.orderBy("doc_id").collect(), op9.decode(ids.drop("text"), default_model()).orderBy("doc_id").collect(), strict=True):
        assert s.text == (None if r.text is None else r.text.replace(MARK, " "))


def test_unigram_relaxation_equals_brute_force():
    v = load(default_model())
    e = op9.Encoder(v, "unigram")
    ids, floor = v.ids(), min(v.scores[i] for i in v.usable) - 10
    for text in ["the thing is in a ring", "nationality", "日本 qé\n", "a  b"]:
        t = MARK + text.replace(" ", MARK)
        best = [0.0] + [float("-inf")] * len(t)
        for b in range(1, len(t) + 1):
            for a in range(max(0, b - 16), b):
                score = v.scores[ids[t[a:b]]] if t[a:b] in ids else floor if b - a == 1 else float("-inf")
                best[b] = max(best[b], best[a] + score)
        (raw,) = e.encode([text])
        got, at = 0.0, 0
        found = np.frombuffer(raw, "<i4").tolist()
        known = set(v.byte_ids)
        while at < len(found):
            if found[at] in known:
                n = len(t.encode()) and (1 if v.byte_ids.index(found[at]) < 0xC0 else 2 if v.byte_ids.index(found[at]) < 0xE0 else 3)
                got, at = got + floor, at + n
            else:
                got, at = got + v.scores[found[at]], at + 1
        assert got == pytest.approx(best[-1])
        assert e.decode(np.array(found)) == text


def test_empty_table_and_clashing_columns(spark):
    assert op9.digest(table(spark, [], "doc_id long, text string"), default_model()).count() == 0
    rows = op9.encode(table(spark, [(1, "a", "x")], "doc_id long, text string, ids string"), default_model()).collect()
    assert rows[0].ids == [264]


def test_long_unbroken_texts_equal_the_library_in_bounded_time(library):
    import time

    rng = random.Random(8)
    signs = "aetinghonsrd日本é23+/="
    e = op9.Encoder(load(default_model()))
    long = ["".join(rng.choice(signs) for _ in range(n)) for n in (1001, 5000, 70_000, 300_000)]
    long += ["x" * 70_000, "日" * 30_000, " " * 5000 + "a", "the" * 25_000, "�😀" * 3000]
    for text in long:
        began = time.time()
        (raw,) = e.encode([text])
        assert np.frombuffer(raw, "<i4").tolist() == library.encode(text)
        assert time.time() - began < 30
        assert e.decode(np.frombuffer(raw, "<i4")) == text


def test_long_and_short_parts_relax_alike(monkeypatch):
    v = load(default_model())
    texts = odd_texts(150)
    for kind in ("bpe", "unigram"):
        want = op9.Encoder(v, kind).encode(texts)
        alone = op9.Encoder(v, kind)
        alone._encode = lambda parts, e=alone: [e._encode_long(p) for p in parts]
        monkeypatch.setattr(op9, "_WINDOW", 8)
        assert alone.encode(texts) == want
        monkeypatch.undo()


def test_models_that_break_an_assumption_raise():
    import dataclasses

    v = load(default_model())
    assert v.kind == "bpe"
    for piece in ("a▁b", "a\nb", "▁\n"):
        odd = dataclasses.replace(v, pieces=(*v.pieces, piece), scores=(*v.scores, -1.0), usable=v.usable | {len(v.pieces)})
        with pytest.raises(ValueError):
            op9.Encoder(odd)
    with pytest.raises(ValueError):
        op9.Encoder(v, "word")


def test_cost_is_near_that_of_the_library(spark, library):
    import time

    rows = [text for _, text in texts(spark, "/root/testdata/sf0.01") if text]
    v, first = load(default_model()), [text for _, text in texts(spark)]

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    def ours(e):
        for k in range(0, len(rows), 500):
            for raw, text in zip(e.encode(rows[k : k + 500]), rows[k : k + 500], strict=True):
                assert e.decode(np.frombuffer(raw, "<i4")) == text.replace(MARK, " ")

    ratios = []
    for _ in range(3):  # the least of them, as other work on the machine disturbs
        e = op9.Encoder(v)
        e.encode(first)
        ratios.append(seconds(lambda e=e: ours(e)) / seconds(lambda: library.encode(rows, num_threads=1)))
    assert min(ratios) < 1.6


def test_frequent_parts_stay_known(monkeypatch):
    monkeypatch.setattr(op9, "_KEPT", 5)
    e, seen = op9.Encoder(load(default_model())), []
    work = e._encode
    monkeypatch.setattr(e, "_encode", lambda parts: (seen.extend(parts), work(parts)))
    for k in range(20):
        e.encode([f"often {k}a {k}b {k}c"])
        assert len(e.done) + len(getattr(e, "old", ())) < 20
    assert len([p for p in seen if p in (" often", b" often")]) == 1


def test_pairs_in_arrays_fit_as_single_ones():
    v = load(default_model())
    e, rng = op9.Encoder(v), np.random.default_rng(7)
    ids = np.array(sorted(v.usable))
    before, after = rng.choice(np.concatenate([ids[:2000], [-2, -1]]), 6000), rng.choice(np.concatenate([ids[:2000], [-1]]), 6000)
    want = [e._stays(b, p) for b, p in zip(before.tolist(), after.tolist(), strict=True)]
    assert 0 < sum(want) < len(want)
    for _ in range(2):  # the second time from the table
        assert e.merges.fits(before, after).tolist() == want


def test_parts_and_decoded_bytes_of_odd_texts(spark, library):
    # long pieces, pieces beyond eight bytes, bytes of no piece, spaces and line feeds at every border, slices of an array
    rows = ["", None, " ", "\n", "  \n  a\n\n b ", "a\x00b", "internationalization", " " * 40 + "x", "-" * 999, "\U0001f600é", MARK, f"{MARK}{MARK}x {MARK}"]
    column = pa.array(["skipped", *rows], pa.string()).slice(1)
    e = op9.Encoder(load(default_model()))
    ids, at, want, bounds = e.encode_column(column)
    for k, text in enumerate(rows):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(text or "")
    assert e.returns(ids, at, want, bounds) == [True] * len(rows)
    wrong = ids.copy()
    wrong[at[4]] = wrong[at[6]]
    assert e.returns(wrong, at, want, bounds) == [k != 4 for k in range(len(rows))]
    got = op9.encode(table(spark, list(enumerate(rows)), "doc_id long, text string"), default_model(), decoded=True).orderBy("doc_id").collect()
    assert [r.text for r in got] == [None if t is None else t.replace(MARK, " ") for t in rows]
