import corpus_pipeline
import test_op2
import test_op7
from common import words
from pyspark.sql import functions as F
from test_op10 import flat

from talus.llm import op8_quality_rules as op8
from talus.llm.tables import read
from talus.llm.vocabulary import default_model

SF = "/root/testdata/sf0.001"


def cut(rows, n=20):
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), (i, k))
    out = []
    for i, text in rows:
        w = words(text)
        gone = {k + x for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < (i, k) for x in range(n)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text))
    return out


def leaks(text, items, n=10):
    w = [x for x in flat(text) if x]
    return any(tuple(w[k : k + n]) in items for k in range(len(w) - n + 1))


def test_run_equals_brute_force(spark):
    from sentencepiece import SentencePieceProcessor

    docs = read(spark, SF, "documents")
    model = op8.train(docs, read(spark, SF, "labels"))
    good = {r.doc_id for r in op8.judge(docs, model).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect() if r.doc_id in good]
    first = {i for i, _, c in test_op7.components(rows) if i == c}
    rows = cut([r for r in rows if r[0] in first])
    items = set()
    for r in read(spark, SF, "benchmark").collect():
        w = [x for x in flat(r.text) if x]
        items |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    rows = [r for r in rows if not leaks(r[1], items)]
    library = SentencePieceProcessor(model_file=default_model())
    want = {i: (t, library.encode(t)) for i, t in rows}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.text, r.ids) for r in got} == want
    assert all(r.n_chars == len(r.text) and r.n_pieces == len(r.ids) for r in got)
    assert 50 < len(got) < len(good) < 200


def test_stages_keep_columns_and_stand_nulls_empty_and_clashing_columns(spark):
    docs = read(spark, SF, "documents").limit(40)
    odd = docs.limit(3).select(F.when(F.col("doc_id") < 0, 0).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(odd).withColumn("kept", F.lit("x")).withColumn("simhash", F.lit("y")).withColumn("_spans", F.lit("z"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_brute_force_forms_agree():
    rows = sorted(test_op2.variants(3))
    assert [(i, len(words(t))) for i, t in cut(rows)] == [(i, n - gone) for i, n, gone, _ in test_op2.brute(rows)]
