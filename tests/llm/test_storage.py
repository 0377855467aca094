from pathlib import Path
from types import SimpleNamespace

import pytest
from common import table

from talus.llm import skew, storage


def test_scratch_removes_what_does_not_stay(spark):
    df = table(spark, [(1,)], "a int")
    at = lambda t: Path(t.kept_at.removeprefix("file://"))
    with storage.scratch(spark):
        gone, stays = storage.keep(df, "x"), storage.keep(df, "y", stay=True)
        assert at(gone).exists()
    after = storage.keep(df, "z")
    assert not at(gone).exists() and at(stays).exists() and at(after).exists()


def test_a_cluster_without_a_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda *_: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="x")))


def test_join_counted_equals_a_plain_join(spark):
    rows = table(spark, [(k, None if k % 7 == 0 else k % 3 if k % 2 else k) for k in range(500)], "id long, key long")
    counts = rows.groupBy("key").count().withColumnRenamed("count", "n").where("key is not null and key % 5 < 3")
    found = counts.selectExpr("key", "n", "key * 2 as twice")
    old, skew.SHARE = skew.SHARE, 20
    try:
        for how in ("left", "inner"):
            want = sorted(map(str, rows.join(found.drop("n"), "key", how).select("id", "key", "twice").collect()))
            assert sorted(map(str, skew.join_counted(rows, found, "key", how).collect())) == want
    finally:
        skew.SHARE = old


def test_bytes_that_are_no_utf8_have_one_rule(spark):
    from talus.llm import op2_substring_dedup as op2
    from talus.llm import op8_quality_rules as op8
    from talus.llm import op9_sentencepiece as op9
    from talus.llm.vocabulary import default_model

    docs = spark.sql("select * from values (1, cast(X'61FF62203FE2' as string)), (2, 'a'), (3, cast(X'F0' as string)) as t(doc_id, text)").selectExpr("cast(doc_id as long) doc_id", "text")
    assert [r.n_words for r in op8.judge(docs, None, drop=("text",)).orderBy("doc_id").collect()] == [2, 1, 1]
    assert [r.n_words for r in op2.remove_repeats(docs, digest=True).orderBy("doc_id").collect()] == [2, 1, 1]
    assert op2.remove_repeats(docs).count() == 3
    assert op9.digest(docs, default_model(), drop=("text",)).where("n_pieces > 0").count() == 3
    block = next(batches_blocks(docs))
    assert op8.gram_buckets(block.find_words())[1].tolist() == [0, 4, 4, 4]


def batches_blocks(docs):
    from talus.llm.blocks import blocks

    yield from blocks(docs.select("text").orderBy("doc_id").toArrow()["text"])
