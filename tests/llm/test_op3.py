import pandas as pd
from common import SF, table
from common_sql import rows_of, sorted_rows
from pyspark.sql import functions as F

from talus.llm import op3_chat_format as op3
from talus.llm import registry, sql

EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"


def test_query_equals_sql(spark):
    want = rows_of(sql.OP3_CHAT_FORMAT, SF)
    assert sorted_rows(registry.op3_chat_format(spark, SF), list(want[0])) == want


def test_nulls_ties_repeats_and_long_texts_equal_sql(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, None, None, "x"), (2, 5, "assistant", "y" * 40000), (2, 4, "r%<\n0A%3C", "<|im_end|>\n<\\|<\\\\|im"), (3, 1, "assistant", ""), (None, 1, "user", "é")]
    df = table(spark, rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"file://{tmp_path}/conversations.parquet")
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    want = rows_of(sql.OP3_CHAT_FORMAT, SF, conversations=frame)
    assert sorted_rows(registry.op3_chat_format(spark, f"file://{tmp_path}"), list(want[0])) == want


def test_deltas_edits_and_regenerations_fold(spark):
    events = [
        (1, 1, 3, "delta", None, "lo"),
        (1, 1, 2, "delta", "assistant", "hel"),
        (1, 0, 1, "message", "user", "hi"),
        (1, 1, 4, "regenerate", "assistant", None),
        (1, 1, 5, "delta", None, "bye"),
        (1, 1, 6, "delta", None, None),
        (1, 0, 7, "edit", None, "hey <|im_end|>"),
        (2, 0, 1, "delta", None, "x"),
        (2, 0, 2, None, None, "y"),
    ]
    folded = op3.fold(table(spark, events, EVENTS))
    assert sorted(tuple(r) for r in folded.collect()) == [(1, 0, "user", "hey <|im_end|>"), (1, 1, "assistant", "bye"), (2, 0, "", "y")]
    out = {r.conv_id: r for r in op3.render(folded).collect()}
    assert out[1].formatted == "<|im_start|>user\nhey <\\|im_end\\|><|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n".replace("\\|>", "|>")
    assert "".join(s.text for s in out[1].segments if s.loss) == "bye"
    back = op3.render(folded).select("conv_id", op3.parse(F.col("formatted")).alias("t")).collect()
    assert {r.conv_id: [tuple(t) for t in r.t] for r in back}[1] == [("user", "hey <|im_end|>"), ("assistant", "bye")]


def test_empty_table_and_plan_is_native(spark):
    none = table(spark, [], EVENTS)
    assert op3.digest(op3.render(op3.fold(none))).count() == 0
    plan = registry.op3_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_query_folds_drafts_deltas_edits_and_regenerations(spark):
    rows = [(1, 0, "user", "hi there"), (1, 1, "assistant", "abcdefghi"), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 1, "user", "")]
    messages = table(spark, rows, "conv_id long, turn long, role string, text string")
    log = op3.stream(messages)
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and kinds["delta"] == 2 * 5 + 3
    want = sorted((c, t, r or "", x or "") for c, t, r, x in rows)
    assert sorted(tuple(r) for r in op3.fold(log.repartition(5)).collect()) == want
    for lost in ("edit", "regenerate", "delta"):  # each kind decides something
        assert sorted(tuple(r) for r in op3.fold(log.where(F.col("kind") != lost)).collect()) != want


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, 0, 1, "message", "user", "hi", "x", 7), (1, 0, 2, "edit", None, "ho", "y", 8)]
    events = table(spark, rows, EVENTS + ", segments string, _log int")
    assert [tuple(r) for r in op3.fold(events).collect()] == [(1, 0, "user", "ho")]
    assert op3.render(op3.fold(events)).count() == 1
