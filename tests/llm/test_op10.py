from common import table, texts, words

from talus.llm import op10_decontaminate as op10
from talus.llm import registry

ITEM = "When Anna walked 12 km to Berlin with Peter, she spent 12 hours on the road and met 7 people there."


def flat(text):
    return ["".join(c for c in w if c.isascii() and c.isalnum() or ord(c) > 127).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words(text)]


def verdicts(spark, texts, items=((1, ITEM),), **more):
    docs = table(spark, list(enumerate(texts)), "doc_id long, text string")
    rows = op10.decontaminate(docs, table(spark, list(items), "item_id long, text string"), **more).orderBy("doc_id").collect()
    return [(r.contaminated, r.item_ids, r.reparameterised) for r in rows]


def test_query_equals_brute_force_on_literal_windows(spark):
    n, windows = 10, {}
    for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect():
        w = [x for x in flat(r.text) if x]
        for k in range(len(w) - n + 1):
            windows.setdefault(tuple(w[k : k + n]), set()).add(r.item_id)
    brute = {}
    for i, text in texts(spark):
        w = [x for x in flat(text) if x]
        found = {x for k in range(len(w) - n + 1) for x in windows.get(tuple(w[k : k + n]), ())}
        brute[i] = sorted(found)
    rows = registry.op10_decontaminate(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.item_ids for r in rows} == brute
    assert any(brute.values()) and all(r.contaminated == bool(r.item_ids) for r in rows)


def test_slots(spark):
    other = ITEM.replace("12", "30").replace("7", "4").replace("Anna", "Eve").replace("Peter", "Carl").replace("Berlin", "Rome").replace("km", "miles")
    mixed = "When Anna walked 12 km to Anna with Anna, she spent 15 hours on the road and met 15 people there."
    got = verdicts(spark, [ITEM, "It begins. " + other + " It ends.", ITEM.upper(), mixed, "Other words altogether, none of which are of the item at all."])
    assert got[0] == (True, [1], False)
    assert got[1] == (True, [1], True)
    assert got[2] == (True, [1], False)
    assert got[3] == (False, [], False)
    assert got[4] == (False, [], False)


def test_names_at_starts_of_sentences_accents_runs_and_joined_units(spark):
    items = [
        (1, "Tom has 3 cats. Sue has 4 dogs. Who has more?"),
        (2, "When Anna drove from Berlin to Rome with 5kg of apples, she lost 2 of them on the way."),
        (3, "The shop of Peter sold 30 red lamps on a day and 12 more the day after."),
        (4, "Every day Mary walks from home to school and meets her friends at noon."),
    ]
    texts = [
        "Bob has 5 cats. Ann has 9 dogs. Who has more?",
        "When \u00c9lodie drove from \u00c5rhus to New York with 7 kg of apples, she lost 4 of them on the way.",
        "The shop of Mr. Carl Smith sold twenty-five red lamps on a day and 3 hundred more the day after.",
        "Every day \u1ea4n walks from home to school and meets her friends at noon.",
        "Bob has 5 cats. Bob has 9 dogs. Who has more?",
        "Bob had 5 cats. Ann sold 9 dogs. Who paid more?",
    ]
    want = [(True, [1], True), (True, [2], True), (True, [3], True), (True, [4], True), (False, [], False), (False, [], False)]
    assert verdicts(spark, texts, items) == want
    assert verdicts(spark, texts, items, block=20) == want


def test_short_items_nulls_empty_and_blocks(spark):
    items = [(1, ITEM), (2, "what is the capital city of france"), (3, "yes no"), (4, None), (5, ""), (1, ITEM), (None, "")]
    texts = [None, "", "yes no", "well yes no", "so what is the capital city of France then", ITEM + " x" * 20000]
    want = [(False, []), (False, []), (True, [3]), (False, []), (True, [2]), (True, [1])]
    for block in (op10.BLOCK, 20):
        assert [v[:2] for v in verdicts(spark, texts, items, block=block)] == want
    assert [v[:2] for v in verdicts(spark, texts, [])] == [(False, [])] * 6


def test_empty_table_and_clashing_columns(spark):
    items = table(spark, [(1, ITEM)], "item_id long, text string")
    assert op10.decontaminate(table(spark, [], "doc_id long, text string"), items).count() == 0
    docs = table(spark, [(1, ITEM, "x", 3), (1, ITEM, "y", 4)], "doc_id long, text string, item_ids string, n_hits int")
    rows = op10.decontaminate(docs, items).collect()
    assert [r.item_ids for r in rows] == [[1], [1]]


def test_unequal_words_whose_linear_hashes_meet_are_no_hit(spark):
    from test_op2 import thue_morse

    a, b = thue_morse(1024)
    item = f"one two three {a} five six seven eight nine ten"
    assert [v[0] for v in verdicts(spark, [item, item.replace(a, b)], [(1, item)])] == [True, False]
