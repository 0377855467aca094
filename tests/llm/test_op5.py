import random

from common import table, texts, words

from talus.llm import op5_token_counts as op5
from talus.llm import registry
from talus.llm.vocabulary import MARK, default_model, load

SCORES = op5.zipf_scores(load(default_model()))
FLOOR = min(SCORES.values()) - 10
KNOWN = {}


def brute(word):
    """Tokens of one word by its own table."""
    if word not in KNOWN:
        t = MARK + word
        best = [(0.0, 0)]
        for b in range(1, len(t) + 1):
            ways = []
            for a in range(max(0, b - 16), b):
                p = t[a:b]
                if p in SCORES:
                    ways.append((best[a][0] + SCORES[p], b - a, best[a][1] + 1))
                elif b - a == 1:
                    ways.append((best[a][0] + FLOOR, 1, best[a][1] + len(p.encode())))
            w = max(ways)
            best.append((w[0], w[2]))
        KNOWN[word] = best[-1][1]
    return KNOWN[word]


def test_query_equals_brute_force(spark):
    want = {i: (len(words(t)), len(set(words(t))), sum(map(brute, words(t)))) for i, t in texts(spark)}
    got = {r.doc_id: (r.n_words, r.n_distinct, r.n_tokens) for r in registry.op5_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_a_small_store_and_long_words_change_nothing(spark):
    rng = random.Random(2)
    rows = [None, "", " \n", "x" * 5000, "é日😀  b", " ".join("".join(rng.choice("etahion") for _ in range(rng.randrange(1, 30))) for _ in range(300))]
    docs = table(spark, [(i, t, "n") for i, t in enumerate(rows)] + [(1, "", "m")], "doc_id long, text string, n_tokens string")
    want = sorted((i, sum(map(brute, words(t)))) for i, t in [*enumerate(rows), (1, "")])
    for most, long in ((op5.MAX_WORDS, 1000), (40, 12)):
        got = op5.count_tokens(docs, default_model(), most, long).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in got) == want


def test_empty_table(spark):
    assert op5.count_tokens(table(spark, [], "doc_id long, text string"), default_model()).count() == 0
