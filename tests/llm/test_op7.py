import numpy as np
import pytest
import xxhash
from common import table, texts, words

from talus.llm import op7_simhash as op7
from talus.llm import registry


def fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def components(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    smallest = {g: min((k for k in ids if k is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], f"{prints[i]:016x}", smallest[find(i)]) for i in range(len(rows))), key=str)


def result(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    assert result(registry.op7_simhash(spark, "/root/testdata/sf0.001")) == components(texts(spark))


def test_nulls_empty_ties_repeats_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, "A b"), (7, "a B"), (8, "x" * 30000)]
    docs = table(spark, [(a, b, 1, "z") for a, b in rows], "doc_id long, text string, simhash int, component_id string")
    marked = op7.fingerprints(docs.select("doc_id", "text"), drop=("text",))
    got = op7.near_duplicates(marked).collect()
    assert sorted(((r.doc_id, f"{r.simhash & (2**64 - 1):016x}", r.component_id) for r in got), key=str) == components(rows)
    kept = op7.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 5, 6, 8]


def test_empty_table(spark):
    docs = table(spark, [], "doc_id long, text string")
    assert op7.near_duplicates(op7.fingerprints(docs, drop=("text",))).count() == 0
    assert op7.deduplicate(docs).count() == 0


@pytest.mark.parametrize("hot", [20_000, 8])
def test_every_link_is_found_also_under_crowded_keys(spark, hot):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 12, dtype=np.int64)
    prints = {int(s) for s in seeds}
    for s in list(prints):
        x = s
        for _ in range(25):  # a chain: each is within three bits of the one before
            for k in rng.choice(63, rng.integers(1, 5), replace=False):
                x ^= 1 << int(k)
            prints.add(x)
    prints |= {int(s) ^ (int(b) << 33) for s in seeds[:2] for b in rng.integers(0, 2**20, 60)}
    prints = sorted(prints)
    marked = table(spark, list(enumerate(prints)), "doc_id long, simhash long")
    got = {r.doc_id: r.component_id for r in op7.near_duplicates(marked, hot).collect()}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in range(len(prints))}


def test_hot_fingerprints_and_routes_split_twice_and_more(spark):
    """One fingerprint that most rows have, and a segment under which all stand, split until three bytes are fixed."""
    rng = np.random.default_rng(2)
    high = 0x1234ABCD << 32
    prints = sorted({high | int(x) for x in rng.integers(0, 2**12, 900)})
    rows = list(enumerate(prints)) + [(10_000 + k, prints[5]) for k in range(3000)]
    got = {r.doc_id: r.component_id for r in op7.near_duplicates(table(spark, rows, "doc_id long, simhash long"), 5).collect()}
    want = {r.doc_id: r.component_id for r in op7.near_duplicates(table(spark, rows, "doc_id long, simhash long")).collect()}
    assert got == want and len(got) == len(rows) and set(got.values()) == {0}


def test_every_pair_within_reach_shares_a_route_at_each_level():
    rng = np.random.default_rng(3)
    for level in op7._splits():
        for fixed, masks in level.items():
            assert sum(masks) & (2**64 - 1) == ~fixed & (2**64 - 1)  # the parts are disjoint and cover what is free
    for _ in range(300):
        x = int(rng.integers(0, 2**63))
        y = x
        for k in rng.choice(64, 3, replace=False):
            y ^= 1 << int(k)
        low = bin((x ^ y) & 0xFFFFFFFF).count("1") <= 1
        fixed = 0xFFFFFFFF if low else 0xFFFFFFFF << 32
        for level in op7._splits():
            masks = level[fixed if fixed < 1 << 63 else fixed - (1 << 64)]
            same = [m for m in masks if ((x ^ y) & m) & (2**64 - 1) == 0]
            assert same
            fixed |= same[0] & (2**64 - 1)
