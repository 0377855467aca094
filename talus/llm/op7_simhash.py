"""SimHash near-duplicates by multi-index hashing.

Fingerprints have 64 bits in two segments of 32. If two differ in at most 3 bits, they differ in at most 1 bit of one of the
segments. So each distinct fingerprint enters the index under all 33 values within one bit of each of its segments (its small
Hamming balls), and whoever stands under a value that is some fingerprint's own segment is fetched and compared over all
64 bits. Rows are dealt by segment value and sorted there; a value's rows are compared in blocks, and only a spanning forest
of the verified links leaves the task, never all pairs.

A value under which more than ``hot`` fingerprints stand is split by the other segment: of its four bytes at least one is
equal wherever two fingerprints link, so the rows are dealt by (value, byte place, byte) instead, and no link is lost. Where
that is not enough, the bits that are not fixed yet are parted in four again, twice if need be; then 14 bits are free, and
what can stand under a route is bounded.

Null texts count as empty; texts without words have fingerprint 0. Rows with the same text share a fingerprint before any
index is built. A null id never names a component unless no other is there. Rows that repeat an id are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.batches import add_columns, field, restore, shield, tidy
from talus.llm.blocks import Block, blocks
from talus.llm.components import connected_components
from talus.llm.skew import join_counted
from talus.llm.storage import keep

RADIUS = 3
SEED = 42
HOT = 20_000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
#: For each byte a word of eight lanes: lane k holds bit k.
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)


def shingle_hashes(block: Block, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of n lower-cased words, joined by spaces, and their bounds by text; a text of fewer words is one
    shingle, a text without words none."""
    block.find_words()
    if not len(block.starts):
        return np.zeros(0, np.uint64), np.zeros(len(block) + 1, np.int64)
    stay = ~block.space
    after = block.ends[block.ends < len(block.data)]
    stay[after] = True  # a word's last byte is followed by one space, or by the next text
    buffer = _FOLD[block.data[stay]].tobytes()
    place = np.cumsum(stay) - 1
    starts, ends = place[block.starts], place[block.ends - 1] + 1
    count = np.where(block.counts > 0, np.maximum(1, block.counts - n + 1), 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(bounds[-1]) + np.repeat(block.bounds[:-1] - bounds[:-1], count)
    last = np.minimum(first + n, np.repeat(block.bounds[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = (digest(buffer[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True))
    return np.fromiter(hashes, np.uint64, len(first)), bounds


def fold_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each stretch of hashes the bits that are set in over half of them."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    lanes = _LANES[np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)]
    pieces = -(-n[full] // 255)  # lanes are bytes: at most 255 rows a sum
    ends = np.cumsum(pieces)
    within = np.arange(ends[-1]) - np.repeat(ends - pieces, pieces)
    part = np.add.reduceat(lanes, np.repeat(bounds[:-1][full], pieces) + 255 * within, axis=0)
    counts = np.add.reduceat(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 64).astype(np.int64), ends - pieces, axis=0)
    bits = np.packbits(2 * counts > n[full][:, None], axis=1, bitorder="little")
    out[full] = np.ascontiguousarray(bits).view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the column simhash (64 bits in a long)."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [fold_bits(*shingle_hashes(block)) for block in blocks(batch.column("text"))]
        return [pa.array(np.concatenate(found).view(np.int64))]

    return add_columns(docs, [field("simhash", T.LongType())], lambda: compute, drop)


def _index(prints: DataFrame) -> DataFrame:
    """(key, simhash, own): key holds the segment's number and value; own marks a fingerprint's own segments."""
    ball = F.explode(F.array(*(F.lit(0 if k < 0 else 1 << k).cast("long") for k in range(-1, 32))))
    low = lambda shift: F.shiftrightunsigned("simhash", shift).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    flipped = prints.select("simhash", ball.alias("flip"))
    halves = F.explode(F.array(low(0), low(32).bitwiseOR(F.lit(1 << 32).cast("long"))))
    return flipped.select("simhash", "flip", halves.alias("half")).select(F.col("half").bitwiseXOR(F.col("flip")).alias("key"), "simhash", (F.col("flip") == 0).alias("own"))


def _quarters(bits: list[int]) -> list[list[int]]:
    """Bits parted in four, as evenly as may be."""
    step = -(-len(bits) // 4)
    short = 4 * step - len(bits)
    sizes = [step - (k >= 4 - short) for k in range(4)]
    return [bits[sum(sizes[:k]) : sum(sizes[: k + 1])] for k in range(4)]


def _splits() -> list[dict[int, list[int]]]:
    """For each level the masks that split a route, by the mask of the bits that it has fixed so far."""
    signed = lambda bits: sum(1 << k for k in bits) - (1 << 64 if 63 in bits else 0)
    fixed, levels = [set(range(32)), set(range(32, 64))], []
    for _ in range(3):
        level, after = {}, []
        for f in fixed:
            parts = _quarters(sorted(set(range(64)) - f))
            level[signed(f)] = [signed(set(p)) for p in parts]
            after += [f | set(p) for p in parts]
        levels.append(level)
        fixed = after
    return levels


def _split(rows: DataFrame, masks: dict[int, list[int]], hot: int) -> DataFrame | None:
    """rows (route, simhash, own, fixed, settled) with the routes of over hot rows split; None where there are none."""
    crowded = rows.where("not settled").groupBy("route").agg(F.count("*").alias("n"), F.max("own").alias("met")).where(f"n > {hot} and met")
    crowded = keep(crowded.select(F.col("route").alias("_route")), "crowded")
    if crowded.isEmpty():
        return None
    table = F.create_map(*(x for k, v in masks.items() for x in (F.lit(k).cast("long"), F.array(*(F.lit(m).cast("long") for m in v)))))
    marked = rows.join(crowded, F.col("route") == F.col("_route"), "left")
    mask = F.explode(F.when(F.col("_route").isNotNull() & ~F.col("settled"), table[F.col("fixed")]).otherwise(F.array(F.lit(0).cast("long"))))
    parted = marked.select("route", "simhash", "own", "fixed", "settled", mask.alias("_mask"))
    more = F.col("_mask") != 0
    return parted.select(
        F.when(more, F.xxhash64("route", "_mask", F.col("simhash").bitwiseAND(F.col("_mask")))).otherwise(F.col("route")).alias("route"),
        "simhash",
        "own",
        F.col("fixed").bitwiseOR(F.col("_mask")).alias("fixed"),
        (F.col("settled") | ~more).alias("settled"),
    )


def _forest(prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within RADIUS between fingerprints of one group, without those that close a circle. Rows are sorted by group."""
    n = len(prints)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach = np.searchsorted(group, group, "right") - np.arange(n) - 1  # rows of the group that follow
    rows = np.flatnonzero(reach)
    a, b, d = [], [], 1
    while len(rows):
        other = rows + d
        near = np.bitwise_count(prints[rows] ^ prints[other]) <= RADIUS
        near &= root[rows] != root[other]
        for i, j in zip(rows[near].tolist(), other[near].tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(i)
                b.append(j)
        d += 1
        rows = rows[reach[rows] >= d]
    return prints[a], prints[b]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by route; the last route of a batch waits for the next batch."""

    def links(route, prints, own):
        edge = np.concatenate([[True], route[1:] != route[:-1]]) if len(route) else np.zeros(0, bool)
        group = np.cumsum(edge) - 1
        size = np.bincount(group)
        has = (np.bincount(group, own) > 0) & (size > 1)
        use = has[group]
        a, b = _forest(prints[use].view(np.uint64), group[use])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

    waiting: list[list[np.ndarray]] = []  # parts of one route
    for batch in batches:
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))  # sorted: where the last route begins
        if waiting and waiting[0][0][0] != now[0][0]:
            yield links(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
            waiting = []
        if cut:
            whole = [*waiting, [x[:cut] for x in now]]
            waiting = []
            yield links(*(np.concatenate(x) for x in zip(*whole, strict=True)))
        waiting.append([x[cut:] for x in now])
    if waiting:
        yield links(*(np.concatenate(x) for x in zip(*waiting, strict=True)))


def link(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (src, dst) between the distinct fingerprints of prints (simhash) that join all that lie within 3 bits."""
    levels = _splits()
    half = list(levels[0])
    fixed = F.when(F.col("key") < (1 << 32), F.lit(half[0])).otherwise(F.lit(half[1])).cast("long")
    routed = _index(prints).select(F.col("key").alias("route"), "simhash", "own", fixed.alias("fixed"), F.lit(False).alias("settled"))
    for masks in levels:
        parted = _split(routed, masks, hot)
        if parted is None:
            break
        routed = parted
    return routed.select("route", "simhash", "own").repartition("route").sortWithinPartitions("route").mapInArrow(tidy(_verify), "src long, dst long")


def near_duplicates(marked: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, simhash, component_id) for each row of marked (doc_id, simhash): the smallest id that can be reached."""
    prints = keep(marked.groupBy("simhash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "prints")
    groups = connected_components(link(prints.select("simhash"), hot)).withColumnRenamed("node", "simhash")
    labelled = prints.join(groups, "simhash", "left").select("simhash", F.coalesce("component", "simhash").alias("component"), "first_id", "n")
    ids = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_print = keep(labelled.join(ids, "component").select("simhash", "n", "component_id"), "classes")
    return join_counted(marked.select("doc_id", "simhash"), by_print, "simhash", "inner")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays (with all rows that have both its
    id and its text: they are one document; of other texts under the id those that have its fingerprint stay too). Columns stay
    as they are. Texts are read once for their fingerprints; rows are told apart by id, length and hash of the text."""
    need = ("doc_id", "text")
    said = F.coalesce("text", F.lit(""))
    own = {"_long": F.octet_length(said), "_hash": F.xxhash64(said)}
    small = keep(fingerprints(docs.select(*need, *(c.alias(k) for k, c in own.items())), drop=("text",)), "simhash")
    best = near_duplicates(small.select("doc_id", "simhash")).where("doc_id <=> component_id").select(F.col("doc_id").alias("_id"), F.col("simhash").alias("_print")).distinct()
    stay = small.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("simhash") == F.col("_print"))).select("_id", F.col("_long").alias("_l"), F.col("_hash").alias("_h")).distinct()
    kept = shield(docs, need).withColumns(own).join(stay, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_long") == F.col("_l")) & (F.col("_hash") == F.col("_h")), "left_semi")
    return restore(kept, docs, need)
