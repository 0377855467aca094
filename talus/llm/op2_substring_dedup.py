"""Removal of word windows that occur earlier in the corpus, by suffix automata.

A window of ``length`` words goes if the same words also start earlier: in a document with a smaller id, or in the same
document at an earlier word. Comparing every document with automata of all others would be quadratic, and such automata
couldn't be broadcast. So the reference is sharded by content. Every window has an anchor, the ``gram`` words in it whose hash
is smallest (the leftmost of equals); equal windows have equal anchors in equal places. Consecutive windows with one anchor
form a segment, and segments are dealt by anchor: whatever equals a window stands under its anchor.

1. ``_segments`` reads each text once. Among some hundred thousand segments of a task all but the first holder of a segment
   are settled on the spot, after their bytes have been compared (an earlier document has all its windows), so of a passage
   that a third of all documents hold, few rows are shuffled.
2. Rows are counted by anchor. Anchors with one row need no more; all rows of the others are sent on with their words. Hashes
   only bring rows together here: nothing is removed by them.
3. ``_match`` has one suffix automaton for an anchor's segments, a reference shard of bounded size. Segments come in order of
   id and place; each is streamed through the automaton for its matching statistics (the longest suffix at each word that
   occurs before), the maximal spans of at least ``length`` words are removed, and it joins the automaton; a segment whose
   words are those of an earlier one goes whole. Anchors with more than ``wide`` rows are dealt on by the windows' hashes, so
   that no shard grows without bound; equal windows still meet.
4. ``_cut`` joins the spans with the texts by id.

Nulls and empty texts have no words. Rows that repeat an id and its text are one document: they never make each other's
windows earlier. Where texts under one id differ they are documents of their own, in order of a hash of the text, and all ids
are replaced by numbers that keep this order. Rows without an id come before all others, and are told apart likewise. Words are kept unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.batches import add_columns, bound_batches, field, restore, shield, tidy
from talus.llm.blocks import Block, blocks, covered_runs, hash_runs, hash_windows, mix, numbers
from talus.llm.storage import keep

LENGTH = 20
GRAM = 6
WIDE = 2000
_TOGETHER = 600_000  # segments among which copies are settled at once
_NO_ID = np.iinfo(np.int64).min
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_min(v: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    span, m = 1, v
    while 2 * span <= n:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(v) - n + 1], m[n - span : n - span + len(v) - n + 1])


def segments(block: Block, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of a block: the first and last (exclusive) word of each segment, the hashes of its anchor and of its words."""
    block.find_words().hash_words()
    at = block.window_starts(length)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    grams = hash_windows(block.words, gram)
    g = np.arange(len(grams))
    least = _sliding_min((grams & ~_PLACE) | (g.astype(np.uint64) & _PLACE), length - gram + 1)[at]
    doc = block.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    first = at[head]
    last = at[np.append(head[1:], len(at)) - 1] + length
    base = (first >> 24) << 24  # places are kept modulo 2**24
    anchor = base + (least[head] & _PLACE).astype(np.int64)
    anchor = np.where(anchor < first, anchor + (1 << 24), anchor)
    return first, last, grams[anchor], hash_runs(hash_windows(block.words, length)[at], head)


def _copies(key: np.ndarray, ids: np.ndarray, row: np.ndarray, first: np.ndarray, text: Callable[[int], bytes]) -> np.ndarray:
    """Which places hold the words of one with their key that stands earlier: under a smaller id, or before it in the same
    row. text gives the bytes of a place, and the words in them decide."""
    known = np.zeros(len(key), bool)
    if not len(key):
        return known
    order = np.lexsort((first, row, ids, key))
    k, i, r, f = key[order], ids[order], row[order], first[order]
    lead = np.maximum.accumulate(np.where(np.append(True, k[1:] != k[:-1]), np.arange(len(k)), 0))
    met = (i != i[lead]) | ((r == r[lead]) & (f != f[lead]))
    now, held = -1, b""
    for place, head in zip(order[met].tolist(), order[lead[met]].tolist(), strict=True):
        if head != now:
            now, held = head, text(head)
        own = text(place)
        known[place] = own == held or own.split() == held.split()
    return known


_ROWS = "route long, anchor long, id long, first int, last int"


def _segments(length: int, gram: int):
    """Rows of all segments: those already known to be copies have a null anchor, and a route of their own."""

    def rows_of(parts: list[tuple], raw: list[bytes]) -> pa.RecordBatch:
        i, first, last, anchor, words, row, which, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        at, to, of = a.tolist(), b.tolist(), which.tolist()
        known = _copies(mix(anchor + mix(words)), i, row, first, lambda k: raw[of[k]][at[k] : to[k]])
        route = np.where(known, mix(i.view(np.uint64) + mix(first.astype(np.uint64))), anchor)
        return pa.RecordBatch.from_arrays(
            [pa.array(route.view(np.int64)), pa.array(anchor.view(np.int64), mask=known), pa.array(i), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
            names=["route", "anchor", "id", "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, raw, held, rows = [], [], 0, 0
        for batch in batches:
            ids = numbers(batch.column(0))
            for block in blocks(batch.column(1)):
                first, last, anchor, words = segments(block, length, gram)
                if not len(first):
                    continue
                doc = block.doc[first]
                which = np.full(len(first), len(raw))
                parts.append((ids[block.first + doc], first - block.bounds[doc], last - block.bounds[doc], anchor, words, rows + block.first + doc, which, block.starts[first], block.ends[last - 1]))
                raw.append(block.data.tobytes())
                held += len(first)
            rows += batch.num_rows
            if held >= _TOGETHER:
                yield rows_of(parts, raw)
                parts, raw, held = [], [], 0
        if parts:
            yield rows_of(parts, raw)

    return run


_WORDS = "shard long, id long, first int, last int, words binary"


def _words_of(length: int, wide: int, id_at: int, text_at: int, spans_at: int):
    """The words of spans that wait, from texts joined with their spans. Spans of an anchor with more than wide rows are
    parted into windows; windows that an earlier text of the block has are settled, and their runs have null words."""

    def rows_of(block: Block, ids: np.ndarray, spans: pa.ListArray) -> pa.RecordBatch | None:
        block.find_words().hash_words()
        raw = block.data.tobytes()
        held = spans.slice(block.first, len(block))
        flat = held.flatten()
        doc = np.repeat(np.arange(len(block)), np.diff(held.offsets.to_numpy()))
        first, last, anchor, variants = (flat.field(k).to_numpy() for k in range(4))
        lo, hi = block.bounds[doc] + first, block.bounds[doc] + last
        fit = hi <= block.bounds[doc + 1]  # else another row of this id is longer
        few = fit & (variants <= wide)
        lo, hi, shard, many = lo[few], hi[few], anchor[few], (fit & ~few)
        gone_lo = gone_hi = np.zeros(0, np.int64)
        if many.any():
            a, n = (block.bounds[doc] + first)[many], (last - first)[many] - length + 1
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            key = hash_windows(block.words, length)[at]
            x, y = block.starts[at].tolist(), block.ends[at + length - 1].tolist()
            known = _copies(key, ids[block.first + block.doc[at]], block.doc[at], at, lambda k: raw[x[k] : y[k]])
            cover = covered_runs(len(block.starts), at[known], at[known] + length)
            edge = np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))
            cut = np.zeros(len(cover) + 1, bool)  # runs end with their texts
            cut[block.bounds] = True
            edge_lo = np.flatnonzero((edge[:-1] == 1) | (cut[:-1] & cover))
            edge_hi = np.flatnonzero((edge[1:] == -1) | (cut[1:] & cover)) + 1
            gone_lo, gone_hi = edge_lo, edge_hi
            at, key = at[~known], key[~known]
            lo, hi, shard = np.concatenate([lo, at]), np.concatenate([hi, at + length]), np.concatenate([shard, key.view(np.int64)])
        if not len(lo) + len(gone_lo):
            return None
        a, b = block.starts[lo].tolist(), block.ends[hi - 1].tolist()
        words = [b" ".join(raw[x:y].split()) for x, y in zip(a, b, strict=True)] + [None] * len(gone_lo)
        lo, hi = np.concatenate([lo, gone_lo]), np.concatenate([hi, gone_hi])
        who = block.doc[lo]
        shard = np.concatenate([shard, mix(gone_lo.astype(np.uint64)).view(np.int64)])
        base = block.bounds[who]
        return pa.RecordBatch.from_arrays(
            [pa.array(shard), pa.array(ids[block.first + who]), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32)), pa.array(words, pa.binary())],
            names=["shard", "id", "first", "last", "words"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = numbers(batch.column(id_at))
            for block in blocks(batch.column(text_at), 1 << 19):
                out = rows_of(block, ids, batch.column(spans_at))
                if out is not None:
                    yield out

    return run


class SuffixAutomaton:
    """All substrings of the sequences added so far (a generalised suffix automaton, built online)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _clone(self, p: int, q: int, token) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = new
            p = self.link[p]
        return new

    def add(self, tokens: list) -> None:
        last = 0
        for token in tokens:
            q = self.next[last].get(token)
            if q is not None:  # the prefix so far occurs already
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, token)
                continue
            new, p = len(self.next), last
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            while p >= 0 and token not in self.next[p]:
                self.next[p][token] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][token]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, token)
            last = new

    def spans(self, tokens: list, least: int) -> list[tuple[int, int]]:
        """Maximal stretches of tokens covered by matches of at least so many tokens."""
        out: list[tuple[int, int]] = []
        state = size = 0
        follow, link, length = self.next, self.link, self.length
        for end, token in enumerate(tokens, 1):
            while state and token not in follow[state]:
                state = link[state]
                size = length[state]
            step = follow[state].get(token)
            if step is None:
                size = 0
                continue
            state, size = step, size + 1
            if size >= least:
                start = end - size
                while out and out[-1][1] >= start:
                    start = min(start, out.pop()[0])
                out.append((start, end))
        return out


def _match(length: int):
    """Spans that occur in earlier segments of their shard; rows are sorted by shard, id and first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen, alone, automaton = None, {}, None, None  # seen: the first place of each text; alone: the only one so far
        for batch in batches:
            who, first, last = [], [], []
            for where, i, start, stop, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if text is None:
                    who.append(i)
                    first.append(start)
                    last.append(stop)
                    continue
                if where != shard:
                    shard, seen, alone, automaton = where, {}, None, None
                new, tokens = text not in seen, text.split()
                if not new and seen[text] == (i, start):
                    continue  # another row of this id
                if not new:
                    spans = [(0, len(tokens))]  # its twin has streamed through and stands in the shard
                elif alone is None:
                    alone, spans = tokens, []
                else:
                    if automaton is None:
                        automaton = SuffixAutomaton()
                        automaton.add(alone)
                    spans = automaton.spans(tokens, length)
                    automaton.add(tokens)
                seen.setdefault(text, (i, start))
                for x, y in spans:
                    who.append(i)
                    first.append(start + x)
                    last.append(start + y)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["id", "first", "last"])

    return run


def _cut(batch: pa.RecordBatch, text_at: int, spans_at: int) -> list[pa.Array]:
    """n_words, n_removed, and the kept words joined by single spaces."""
    spans = batch.column(spans_at)
    counts, removed, kept = [], [], []
    for block in blocks(batch.column(text_at)):
        block.find_words()
        part = spans.slice(block.first, len(block))
        flat = part.flatten()
        lengths = np.diff(part.offsets.to_numpy()) if len(part) else np.zeros(0, np.int64)
        lengths = np.where(part.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
        doc = np.repeat(np.arange(len(block)), lengths)
        lo = np.minimum(block.bounds[doc] + flat.field(0).to_numpy(), block.bounds[doc + 1])
        hi = np.minimum(block.bounds[doc] + flat.field(1).to_numpy(), block.bounds[doc + 1])
        gone = covered_runs(len(block.starts), lo, hi)
        mask = np.zeros(len(block.data) + 1, np.int8)
        np.add.at(mask, block.starts[~gone], 1)
        np.add.at(mask, block.ends[~gone], -1)
        stay = np.cumsum(mask[:-1]) > 0
        keepers = np.flatnonzero(~gone)
        more = keepers[:-1][block.doc[keepers[1:]] == block.doc[keepers[:-1]]] if len(keepers) else keepers
        stay[block.ends[more]] = True  # the space behind each kept word but a text's last
        data = block.data[stay].copy()
        data[block.space[stay]] = 32
        place = np.concatenate([[0], np.cumsum(stay)])[block.offsets]
        raw = data.tobytes()
        kept += [raw[a:b] for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
        counts.append(block.counts)
        removed.append(np.bincount(block.doc[gone], minlength=len(block)))
    return [pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(removed).astype(np.int64)), kept]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, wide: int = WIDE) -> DataFrame:
    """(id, first, last): words of documents (_number, text and further columns) that some earlier window covers. Spans may
    overlap. All columns of docs take part in its join with the spans that wait, so that a later join by _number can use the
    same shuffle of texts."""
    rows = bound_batches(docs.select("_number", "text")).mapInArrow(tidy(_segments(length, gram)), _ROWS)
    met = rows.repartition("route").withColumn("variants", F.count("*").over(Window.partitionBy("route")))
    spans = keep(met.where("anchor is null or variants > 1").drop("route"), "spans")
    waiting = spans.where("anchor is not null").groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("first", "last", "anchor", "variants")).alias("_waiting"))
    texts = docs.join(waiting, F.col("_number") == F.col("_id"))
    at = [texts.columns.index(c) for c in ("_number", "text", "_waiting")]
    words = texts.mapInArrow(tidy(_words_of(length, wide, *at)), _WORDS)
    matched = words.repartition("shard").sortWithinPartitions("shard", "id", "first").mapInArrow(tidy(_match(length)), "id long, first int, last int")
    return spans.where("anchor is null").select("id", "first", "last").unionByName(matched)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with _number, which orders documents and is equal only in rows with the same doc_id and text."""
    known = docs.withColumns({"_key": F.coalesce("doc_id", F.lit(_NO_ID)), "_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    if known.groupBy("_key").agg(F.min("_hash").alias("a"), F.max("_hash").alias("b")).where("a < b").isEmpty():
        return known.withColumn("_number", F.col("_key")).drop("_key", "_hash")
    parted = known.select("_key", "_hash").distinct().repartitionByRange("_key", "_hash").withColumn("_part", F.spark_partition_id())
    placed = keep(parted.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy("_key", "_hash"))), "places")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbers_of = placed.join(F.broadcast(before), "_part").select("_key", "_hash", (F.col("_before") + F.col("_place")).alias("_number"))
    return known.join(numbers_of, ["_key", "_hash"]).drop("_key", "_hash")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, wide: int = WIDE, digest: bool = False) -> DataFrame:
    """docs with n_words, n_removed and the text of kept words, joined by single spaces; a text that loses nothing stays as
    it is. With digest, kept_sha256 (of the kept words) stands in for the text."""
    need = ("doc_id", "text")
    numbered = _numbered(shield(docs, need))
    spans = repeated_spans(numbered, length, gram, wide).groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("first", "last")).alias("_spans"))
    joined = numbered.join(spans, F.col("_number") == F.col("_id"), "left").drop("_id", "_number")
    text_at, spans_at = joined.columns.index("text"), len(joined.columns) - 1

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        n, removed, kept = _cut(batch, text_at, spans_at)
        if digest:
            return [n, removed, pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        old = batch.column(text_at).view(pa.large_binary() if pa.types.is_large_string(batch.column(text_at).type) else pa.binary())
        changed = removed.to_numpy() > 0
        new = [kept[k] if changed[k] else old[k].as_py() for k in range(len(kept))]
        return [n, removed, pa.array(new, pa.binary()).view(pa.string())]  # bytes that are no UTF-8 stay as they are

    fields = [field("n_words", T.LongType()), field("n_removed", T.LongType()), field("kept_sha256" if digest else "text", T.StringType())]
    out = add_columns(joined, fields, lambda: compute, drop=("_spans", "text") if digest else ("_spans",))
    return restore(out, docs, need, ("n_words", "n_removed", "kept_sha256"), ("text",)) if digest else restore(out, docs, need, ("n_words", "n_removed"))
