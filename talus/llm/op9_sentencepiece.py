"""SentencePiece encoding and decoding by suffix-array matching.

Texts get a leading space, and each text is parted where no piece can reach across (before runs of spaces, which stand for the
mark, around line feeds). The distinct parts of a run of texts are concatenated and indexed by a suffix array, sorted by eight
bytes; every piece is found by binary search as a range of suffixes (what a longer piece has beyond is compared), and each suffix
in the range is an edge of the lattice. Edges are sorted by position and relaxed from left to right. Parts of over a thousand
bytes are relaxed alone, their edges found in windows. Models with pieces that reach across the borders of parts, with a
normaliser or without byte fallback raise when they are loaded.

``bpe`` models: an edge extends the encoding that ends where it starts if its piece and the last piece there stay two pieces
when they are merged alone. Each prefix has one encoding, so the first edge that fits ends the search for its end. ``unigram``
models: the edge with the best sum of scores stays, of equals the longer. Code points that are no piece become byte pieces.
The ids equal those of the SentencePiece library for models without a normaliser (the public one is such a model).

Decoding joins pieces, turns marks into spaces and drops the leading space, so it returns each text, but that a mark in the
text itself comes back as a space. Bytes that are no UTF-8 come in as U+FFFD. Null texts have null ids and null texts have null decodings; empty texts have no ids. Ids
outside the vocabulary are an error. Parts once encoded are kept in bounded tables of the task.
"""

from __future__ import annotations

import copy
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talus.llm.batches import add_columns, field
from talus.llm.vocabulary import MARK, Vocabulary, load

#: What a piece must look like so that none crosses a border between parts.
_WITHIN = re.compile(f"{MARK}*[^{MARK}\n]*|\n")
_SLICE = 1 << 19
_WINDOW = 1 << 16  # bytes of a long part whose edges are held at once
_TEXTS = 1 << 22  # bytes of the texts that are parted at once
_KEPT = 200_000
_LONG = 1000
_SLOTS, _MIX = 20, np.uint64(0x9E3779B97F4A7C15)  # places in the table of pairs: 2 ** _SLOTS
_PAIRS = 1 << 16
_LATE = 1 << 40
_END = 0xFE
_NONE, _START, _NEVER = -3, -2, float("inf")
_STEP = np.ones(256, np.int64)
_STEP[0xC0:0xE0], _STEP[0xE0:0xF0], _STEP[0xF0:] = 2, 3, 4


def _spaced(piece: str) -> bytes:
    return piece.replace(MARK, " ").encode()


def _words(raw: bytes) -> np.ndarray:
    """For each place but the last seven the eight bytes from there on, as a number that sorts as they do."""
    words = np.frombuffer(raw, np.uint8).astype(np.uint64)
    for k in (1, 2, 4):
        words = (words[:-k] << np.uint64(8 * k)) | words[k:]
    return words


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of large texts or large binaries, and the offsets of its rows in them."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, kind: str | None = None):
        self.kind, self.ids = kind or vocabulary.kind, vocabulary.ids()
        if self.kind not in ("bpe", "unigram"):
            raise ValueError(f"unknown kind of model {self.kind}")
        crossing = [vocabulary.pieces[i] for i in vocabulary.usable if not _WITHIN.fullmatch(vocabulary.pieces[i])]
        if crossing:
            raise ValueError(f"pieces such as {crossing[0]!r} reach across the borders at which texts are parted")
        self.pieces, self.byte_ids, self.n = vocabulary.pieces, vocabulary.byte_ids, len(vocabulary.pieces)
        self.scores = np.array([*vocabulary.scores, min(vocabulary.scores[i] for i in vocabulary.usable) - 10])  # the last: of what is no piece
        # in parts a space stands for the mark, so a piece with a space of its own matches none
        raw, self.found = zip(*sorted((_spaced(vocabulary.pieces[i]), i) for i in vocabulary.usable if " " not in vocabulary.pieces[i]), strict=True)
        self.found, self.lengths = np.array(self.found), np.array([len(r) for r in raw])
        self.width = max(map(len, raw))
        self.words = -(-self.width // 8)
        low = _words(b"".join(r.ljust(8 * self.words, b"\0") for r in raw))[::8].reshape(-1, self.words)
        high = _words(b"".join(r.ljust(8 * self.words, b"\xff") for r in raw))[::8].reshape(-1, self.words)
        self.low, self.high, self.rest, self.mask = low[:, 0].copy(), high[:, 0].copy(), low, ~(low ^ high)
        self.done: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, tuple] = {}
        self.merges = _Merges(self) if self.kind == "bpe" else None
        output = [_spaced(p) for p in vocabulary.pieces]
        for value, i in enumerate(vocabulary.byte_ids):
            output[i] = bytes([value])
        self.output = pa.array(output, pa.large_binary())

    # lattice

    def _edges(self, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every edge in the joined parts; a code point that is no piece has an edge of piece -1."""
        words = _words(joined + bytes([_END]) * (8 * self.words))
        text = np.frombuffer(joined, np.uint8)
        at = np.flatnonzero(((text & 0xC0) != 0x80) & (text != _END))
        array = words[at]
        order = np.argsort(array)
        array = array[order]
        lo, hi = np.searchsorted(array, self.low), np.searchsorted(array, self.high, "right")
        count = hi - lo
        which = np.repeat(np.arange(len(lo)), count)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(count) - count - lo, count)
        start = at[order][rank]
        lengths = self.lengths[which]
        for k in range(1, self.words):  # suffixes are sorted by eight bytes; what longer pieces have beyond is compared
            more = np.flatnonzero(lengths > 8 * k)
            differ = more[(words[start[more] + 8 * k] & self.mask[which[more], k]) != self.rest[which[more], k]]
            if len(differ):
                keep = np.ones(len(which), bool)
                keep[differ] = False
                which, start, lengths = which[keep], start[keep], lengths[keep]
        step = _STEP[text]
        single = np.zeros(len(joined), bool)
        single[start[lengths == step[start]]] = True
        gap = at[~single[at]]
        return (
            np.concatenate([start, gap]),
            np.concatenate([start + lengths, gap + step[gap]]),
            np.concatenate([self.found[which], np.full(len(gap), -1)]),
        )

    def _unknown(self, raw: bytes) -> list[int]:
        return [self.byte_ids[v] for v in raw.replace(b" ", MARK.encode())]

    def _encode_long(self, raw: bytes) -> None:
        """Relax the edges of one long part place by place; edges are found in windows, so few of them are held."""
        last, back = np.full(len(raw) + 1, _NONE, np.int32), np.zeros(len(raw) + 1, np.int64)
        last[0] = _START
        bpe, fits, scores = self.kind == "bpe", self._fit, self.scores.tolist()
        # what is known of the places that edges of the window may end at
        ahead: dict[int, tuple] = {0: (_START, 0, 0.0)}
        for low in range(0, len(raw), _WINDOW):
            start, end, piece = self._edges(raw[low : low + _WINDOW + self.width])
            own = start < _WINDOW
            order = np.argsort(start[own], kind="stable")
            now, at = -1, None
            for s, e, p in zip((start[own][order] + low).tolist(), (end[own][order] + low).tolist(), piece[own][order].tolist(), strict=True):
                if s != now:
                    now, at = s, ahead.pop(s, None)
                    if at is not None:
                        last[s], back[s] = at[0], at[1]
                if at is None:
                    continue
                if bpe:
                    if e not in ahead and fits(at[0], p):
                        ahead[e] = (p, s, 0.0)
                else:
                    total, known = at[2] + scores[p], ahead.get(e)
                    if known is None or total > known[2]:
                        ahead[e] = (p, s, total)
        at = ahead.pop(len(raw))
        last[-1], back[-1] = at[0], at[1]
        ids: list[int] = []
        e = len(raw)
        while e:
            s, p = int(back[e]), int(last[e])
            if p >= 0:
                ids.append(p)
            else:
                ids += reversed(self._unknown(raw[s:e]))
            e = s
        self.done[raw] = np.array(ids[::-1], "<i4").tobytes()

    def _encode(self, parts: list[bytes]) -> None:
        """Relax the edges of all parts in step: those at the first place of every part, then those at the next, and so on;
        long parts alone, so that the others need few steps."""
        for part in parts:
            if len(part) > _LONG:
                self._encode_long(part)
        parts = [p for p in parts if len(p) <= _LONG]
        if not parts:
            return
        start, end, piece = self._edges(bytes([_END]).join(parts) + bytes([_END]))
        sizes = np.array([len(p) for p in parts])
        heads = np.cumsum(np.concatenate([[0], sizes[:-1] + 1]))
        size = int(sizes.sum()) + len(parts) + 1
        places = (np.arange(size - 1) - np.repeat(heads, sizes + 1)).astype(np.uint16)  # at most _LONG; such small numbers sort by radix
        place = places[start]
        order = np.argsort(place, kind="stable")
        start, end, piece, place = start[order], end[order], piece[order], place[order]
        last = np.full(size, _NONE)  # the piece that ends here
        back = np.zeros(size, np.int64)
        total = np.full(size, -np.inf)
        last[heads], total[heads] = _START, 0.0
        cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])).tolist() + [len(place)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            if self.kind == "bpe":
                take = np.flatnonzero((last[e] == _NONE) & (last[s] != _NONE))
                s, e, p = s[take], e[take], p[take]
                take = self.merges.fits(last[s], p)
            else:
                sums = total[s] + self.scores[p]
                take = sums > total[e]
                total[e[take]] = sums[take]
            last[e[take]], back[e[take]] = p[take], s[take]
        found, owner, now, who = [], [], heads + sizes, np.arange(len(parts))
        while len(now):
            live = last[now] != _START
            now, who = now[live], who[live]
            found.append(np.where(last[now] >= 0, last[now], -now - 1))
            owner.append(who)
            now = back[now]
        count = np.bincount(np.concatenate(owner), minlength=len(parts))
        bounds = np.concatenate([[0], np.cumsum(count)])
        ids = np.zeros(bounds[-1], np.int64)
        for level, (f, who) in enumerate(zip(found, owner, strict=True)):  # from the end of each part
            ids[bounds[1:][who] - 1 - level] = f
        odd = np.unique(np.repeat(np.arange(len(parts)), count)[ids < 0]).tolist()
        out, cuts = ids.astype("<i4").tobytes(), (4 * bounds).tolist()
        self.done.update((part, out[a:b]) for part, a, b in zip(parts, cuts[:-1], cuts[1:], strict=True))
        for k in odd:
            found = []
            for f in ids[bounds[k] : bounds[k + 1]].tolist():
                e = -f - 1
                found += [f] if f >= 0 else self._unknown(parts[k][back[e] - heads[k] : e - heads[k]])
            self.done[parts[k]] = np.array(found, "<i4").tobytes()

    # merges

    def _spines(self, p: int) -> tuple:
        """How merging alone makes a piece of its code points: whether it gets there, and the symbols that stand at its left
        and at its right edge meanwhile: each with its rank (that of its piece; lower comes first) and the rank at which it goes.
        """
        got = self.spines.get(p)
        if got is None:
            symbols = list(self.pieces[p])
            left, right, rank = [(symbols[0], -1)], [(symbols[-1], -1)], self._rank
            while len(symbols) > 1:
                best, k = min((rank(symbols[k] + symbols[k + 1]), k) for k in range(len(symbols) - 1))
                if best == _NEVER:
                    break
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                if k == 0:
                    left.append((symbols[0], best))
                if k == len(symbols) - 1:
                    right.append((symbols[-1], best))
            gone = lambda edge: [(x, r, edge[i + 1][1] if i + 1 < len(edge) else _NEVER) for i, (x, r) in enumerate(edge)]
            got = self.spines[p] = (len(symbols) == 1, gone(left), gone(right))
        return got

    def _rank(self, text: str) -> float:
        i = self.ids.get(text)
        return _NEVER if i is None else -self.scores[i]

    def _stays(self, before: int, p: int) -> bool:
        """Whether a piece after another (or at the start) stays one piece. The border falls if two symbols that stand at it
        at the same time join before either goes; of equal ranks the pair on the left goes first."""
        if p < 0:
            return True
        whole, left, _ = self._spines(p)
        if before < 0:
            return whole
        for x, made, gone in self._spines(before)[2]:
            for y, made_too, gone_too in left:
                r = self._rank(x + y)
                if r != _NEVER:
                    time = max(r, made, made_too)
                    if time < gone and time <= gone_too:
                        return False
        return whole

    def _fit(self, before: int, p: int) -> bool:
        key = (before + 3) * (self.n + 3) + p + 3
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._stays(before, p)
        return known

    # texts

    def _parts(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of each part. Of parts once encoded, two bounded tables are kept: when the newer is full it takes the place of
        the older, and what is met again comes over, so frequent parts stay."""
        if len(self.done) > _KEPT:
            self.old, self.done = self.done, {}
        if len(self.pairs) > 2 * _KEPT:
            self.pairs.clear()
        done, old = self.done, self.old
        fresh, missing, size = [part for part in distinct if part not in done], [], 0
        for part in fresh:
            known = old.get(part)
            if known is not None:
                done[part] = known
                continue
            missing.append(part)
            size += len(part)
            if size > _SLICE:
                self._encode(missing)
                missing, size = [], 0
        if missing:
            self._encode(missing)
        out = list(map(done.__getitem__, distinct))
        for part in fresh:
            if len(part) > _LONG:
                done.pop(part, None)
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts and the offsets of the rows in them; the bytes that the ids should decode to (a space, then the
        text with its marks as spaces) and the offsets of the rows in these. Null and empty texts have none of either."""
        plain = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
        space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        led = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(plain), 0), nothing, space), plain, nothing)
        data, rows = _flat(led)
        if not len(data):
            return np.zeros(0, "<i4"), rows, data, rows
        # a part begins with a text, before a run of spaces, and before and after a line feed
        blank, line = data == 0x20, data == 0x0A
        begins = blank | line
        begins[1:] &= ~(blank[1:] & blank[:-1])
        begins[1:] |= line[:-1]
        begins[rows[:-1][rows[:-1] < rows[1:]]] = True
        begins = np.flatnonzero(begins)
        bounds = np.append(begins, len(data))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        parts = parts.dictionary_encode()
        found = pa.array(self._parts(parts.dictionary.to_pylist()), pa.large_binary()).take(parts.indices)
        ids, ends = _flat(found)
        return ids.view("<i4"), ends[np.searchsorted(begins, rows)] // 4, data, rows

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """For each text its ids as little-endian 32-bit integers."""
        ids, at, _, _ = self.encode_column(pa.array(texts, pa.large_string()))
        return [None if t is None else ids[a:b].tobytes() for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _decoded(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of rows of ids joined, marks of pieces as spaces, and the offsets of the rows in them."""
        data, ends = _flat(self.output.take(pa.array(ids)))
        return data, ends[at]

    def decode_rows(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        data, rows = self._decoded(ids, at)
        texts = (data[a:b].tobytes().decode("utf-8", "replace").replace(MARK, " ") for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True))
        return [t.removeprefix(" ") for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_rows(ids, np.array([0, len(ids)]))[0]

    def returns(self, ids: np.ndarray, at: np.ndarray, want: np.ndarray, rows: np.ndarray) -> list[bool]:
        """Whether each row of ids decodes to the bytes wanted, which are UTF-8 without marks."""
        data, got = self._decoded(ids, at)
        if np.array_equal(got, rows) and np.array_equal(data, want):
            return [True] * (len(rows) - 1)
        texts = [want[a:b].tobytes().decode().removeprefix(" ") for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
        return [a == b for a, b in zip(self.decode_rows(ids, at), texts, strict=True)]


class _Merges:
    """Encoder._stays for arrays of pairs. What is known of pairs is held in a table with one place for each hash."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.n = encoder, encoder.n
        self.symbols = dict(encoder.ids)  # pieces and, from n on, code points that are none
        _, order = np.unique(-encoder.scores[:-1], return_inverse=True)
        self.order = {float(-x): int(r) for x, r in zip(encoder.scores, order, strict=False)}
        keys, ranks = [], []
        for piece, i in encoder.ids.items():
            for k in range(1, len(piece)):
                x, y = self._symbol(piece[:k]), self._symbol(piece[k:])
                if x is not None and y is not None:
                    keys.append(x << 32 | y)
                    ranks.append(order[i])
        by = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks = np.append(np.array(keys, np.int64)[by], -1), np.append(np.array(ranks, np.int64)[by], 0)
        # of each piece whether it is whole (-1: not looked at yet), and where its left and right symbols are listed
        self.whole = np.full(self.n, -1, np.int8)
        self.at, self.sizes = np.zeros((2, self.n), np.int64), np.zeros((2, self.n), np.int64)
        self.listed, self.used = np.zeros((3, 1024), np.int64), 0  # symbol, rank when it comes, rank when it goes
        self.slots, self.values = np.full(1 << _SLOTS, -1, np.int64), np.zeros(1 << _SLOTS, bool)

    def _symbol(self, text: str) -> int | None:
        got = self.symbols.get(text)
        if got is None and len(text) == 1:
            got = self.symbols[text] = self.n + len(self.symbols)
        return got

    def _rank(self, rank: float) -> int:
        return -1 if rank == -1 else _LATE if rank == _NEVER else self.order[rank]

    def _list(self, pieces: np.ndarray) -> None:
        for p in pieces[self.whole[pieces] < 0].tolist():
            if self.whole[p] >= 0:
                continue
            whole, *edges = self.encoder._spines(p)
            for side, edge in enumerate(edges):
                if self.used + len(edge) > self.listed.shape[1]:
                    self.listed = np.concatenate([self.listed, np.zeros((3, max(len(edge), self.listed.shape[1])), np.int64)], axis=1)
                for x, made, gone in edge:
                    self.listed[:, self.used] = self._symbol(x), self._rank(made), self._rank(gone)
                    self.used += 1
                self.at[side, p], self.sizes[side, p] = self.used - len(edge), len(edge)
            self.whole[p] = whole

    def stays(self, before: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.ones(len(p), bool)
        known = np.flatnonzero(p >= 0)
        self._list(p[known])
        out[known] = self.whole[p[known]] == 1
        known = np.flatnonzero(out & (p >= 0) & (before >= 0))
        before, p = before[known], p[known]
        self._list(before)
        lefts = self.sizes[0, p]
        count = self.sizes[1, before] * lefts
        pair = np.repeat(np.arange(len(p)), count)
        i, j = np.divmod(np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count), lefts[pair])
        x, made, gone = self.listed[:, self.at[1, before][pair] + i]
        y, made_too, gone_too = self.listed[:, self.at[0, p][pair] + j]
        key = x << 32 | y
        place = np.searchsorted(self.keys[:-1], key)
        time = np.maximum(self.ranks[place], np.maximum(made, made_too))
        falls = (self.keys[place] == key) & (time < gone) & (time <= gone_too)
        out[known[pair[falls]]] = False
        return out

    def fits(self, before: np.ndarray, p: np.ndarray) -> np.ndarray:
        keys = (before + 3) * (self.n + 3) + p + 3
        slot = ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out, unknown = self.values[slot], np.flatnonzero(self.slots[slot] != keys)
        if len(unknown):
            _, first, inverse = np.unique(keys[unknown], return_index=True, return_inverse=True)
            first = unknown[first]
            for k in range(0, len(first), _PAIRS):
                now = first[k : k + _PAIRS]
                out[now] = self.stays(before[now], p[now])
            out[unknown] = out[first][inverse]
            _, one = np.unique(slot[first], return_index=True)  # one key for each place
            self.slots[slot[first[one]]], self.values[slot[first[one]]] = keys[first[one]], out[first[one]]
        return out


_KNOWN: dict[tuple, tuple] = {}


def _encoder(vocabulary: Vocabulary, kind: str | None) -> Encoder:
    """An encoder for a task; its index of pieces and what is known about pairs (a bounded table) are shared by the tasks of a
    worker, and what is known of parts is not."""
    key = (hash(vocabulary.pieces), hash(vocabulary.scores), kind or vocabulary.kind)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Encoder(vocabulary, kind)
    encoder = copy.copy(_KNOWN[key])
    encoder.done, encoder.old = {}, {}
    return encoder


def _valid(column: pa.Array) -> pa.Array:
    """The column, its bytes that are no UTF-8 as U+FFFD."""
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
        return pa.array([None if r is None else r.decode("utf-8", "replace") for r in raw], pa.large_string())


def _in_slices(column: pa.Array):
    """Runs of rows of about _TEXTS bytes together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _TEXTS, "right")))
        yield _valid(column.slice(a, b - a))
        a = b


def encode(docs: DataFrame, model_file: str, kind: str | None = None, drop: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """docs with ids (an array of integers); with decoded, text becomes what the ids decode to, as decode() would make it."""
    held = docs.sparkSession.sparkContext.broadcast(load(model_file))

    def make():
        encoder = _encoder(held.value, kind)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            column, values, sizes, back = batch.column("text"), [], [[0]], []
            for part in _in_slices(column):
                ids, at, _, _ = encoder.encode_column(part)
                values.append(ids)
                sizes.append(np.diff(at))
                if decoded:
                    back += encoder.decode_rows(ids, at)
            null = column.is_null()
            offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
            out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), pa.int32()), mask=null)]
            if decoded:
                out.append(pc.if_else(null, None, pa.array(back, pa.string())))
            return out

        return compute

    fields = [field("ids", T.ArrayType(T.IntegerType()))] + ([field("text", T.StringType())] if decoded else [])
    return add_columns(docs, fields, make, drop)


def decode(rows: DataFrame, model_file: str, kind: str | None = None) -> DataFrame:
    """rows (with ids) with the decoded text as column text."""
    held = rows.sparkSession.sparkContext.broadcast(load(model_file))

    def make():
        encoder = _encoder(held.value, kind)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column("ids")
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            full = column.is_valid().to_numpy(zero_copy_only=False)
            return [pa.array([encoder.decode(values[ends[k] : ends[k + 1]]) if full[k] else None for k in range(len(full))], pa.string())]

        return compute

    return add_columns(rows, [field("text", T.StringType())], make)


def digest(docs: DataFrame, model_file: str, kind: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_pieces, ids_sha256 (of the ids as little-endian 32-bit integers) and round_trip: the ids decode to the
    text with its marks as spaces. All three are null for null texts."""
    held = docs.sparkSession.sparkContext.broadcast(load(model_file))

    def make():
        encoder = _encoder(held.value, kind)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            column, n, sha, back = batch.column("text"), [], [], []
            for part in _in_slices(column):
                ids, at, want, rows = encoder.encode_column(part)
                n += np.diff(at).tolist()
                sha += [hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                back += encoder.returns(ids, at, want, rows)
            null = column.is_null()
            return [pc.if_else(null, None, pa.array(v, t)) for v, t in ((n, pa.int64()), (sha, pa.string()), (back, pa.bool_()))]

        return compute

    fields = [field("n_pieces", T.LongType()), field("ids_sha256", T.StringType()), field("round_trip", T.BooleanType())]
    return add_columns(docs, fields, make, drop)
