"""Vectorised text kernels over Arrow string buffers.

A *block* is a slice of an Arrow batch whose texts hold at most ``BLOCK_BYTES`` (a single longer text is a block of its
own). The kernels work on the UTF-8 bytes of a block at once: words are maximal runs of bytes outside the six ASCII white
space characters, so they equal the words that ``[^\\x20\\x09-\\x0D]+`` finds. Null texts count as empty.

Hashes of 64 bits only nominate: words, lines and windows count as equal after their bytes (or their words' exact numbers) have
been compared. They are not linear (every step ends in a finaliser), so no pattern of letters makes them meet by construction,
and they do not depend on the process, so executors agree on them. Texts are Spark's strings; bytes that are no UTF-8 are
taken as they are by the word rules and as U+FFFD where code points are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LEFT = np.uint64(0xD1342543DE82EF95)
#: Slices of more bytes are hashed and compared one by one.
_LONG = 64
#: By length up to 8 the mask that leaves so many bytes of a little-endian load.
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that begin a code point.
LEADS = np.ones(256, dtype=bool)
LEADS[0x80:0xC0] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (a finaliser with two multiplications)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a little-endian number; beyond the end stand zeros."""
    return np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))


def hash_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of slices of bytes, eight bytes a step."""
    n = ends - starts
    out = mix(n.astype(np.uint64) * _ODD + np.uint64(1))
    loads, rows, k = _loads(data), np.flatnonzero((n > 0) & (n <= _LONG)), 0
    while len(rows):
        left = n[rows] - k
        out[rows] = mix(out[rows] * _LEFT + (loads[starts[rows] + k] & _MASKS[np.minimum(left, 8)]))
        k += 8
        rows = rows[left > 8]
    for i in np.flatnonzero(n > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].data, 17)
    return out


def same_slices(data: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether the bytes from a to b are those from c to d, for each place."""
    n = b - a
    out = n == d - c
    loads, rows, k = _loads(data), np.flatnonzero(out & (n > 0) & (n <= _LONG)), 0
    while len(rows):
        left = n[rows] - k
        equal = (loads[a[rows] + k] ^ loads[c[rows] + k]) & _MASKS[np.minimum(left, 8)] == 0
        out[rows[~equal]] = False
        k += 8
        rows = rows[equal & (left > 8)]
    for i in np.flatnonzero(out & (n > _LONG)).tolist():
        out[i] = a[i] == c[i] or data[a[i] : b[i]].tobytes() == data[c[i] : d[i]].tobytes()
    return out


def hash_windows(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive codes, from those of powers of two."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, done, level, span = None, 0, codes, 1
    while True:
        if n & span:
            part = level[done : done + m]
            out = part if out is None else mix(out * _LEFT + part)
            done += span
        if 2 * span > n:
            return mix(out + np.uint64(n))
        level = mix(level[:-span] * _LEFT + level[span:])
        span *= 2


def hash_runs(codes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """A hash of the codes from each head to the next, all heads together covering the codes."""
    if not len(heads):
        return np.zeros(0, np.uint64)
    n = np.diff(np.append(heads, len(codes)))
    place = np.arange(len(codes)) - np.repeat(heads, n)
    return mix(np.add.reduceat(mix(codes + place.astype(np.uint64) * _ODD), heads) + n.astype(np.uint64))


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and n + 1 offsets into them. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Block:
    """Some consecutive texts of a batch: rows first to last (exclusive), their bytes, and offsets from 0."""

    def __init__(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.last, self.data, self.offsets = first, last, data, offsets

    def __len__(self) -> int:
        return self.last - self.first

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def find_words(self) -> "Block":
        """Sets starts and ends (byte positions of words), bounds (n + 1 word numbers) and doc (the text of each word)."""
        n, space = len(self.data), SPACE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.ones(n, dtype=bool)
        before[1:] = space[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = space[1:]
        self.space = space
        self.starts = np.flatnonzero(~space & (before | edge[:n]))
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(self)), self.counts)
        return self

    def hash_words(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; call find_words() first."""
        self.words = hash_slices(self.data, self.starts, self.ends)
        return self.words

    def number_words(self) -> np.ndarray:
        """A number for each word, equal where and only where the bytes are; call hash_words() first."""
        order = np.argsort(self.words)
        h = self.words[order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        self.ids = np.empty(len(h), np.int64)
        self.ids[order] = np.cumsum(new) - 1
        first = order[new][self.ids]
        if not same_slices(self.data, self.starts, self.ends, self.starts[first], self.ends[first]).all():
            known: dict[bytes, int] = {}
            for k, (a, b) in enumerate(zip(self.starts.tolist(), self.ends.tolist(), strict=True)):
                self.ids[k] = known.setdefault(self.data[a:b].tobytes(), len(known))
        return self.ids

    def window_starts(self, n: int) -> np.ndarray:
        """Word numbers at which a window of n words of one text starts."""
        w = np.arange(len(self.starts))
        return w[w + n <= self.bounds[self.doc + 1]] if len(w) else w


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    data, offsets = texts_of(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield Block(i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; empty stretches give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in a stretch of this length from one of the starts."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def covered_runs(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in a stretch from a start to its end (exclusive)."""
    step = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(step[:-1]) > 0


def _by_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of their keys, for each of them the first place with its key, and which of them are others."""
    order = np.argsort(key)
    k = order if not len(order) else key[order]
    heads = np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)])
    first = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.append(heads, len(k)))) if len(k) else order
    return order, first, first != order


def later(doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which (doc, number) pairs equal an earlier one. Numbers are small and exact: they count what they stand for."""
    order, _, other = _by_key(doc * (int(number.max(initial=0)) + 1) + number)
    out = np.zeros(len(order), bool)
    out[order[other]] = True
    return out


def later_slices(data: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which slices of bytes equal an earlier one of their doc: hashes nominate, bytes decide."""
    order, first, other = _by_key(mix(hash_slices(data, starts, ends) + doc.astype(np.uint64) * _ODD))
    hit, before = order[other], first[other]
    out = np.zeros(len(order), bool)
    if (doc[hit] == doc[before]).all() and same_slices(data, starts[hit], ends[hit], starts[before], ends[before]).all():
        out[hit] = True
        return out
    seen: set[tuple[int, bytes]] = set()
    for k, (d, a, b) in enumerate(zip(doc.tolist(), starts.tolist(), ends.tolist(), strict=True)):
        known = (d, data[a:b].tobytes())
        out[k] = known in seen
        seen.add(known)
    return out


def repeated_windows(block: Block, n: int) -> np.ndarray:
    """First words of the windows of n words that occur more than once in their text; call number_words() first."""
    at = block.window_starts(n)
    order, first, other = _by_key(mix(hash_windows(block.words, n)[at] + block.doc[at].astype(np.uint64) * _ODD))
    hit, before = at[order[other]], at[first[other]]
    if (block.doc[hit] == block.doc[before]).all() and all((block.ids[hit + k] == block.ids[before + k]).all() for k in range(n)):
        return np.union1d(hit, before)
    found: dict[tuple, list[int]] = {}
    for k in at.tolist():
        found.setdefault((int(block.doc[k]), *block.ids[k : k + n].tolist()), []).append(k)
    return np.array(sorted(k for places in found.values() if len(places) > 1 for k in places), np.int64)


def numbers(column: pa.Array) -> np.ndarray:
    """An integer column as int64; nulls become the smallest value."""
    return pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
