"""Benchmark decontamination with templates.

Words lose everything but letters and digits, and case; words of which nothing is left are no tokens. Then numbers, names
(words with a capital that don't start a sentence) and units become typed slots. A document is contaminated where a
window of ``window`` tokens has the template of a window of some benchmark item, and the slots are consistent: over the
tokens that the two share at one alignment, equal values of the item stand for equal values of the document and different
ones for different ones. So a question with other numbers and names is caught, and one that mixes them up isn't. A window
in which fewer than ``literals`` tokens are no slots says too little; it counts only if all its slot values are equal too.
A second index holds the plain tokens, for copies whose case was changed.

A third index holds a looser template, for items that the first two miss: there capitalised words are names at the start of
a sentence too, unless they are function words (``OPENERS``); words are parted at hyphens and between digits and letters
(5kg, twenty-five); and a run of names or of numbers without punctuation in it is one slot, however many words it has.

Items shorter than a window count with their whole length; items of fewer than five tokens only where they are the whole
document. Null or empty texts and items match nothing; the same item twice counts once. Rows that repeat an id are judged
one by one. The index is broadcast in blocks of at most ``block`` windows: a larger benchmark takes several scans.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.batches import add_columns, field, restore, shield
from talus.llm.blocks import SPACE, Block, blocks, hash_slices, hash_windows, mix, sums

WINDOW = 10
LITERALS = 5
BLOCK = 1_000_000
_SHORT = 5

# Units, and numbers in words.
UNITS = """
mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes ounce ounces pound pounds lb lbs
ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks
month months year years hz khz mhz ghz w kw watt watts v volt volts j joule joules cal kcal pa kpa bar degree degrees
celsius fahrenheit kelvin percent dollar dollars cent cents euro euros usd eur kb mb gb tb
""".split()
NUMBERS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
""".split()

# Words that open sentences as what they are, not as names; and titles, whose full stop ends no name.
OPENERS = """
a about after all also although an and another any are as at because before both but by can could did do does during each
either every everyone few find first for from give given had has have he her here his how however i if in is it its last
let many more most much my neither next no not now of on once one only or our she should since so some such suppose than
that the their then there these they this those though to today tomorrow under until was we were what when where which
while who whom whose why will with would yes yesterday yet you your
""".split()
TITLES = "mr mrs ms miss dr prof professor st sir lady".split()

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Code points of the basic plane that are capitals.
_CAPITAL = np.array([chr(c).isupper() or chr(c).istitle() for c in range(1 << 16)])
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:")] = True
_SLOTS = mix(np.array([11, 12, 13], np.uint64))  # number, unit, name


def _hash_list(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(hash_slices(data, ends - [len(w) for w in words], ends))


_UNITS, _NUMBERS = _hash_list(UNITS), _hash_list(NUMBERS)
_OPENERS, _TITLES = _hash_list(OPENERS), _hash_list(TITLES)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _capitals(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the code points (of UTF-8 data) that begin at these places are capitals."""
    x, y, z = (np.append(data, [0, 0, 0])[at + k].astype(np.int64) for k in range(3))
    two, three = ((x & 31) << 6) | (y & 63), ((x & 15) << 12) | ((y & 63) << 6) | (z & 63)
    return _CAPITAL[np.where(x < 0x80, x, np.where(x < 0xE0, two, np.where(x < 0xF0, three, 0)))]


class Letters:
    """What both templates need of a block: the bytes that tokens are made of (use; plain, folded, digit), how many line feeds
    stand before each byte, and the words that hold such bytes (starts and ends among them, doc, opens)."""

    def __init__(self, block: Block):
        block.find_words()
        self.use = _LETTER[block.data]
        place = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum(self.use, out=place[1:])
        a, b = place[block.starts], place[block.ends]
        full = b > a
        self.plain = block.data[self.use]
        self.folded = _FOLD[self.plain]
        self.digit = (self.plain >= 48) & (self.plain <= 57)
        self.feeds = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum(block.data == 10, out=self.feeds[1:])
        opens = np.ones(len(a), bool)  # starts a sentence
        if len(a) > 1:
            opens[1:] = _STOP[block.data[block.ends[:-1] - 1]] | (self.feeds[block.starts[1:]] > self.feeds[block.ends[:-1]])
            opens[1:] |= block.doc[1:] != block.doc[:-1]
        self.starts, self.ends = a[full], b[full]
        self.doc, self.opens = block.doc[full], opens[full]


class Tokens:
    """Tokens of a block: values (hashes of folded words), kinds (0 literal, 1 number, 2 unit, 3 name), codes, doc, bounds;
    with ``loose`` those of the looser template."""

    def __init__(self, block: Block, loose: bool = False, letters: Letters | None = None):
        found = letters or Letters(block)
        a, b, opens, plain, digit = found.starts, found.ends, found.opens, found.plain, found.digit
        self.doc, self.folded = found.doc, found.folded
        if loose and len(a):
            a, b, opens = self._part(block, found.use, digit, a, opens)
        self.values, self.starts, self.ends = hash_slices(self.folded, a, b), a, b
        digits = sums(digit, np.append(a, b[-1:])) if len(a) else a
        number = (digits == b - a) | _among(self.values, _NUMBERS)
        unit = _among(self.values, _UNITS)
        name = _capitals(plain, a) & ~(opens & _among(self.values, _OPENERS) if loose else opens)
        self.kinds = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0))).astype(np.int8)
        if loose and len(a):
            self._join(block, found, a, b)
        self.bounds = np.searchsorted(self.doc, np.arange(len(block) + 1))
        self.codes = np.where(self.kinds > 0, _SLOTS[np.maximum(self.kinds, 1) - 1], self.values)

    def _part(self, block: Block, use: np.ndarray, digit: np.ndarray, a: np.ndarray, opens: np.ndarray) -> tuple:
        """Starts, ends and opens of the parts of words between hyphens, digits and letters; doc follows."""
        before = np.append(np.uint8(32), block.data)[np.flatnonzero(use)]  # the byte before each that is used
        cut = before == 45
        cut[1:] |= digit[1:] != digit[:-1]
        word = np.zeros(len(cut), bool)
        word[a] = True
        starts = np.flatnonzero(cut | word)
        of = np.cumsum(word)[starts] - 1
        self.doc = self.doc[of]
        return starts, np.append(starts[1:], len(cut)), opens[of] & word[starts]

    def _join(self, block: Block, found: Letters, a: np.ndarray, b: np.ndarray) -> None:
        """Runs of names or numbers become one token: what lies between two of them is white space or hyphens alone, or the
        full stop of a title or initial."""
        use, feeds, raw = found.use, found.feeds, np.flatnonzero(found.use)
        marks = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum(~use & ~SPACE[block.data] & (block.data != 45), out=marks[1:])
        end, begin = raw[b[:-1] - 1] + 1, raw[a[1:]]
        short = _among(self.values[:-1], _TITLES) | (b[:-1] - a[:-1] == 1)
        stop = (block.data[np.minimum(end, len(block.data) - 1)] == 46) & (marks[begin] - marks[end] == 1)
        clear = (marks[begin] == marks[end]) | (stop & short & (self.kinds[:-1] == 3))
        same = (self.kinds[1:] == self.kinds[:-1]) & np.isin(self.kinds[1:], (1, 3)) & (self.doc[1:] == self.doc[:-1])
        first = np.flatnonzero(np.append(True, ~(same & clear & (feeds[begin] == feeds[end]))))
        last = np.append(first[1:], len(a)) - 1
        self.starts, self.ends = a[first], b[last]
        self.values = hash_slices(self.folded, self.starts, self.ends)
        self.kinds, self.doc = self.kinds[first], self.doc[first]

    def windows(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of the windows of n tokens of one text."""
        at = np.arange(len(self.doc))
        at = at[at + n <= self.bounds[self.doc + 1]] if len(at) else at
        return at, hash_windows(codes, n)[at]

    def words(self, at: Iterable[int]) -> list[bytes]:
        """The folded bytes of tokens."""
        return [self.folded[self.starts[k] : self.ends[k]].tobytes() for k in at]


class Index:
    """The windows of some benchmark items, by hash."""

    def __init__(self, items: list[tuple[int, str]], window: int, loose: bool = False):
        self.ids = [i for i, _ in items]
        (block,) = list(blocks(pa.array([t for _, t in items], pa.string()), limit=1 << 62)) or [None]
        t = Tokens(block, loose)
        self.parts = [slice(t.bounds[k], t.bounds[k + 1]) for k in range(len(items))]
        self.kinds, self.words = t.kinds, t.words(range(len(t.doc)))
        lengths = np.diff(t.bounds)
        self.tables: dict[tuple[int, bool], tuple] = {}
        for n in sorted({*np.minimum(lengths, window).tolist()} - {0}):
            of = lengths >= window if n == window else lengths == n
            for plain in (False,) if loose else (False, True):
                at, h = t.windows(t.values if plain else t.codes, n)
                mine = of[t.doc[at]]
                at, h = at[mine], h[mine]
                order = np.argsort(h, kind="stable")
                mark = np.zeros(1 << 18, bool)
                mark[(h >> np.uint64(46)).astype(np.int64)] = True
                self.tables[n, plain] = (h[order], at[order], mark)
        self.doc = t.doc


def _consistent(slots: list[tuple[int, bytes, bytes]]) -> bool:
    """Whether slots (kind, theirs, ours) map one to one."""
    pairs = set(slots)
    return len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs})


def _hits(t: Tokens, index: Index, window: int, literals: int, docs: int) -> list[dict[int, list[int]]]:
    """For each text the items that it contains: number of windows, and whether some slot value differs. Hashes nominate
    windows; the bytes of their tokens decide."""
    aligned: dict[tuple, dict[int, bool]] = defaultdict(dict)
    for (n, plain), (hashes, places, mark) in index.tables.items():
        at, h = t.windows(t.values if plain else t.codes, n)
        met = mark[(h >> np.uint64(46)).astype(np.int64)]
        at, h = at[met], h[met]
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for k in np.flatnonzero(hi > lo).tolist():
            a = int(at[k])
            if n < _SHORT and t.bounds[t.doc[a] + 1] - t.bounds[t.doc[a]] != n:
                continue
            ours, kinds = t.words(range(a, a + n)), t.kinds[a : a + n]
            for b in places[lo[k] : hi[k]].tolist():
                slots = np.zeros(n, bool) if plain else (kinds > 0) & (kinds == index.kinds[b : b + n])
                if all(slot or x == y for slot, x, y in zip(slots.tolist(), ours, index.words[b : b + n], strict=True)):
                    aligned[int(t.doc[a]), int(index.doc[b]), a - b, n][a] = plain
    found: list[dict[int, list[int]]] = [{} for _ in range(docs)]

    def sound(tokens: np.ndarray, shift: int) -> bool:
        slots = tokens[(index.kinds[tokens - shift] > 0) & (t.kinds[tokens] > 0)]
        theirs = [index.words[k] for k in (slots - shift).tolist()]
        return _consistent(list(zip(index.kinds[slots - shift].tolist(), theirs, t.words(slots.tolist()), strict=True)))

    for (doc, item, shift, n), starts in aligned.items():
        tokens = np.unique(np.concatenate([np.arange(a, a + n) for a in starts]))
        whole = sound(tokens, shift)
        good, other = 0, False
        for a, plain in starts.items():
            own = np.arange(a, a + n)
            equal = plain or t.words(range(a, a + n)) == index.words[a - shift : a - shift + n]
            enough = int((index.kinds[own - shift] == 0).sum()) >= min(literals, n)
            if equal or (enough and whole):
                good, other = good + 1, other or not equal
        if good:
            seen = found[doc].setdefault(index.ids[item], [0, 0])
            seen[0] += good
            seen[1] |= other
    return found


def _both(block: Block, held: tuple[Index, Index], window: int, literals: int) -> list[dict[int, list[int]]]:
    """The items that the typed template and the plain tokens find, and those that only the looser template does."""
    exact, loose = held
    letters = Letters(block)
    found = _hits(Tokens(block, False, letters), exact, window, literals, len(block))
    for mine, more in zip(found, _hits(Tokens(block, True, letters), loose, window, literals, len(block)), strict=True):
        for item, seen in more.items():
            mine.setdefault(item, seen)
    return found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, block: int = BLOCK, drop: tuple[str, ...] = ()
) -> DataFrame:
    """docs with contaminated, item_ids (sorted), n_hits (windows) and reparameterised (some slot value differs)."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.length("text")), F.count("*")).first()
    parts = max(1, -(-int(size[0] or 0) // (2 * block)))  # a token takes two characters at least
    fields = [
        field("contaminated", T.BooleanType()),
        field("item_ids", T.ArrayType(T.LongType())),
        field("n_hits", T.LongType()),
        field("reparameterised", T.BooleanType()),
    ]
    out = docs
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        texts = sorted(((r.item_id, r.text) for r in rows), key=str)
        held = spark.sparkContext.broadcast((Index(texts, window), Index(texts, window, True)) if rows else None)
        out = add_columns(out, fields, _probe(held, window, literals, p > 0), drop if p == parts - 1 else ())
    return out


def filter_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with docs' columns."""
    need = ("doc_id", "text")
    return restore(decontaminate(shield(docs, need), benchmark).where("not contaminated"), docs, need)


def _probe(held, window: int, literals: int, more: bool):
    """more: the columns exist from the block before, and its hits stay."""

    def make():
        both = held.value

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            found: list[dict[int, list[int]]] = []
            for block in blocks(batch.column("text")):
                found += _both(block, both, window, literals) if both else [{}] * len(block)
            ids, n, other = ([sorted(x, key=lambda v: (v is None, v or 0)) for x in found], [sum(v[0] for v in x.values()) for x in found], [any(v[1] for v in x.values()) for x in found])
            if more:
                ids = [sorted({*a, *b}, key=lambda v: (v is None, v or 0)) for a, b in zip(ids, batch.column("item_ids").to_pylist(), strict=True)]
                n = [a + b for a, b in zip(n, batch.column("n_hits").to_pylist(), strict=True)]
                other = [a or b for a, b in zip(other, batch.column("reparameterised").to_pylist(), strict=True)]
            return [pa.array([bool(x) for x in ids], pa.bool_()), pa.array(ids, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(other, pa.bool_())]

        return compute

    return make
