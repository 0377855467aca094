"""Counts over whole texts, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

from talus.llm.blocks import LEADS, Block, covered, later, later_slices, repeated_windows, sums

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[list(b"!\"'(),-./:;?@[]_`{}~\\^+=")] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def dup_lines(block: Block) -> np.ndarray:
    """Lines (parted by line feeds) with a word that equal an earlier line of their text, by text."""
    n = len(block.data)
    if not n:
        return np.zeros(len(block), np.int64)
    feeds = np.flatnonzero(block.data == 10)
    # a line starts at each text's start and after each feed; it ends at a feed or at the text's end
    starts = np.sort(np.concatenate([block.offsets[:-1], feeds + 1]))
    doc = np.repeat(np.arange(len(block)), 1 + np.diff(np.searchsorted(feeds, block.offsets)))
    ends = np.sort(np.concatenate([block.offsets[1:], feeds]))
    has = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    starts, ends, doc = starts[has], ends[has], doc[has]
    return np.bincount(doc[later_slices(block.data, doc, starts, ends)], minlength=len(block))


def repeat_words(block: Block, window: int) -> np.ndarray:
    """Words in windows of so many words that occur twice or more in their text, the first included, by text."""
    return sums(covered(len(block.starts), repeated_windows(block, window), window), block.bounds)


def base_counts(block: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (windows of 8 words) of each text."""
    block.find_words().hash_words()
    block.number_words()
    return {
        "n_words": block.counts.astype(np.int64),
        "word_chars": sums(LEADS[block.data] & ~block.space, block.offsets),
        "n_symbols": sums(SYMBOLS[block.data], block.offsets),
        "n_dup_lines": dup_lines(block),
        "n_repeat_words": repeat_words(block, 8),
    }


def shape_counts(block: Block) -> dict[str, np.ndarray]:
    """Further counts of each text: classes of characters, lines, short and long words, repeated words."""
    d, o = block.data, block.offsets
    lengths = block.ends - block.starts
    first_upper = _UPPER[d[block.starts]]
    caps = first_upper & _UPPER[d[np.minimum(block.starts + 1, max(0, len(d) - 1))]] & (lengths > 1) if len(d) else first_upper
    again = later(block.doc, block.ids)
    return {
        "n_bytes": np.diff(o),
        "n_upper": sums(_UPPER[d], o),
        "n_lower": sums(_LOWER[d], o),
        "n_digit": sums(_DIGIT[d], o),
        "n_punct": sums(_PUNCT[d], o),
        "n_pipe": sums(d == 124, o),
        "n_bang": sums(d == 33, o),
        "n_wide": sums(d >= 0xC2, o),
        "n_feeds": sums(d == 10, o),
        "n_cap_words": sums(first_upper, block.bounds),
        "n_all_caps": sums(caps, block.bounds),
        "n_short_words": sums(lengths <= 3, block.bounds),
        "n_long_words": sums(lengths >= 12, block.bounds),
        "n_again_words": sums(again, block.bounds),
    }
