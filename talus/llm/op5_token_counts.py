"""Token counts of a unigram model, by dynamic programming on a trie of pre-tokens.

Pre-tokens are the words of a text with the mark before them. The distinct new pre-tokens of a slice of texts are inserted
into a trie in sorted order, which is its depth-first order: the path to the last pre-token is all that is held of the trie,
and the next one branches off where its prefix ends. A node stands for a prefix and holds the best score of any way to part it
into pieces, how many pieces that way has, and which pieces may go on from here; so a prefix that pre-tokens share is scored
once. The count at the node where a pre-token ends is stored by pre-token, and a text's count is a sum of stored counts.

A piece's score is its log probability under Zipf's law, ``-log(rank + 1)`` with the rank of its id among the pieces (the
public model states merge ranks, not probabilities). A code point that is no piece costs the score of the last rank less 10
and counts as one token for each UTF-8 byte. Of ways with equal scores the one with the longer last piece counts.

Nulls and empty texts have no tokens. The stored counts are emptied when there are ``max_words``, which changes no count;
pre-tokens of over ``long_word`` bytes are scored but not stored. Rows that repeat an id are counted one by one.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talus.llm.batches import add_columns, field
from talus.llm.vocabulary import MARK, Vocabulary, load

MAX_WORDS = 500_000
LONG_WORD = 1000


def zipf_scores(vocabulary: Vocabulary) -> dict[str, float]:
    """Log probabilities (up to a constant) of pieces by the rank of their ids."""
    return {vocabulary.pieces[i]: -math.log(rank + 1) for rank, i in enumerate(sorted(vocabulary.usable), 1)}


class TrieCounts:
    """Counts by pre-token (UTF-8 bytes of a word without its mark)."""

    def __init__(self, scores: dict[str, float], max_words: int = MAX_WORDS, long_word: int = LONG_WORD):
        self.max_words, self.long_word = max_words, long_word
        self.floor = min(scores.values()) - 10
        self.counts: dict[bytes, int] = {}
        self.pieces: dict = {}  # pieces by code point; under None the score of the piece that ends
        for piece, score in scores.items():
            node = self.pieces
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = score

    def insert(self, words: list[bytes]) -> None:
        """Store the counts of words."""
        pieces, floor, counts = self.pieces, self.floor, self.counts
        path: list[tuple[float, int, list]] = [(0.0, 0, [])]  # best score, count, and the open pieces with their starts
        last = ""
        for text, word in sorted((MARK + w.decode("utf-8", "replace"), w) for w in words):
            depth, most = 0, min(len(last), len(text))
            while depth < most and last[depth] == text[depth]:
                depth += 1
            del path[depth + 1 :]
            for end in range(depth, len(text)):
                c = text[end]
                best, count, still = float("-inf"), 0, []
                for start, node in (*path[-1][2], (end, pieces)):  # the longest piece first
                    node = node.get(c)
                    if node is None:
                        continue
                    still.append((start, node))
                    score = node.get(None)
                    if score is not None:
                        before = path[start]
                        if before[0] + score > best:
                            best, count = before[0] + score, before[1] + 1
                if c not in pieces or None not in pieces[c]:
                    before = path[end]
                    if before[0] + floor > best:
                        best, count = before[0] + floor, before[1] + len(c.encode())
                path.append((best, count, still))
            counts[word] = path[-1][1]
            last = text

    def tokens(self, texts: list[list[bytes]]) -> tuple[list[int], list[int]]:
        """Of each list of words: how many are distinct, and the sum of their counts."""
        counts = self.counts
        if len(counts) > self.max_words:
            counts.clear()
        distinct = [set(words) for words in texts]
        fresh = {w for words in distinct for w in words if w not in counts}
        self.insert(list(fresh))
        sums = [sum(map(counts.__getitem__, words)) for words in texts]
        for w in fresh:
            if len(w) > self.long_word:
                del counts[w]
        return [len(d) for d in distinct], sums


def count_tokens(docs: DataFrame, model_file: str, max_words: int = MAX_WORDS, long_word: int = LONG_WORD, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_words, n_distinct (pre-tokens of the text) and n_tokens."""
    held = docs.sparkSession.sparkContext.broadcast(zipf_scores(load(model_file)))

    def make():
        counts = TrieCounts(held.value, max_words, long_word)

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            words, distinct, tokens = [], [], []
            column = batch.column("text")
            for k in range(0, len(column), 1000):
                found = [t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in column.slice(k, 1000)]
                words += map(len, found)
                more = counts.tokens(found)
                distinct += more[0]
                tokens += more[1]
            return [pa.array(x, pa.int64()) for x in (words, distinct, tokens)]

        return compute

    return add_columns(docs, [field(n, T.LongType()) for n in ("n_words", "n_distinct", "n_tokens")], make, drop)
