"""Vocabularies of public SentencePiece models. Models are read, never trained."""

from __future__ import annotations

from dataclasses import dataclass

#: The sign that stands for a space inside pieces.
MARK = "▁"


def default_model() -> str:
    """Path of the public model that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """pieces[id] is the text of a piece; ids of single bytes stand in order in byte_ids; usable ids can match text; kind is
    unigram or bpe."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    usable: frozenset[int]
    kind: str = "bpe"

    def ids(self) -> dict[str, int]:
        return {self.pieces[i]: i for i in self.usable}


#: Numbers of fields in a SentencePiece model file, and its kinds of models.
_TRAINER, _NORMALIZER, _MODEL_TYPE, _CHARSMAP, _DUMMY_PREFIX, _REMOVE_EXTRA, _ESCAPE = 2, 3, 3, 2, 3, 4, 5
_KINDS = {1: "unigram", 2: "bpe", 3: "word", 4: "char"}


def _fields(raw: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a protocol buffers message: a number, or the bytes of a text or message."""
    out: dict[int, int | bytes] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            out[tag >> 3] = number()
            continue
        size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
        out[tag >> 3] = raw[at : at + size]
        at += size
    return out


def load(model_file: str) -> Vocabulary:
    """The vocabulary of a unigram or bpe model with byte fallback, without a normaliser, which takes a leading space and keeps
    runs of spaces; other models raise."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    every = range(sp.vocab_size())
    byte_ids = tuple(sorted((i for i in every if sp.is_byte(i)), key=lambda i: int(sp.id_to_piece(i)[3:5], 16)))
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte fallback")
    spec = _fields(sp.serialized_model_proto())
    kind = _KINDS.get(_fields(spec.get(_TRAINER, b"")).get(_MODEL_TYPE, 1), "unknown")
    rules = _fields(spec.get(_NORMALIZER, b""))
    if kind not in ("unigram", "bpe"):
        raise ValueError(f"a {kind} model has no lattice of pieces")
    if rules.get(_CHARSMAP) or not rules.get(_DUMMY_PREFIX, 1) or rules.get(_REMOVE_EXTRA, 1) or not rules.get(_ESCAPE, 1):
        raise ValueError("the model normalises texts in a way that is not done here")
    usable = frozenset(i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)))
    return Vocabulary(tuple(map(sp.id_to_piece, every)), tuple(map(sp.get_score, every)), byte_ids, usable, kind)
