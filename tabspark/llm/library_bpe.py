"""Ids as the ``tokenizers`` and ``sentencepiece`` libraries give them, from their vocabulary files.

The byte-level vocabulary of a ``tokenizers`` file is run by ``tiktoken``, which merges by the same ranks: a quarter of the time,
without an object for each token. Tests hold its ids against the ``tokenizers`` library. Long texts are cut between two
words, where neither vocabulary ever merges (checked for the piece model when it is opened), so ids don't depend on cuts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np

from .bpe import SPLIT, Codec
from .shared import LONG_TEXT

#: The letter that stands for a space in piece models (fixed value).
SPACE = "▁"
#: Letters of a part of a long text, at least.
PART = 1 << 18
BORDER = re.compile(r"[A-Za-z](?= [A-Za-z])")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """A text as it is, or if it is long in parts that end between two words; the later parts begin with the space."""
    at = 0
    while len(text) > LONG_TEXT and (m := BORDER.search(text, at + size)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


class ByteCodec:
    """Encoder of a byte-level vocabulary; ``plain``: strings of special tokens inside texts are ordinary text."""

    def __init__(self, raw: bytes, plain: bool = False):
        import tiktoken

        codec = Codec(raw)
        special = {} if plain else {text: len(codec.outer) + k for k, text in enumerate(codec.special)}
        self.library = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=codec.rank, special_tokens=special)
        self.ids = np.append(codec.outer, [codec.special[text] for text in special]).astype(np.uint32)
        self.bytes = codec.bytes

    def encode(self, text: str) -> np.ndarray:
        made = [self.ids[self.library.encode_to_numpy(p, allowed_special="all", disallowed_special=())] for p in parts(text)]
        return made[0] if len(made) == 1 else np.concatenate(made)


class PieceCodec:
    """Encoder of a ``sentencepiece`` model that adds a space in front of a text."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces that go on after a space are not supported")
        byte = re.compile(r"<0x([0-9A-F]{2})>\Z")
        self.bytes = [bytes([int(byte.match(p)[1], 16)]) if byte.match(p) else p.replace(SPACE, " ").encode() for p in pieces]

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text with a space in front, which the library also adds to later parts instead of their own."""
        made = self.library.encode([p[1:] if k else p for k, p in enumerate(parts(text))], num_threads=1)
        return np.array(made[0] if len(made) == 1 else [i for ids in made for i in ids], dtype=np.uint32)


_OPENED: dict[tuple[str, str], object] = {}


def opened(kind: str, make: Callable[[bytes], object], raw: bytes):
    """One codec of each kind in a worker, made again only for another file."""
    name = (kind, hashlib.sha256(raw).hexdigest())
    if name not in _OPENED:
        for other in [k for k in _OPENED if k[0] == kind]:
            del _OPENED[other]
        _OPENED[name] = make(raw)
    return _OPENED[name]


def byte_codec(raw: bytes, plain: bool = False) -> ByteCodec:
    return opened("plain" if plain else "special", lambda r: ByteCodec(r, plain), raw)


def piece_codec(raw: bytes) -> PieceCodec:
    return opened("piece", PieceCodec, raw)

