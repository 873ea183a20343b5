"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

The tokenizer files meant here drop white space and never join tokens across it, so a text's ids are those
of its pieces between ASCII white space, one after the other. A task keeps the ids of pieces it has met.

Most pieces are a run of letters of the first 256 code points, often with ASCII marks after it. To such a file these
are one or two words that its normaliser only puts into lower case, so they go to the library's model at once, written
in the vocabulary's letters for bytes; all others take the whole way.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np

from millrace.llm.bpe_automaton import byte_letters

#: Pieces of a generation; a task holds two.
GENERATION = 250_000
#: Longer pieces are not remembered, so that a generation is some 60 MB at most.
LONGEST = 64
_STOP = b"\xff"  # never part of UTF-8
_STOP_ID = 0xFFFFFFFF
#: Letters, then marks: two words of the tokenizer's splitter, whatever the marks are.
_WORD = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
_LETTERS = {b: c for c, b in byte_letters().items()}


class _Known(dict):
    """Piece -> ids as bytes; a piece that is not here is taken from ``before`` or encoded."""

    def __init__(self, encode_piece, before: dict):
        super().__init__()
        self.encode_piece, self.before = encode_piece, before

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encode_piece(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.known = self._next({})

    def _next(self, before: dict) -> _Known:
        known = _Known(self._ids, before)
        known[_STOP] = _STOP_ID.to_bytes(4, "little")
        return known

    def forget(self) -> None:
        """Drop the pieces met so far."""
        self.known = self._next({})

    def _ids(self, piece: bytes) -> bytes:
        word = _WORD.fullmatch(piece)
        if word is None:
            return array("I", self.library.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        letters, marks = word.groups()
        word = letters.decode().lower()
        found = self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS))
        if marks:
            found += self.model.tokenize(marks.decode())
        return array("I", [t.id for t in found]).tobytes()

    def encode(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        """uint32 ids of each text with ``end`` after them."""
        if not texts:
            return []
        joined = b"".join([t + b" \xff " for t in texts])
        # Lower case first makes fewer pieces. It changes nothing but special strings and letters that a mark follows.
        if b"<|" not in joined and b"\xcc" not in joined and b"\xcd" not in joined:
            joined = joined.lower()
        if len(self.known) > GENERATION:
            self.known = self._next(dict(self.known))
        ids = np.frombuffer(bytearray(b"".join(map(self.known.__getitem__, joined.split()))), np.uint32)
        stops = np.flatnonzero(ids == _STOP_ID)
        ids[stops] = end
        return np.split(ids, stops[:-1] + 1)


@lru_cache(2)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@contextmanager
def encoder(path: str) -> Iterator[PieceEncoder]:
    """The worker's encoder for one task; its pieces go with the task, as idle workers live on while later stages need the machine."""
    own = _encoder(path)
    try:
        yield own
    finally:
        own.forget()
