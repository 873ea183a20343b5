"""Packing documents into windows by the sum-of-squares rule.

Each partition of the input packs its own rows as they come. A level array counts the partly filled windows
of each fill; a document goes to the fill for which the sum of the squared counts afterwards is least (the
fullest on ties). Documents longer than a window give whole windows first and the rest is placed. Windows that no
rest fills would pile up; when MOST_OPEN are open, they are closed by cutting: pieces of the emptiest fill the
fullest, and the last one that is not full stays open. So it goes at the end of the partition too, where what is
left at last is cut into sequences whose lengths are powers of two. No sequence needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.arrow_docs import bounded_batches, frugal, slices, utf8
from millrace.llm.piece_encoder import PieceEncoder, encoder

Piece = tuple  # (key, start, ids, ids of the whole document)
_NEVER = 1 << 40
#: Windows that a task holds open, of four bytes an id: 32 MB of windows of 4096.
MOST_OPEN = 2048


class SumOfSquares:
    """Windows of ``size`` ids, filled by placing pieces of less than that."""

    def __init__(self, size: int):
        self.size = size
        self._empty()

    def _empty(self) -> None:
        size = self.size
        self.held = 0
        self.leave = np.full(size + 1, _NEVER, np.int64)  # change of the sum if a window leaves this fill
        self.leave[0] = 0
        self.enter = np.ones(size + 1, np.int64)  # and if one comes to it; full windows do not count
        self.enter[size] = 0
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def _changed(self, fill: int) -> None:
        n = len(self.open[fill])
        self.leave[fill] = 1 - 2 * n if n else _NEVER
        self.enter[fill] = 2 * n + 1

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put the piece into a window; the window's pieces if that filled it."""
        size = len(piece[2])
        change = self.leave[: self.size - size + 1] + self.enter[size:]
        fill = len(change) - 1 - int(np.argmin(change[::-1]))
        window = self.open[fill].pop() if fill else []
        window.append(piece)
        if fill:
            self._changed(fill)
        self.held += (not fill) - (fill + size == self.size)
        if fill + size == self.size:
            return window
        self.open[fill + size].append(window)
        self._changed(fill + size)
        return None

    def close(self, last: bool = True) -> Iterator[list[Piece]]:
        """The sequences into which the open windows are cut; what fills none is cut too if these are the last, else it stays as an open window."""
        windows = [w for fill in reversed(self.open) for w in fill]
        pieces = [p for w in windows for p in w]
        left = sum(len(p[2]) for p in pieces)
        pieces.reverse()
        self._empty()
        while left >= self.size or last and left:
            want = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= want
            sequence = []
            while want:
                key, start, ids, whole = pieces.pop()
                if len(ids) > want:
                    pieces.append((key, start + want, ids[want:], whole))
                    ids = ids[:want]
                sequence.append((key, start, ids, whole))
                want -= len(ids)
            yield sequence
        if left:
            self.open[left].append(pieces[::-1])
            self._changed(left)
            self.held = 1


def pack_stream(documents: Iterator[tuple[object, np.ndarray]], size: int) -> Iterator[list[Piece]]:
    """The sequences of one stream of (key, ids)."""
    packer = SumOfSquares(size)
    for key, ids in documents:
        whole = len(ids)
        for start in range(0, whole - whole % size, size):
            yield [(key, start, ids[start : start + size], whole)]
        if whole % size:
            start = whole - whole % size
            if full := packer.place((key, start, ids[start:].copy(), whole)):
                yield full
            if packer.held > MOST_OPEN:
                yield from packer.close(last=False)
    yield from packer.close()


def pack(docs: DataFrame, tokenizer: str, end: int, size: int = 4096, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Every row of ``docs`` is encoded with ``end`` after it (a null text is empty and gives that id alone), and
    each of its ids lies in one piece. Sequences hold ``size`` ids or a power of two. Ties go to the fullest
    window; repeated rows and null keys are packed like others; an empty table gives no rows. Texts of any length are
    encoded whole. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def packed(batches: Iterator[pa.RecordBatch], encode: PieceEncoder) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        key_type = None

        def documents():
            nonlocal key_type
            for batch in slices(batches, text):
                key_type = batch.schema.field(key).type
                yield from zip(batch.column(key).to_pylist(), encode.encode(utf8(batch.column(text)), end), strict=True)

        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], key_type), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for sequence in pack_stream(documents(), size):
            offset = 0
            for k, start, ids, whole in sequence:
                rows.append((k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole, number, offset) + ((ids,) if with_ids else ()))
                offset += len(ids)
            number += 1
            if len(rows) >= 4096 or with_ids and len(rows) >= 256:
                yield made()
        if rows:
            yield made()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer) as encode:
            yield from packed(batches, encode)

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(key, text).mapInArrow(run, schema)
