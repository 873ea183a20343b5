"""Suffix-array dedup: bytes covered by a long enough string that an earlier document also holds.

Equal strings of ``least`` bytes share the least k-gram hash inside them and its place. So a document is cut
into pieces, each the run of consecutive strings that one k-gram leads, and pieces meet where their k-grams
do. Documents are dealt to slices of bounded text. Each slice first sends its k-grams' hashes alone and gets one
bit back for each, whether another document has it; pieces of the other k-grams stay where they are. A few
k-grams share a hash (this costs work, not results), as few on large inputs as on small ones. Pieces that are
equal as a whole settle each other; of the others, one of a kind goes into a text whose Burrows-Wheeler
transform is extended backwards, breadth first: the intervals of all strings that occur twice, by increasing
length, until they have ``least`` bytes. A piece with the same content occurring in one slice is sent once, so
a passage in a third of all documents costs a reducer one row per slice. The texts are shuffled once: the slices
that send hashes, those that send pieces and those that are cut read the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow_docs import bounded_batches, frugal_cogroup, frugal_group, slices, utf8
from millrace.llm.shingle_join import Cells, bounded_broadcast
from millrace.llm.word_hashes import gram_hashes, range_hashes
from millrace.session import settle

#: Bytes of the k-grams that lead strings: long ones meet less by chance, short ones make fewer pieces.
GRAM = 20
#: Bytes of all texts for each part in which pieces meet, for each slice of documents, for each part in which hashes meet.
PART_BYTES = 1 << 20
SLICE_BYTES = 8 << 20
HASH_BYTES = 32 << 20
LEAST_PARTS = 64
#: Bits of a k-gram's hash that are sent, besides its part.
HASH_BITS = 26
#: Bytes of a text that is transformed, which takes some fifty times as much memory.
TEXT_BYTES = 2 << 20
#: Bytes that are copied by their places at once.
AT_ONCE = 1 << 20
_SEPARATOR = 0xFF  # never part of UTF-8


def pieces(data: np.ndarray, stops: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, key) of every piece; texts end in ``data`` at ``stops``, each with one byte that is not its own.

    start and end are places in ``data``; key is the hash of the k-gram that leads the piece's strings.
    """
    n = len(data) - gram + 1
    width = least - gram + 1
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none, np.zeros(0, np.uint64)
    hashes = gram_hashes(data, gram)
    lead = hashes & np.uint64(0xFFFFFFFF00000000)
    lead |= np.arange(n, dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:  # least of ``reach`` grams from each place on
        lead = np.minimum(lead[: len(lead) - reach], lead[reach:])
        reach *= 2
    if reach < width:
        lead = np.minimum(lead[: len(lead) - (width - reach)], lead[width - reach :])
    lead = (lead & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.concatenate([[0], stops[:-1]])
    lengths = np.maximum(0, stops - 1 - begins - least + 1)  # strings that lie inside each text
    text = np.repeat(np.arange(len(stops)), lengths)
    places = np.arange(lengths.sum()) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)
    if not len(places):
        return none, none, none, np.zeros(0, np.uint64)
    lead = lead[places]
    first = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:], len(places)) - 1
    return text[first], places[first], places[last] + least, hashes[lead[first]]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    return data, np.cumsum([len(t) + 1 for t in texts])


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to AT_ONCE or a little more."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + AT_ONCE)) + 1
        yield a, min(b, len(sizes))
        a = b


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, gap: int = 0) -> np.ndarray:
    """The bytes of all ranges, one after the other, with ``gap`` separators after each."""
    out = np.full(int(sizes.sum()) + gap * len(sizes), _SEPARATOR, np.uint8)
    at = 0
    for a, b in _blocks(sizes):  # places take eight bytes each, so only some at once
        size = sizes[a:b]
        before = np.cumsum(size) - size
        steps = np.arange(size.sum())
        to = steps + np.repeat(at + gap * np.arange(b - a), size) if gap else slice(at, at + len(steps))
        out[to] = data[np.repeat(starts[a:b] - before, size) + steps]
        at += len(steps) + gap * (b - a)
    return out


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``data`` by the text that follows, compared for at least ``depth`` bytes."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    rank = np.zeros(n, np.uint64)
    for k in range(7):
        rank <<= np.uint64(8)
        rank |= padded[k : n + k]
    known = 7
    while True:
        order = np.argsort(rank, kind="stable")
        rank = rank[order]
        fresh = np.ones(n, bool)
        np.not_equal(rank[1:], rank[:-1], out=fresh[1:])
        del rank
        if known >= depth:
            return order.astype(np.int32) if n < 1 << 31 else order
        dense = np.empty(n, np.uint32)
        dense[order] = np.cumsum(fresh, dtype=np.uint32)
        del order, fresh
        rank = dense.astype(np.uint64)
        rank <<= np.uint64(32)
        rank[: max(0, n - known)] |= dense[known:]
        known *= 2


def repeated_intervals(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, low, high): the intervals of ``order`` whose suffixes begin with the same ``least`` bytes, none a separator.

    Breadth-first backward extension: level l holds the intervals of all strings of l bytes that occur twice.
    """
    n = len(data)
    order = suffix_order(data, least + 1)
    before = data[order - 1]  # the transform; the first byte's predecessor is the last separator
    forward = np.empty(n, order.dtype)
    forward[np.argsort(before, kind="stable")] = np.arange(n, dtype=order.dtype)
    counts = np.bincount(data, minlength=256)
    high = np.cumsum(counts)
    low = high - counts
    keep = (counts > 1) & (np.arange(256) != _SEPARATOR)
    low, high = low[keep], high[keep]
    label = np.full(n, -1, np.int64)
    for _ in range(least - 1):
        size = high - low
        live = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        byte = before[live]
        own = byte != _SEPARATOR
        to = forward[live[own]]
        label[to] = np.repeat(np.arange(len(low)), size)[own] << 8 | byte[own]
        to = np.sort(to) if len(to) * 8 < n else np.flatnonzero(label >= 0)
        names = label[to]
        label[to] = -1
        edge = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(to) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(to)))
        twice = size > 1
        low = to[edge[twice]] if len(to) else np.zeros(0, np.int64)
        high = low + size[twice]
    return order, low, high


def later_strings(data: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """Places in ``data`` of strings of ``least`` bytes that also start under a smaller ``owner`` (one for each place)."""
    order, low, high = repeated_intervals(data, least)
    if not len(low):
        return np.zeros(0, np.int64)
    size = high - low
    places = order[np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)]
    first = np.minimum.reduceat(owner[places], np.cumsum(size) - size)
    return places[owner[places] > np.repeat(first, size)]


def _marks(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """range_hashes() of the pieces, which take some hundred bytes of memory for each byte, so only some at once."""
    out = [np.zeros(0, np.uint64)]
    for a, b in _blocks(sizes):
        ends = np.cumsum(sizes[a:b])
        out.append(range_hashes(gathered(data, at[a:b], sizes[a:b]), ends - sizes[a:b], ends))
    return np.concatenate(out)


def _cut_again(data: np.ndarray, at: np.ndarray, sizes: np.ndarray, least: int, gram: int) -> np.ndarray:
    """Rows (piece, start in ``data``, size, key) of the pieces that ``gram``-grams cut each piece into."""
    out = []
    for a, b in _blocks(sizes):
        stops = np.cumsum(sizes[a:b] + 1)
        piece, start, end, key = pieces(gathered(data, at[a:b], sizes[a:b], gap=1), stops, least, gram)
        out.append(np.stack([a + piece, start + (at[a:b] - stops + sizes[a:b] + 1)[piece], end - start, key.view(np.int64)]))
    return np.concatenate(out, axis=1)


def later_spans(data: np.ndarray, at: np.ndarray, sizes: np.ndarray, key: np.ndarray, doc: np.ndarray, least: int, gram: int, most: int = TEXT_BYTES) -> np.ndarray:
    """Rows (piece, start, end): what strings of ``least`` bytes that also start under a smaller ``doc`` cover in each piece.

    Pieces of one key are led by one ``gram``-gram. Equal ones settle each other; of the others, one of a kind is transformed,
    ``most`` bytes at once. A key that has more is cut again by longer grams, at last into single strings, which are equal.
    """
    order, head, later = _settle_equal(key, _marks(data, at, sizes), doc, doc)
    gone = order[later]
    spans = [np.stack([gone, np.zeros(len(gone), np.int64), sizes[gone]])]
    heads = order[np.unique(head)]  # one piece of each content, under its least doc; still by key
    group = np.cumsum(np.concatenate([[0], key[heads][1:] != key[heads][:-1]]))
    edge = np.flatnonzero(np.diff(group, prepend=-1))
    differ = np.minimum.reduceat(doc[heads], edge) < np.maximum.reduceat(doc[heads], edge)
    heads = heads[differ[group]]
    if not len(heads):
        return spans[0]
    ends = np.cumsum(sizes[heads] + 1)
    begins = ends - sizes[heads] - 1
    last = np.append(np.flatnonzero(np.diff(key[heads])), len(heads) - 1)  # of each key
    found, a = [], 0
    while a < len(heads):
        full = np.searchsorted(ends[last], begins[a] + most, side="right")  # keys that end within most bytes, or one
        b = int(last[max(full - 1, np.searchsorted(last, a))]) + 1
        some = heads[a:b]
        if ends[b - 1] - begins[a] > most and gram < least:
            longer = gram + (least - gram + 1) // 2
            piece, start, size, lead = _cut_again(data, at[some], sizes[some], least, longer)
            sub, low, high = later_spans(data, start, size, lead.view(np.uint64), doc[some][piece], least, longer, most)
            base = (begins[a:b] - at[some])[piece[sub]] + start[sub]
            by = np.argsort(base + low, kind="stable")
            found.append(np.stack([base + low, base + high])[:, by])
        else:
            places = np.sort(later_strings(gathered(data, at[some], sizes[some], gap=1), np.repeat(doc[some], sizes[some] + 1), least)) + begins[a]
            found.append(np.stack([places, places + least]))
        a = b
    from_, to = np.concatenate(found, axis=1)
    from_, to = merged(np.searchsorted(begins, from_, side="right"), from_, to)
    which = np.searchsorted(begins, from_, side="right") - 1
    # the strings found in a piece count for every row of its content under the same doc
    run_of = np.full(len(order), -1, np.int64)
    run_of[heads] = np.arange(len(heads))
    rows = order[~later]
    run = run_of[order[head[~later]]]
    rows, run = rows[run >= 0], run[run >= 0]
    by = np.argsort(run, kind="stable")
    rows, run = rows[by], run[by]
    a, b = np.searchsorted(run, which), np.searchsorted(run, which, side="right")
    many = b - a
    row = rows[np.arange(many.sum()) + np.repeat(a - (np.cumsum(many) - many), many)]
    spans.append(np.stack([row, np.repeat(from_ - begins[which], many), np.repeat(to - begins[which], many)]))
    return np.concatenate(spans, axis=1)


def _parts(size: int, each: int) -> int:
    return min(1 << 16, max(LEAST_PARTS, 1 << (size // each).bit_length()))


def _cut_slice(table: pa.Table, least: int, gram: int) -> list[tuple]:
    """(doc_ids, digests, data, stops, pieces) of the rows that have a doc_id and are no copies, some at once."""
    out = []
    for batch in slices(table.to_batches(), "text"):
        batch = batch.filter(pc.and_(batch.column("doc_id").is_valid(), pc.invert(batch.column("copied"))))
        if batch.num_rows:
            data, stops = _joined(utf8(batch.column("text")))
            out.append((batch.column("doc_id").to_numpy(), batch.column("digest").to_numpy(), data, stops, pieces(data, stops, least, gram)))
    return out


def _hashes(cut: list[tuple], parts: Cells) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of a slice's k-grams, ascending: part and HASH_BITS more; whether two of its texts have it)."""
    once = [np.zeros(0, np.uint64)]
    for *_, (text, _, _, key) in cut:
        order = np.lexsort((text, key))
        text, key = text[order], key[order]
        once.append(_hash(key[np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])] if len(key) else key, parts))
    found, counts = np.unique(np.concatenate(once), return_counts=True)
    return found, counts > 1


def _hash(key: np.ndarray, parts: Cells) -> np.ndarray:
    return key >> np.uint64(64 - HASH_BITS - parts.bits)


def _dealt(found: np.ndarray, parts: Cells) -> np.ndarray:
    return np.searchsorted(found >> np.uint64(HASH_BITS), np.arange(parts.parts + 1, dtype=np.uint64))


def _planes(numbers: np.ndarray) -> bytes:
    """Steps between ascending numbers as planes of bytes, which shrink when shuffled."""
    return np.ascontiguousarray(np.diff(numbers.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4"), dtype=np.uint32)


def met_elsewhere(source: DataFrame, least: int, gram: int, parts: Cells) -> DataFrame:
    """(slice, part, bits): for each of a slice's hashes in a part, in their order, whether two texts have it; none where no hash is met."""

    @frugal_group
    def send(table: pa.Table) -> pa.Table:
        found, twice = _hashes(_cut_slice(table, least, gram), parts)
        at = _dealt(found, parts)
        low = ((found & np.uint64((1 << HASH_BITS) - 1)) << np.uint64(1)) | twice
        used = [(p, a, b) for p, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)) if b > a]
        of = table.column("slice")[0].as_py()
        return pa.table({"slice": pa.array([of] * len(used), pa.int32()), "part": pa.array([p for p, _, _ in used], pa.int32()), "hashes": pa.array([_planes(low[a:b]) for _, a, b in used], pa.binary())})

    @frugal_group
    def meet(table: pa.Table) -> pa.Table:
        runs = [_numbers(x) for x in table.column("hashes").to_pylist()]
        ends = np.cumsum([len(r) for r in runs])
        every = np.concatenate(runs)
        order = np.argsort(every >> 1, kind="stable")
        low = every[order] >> 1
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        size = np.diff(np.append(first, len(low)))
        met = np.empty(len(low), bool)
        met[order] = np.repeat((size > 1) | (np.maximum.reduceat(every[order] & 1, first) == 1), size)
        bits = [met[b - len(r) : b] for r, b in zip(runs, ends.tolist(), strict=True)]
        some = pa.array([bool(x.any()) for x in bits])
        return pa.table({"slice": table.column("slice"), "part": table.column("part"), "bits": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())}).filter(some)

    sent = source.groupBy("slice").applyInArrow(send, "slice int, part int, hashes binary")
    return sent.groupBy("part").applyInArrow(meet, "slice int, part int, bits binary")


# Blobs: kind 0, pieces: key, doc, digest, start, size, then the bytes; kind 1, spans: doc, digest, start, end; part is then the slice.
ROWS = "kind int, part int, slice int, n int, blob binary, bytes binary"


def _span_rows(doc: np.ndarray, digest: np.ndarray, start: np.ndarray, end: np.ndarray, slice_: np.ndarray) -> pa.Table:
    order = np.argsort(slice_, kind="stable")
    slice_, table = slice_[order], np.stack([doc, digest, start, end])[:, order]
    at = np.flatnonzero(np.diff(slice_, prepend=-1))
    return pa.table({"slice": pa.array(slice_[at], pa.int32()), "blob": pa.array([np.ascontiguousarray(table[:, a:b]).tobytes() for a, b in zip(at, np.append(at, len(slice_))[1:], strict=True)], pa.binary())})


def _settle_equal(key, mark, doc, digest):
    """(order, first of run, earlier): rows by content then doc; whether a smaller doc has the same content."""
    order = np.lexsort((digest, doc, mark, key))
    key, mark, doc = key[order], mark[order], doc[order]
    run = np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])]) if len(key) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(run, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    return order, head, doc > doc[head] if len(key) else np.zeros(0, bool)


def _meet(source: DataFrame, least: int, gram: int, size: int) -> DataFrame:
    """(slice, blob): spans of the slice's documents, in any order; ``size`` is the bytes of all texts."""
    cells, parts = Cells(_parts(size, PART_BYTES)), Cells(_parts(size, HASH_BYTES))  # by the texts, whatever the session's partitions

    @frugal_cogroup
    def gather(table: pa.Table, bits: pa.Table) -> pa.Table:
        kinds = ["kind", "part", "slice", "n"]
        none = pa.table({**{c: pa.array([], pa.int32()) for c in kinds}, **{c: pa.array([], pa.binary()) for c in ("blob", "bytes")}})
        if not bits.num_rows or not table.num_rows:
            return none
        of = table.column("slice")[0].as_py()
        cut = _cut_slice(table, least, gram)
        found, _ = _hashes(cut, parts)
        at, met = _dealt(found, parts), np.zeros(len(found), bool)
        for p, raw in zip(bits.column("part").to_pylist(), bits.column("bits").to_pylist(), strict=True):
            met[at[p] : at[p + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=at[p + 1] - at[p])
        held: list[tuple] = []
        while cut:
            ids, digests, data, stops, (text, start, end, key) = cut.pop()
            some = met[np.searchsorted(found, _hash(key, parts))]
            text, start, end, key = text[some], start[some], end[some], key[some]
            if len(text):
                begins = np.concatenate([[0], stops[:-1]])
                held.append((key, range_hashes(data, start, end), ids[text], digests[text], start - begins[text], end - start, gathered(data, start, end - start)))
        if not held:
            return none
        key, mark, doc, digest, start, sizes, data = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        tool = zstandard.ZstdCompressor(level=3)
        places = np.cumsum(sizes) - sizes
        order, _, later = _settle_equal(key, mark, doc, digest)
        gone = order[later]
        rows = order[~later]  # by key, so by part
        cuts = np.searchsorted(cells.part(key[rows]), np.arange(cells.parts + 1, dtype=np.uint64))
        used = [(p, rows[a:b]) for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if b > a]
        blobs = [np.stack([key[r], *[c[r].astype(np.int64).view(np.uint64) for c in (doc, digest, start, sizes)]]).tobytes() for _, r in used]
        texts = [tool.compress(gathered(data, places[r], sizes[r])) for _, r in used]
        numbers = [[0] * len(used), [p for p, _ in used], [of] * len(used), [len(r) for _, r in used]]
        if len(gone):
            for column, x in zip([*numbers, blobs, texts], [1, of, of, len(gone), np.stack([doc[gone], digest[gone], start[gone], start[gone] + sizes[gone]]).tobytes(), b""], strict=True):
                column.append(x)
        return pa.table({**{c: pa.array(x, pa.int32()) for c, x in zip(kinds, numbers, strict=True)}, "blob": pa.array(blobs, pa.binary()), "bytes": pa.array(texts, pa.binary())})

    @frugal_group
    def reduce(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py():
            return table.select(["slice", "blob"])
        blobs = table.column("blob").to_pylist()
        slice_ = np.repeat(table.column("slice").to_numpy(), table.column("n").to_numpy())
        raw = np.concatenate([np.frombuffer(b, np.uint64).reshape(5, -1) for b in blobs], axis=1)
        key, (doc, digest, start, sizes) = raw[0], raw[1:].astype(np.int64)
        tool = zstandard.ZstdDecompressor()
        data = np.frombuffer(b"".join(map(tool.decompress, table.column("bytes").to_pylist())), np.uint8)
        at = np.cumsum(sizes) - sizes
        row, low, high = later_spans(data, at, sizes, key, doc, least, gram)
        return _span_rows(doc[row], digest[row], start[row] + low, start[row] + high, slice_[row])

    bits = met_elsewhere(source, least, gram, parts)
    made = source.groupBy("slice").cogroup(bits.groupBy("slice")).applyInArrow(gather, ROWS)
    return made.groupBy("kind", "part").applyInArrow(reduce, "slice int, blob binary")


def merged(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that touch or overlap, within groups; spans come by group and start."""
    if not len(group):
        return start, end
    reach = np.maximum.accumulate(end + group * (np.int64(1) << 40)) - group * (np.int64(1) << 40)
    first = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1])])
    at = np.flatnonzero(first)
    return start[at], reach[np.append(at[1:], len(start)) - 1]


def _runs(blobs: list[bytes]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """The maximal removed runs, (starts, ends), of each (doc, digest) that has any."""
    if not blobs:
        return {}
    doc, digest, start, end = np.concatenate([np.frombuffer(b, np.int64).reshape(4, -1) for b in blobs], axis=1)
    order = np.lexsort((start, digest, doc))
    doc, digest, start, end = doc[order], digest[order], start[order], end[order]
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])])
    at = np.flatnonzero(first)
    return {(int(doc[a]), int(digest[a])): merged(np.zeros(b - a, np.int64), start[a:b], end[a:b]) for a, b in zip(at, np.append(at[1:], len(doc)), strict=True)}


def _copies(source: DataFrame) -> DataFrame:
    """(doc_id, digest, copied) of documents whose whole text, by 128 bits of hash, a smaller doc_id has."""
    hashed = source.filter("doc_id IS NOT NULL").select("doc_id", "digest", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(11), F.col("text")).alias("g"))
    firsts = hashed.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last")
    firsts = bounded_broadcast(settle(firsts, "firsts"))  # a text of a third of all rows must not meet in one task
    return hashed.join(firsts, ["h", "g"]).filter("doc_id > first").select("doc_id", "digest").distinct().withColumn("copied", F.lit(True))


def remove_repeats(docs: DataFrame, least: int = 50, with_text: bool = False, gram: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, text]) of every row of ``docs``.

    Each byte goes that is covered by a string of ``least`` bytes that also starts in a document with a smaller
    doc_id; strings are judged on the input. Null texts are empty. A row with a null doc_id keeps all and is
    no source. Rows that share a doc_id do not remove each other's bytes. Kept text may end amid a character;
    ``text`` then has the replacement character. An empty table gives no rows. Other columns are not read. Rows that
    share both doc_id and text are in one slice, whose texts a worker holds.
    """
    text_ = F.coalesce("text", F.lit(""))
    once = docs.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1").limit(1).count() == 0
    digest = F.lit(0).cast("long") if once else F.xxhash64(text_)  # tells apart the texts of rows that share a doc_id
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), text_.alias("text"))
    copies = settle(_copies(source), "copies")  # a copy's strings all start in the document that it copies; leaving it out saves work only
    source = source.join(bounded_broadcast(copies), ["doc_id", "digest"], "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), "digest"), F.lit(max(LEAST_PARTS, size // SLICE_BYTES)))
    source = source.select("doc_id", "digest", "text", "copied", place.cast("int").alias("slice"))
    bounded_batches(docs.sparkSession)
    spans = _meet(source, least, gram or min(GRAM, max(1, least * 3 // 5)), size)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text

    @frugal_cogroup
    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        runs, none, rows = _runs(found.column("blob").to_pylist()), np.zeros((2, 0), np.int64), []
        for batch in slices(table.to_batches(), "text"):
            for doc, digest, raw, copied in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), utf8(batch.column("text")), batch.column("copied").to_pylist(), strict=True):
                low, high = runs.get((doc, digest), none)
                if copied and len(raw) >= least:
                    low, high = np.array([0]), np.array([len(raw)])
                kept = b"".join(raw[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(raw)], strict=True))
                rows.append((doc, len(raw), len(raw) - len(kept), len(low), hashlib.sha256(kept).hexdigest()) + ((kept.decode("utf-8", "replace"),) if with_text else ()))
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    whole = source.groupBy("slice").cogroup(spans.groupBy("slice"))
    return whole.applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text)
