"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit verification.

Texts are sequences of word hashes (runs of ASCII letters, digits and other characters; A-Z as a-z). A random
walk in the manner of Chakraborty, Goldenberg and Koucky reads a sequence: each step writes the word under the
pointer, and a random bit of that word and step says whether the pointer moves on. Sequences at a small edit
distance then agree in most steps: the embedding turns edits into differing steps.

A window is an item's own size: walks start at anchors, the longest words of each item, and run forwards to the
item's end and backwards to its beginning. A signature hashes the words of sampled steps, one from each of SPANS,
as far as the walk stays inside the item; REPEATS independent walks and samples bring the recall. A document walks
from each of its words that is an anchor of some item, as long as its samples so far are those of some item's
walk. Where a signature is an item's, the whole item is held against the document around it by exact edit
distance over words.

Signatures of items are a table; documents' signatures are joined to it. Workers hold bits of fixed number that say
which anchors, unfinished and finished signatures there are; a false hit costs work only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow_docs import bounded_batches, frugal, slices, utf8
from millrace.llm.columns import unused
from millrace.llm.shingle_join import bounded_broadcast
from millrace.llm.word_hashes import ALNUM, mix, words
from millrace.session import settle

REPEATS = 8
#: Anchors of an item, and how many more it has at least than the edits it may have, so that edits cannot hit them all.
ANCHORS = 8
SPARE = 4
#: Steps [a, b) of which one is sampled; a walk of 50 steps passes some 25 words.
SPANS = tuple((2 * 3**i, 6 * 3**i) for i in range(9))
#: Items that a worker walks at once.
ITEMS_A_PASS = 4096
#: Bits that tell which hashes belong to items.
BITS = 24
_ANCHOR, _OPEN, _DONE = (np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))


def _draws(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _cells(hashes: np.ndarray, kind: np.uint64) -> np.ndarray:
    return (mix(hashes ^ kind) >> np.uint64(64 - BITS)).astype(np.int64)


def _known(bits: np.ndarray, hashes: np.ndarray, kind: np.uint64) -> np.ndarray:
    cells = _cells(hashes, kind)
    return bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1 == 1


def walks(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray, step: int, repeat: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lanes, signatures) at the start and after each sampled step, of walks from ``starts`` that are within [low, high).

    Send the lanes' marks (True: walk on) after each pair; None keeps all.
    """
    seed = 2 * repeat + (step > 0)
    coins = _draws(1009 * seed + 7, SPANS[-1][1]) | np.uint64(1)
    picks = _draws(31 * seed + 5, len(SPANS)).tolist()
    sampled = {a + d % (b - a) for (a, b), d in zip(SPANS, picks, strict=True)}
    lanes, at, low, high = np.arange(len(starts)), starts, low, high
    signatures = mix(hashes[starts] + np.uint64(seed + 1))
    for j in range(max(sampled) + 1):
        if j in sampled or not j:
            if j:
                signatures = mix(signatures * np.uint64(3) + hashes[at])
            keep = yield lanes, signatures
            if keep is not None:
                lanes, at, low, high, signatures = (x[keep] for x in (lanes, at, low, high, signatures))
        at = at + step * (mix(hashes[at] * coins[j]) >> np.uint64(63)).astype(np.int64)
        inside = (at >= low) & (at < high)
        if not inside.all():
            lanes, at, low, high, signatures = (x[inside] for x in (lanes, at, low, high, signatures))
        if not len(lanes):
            return


def item_signatures(hashes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, item, place, signature): the bits that items set, and their finished signatures with the anchor's place.

    ``lengths`` are the bytes of each word; items are hashes[offsets[i]:offsets[i + 1]].
    """
    chosen = [a + np.sort(np.argsort(-lengths[a:b], kind="stable")[: max(ANCHORS, int(share * (b - a)) + SPARE)]) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
    starts = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
    item = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
    low, high = offsets[item], offsets[item + 1]
    cells, found = [_cells(hashes[starts], _ANCHOR)], []
    for repeat in range(REPEATS):
        only_start = np.ones(len(starts), bool)
        lasts = []
        for step in (1, -1):
            last, taken = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
            for lanes, signatures in walks(hashes, low, high, starts, step, repeat):
                cells.append(_cells(last[lanes[taken[lanes] > 0]], _OPEN))
                last[lanes] = signatures
                taken[lanes] += 1
            only_start &= taken == 1
            lasts.append((last, taken))
        most = np.maximum(lasts[0][1], lasts[1][1])
        for way, (last, taken) in enumerate(lasts):
            done = taken >= np.minimum(most, 3)  # a walk that leaves the item soon says little; the one the other way says more
            if way:
                done &= ~only_start
            cells.append(_cells(last[done], _DONE))
            found.append((item[done], (starts - low)[done], last[done]))
    item, place, signatures = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.unique(np.concatenate(cells)), item, place, signatures


def document_signatures(hashes: np.ndarray, offsets: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, signature) of the walks whose signature some item may have; text i is hashes[offsets[i]:offsets[i + 1]]."""
    starts = np.flatnonzero(_known(bits, hashes, _ANCHOR))
    text = np.searchsorted(offsets, starts, side="right") - 1
    low, high = offsets[text], offsets[text + 1]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for repeat in range(REPEATS if len(starts) else 0):
        for step in (1, -1):
            walk = walks(hashes, low, high, starts, step, repeat)
            reply = None
            while True:
                try:
                    lanes, signatures = walk.send(reply)
                except StopIteration:
                    break
                done = _known(bits, signatures, _DONE)
                found.append((lanes[done], signatures[done]))
                reply = _known(bits, signatures, _OPEN)
    lanes, signatures = (np.concatenate(x) for x in zip(*found, strict=True))
    return text[lanes], starts[lanes] - low[lanes], signatures


def _plain_words(text: bytes) -> list[bytes]:
    inside = ALNUM[np.frombuffer(text + b"\n", np.uint8)]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    return [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the part of ``region`` at the least edit distance from ``item``; the first such end."""
    n = len(region)
    row = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)
    ramp = np.arange(n + 1)
    for i, word in enumerate(item):
        step = np.empty(n + 1, np.int64)
        step[0] = i + 1
        swap = row[:-1] + (region != word)
        skip = row[1:] + 1
        step[1:] = np.minimum(swap, skip)
        source = np.empty(n + 1, np.int64)
        source[0] = 0
        source[1:] = np.where(swap <= skip, origin[:-1], origin[1:])
        least = np.minimum.accumulate(step - ramp)  # words of the region that the item lacks
        place = np.maximum.accumulate(np.where(step - ramp == least, ramp, 0))
        row, origin = least + ramp, source[place]
    end = int(np.argmin(row))
    return int(row[end]), int(origin[end]), end


def _word_lengths(texts: list[bytes]) -> np.ndarray:
    return np.array([len(w) for t in texts for w in _plain_words(t)], np.int64)


SIGNATURES = "cells binary, no long, place long, n long, signature long"


def _sign_items(items: DataFrame, share: float) -> DataFrame:
    """SIGNATURES rows of items (no, text): rows with cells, and rows with a signature."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for at in range(0, batch.num_rows, ITEMS_A_PASS):
                part = batch.slice(at, ITEMS_A_PASS)
                texts = utf8(part.column("text"))
                hashes, offsets = words(texts, ALNUM)
                if not len(hashes):
                    continue
                cells, item, place, signatures = item_signatures(hashes, offsets, _word_lengths(texts), share)
                none = lambda k, t: pa.nulls(k, t)
                rows = len(item)
                columns = [
                    pa.array([cells.astype("<i8").tobytes(), *[None] * rows], pa.binary()),
                    pa.concat_arrays([none(1, pa.int64()), part.column("no").take(pa.array(item))]),
                    pa.concat_arrays([none(1, pa.int64()), pa.array(place)]),
                    pa.concat_arrays([none(1, pa.int64()), pa.array(np.diff(offsets)[item])]),
                    pa.concat_arrays([none(1, pa.int64()), pa.array(signatures.view(np.int64))]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SIGNATURES.split(", ")])

    return settle(items.select("no", "text").mapInArrow(run, SIGNATURES), "signatures")


def _bits_of(signed: DataFrame) -> np.ndarray:
    """The bits that items set, joined a part at a time: what reaches the driver are at most 2 ** BITS bits."""

    def merge(table: pa.Table) -> pa.Table:
        cells = np.unique(np.concatenate([np.frombuffer(b, "<i8") for b in table.column("cells").to_pylist()]))
        row = np.zeros(1 << BITS, bool)
        row[cells] = True
        return pa.table({"bits": pa.array([np.packbits(row, bitorder="little").tobytes()], pa.binary())})

    tasks = 16
    parts = signed.filter("cells IS NOT NULL").select("cells", F.pmod(F.xxhash64("cells"), F.lit(tasks)).alias("part"))
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for row in parts.groupBy("part").applyInArrow(merge, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    return bits


def _hits(docs: DataFrame, signed: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, mark, no, n, begin): where items would begin in documents, by a common signature; words counted from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, place, signatures = document_signatures(*words(utf8(batch.column("text")), ALNUM), shared.value)
            if len(text):
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("mark").take(at), pa.array(place), pa.array(signatures.view(np.int64))], ["doc_id", "mark", "at", "signature"])

    made = docs.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, at long, signature long")
    known = signed.filter("signature IS NOT NULL").select("no", "place", "n", "signature").distinct()
    met = made.join(bounded_broadcast(known), "signature").select("doc_id", "mark", "no", "n", (F.col("at") - F.col("place")).alias("begin"))
    return settle(met.distinct(), "hits")


def _joined(ranges: Iterator[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Ranges (item, low, high) that are not empty, those of one item that touch as one."""
    out: list[tuple[int, int, int]] = []
    for no, low, high in sorted(r for r in ranges if r[2] > r[1]):
        if out and out[-1][0] == no and low <= out[-1][2]:
            out[-1] = (no, out[-1][1], max(out[-1][2], high))
        else:
            out.append((no, low, high))
    return out


def _regions(docs: DataFrame, hits: DataFrame, share: float) -> DataFrame:
    """(doc_id, no, low, region): the word hashes of documents around hits, those of one item that overlap as one."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, offsets = words(utf8(batch.column("text")), ALNUM)
            rows = []
            for i, (key, found) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("found").to_pylist(), strict=True)):
                own = hashes[offsets[i] : offsets[i + 1]]
                for no, low, high in _joined((f["no"], max(0, f["begin"] - int(share * f["n"])), min(len(own), f["begin"] + f["n"] + int(share * f["n"]))) for f in found):
                    rows.append((key, no, low, own[low:high].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.binary()], strict=True)], ["doc_id", "no", "low", "region"])

    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])
    ids = bounded_broadcast(hits.select("doc_id", "mark").distinct())
    few = docs.join(ids, same(docs, ids), "left_semi").select(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"), "text")
    grouped = hits.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("no", "n", "begin")).alias("found"))
    joined = few.join(grouped, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_mark") == F.col("mark")))
    return joined.select("doc_id", "text", "found").mapInArrow(run, "doc_id long, no long, low long, region binary")


FOUND = "doc_id long, item_id long, distance long, item_words long, start_word long, end_word long"


def find_items(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start_word, end_word): the items that documents hold.

    A document holds an item if some run of its words is within floor(share * words of the item) word edits of
    the whole item; the row has the least distance that was verified (then the first place), one row for each pair.
    Items and texts that are null, empty or without words give no row; rows that repeat an id count as one document
    or item by that id; null ids count as an id. An empty table on either side gives no rows. Texts are read whole,
    whatever their length, and benchmarks of any size in one pass. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    items = settle(items.withColumn("no", F.monotonically_increasing_id()), "items")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").withColumn("mark", F.xxhash64("text"))
    signed = _sign_items(items, share)
    hits = _hits(docs, signed, _bits_of(signed))
    held = _regions(docs, hits, share).join(items, "no").select("doc_id", "item_id", "text", "low", "region")
    names = [c.split()[0] for c in FOUND.split(", ")]

    @frugal
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "region"):
            hashes, offsets = words(utf8(batch.column("text")), ALNUM)
            rows = []
            for i, (doc, item, low, region) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "item_id", "low", "region")], strict=True)):
                own = hashes[offsets[i] : offsets[i + 1]]
                distance, a, b = best_match(own, np.frombuffer(region, np.uint64))
                if distance <= int(share * len(own)):
                    rows.append((doc, item, distance, len(own), low + a, low + b))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    least = held.mapInArrow(verify, FOUND).groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start_word", "end_word", "item_words")).alias("m"))
    return least.select("doc_id", "item_id", *[F.col("m")[c].alias(c) for c in names[2:]])


def without_items(docs: DataFrame, benchmark: DataFrame, share: float = 0.2) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark; rows with a null doc_id stay."""
    name = unused(docs, "gone")
    gone = find_items(docs, benchmark, share).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
