"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is K values of b bits: the low bits of the least hash of its shingles under K hash functions. Two
signatures differ in about (1 - similarity) K places; ``distance_bound`` is the distance that a pair at the threshold
passes with a probability of no more than MISSED. Every pair within that distance is found: the signature is split
into so many chunks that, by the pigeonhole principle, at least one chunk differs in at most one place, and every
chunk is looked up once for each place left out.

Equal sets are one class and are represented by their least document. In a group of one key, each document is first held against the document
that comes first in a random order, under a few orders; then against the nearest document of another component; then
against all documents of other components. Two exact bounds come before a pair leaves its task: the sizes, and a
parity sketch, one bit for the tokens of each cell, in which two sets differ in no more bits than their symmetric
difference has tokens. What is left is compared on whole sets. So a large group of near copies costs its size, and a
pair that could connect two components is never left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow_docs import bounded_batches, frugal, frugal_group, slices, utf8
from millrace.llm.columns import unused
from millrace.llm.components import connected_components
from millrace.llm.shingle_join import _compare as compare_sets
from millrace.llm.shingle_join import bounded_broadcast
from millrace.llm.word_hashes import mix, shingle_sets
from millrace.session import settle, unsettle

PLACES = 128
BITS = 8
MISSED = 1e-6
SKETCH_BITS = 1024
#: Tokens that are hashed under all functions at once.
STEP = 1 << 9
#: Members of a block; a larger group is dealt to pairs of blocks.
BLOCK = 4096
#: Rows that a task takes, about.
PART_ROWS = 40_000
ORDERS = 2

#: Odd multipliers, one for each hash function.
_FACTORS = mix(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@lru_cache(16)
def distance_bound(threshold: int, places: int = PLACES, missed: float = MISSED) -> int:
    """The least distance that signatures of two sets with a similarity of ``threshold`` percent exceed with a probability of at most ``missed``."""
    p, total = 1 - threshold / 100, 0.0
    for d in range(places + 1):
        total += math.comb(places, d) * p**d * (1 - p) ** (places - d)
        if 1 - total <= missed:
            return d
    return places


def chunk_starts(bound: int, places: int = PLACES) -> np.ndarray:
    """Where chunks begin: so many that signatures within ``bound`` differ in at most one place of one chunk at least."""
    count = min(places, bound // 2 + 1)
    return np.arange(count) * places // count


def signature(tokens: np.ndarray) -> np.ndarray:
    """PLACES values of BITS bits of a set that is not empty."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(tokens), STEP):
        np.minimum(least, (tokens[None, a : a + STEP] * _FACTORS[:, None]).min(axis=1), out=least)
    return (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens in each of SKETCH_BITS cells, packed."""
    cells = np.bincount((mix(tokens) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits(cells.astype(np.uint8) & 1)


def chunk_keys(signatures: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row of ``signatures`` and each place: the key of its chunk with that place left out."""
    places = np.arange(PLACES, dtype=np.uint64)
    hashed = mix(signatures.astype(np.uint64) + (places << np.uint64(BITS)) + np.uint64(1 << 32))
    sums = np.add.reduceat(hashed, starts, axis=1)
    of = np.searchsorted(starts, np.arange(PLACES), side="right") - 1
    return mix(sums[:, of] - hashed + places * np.uint64(0xD6E8FEB86659FD93))


def first_slot(differs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For rows of differing places: the first place whose key the two signatures share, -1 if there is none."""
    wrong = np.add.reduceat(differs, starts, axis=1, dtype=np.int64)
    chunk = np.argmax(wrong <= 1, axis=1)
    rows = np.arange(len(differs))
    start = starts[chunk]
    stop = np.append(starts[1:], differs.shape[1])[chunk]
    inside = (np.arange(differs.shape[1]) >= start[:, None]) & (np.arange(differs.shape[1]) < stop[:, None]) & differs
    slot = np.where(wrong[rows, chunk] == 0, start, np.argmax(inside, axis=1))
    return np.where(wrong[rows, chunk] <= 1, slot, -1)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc, n, low, high, signature, sketch) of each row with a doc_id; low and high are a set's digest."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for tokens in shingle_sets(utf8(batch.column("text")), size):
                n, place = len(tokens), np.arange(1, len(tokens) + 1, dtype=np.uint64)
                low, high = (int(mix(tokens * np.uint64(f) + place).sum(dtype=np.uint64).astype(np.int64)) for f in (1, 0xA24BAED4963EE407))
                rows.append((n, low, high, signature(tokens).tobytes() if n else None, sketch(tokens).tobytes() if n else None))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc", "n", "low", "high", "signature", "sketch"])

    return settle(docs.filter("doc IS NOT NULL").mapInArrow(run, "doc long, n long, low long, high long, signature binary, sketch binary"), "signatures")


def _keys(classes: DataFrame, starts: np.ndarray) -> DataFrame:
    """(key, slot, doc): PLACES rows for each class."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = chunk_keys(np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, PLACES), starts)
                slots = np.tile(np.arange(PLACES, dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(slots), pa.array(np.repeat(batch.column("doc").to_numpy(), PLACES))], ["key", "slot", "doc"])

    return classes.select("doc", "signature").mapInArrow(run, "key long, slot int, doc long")


def _group_pairs(docs: np.ndarray, roots: np.ndarray, n: np.ndarray, marks: np.ndarray, sketches: np.ndarray, left: np.ndarray, right: np.ndarray, slot: int, starts: np.ndarray, bound: int, threshold: int, nearest: bool) -> list[tuple[int, int, int]]:
    """(x, y, sketch distance) of members ``left`` and ``right`` of one group that have other roots, pass the bounds and
    share no key before this one; with ``nearest``, for each x only that with the least sketch distance."""
    out = []
    for x in left.tolist():
        total = n[right] + n[x]
        may = (roots[right] != roots[x]) & (100 * np.minimum(n[right], n[x]) >= threshold * np.maximum(n[right], n[x]))
        near = right[may]
        far = np.bitwise_count(sketches[near] ^ sketches[x]).sum(axis=1, dtype=np.int64)
        fits = far * (100 + threshold) <= total[may] * (100 - threshold)
        near, far = near[fits], far[fits]
        if not len(near):
            continue
        differs = marks[near] != marks[x]
        fits = (differs.sum(axis=1) <= bound) & (first_slot(differs, starts) == slot)
        near, far = near[fits], far[fits]
        if nearest and len(near):
            best = np.lexsort((docs[near], far))[:1]
            near, far = near[best], far[best]
        out += zip([int(docs[x])] * len(near), docs[near].tolist(), far.tolist(), strict=True)
    return out


def _open_pairs(hits: DataFrame, classes: DataFrame, roots: DataFrame, starts: np.ndarray, bound: int, threshold: int, nearest: bool) -> DataFrame:
    """(x, y, far): pairs of classes that share a key, have other roots and pass the bounds; a pair comes once, with
    ``nearest`` only the nearest of each x and key. Groups over BLOCK members are dealt to pairs of blocks."""
    rooted = hits.join(roots, F.col("doc") == F.col("node"), "left").select("key", "slot", "doc", F.coalesce("root", "doc").alias("root"))
    groups = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("members")).filter("a < b").select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    rows = rooted.join(groups, "key").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = settle(rows.select("key", "slot", "doc", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")), "open")
    parts = max(1, rows.count() // PART_ROWS + 1)
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    full = rows.withColumn("part", F.pmod(cell, F.lit(parts)).cast("int")).join(classes.select("doc", "n", "signature", "sketch"), "doc")

    @frugal_group
    def run(table: pa.Table) -> pa.Table:
        key, slot, doc, root, own, other, n = (table.column(c).to_numpy() for c in ("key", "slot", "doc", "root", "own", "other", "n"))
        marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, PLACES)
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8).view(np.uint64)
        low, high = np.minimum(own, other), np.maximum(own, other)
        order = np.lexsort((doc, high, low, key))
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)]))
        out: list[tuple[int, int, int]] = []
        for at in np.split(order, edges[1:]):
            if root[at].min() == root[at].max():
                continue
            first = int(at[0])
            if low[first] == high[first]:
                names, counts = np.unique(root[at], return_counts=True)
                left, right = at[root[at] != names[np.argmax(counts)]], at
            else:
                left, right = at[own[at] == low[first]], at[own[at] == high[first]]
            out += _group_pairs(doc, root, n, marks, sketches, left, right, int(slot[first]), starts, bound, threshold, nearest)
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["x", "y", "far"])

    found = full.groupBy("part").applyInArrow(run, "x long, y long, far long")
    if nearest:
        found = found.groupBy("x").agg(F.min(F.struct("far", "y")).alias("b")).select("x", F.col("b.y").alias("y"))
    pairs = settle(found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    unsettle(rows)
    return pairs


def minhash_components(docs: DataFrame, size: int = 5, threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of ``docs`` with columns doc_id and text.

    classes: a row for each row of ``docs`` with a doc_id: doc_id, n_shingles, component_id (the least doc_id that
    links reach, itself included), class_id (the least doc_id with the same set). links: (x, y) between class representatives, each confirmed on whole sets, enough to
    connect all that is connected. Words are runs of bytes other than ASCII white space, A-Z as a-z. A text with
    fewer words than ``size`` is one shingle; one without words, null or empty, has no shingle and no link. Rows with a null doc_id are left out. Rows
    that share a doc_id are one node. An empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    bounded_batches(docs.sparkSession)
    bound = distance_bound(threshold)
    starts = chunk_starts(bound)
    signed = _signatures(docs, size)
    digest = ["low", "high", "n"]
    firsts = settle(signed.filter("n > 0").groupBy(*digest).agg(F.min("doc").alias("head"), F.max("doc").alias("last"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")), "classes")
    classes = firsts.select(F.col("head").alias("doc"), "n", "signature", "sketch")
    copied = bounded_broadcast(settle(firsts.filter("head < last").select(*digest, "head"), "heads"))  # a set of a third of all rows must not meet in one task
    headed = signed.select("doc", *digest).join(copied, digest, "left").select("doc", "n", F.coalesce("head", "doc").alias("head"))

    keyed = _keys(classes, starts)
    shared = keyed.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("key")
    hits = settle(keyed.join(shared, "key", "left_semi"), "hits")
    wanted = settle(hits.select("doc").distinct(), "wanted")
    texts = settle(docs.join(bounded_broadcast(wanted), "doc", "left_semi").select(F.col("doc").alias("doc_id"), "text"), "texts")

    tried = []
    for k in range(ORDERS):
        rank = F.struct(F.xxhash64("doc", F.lit(k)).alias("rank"), F.col("doc").alias("first"))
        heads = hits.groupBy("key").agg(F.min(rank).alias("h"))
        best = hits.join(heads, "key").filter(F.col("doc") != F.col("h.first")).groupBy("doc").agg(F.min("h").alias("h"))
        tried.append(best.select(F.least("doc", "h.first").alias("x"), F.greatest("doc", "h.first").alias("y")))
    links = compare_sets(settle(reduce(DataFrame.union, tried).distinct(), "pairs"), texts, size, threshold)

    own = headed.groupBy("doc").agg(F.min("head").alias("a"), F.max("head").alias("b")).filter("a < b").select("doc", "a")
    links = links.union(headed.join(own, "doc").filter("head <> a").select(F.col("a").alias("x"), F.col("head").alias("y")).distinct())
    for nearest in (True, False):
        roots = settle(connected_components(links, "x", "y"), "roots")
        links = links.union(compare_sets(_open_pairs(hits, classes, roots, starts, bound, threshold, nearest), texts, size, threshold))
    roots = connected_components(links, "x", "y")
    unsettle(wanted, texts, hits)
    found = headed.join(roots, F.col("head") == F.col("node"), "left")
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "head").alias("component_id"), F.col("head").alias("class_id")), links


def one_of_each(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a document of a smaller doc_id; rows without doc_id stay."""
    classes, _ = minhash_components(docs, size, threshold)
    name = unused(docs, "gone")
    gone = classes.filter("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
