"""N-gram Jaccard join with prefix filters under several global orders.

Two sets whose Jaccard similarity reaches the threshold share a token among the first n - ceil(t n) + 1
tokens of each, under every total order of tokens. Two orders are used; both put rare tokens first, by the
logarithm of a document count over all documents, and break ties by different hashes. Candidates must share
a prefix token under the first order and under the second; then their whole sets are compared.

A token that one document holds alone matches nothing. So of a set of n tokens with m shared ones, no more than m
meet any other set: sets with m < t n are left out, and pairs whose m and n cannot reach the threshold too. A pair
is taken up at a common token only where enough follows it in both sets, which holds at its first common one.

Sets that are equal are one class and are represented by their least document. Members of a prefix token's
group are first held against two representatives of the group; then all pairs of a group that are not yet
known to be connected are compared. So groups of copies cost their size, and no link that could connect two
components is left out.

Document counts are kept per cell, a cell being some leading bits of a token's hash. What the workers get of
them is of fixed size: a bitmap of cells with two documents or more, and at most MOST_RANKED cells that many
documents hold. Both only choose the order of tokens and which tokens cannot match; any choice gives the
same links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow_docs import bounded_batches, frugal, frugal_group, slices, utf8
from millrace.llm.columns import unused
from millrace.llm.components import connected_components
from millrace.llm.word_hashes import mix, shingle_sets
from millrace.session import settle, unsettle

BITMAP_BITS = 27
MOST_RANKED = 1 << 20
RUN_TOKENS = 1 << 21
SMALL_ROWS = 1 << 20
RANKED_FROM = 16

COUNTS = "part int, cells binary"
HITS = "k int, token long, doc long, n long, shared long, twin long, place long"


def prefix_length(n: np.ndarray | int, threshold: int):
    """Tokens of a set of ``n`` that must meet those of any set with similarity of ``threshold`` percent."""
    return n - -(-n * threshold // 100) + 1


class Cells:
    """Where tokens' counts are: ``parts`` is a power of two; a cell is a part and 32 bits more."""

    def __init__(self, parts: int):
        self.bits = parts.bit_length() - 1
        self.parts = 1 << self.bits

    def part(self, tokens: np.ndarray) -> np.ndarray:
        return tokens >> np.uint64(64 - self.bits)

    def cell(self, tokens: np.ndarray) -> np.ndarray:
        return tokens >> np.uint64(32 - self.bits)

    def slot(self, cells: np.ndarray) -> np.ndarray:
        shift = self.bits + 32 - BITMAP_BITS
        return (cells >> np.uint64(shift)).astype(np.int64)


    def met(self, bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether the bitmap has each token's cell."""
        slot = self.slot(self.cell(tokens))
        return bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 == 1


def parts_for(spark: SparkSession) -> int:
    """A power of two, some times the number of shuffle partitions."""
    return min(1 << 16, 1 << max(6, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def _split(parts: np.ndarray, count: int) -> np.ndarray:
    return np.searchsorted(parts, np.arange(count + 1, dtype=np.uint64))


def counted_cells(cells: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct cells, their counts) of ascending ones, each of which counts once or as often as ``counts`` says."""
    if not len(cells):
        return cells, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[first], np.diff(np.append(first, len(cells))) if counts is None else np.add.reduceat(counts.astype(np.int64), first)


def count_cells(docs: DataFrame, tokens_of: Callable[[list[bytes]], list[np.ndarray]], cells: Cells, ranked_from: int) -> DataFrame:
    """(part, cell, n, bits): cells of ``ranked_from`` tokens or more, and one row a part with its slice of the bitmap of cells of two or more."""

    @frugal
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            found, counts = counted_cells(np.sort(cells.cell(np.concatenate(held))))  # a cell goes out once, whatever its count
            held.clear()
            at = _split(found >> np.uint64(32), cells.parts)
            low, counts = found.astype("<u4"), counts.astype("<u4")
            blobs = []
            for a, b in zip(at, at[1:], strict=False):
                steps = np.diff(low[a:b], prepend=np.uint32(0))
                blobs.append(np.ascontiguousarray(np.stack([steps, counts[a:b]], axis=1).view(np.uint8).reshape(-1, 8).T).tobytes())  # planes of bytes shrink when shuffled
            return pa.RecordBatch.from_arrays([pa.array(range(cells.parts), pa.int32()), pa.array(blobs, pa.binary())], ["part", "cells"])

        total = 0
        for batch in slices(batches, "text"):
            sets = tokens_of(utf8(batch.column("text")))
            held += sets
            total += sum(map(len, sets))
            if total >= RUN_TOKENS:
                yield made()
                total = 0
        if total:
            yield made()

    @frugal_group
    def reduce(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        runs = []
        for blob in table.column("cells").to_pylist():
            pairs = np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).reshape(-1).view("<u4").reshape(-1, 2)
            runs.append((np.cumsum(pairs[:, 0], dtype=np.uint32), pairs[:, 1]))
        low, counts = (np.concatenate(x) for x in zip(*runs, strict=True))
        order = np.argsort(low, kind="stable")
        low, counts = counted_cells(low[order], counts[order])
        found = low.astype(np.uint64) | np.uint64(part) << np.uint64(32)
        width = max(1, (1 << BITMAP_BITS) // cells.parts)
        bits = np.zeros(width, bool)
        bits[cells.slot(found[counts > 1]) % width] = True
        many = counts >= ranked_from
        return pa.table(
            {
                "part": pa.array([part] * (1 + int(many.sum())), pa.int32()),
                "cell": pa.array([None, *found[many].astype(np.int64).tolist()], pa.int64()),
                "n": pa.array([None, *counts[many].tolist()], pa.int64()),
                "bits": pa.array([np.packbits(bits).tobytes()] + [None] * int(many.sum()), pa.binary()),
            }
        )

    bounded_batches(docs.sparkSession)
    made = docs.select("text").mapInArrow(gather, COUNTS)
    return settle(made.groupBy("part").applyInArrow(reduce, "part int, cell long, n long, bits binary"), "cells")


def read_ranks(counted: DataFrame, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bitmap, ranked cells ascending, their ranks), of bounded size whatever the input's."""
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    width = max(8, (1 << BITMAP_BITS) // cells.parts) // 8
    for row in counted.filter("bits IS NOT NULL").select("part", "bits").toLocalIterator():
        bitmap[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    ranked = counted.filter("cell IS NOT NULL").withColumn("rank", F.floor(F.log2("n")).cast("int"))
    least, total = 64, 0
    for row in ranked.groupBy("rank").count().orderBy(F.desc("rank")).collect():
        total += row["count"]
        if total > MOST_RANKED:
            break
        least = row["rank"]
    chosen = ranked.filter(F.col("rank") >= least).select("cell", "rank").toPandas().sort_values("cell")
    return bitmap, chosen["cell"].to_numpy(np.int64).astype(np.uint64), chosen["rank"].to_numpy(np.int64).astype(np.uint64)


def _one_of_each_class(table: np.ndarray) -> np.ndarray:
    """The first row of each token and twin, of rows (token, doc, n, twin, place) in that order."""
    token, twin = table[0], table[3]
    return table[:, np.concatenate([[True], (token[1:] != token[:-1]) | (twin[1:] != twin[:-1])])]


def _prefix_groups(docs: DataFrame, size: int, threshold: int, cells: Cells, ranks) -> DataFrame:
    """HITS rows. k 1 and 2: classes in the prefix group of ``token`` under each order, of groups with two
    classes or more; the class is named by its least document there, ``twin`` is its digest. k 0: one row for
    each document, token and twin being the two halves of its set's digest."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    @frugal
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, ranked, rank = shared.value
        held: dict[int, list[np.ndarray]] = {0: [], 1: [], 2: []}

        def made() -> Iterator[pa.RecordBatch]:
            for k, rows in held.items():
                if not rows:
                    continue
                table = np.concatenate(rows, axis=1)
                rows.clear()
                if k:  # of equal sets, the least document goes out
                    table = _one_of_each_class(table[:, np.lexsort((table[1].astype(np.int64), table[3], table[0]))])
                    dealt = cells.part(table[0])
                else:  # a row for each document: not by its set, which may be that of a third of all
                    dealt = cells.part(mix(table[1]))
                    table, dealt = table[:, order := np.argsort(dealt, kind="stable")], dealt[order]
                at = _split(dealt, cells.parts)
                used = [(p, a, b) for p, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(used), pa.int32()), pa.array([p for p, _, _ in used], pa.int32()), pa.array([np.ascontiguousarray(table[:, a:b]).tobytes() for _, a, b in used], pa.binary())],
                    ["k", "part", "rows"],
                )

        total = 0
        for batch in slices(batches, "text"):
            keys = batch.column("doc_id").to_pylist()
            for key, tokens in zip(keys, shingle_sets(utf8(batch.column("text")), size), strict=True):
                if key is None:
                    continue
                n = len(tokens)
                place = np.arange(1, n + 1, dtype=np.uint64)
                twin = int(mix(tokens + place).sum(dtype=np.uint64)) if n else 0
                other = int(mix(tokens * np.uint64(0xA24BAED4963EE407) + place).sum(dtype=np.uint64)) if n else 0
                own = np.array([[other], [key & (1 << 64) - 1], [n], [twin], [0]], np.uint64)
                held[0].append(own)
                total += 1
                if not n:
                    continue
                of = cells.cell(tokens)
                met = cells.met(bitmap, tokens)
                m = int(met.sum())
                if 100 * m < threshold * n:
                    continue  # no other set can reach the threshold
                p = int(prefix_length(n, threshold))
                level = np.zeros(n, np.uint64)
                if len(ranked):
                    near = np.minimum(np.searchsorted(ranked, of), len(ranked) - 1)
                    level = np.where(ranked[near] == of, rank[near], np.uint64(0))
                for k, hashed in ((1, tokens), (2, mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))):
                    order = level << np.uint64(58) | hashed >> np.uint64(6)
                    first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
                    first = first[np.argsort(order[first], kind="stable")]
                    places = np.flatnonzero(met[first])
                    picked = tokens[first[places]]
                    if len(picked):
                        held[k].append(np.stack([picked, *[np.full(len(picked), v, np.uint64) for v in (key & (1 << 64) - 1, m << 32 | n, twin)], places.astype(np.uint64)]))
                        total += len(picked)
            if total >= RUN_TOKENS // 4:
                yield from made()
                total = 0
        yield from made()

    @frugal_group
    def reduce(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        token, doc, n, twin, place = np.concatenate([np.frombuffer(x, np.uint64).reshape(5, -1) for x in table.column("rows").to_pylist()], axis=1)
        doc = doc.astype(np.int64)
        if k:
            order = np.lexsort((doc, twin, token))
            token, doc, n, twin, place = (c[order] for c in (token, doc, n, twin, place))
            token, doc, n, twin, place = _one_of_each_class(np.stack([token, doc.view(np.uint64), n, twin, place]))
            doc = doc.view(np.int64)
            same = token[1:] == token[:-1]
            grouped = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            token, doc, n, twin, place = (c[grouped] for c in (token, doc, n, twin, place))
        shared_ = (n >> np.uint64(32)).astype(np.int64)
        size_ = (n & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return pa.table({"k": pa.array(np.full(len(doc), k, np.int32)), "token": token.astype(np.int64), "doc": doc, "n": size_, "shared": shared_, "twin": twin.astype(np.int64), "place": place.astype(np.int64)})

    made = docs.select("doc_id", "text").mapInArrow(gather, "k int, part int, rows binary")
    return settle(made.groupBy("k", "part").applyInArrow(reduce, HITS), "prefixes")


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most SMALL_ROWS rows (of a few numbers each)."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def _compare(pairs: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """Those (x, y) of ``pairs``, which are settled and go, whose whole sets reach the threshold."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tx", 1 << 20):
            left, right = (shingle_sets(utf8(batch.column(c)), size) for c in ("tx", "ty"))
            keep = []
            for a, b in zip(left, right, strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(len(a) > 0 and len(b) > 0 and 100 * both >= threshold * (len(a) + len(b) - both))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    wanted = settle(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), "wanted")
    texts = docs.select("doc_id", "text").join(bounded_broadcast(wanted), "doc_id", "left_semi")
    x = texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx"))
    y = texts.select(F.col("doc_id").alias("y"), F.col("text").alias("ty"))
    links = settle(pairs.join(x, "x").join(y, "y").select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long").distinct(), "links")
    unsettle(wanted, pairs)
    return links


def jaccard_components(docs: DataFrame, size: int = 5, threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of ``docs`` with columns doc_id and text.

    classes: a row for each row of ``docs`` with a doc_id: doc_id, n_shingles, component_id (the least doc_id
    that links reach, itself included). links: verified (x, y) between class representatives, enough to
    connect all that is connected. Words are runs of bytes other than ASCII white space, A-Z as a-z. A text
    with fewer words than ``size`` is one shingle; one without words, null or empty, has no shingle and no
    link. Rows with a null doc_id are left out. Rows that share a doc_id share its links. An empty table gives
    no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cells = Cells(parts_for(spark))
    counted = count_cells(docs, partial(shingle_sets, size=size), cells, RANKED_FROM)
    ranks = read_ranks(counted, cells)
    unsettle(counted)
    hits = _prefix_groups(docs, size, threshold, cells, ranks)

    near = f"100 * least(n, other) >= {threshold} * greatest(n, other) AND 100 * least(shared, other_shared) >= {threshold} * (n + other - least(shared, other_shared))"
    # at their first common token, two sets can share no more than what follows it in both
    near += f" AND {100 + threshold} * least(n - place, other - other_place) >= {threshold} * (n + other)"
    first = hits.filter("k = 1")
    heads = first.groupBy("token").agg(F.max_by(F.struct("doc", "n", "shared", "place"), F.struct(F.col("shared") - F.col("n"), -F.col("doc"))).alias("a"), F.min_by(F.struct("doc", "n", "shared", "place"), "doc").alias("b"))
    heads = heads.select("token", F.explode(F.array("a", "b")).alias("h")).select("token", F.col("h.doc").alias("head"), F.col("h.n").alias("other"), F.col("h.shared").alias("other_shared"), F.col("h.place").alias("other_place")).distinct()
    tried = first.join(heads, "token").filter("doc <> head").filter(near).select(F.least("doc", "head").alias("x"), F.greatest("doc", "head").alias("y")).distinct()
    second = hits.filter("k = 2").groupBy("doc").agg(F.collect_set("token").alias("tokens"))

    def both_orders(pairs: DataFrame) -> DataFrame:
        x = second.select(F.col("doc").alias("x"), F.col("tokens").alias("tx"))
        y = second.select(F.col("doc").alias("y"), F.col("tokens").alias("ty"))
        return settle(pairs.join(x, "x").join(y, "y").filter(F.arrays_overlap("tx", "ty")).select("x", "y"), "pairs")

    links = _compare(both_orders(tried), docs, size, threshold)
    roots = connected_components(links, "x", "y")

    rooted = first.join(roots, F.col("doc") == F.col("node"), "left").select("token", "doc", "n", "shared", "place", F.coalesce("root", "doc").alias("root"))
    open_groups = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    rest = settle(rooted.join(open_groups, "token"), "open")
    other = rest.select("token", F.col("doc").alias("y"), F.col("n").alias("other"), F.col("shared").alias("other_shared"), F.col("place").alias("other_place"), F.col("root").alias("other_root"))
    pairs = rest.withColumnRenamed("doc", "x").join(other, "token").filter("x < y AND root <> other_root").filter(near).select("x", "y").distinct()
    pairs = pairs.join(tried, ["x", "y"], "left_anti")
    links = links.union(_compare(both_orders(pairs), docs, size, threshold))
    unsettle(rest)
    roots = connected_components(links, "x", "y")

    own = hits.filter("k = 0").select(F.col("doc").alias("doc_id"), "n", "token", "twin")
    full = own.filter("n > 0")
    heads = full.groupBy("token", "twin", "n").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).filter("head < last").drop("last")
    heads = bounded_broadcast(settle(heads, "heads"))  # a set of a third of all rows must not meet in one task
    headed = full.join(heads, ["token", "twin", "n"], "left").select("doc_id", "n", F.coalesce("head", "doc_id").alias("head")).union(own.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("head")))
    classes = headed.join(roots, F.col("head") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "head").alias("component_id"), F.col("head").alias("class_id"))
    # rows that share a doc_id are one node
    return classes, links


def one_of_each(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` without the rows whose component has a document of a smaller doc_id; rows without doc_id stay."""
    classes, _ = jaccard_components(docs, size, threshold)
    name = unused(docs, "gone")
    gone = classes.filter("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
