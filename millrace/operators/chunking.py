"""Paragraph-aware chunks of texts, question lists and inline reasoning."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.order import running_sum
from millrace.operators.rows import RowError

#: Fixed value: characters that the estimate takes for a token, on the safe side.
CHARACTERS_PER_TOKEN = 3.5


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARACTERS_PER_TOKEN))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    parts = F.transform(F.split(text, r"\n(?U:\s)*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def _estimate(characters: int) -> int:
    return math.ceil(characters / CHARACTERS_PER_TOKEN)


def packed(pieces: Iterator[str], most: int, gap: str) -> Iterator[str]:
    """Pieces in order, joined by ``gap`` while the estimate of the whole stays within ``most``."""
    held: list[str] = []
    size = 0
    for piece in pieces:
        grown = size + len(gap) + len(piece) if held else len(piece)
        if held and _estimate(grown) > most:
            yield gap.join(held)
            held, grown = [], len(piece)
        held.append(piece)
        size = grown
    if held:
        yield gap.join(held)


def chunks(text: str, most: int) -> Iterator[str]:
    """Chunks of at most ``most`` estimated tokens: whole paragraphs where they fit, else sentences, else cuts."""
    widest = int(most * CHARACTERS_PER_TOKEN)

    def sentences(paragraph: str) -> Iterator[str]:
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            if _estimate(len(sentence)) <= most:
                yield sentence
            else:
                yield from (sentence[at : at + widest] for at in range(0, len(sentence), widest))

    def pieces() -> Iterator[str]:
        for part in re.split(r"\n\s*\n", text):
            paragraph = part.strip()
            if paragraph and _estimate(len(paragraph)) <= most:
                yield paragraph
            elif paragraph:
                yield from packed(sentences(paragraph), most, " ")

    return packed(pieces(), most, "\n\n")


def chunk_texts(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, chunk_no, chunk), chunks in order; null and blank texts give none."""
    if most < 1:
        raise RowError(f"chunks hold at least 1 token, got {most}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, c) for i, t in enumerate(batch.column(text).to_pylist()) for n, c in enumerate(chunks(t or "", most))]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], [key, "chunk_no", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk_no long, chunk string")


def questions(reply: Column, n: int) -> Column:
    """At most ``n`` questions, one for each nonempty line, without list markers."""
    lines = F.transform(F.split(reply, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), lambda x: F.trim(F.regexp_replace(x, r"^(?U:\s)*(\d+[.)]|[-*])(?U:\s)*", "")))
    return F.slice(F.filter(lines, lambda x: F.length(x) > 0), 1, n)


def without_reasoning(reply: Column) -> Column:
    """struct(text, error): the reply after a leading <tag>...</tag> block; a block that never closes is an error."""
    tag = F.regexp_extract(reply, r"^\s*<([A-Za-z][\w-]*)>", 1)
    close = F.concat(F.lit("</"), tag, F.lit(">"))
    at = F.call_function("locate", close, reply)
    rest = F.ltrim(F.substring(reply, at + F.length(close), F.length(reply)))
    return F.struct(F.when(tag == "", reply).when(at > 0, rest).alias("text"), F.when((tag != "") & (at == 0), F.lit("the reasoning block never closes")).alias("error"))


def tidy_newlines(text: Column) -> Column:
    """No more than one blank line at a time, no blanks at line ends, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\f\r]+(?=\n|$)", ""), r"\n{3,}", "\n\n"))


def fitted(pieces: DataFrame, by: str, priority: str, order: str, tokens: str, budget: int) -> DataFrame:
    """Pieces by priority and order while their tokens fit in ``budget``; each group on its own."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(priority, order)
    return pieces.withColumn("__sum", F.sum(tokens).over(w)).filter(F.col("__sum") <= budget).drop("__sum")


def wrapped(df: DataFrame, order: str, tokens: str, size: int) -> DataFrame:
    """(order, piece, packed, start, length): documents end to end in sequences of ``size``, cut where one is full.

    Offsets are running sums over ranges, so that no task sees all rows.
    """
    placed = running_sum(df.select(order, tokens), tokens, order, into="__at")
    first, last = F.floor(F.col("__at") / size), F.floor((F.col("__at") + F.col(tokens) - 1) / size)
    cut = placed.filter(F.col(tokens) > 0).select(order, "__at", tokens, F.posexplode(F.sequence(first, last)).alias("piece", "packed"))
    low = F.greatest(F.col("__at"), F.col("packed") * size)
    high = F.least(F.col("__at") + F.col(tokens), (F.col("packed") + 1) * size)
    return cut.select(order, "piece", "packed", (low - F.col("packed") * size).alias("start"), (high - low).alias("length"))


class Bins:
    """Bins of ``size`` by the room left in them. A whole number has a bit for each room that some bin has, so the
    least room that holds a row is the lowest bit from its length on."""

    def __init__(self, size: int):
        self.rooms: dict[int, list[int]] = {}
        self.size, self.bits, self.used = size, 0, 0

    def place(self, n: int) -> int:
        """The fullest bin with room for ``n``, the earliest of equals, or a new one; rows over the size fill one alone."""
        left = self.bits >> n
        room = n + (left & -left).bit_length() - 1 if left else None
        if room is None:
            chosen, room = self.used, max(self.size, n)
            self.used += 1
        else:
            chosen = heapq.heappop(self.rooms[room])
            if not self.rooms[room]:
                self.bits ^= 1 << room
        heapq.heappush(self.rooms.setdefault(room - n, []), chosen)
        self.bits |= 1 << (room - n)
        return chosen


def best_fit_decreasing(df: DataFrame, batch: str, key: str, tokens: str, size: int) -> DataFrame:
    """(batch, key, bin): within each batch, rows by falling length go to the fullest bin that holds them; long rows alone."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([tokens, key], ascending=[False, True])
        bins = Bins(size)
        return pd.DataFrame({batch: rows[batch], key: rows[key], "bin": [bins.place(int(n)) for n in rows[tokens]]})

    kinds = dict(df.dtypes)
    return df.select(batch, key, tokens).groupBy(batch).applyInPandas(pack, f"`{batch}` {kinds[batch]}, `{key}` {kinds[key]}, bin long")


def best_fit_split(df: DataFrame, batch: str, key: str, tokens: str, size: int) -> DataFrame:
    """(batch, key, start, length, bin): as best_fit_decreasing(), with rows over ``size`` cut into pieces of it and a rest."""
    pieces = df.filter(F.col(tokens) > 0).select(batch, key, F.col(tokens).alias("__n"), F.explode(F.sequence(F.lit(0), F.col(tokens) - 1, F.lit(size))).alias("start"))
    pieces = pieces.select(batch, F.struct(key, F.col("start").cast("long").alias("start")).alias("__piece"), F.least(F.lit(size), F.col("__n") - F.col("start")).cast("long").alias("length"))
    named = pieces.select(batch, F.to_json("__piece").alias("__name"), "__piece", "length")
    bins = best_fit_decreasing(named, batch, "__name", "length", size)
    return named.join(bins, [batch, "__name"]).select(batch, f"__piece.{key}", "__piece.start", "length", "bin")
