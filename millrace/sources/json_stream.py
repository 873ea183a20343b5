"""JSON object streams read in parallel: objects may span lines or share one, and files are split anywhere.

Spark's text source cuts the files into splits and each split into pieces that end with a closing brace. Where a split
begins, it is not known whether the place lies in a string or how deep it lies in an object. So a first scan gives a
map for each split: from either string state to the state and the change of depth at its end. The maps of a file
compose to the state at each split's beginning, along with its byte and line. The second scan then knows which bytes
begin an object, and every split reads its own. An object that crosses splits is put together from its fragments,
which a scan of their own brings where there are any.

What leaves the tasks for the driver is one row of a few numbers for each split.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.rows import RowError

MAPS = "file string, block long, size long, bytes long, lines long, last_line long, ends0 long, depth0 long, least0 long, ends1 long, depth1 long, least1 long"
FOUND = "file string, offset long, line long, column long, origin long, raw binary, error string"
_WHITE = b" \t\r\n"
_CHANGED = "the file, or how the session splits files, has changed since it was scanned; read it again"
_KINDS = {"[": "list", '"': "str", "t": "bool", "f": "bool", "n": "NoneType"}


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    source = spark.read.option("lineSep", "}").text(path)
    return source.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes, bool]]:
    """(file, block, file size, bytes with their braces, whether the split ends here) of the splits that a task reads."""
    held = None
    for batch in batches:
        file, block = batch.column("file"), batch.column("block").to_numpy()
        if not len(block):
            continue
        other = (np.diff(block) != 0) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(other) + 1).tolist(), len(block)]
        for a, b in zip(edges, edges[1:]):
            data = b"}".join(batch.column("value").slice(a, b - a).cast(pa.binary()).to_pylist()) + b"}"
            now = (file[a].as_py(), int(block[a]), batch.column("size")[a].as_py(), data)
            if held:
                yield *held, held[:2] != now[:2]
            held = now
    if held:
        yield *held, True


def braces(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places of braces, +1 or -1 for each, parity of the quotes before each, parity of all quotes); quotes behind a backslash do not count."""
    text = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(text == 0x22)
    slashes = np.flatnonzero(text == 0x5C)
    if len(slashes):
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        length = np.diff(np.append(first, len(slashes)))
        quotes = np.setdiff1d(quotes, (slashes[first] + length)[length % 2 == 1], assume_unique=True)
    at = np.flatnonzero((text == 0x7B) | (text == 0x7D))
    return at, np.where(text[at] == 0x7B, 1, -1), np.searchsorted(quotes, at) % 2, len(quotes) % 2


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, state, depth, least, size, lines, last = [], [0, 1], [0, 0], [0, 0], 0, 0, -1
    for file, block, whole, data, ends in _runs(batches):
        at, signs, parity, all_quotes = braces(data)
        for start in (0, 1):
            steps = np.cumsum(signs[parity == state[start]])
            if len(steps):
                least[start] = min(least[start], depth[start] + int(steps.min()))
                depth[start] += int(steps[-1])
            state[start] ^= all_quotes
        if (newline := data.rfind(b"\n")) >= 0:
            last = size + newline
        size, lines = size + len(data), lines + data.count(b"\n")
        if ends:
            rows.append((file, block, whole, size, lines, last, state[0], depth[0], least[0], state[1], depth[1], least[1]))
            state, depth, least, size, lines, last = [0, 1], [0, 0], [0, 0], 0, 0, -1
    names = [c.split()[0] for c in MAPS.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(len(names))], names)


@dataclass
class Entry:
    """What is known where a split begins: in a string or not, depth, byte, line, byte at which that line begins, the
    block of the split that began the open object; whether the file's last brace is not in the file; and the byte at which the split ends."""

    quoted: int
    depth: int
    offset: int
    line: int
    line_start: int
    origin: int
    unclosed: bool = False
    end: int = 0


@dataclass
class Layout:
    entries: dict[tuple[str, int], Entry] = field(default_factory=dict)
    crossing: bool = False  # some object crosses splits or has no end


def compose(maps: list[tuple]) -> Layout:
    """The state at the beginning of each split, from the maps of all splits."""
    out = Layout()
    by_file: dict[str, list[tuple]] = {}
    for row in maps:
        by_file.setdefault(row[0], []).append(row)
    for file, rows in by_file.items():
        now, total, size = Entry(0, 0, 0, 1, 0, 0), 0, rows[0][2]
        for _, block, _, count, lines, last, *both in sorted(rows, key=lambda r: r[1]):
            out.entries[file, block] = now
            out.crossing |= now.depth > 0 or now.quoted > 0
            ends, depth, least = both[3 * now.quoted : 3 * now.quoted + 3]
            origin = block if now.depth + least <= 0 else now.origin
            before = now
            before.end = now.offset + count
            now = Entry(ends, now.depth + depth, now.offset + count, now.line + lines, now.offset + last + 1 if last >= 0 else now.line_start, origin)
            total += count
        # the file ends with a brace, or the one behind its last piece was added; a byte order mark is not among the pieces
        before.unclosed = total not in (size, size - 3)
        out.crossing |= now.quoted > 0 or now.depth + before.unclosed != 0
    return out


class _Split:
    """Objects and fragments of one split."""

    def __init__(self, file: str, block: int, entry: Entry):
        self.file, self.block = file, block
        self.quoted, self.depth, self.offset = entry.quoted, entry.depth, entry.offset
        self.line, self.line_start, self.origin = entry.line, entry.line_start, entry.origin
        self.held: list[bytes] = []  # of an object that a chunk before this one began
        self.place = (entry.offset, 0, 0)
        self.broken = entry.depth < 0

    def _where(self, at: int, newlines: np.ndarray) -> tuple[int, int, int]:
        before = int(np.searchsorted(newlines, at))
        start = self.offset + int(newlines[before - 1]) + 1 if before else self.line_start
        return self.offset + at, self.line + before, self.offset + at - start + 1

    def _gap(self, data: bytes, a: int, b: int, newlines: np.ndarray, whole: bool) -> Iterator[tuple]:
        """An error where something else than white space stands between objects."""
        rest = data[a:b].lstrip(_WHITE)
        if rest:
            place = self._where(b - len(rest), newlines)
            first = chr(rest[0])
            kind = _KINDS.get(first, "number" if first.isdigit() or first == "-" else None)
            self.broken = True
            if whole:
                yield (self.file, *place, None, None, f"line {place[1]} column {place[2]}: " + (f"a record is a {kind}, not an object" if kind else "Expecting an object"))

    def chunk(self, data: bytes, whole: bool) -> Iterator[tuple]:
        """FOUND rows of the objects that end in ``data`` (``whole``), or of fragments of those that cross splits."""
        at, signs, parity, all_quotes = braces(data)
        at, signs = at[parity == self.quoted], signs[parity == self.quoted]
        depth = self.depth + np.cumsum(signs)
        newlines = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        opens, closes = at[(signs == 1) & (depth == 1)], at[(signs == -1) & (depth == 0)]
        done = 0
        if self.depth > 0:
            if not len(closes):
                self.held.append(data)
                done = len(data)
            else:
                done = int(closes[0]) + 1
                self.held.append(data[:done])
                yield from self._end(whole)
                closes = closes[1:]
        for a, b in zip(opens.tolist(), [*closes.tolist(), None]):
            yield from self._gap(data, done, a, newlines, whole)
            if self.broken:
                return
            self.place, self.origin = self._where(a, newlines), self.block
            done = len(data) if b is None else b + 1
            self.held = [data[a:done]]
            if b is not None:
                yield from self._end(whole)
        if done < len(data):
            yield from self._gap(data, done, len(data), newlines, whole)
        self.depth = int(depth[-1]) if len(depth) else self.depth
        self.quoted ^= all_quotes
        if len(newlines):
            self.line, self.line_start = self.line + len(newlines), self.offset + int(newlines[-1]) + 1
        self.offset += len(data)

    def _end(self, whole: bool) -> Iterator[tuple]:
        """The object in hand has ended: an object if it began in this split, else its last fragment."""
        raw, self.held = b"".join(self.held), []
        if self.place[1] and whole:
            yield _checked(self.file, *self.place, raw)
        elif not self.place[1] and not whole:
            yield (self.file, *self.place, self.origin, raw, None)

    def close(self, whole: bool) -> Iterator[tuple]:
        if self.held and not whole and not self.broken:
            yield (self.file, *self.place, self.origin, b"".join(self.held), None)


def _checked(file: str, offset: int, line: int, column: int, raw: bytes) -> tuple:
    try:
        text = raw.decode("utf-8")
        _, end = json.JSONDecoder().raw_decode(text)
        error = None if end == len(text) else f"line {line} column {column}: Extra data"
    except UnicodeDecodeError:
        error = "not UTF-8; convert the file"
    except json.JSONDecodeError as bad:
        error = f"line {line + bad.lineno - 1} column {bad.colno + (column - 1 if bad.lineno == 1 else 0)}: {bad.msg}"
    except RecursionError:
        error = f"line {line} column {column}: nested too deep"
    return file, offset, line, column, None, raw, error


_NAMES = [c.split()[0] for c in FOUND.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in FOUND.split(", ")]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def _reader(layout, whole: bool):
    """For mapInArrow: what _Split finds, with ``layout`` a broadcast Layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for file, block, _, data, ends in _runs(batches):
            entry = layout.value.entries.get((file, block))
            if entry is None:
                raise RowError(f"{file}: {_CHANGED}")
            split = split or _Split(file, block, entry)
            rows = [] if split.broken else list(split.chunk(data[:-1] if ends and entry.unclosed else data, whole))
            if ends:
                if not split.broken and split.offset != entry.end - entry.unclosed:
                    raise RowError(f"{file}: {_CHANGED}")
                rows += split.close(whole)
                split = None
            if rows:
                yield _table(rows)

    return run


def _joined(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: (r["offset"], r["line"]))
    head = rows[0]
    return pa.Table.from_batches([_table([_checked(head["file"], head["offset"], head["line"], head["column"], b"".join(r["raw"] for r in rows))])])


def found_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, line, raw, error): each object with its first byte and line, and what is wrong with it, or else null.

    Rows come in the order of their splits; where objects cross splits, they are sorted by file and byte. A row with an error may be no object; nothing behind it in its split is read. Files are parted by JSON white
    space alone. An empty file gives no rows. Columns of errors count characters from the object's line; where
    several objects share that line, bytes. Files and the session's way to split them (spark.sql.files.*, cores) must stay as they are
    until the rows have been read; a change is an error that says so. In a compressed file, which is one split, a last object without its closing brace is taken as closed.
    """
    pieces = _pieces(spark, path)
    maps = pieces.mapInArrow(_maps, MAPS).collect()  # one row for each split
    layout = compose([tuple(r) for r in maps])
    shared = spark.sparkContext.broadcast(layout)
    found = pieces.mapInArrow(_reader(shared, True), FOUND)
    if layout.crossing:
        parts = pieces.mapInArrow(_reader(shared, False), FOUND)
        found = found.unionByName(parts.groupBy("file", "origin").applyInArrow(_joined, FOUND)).orderBy("file", "offset")
    return found.select("file", "offset", "line", F.col("raw").cast("string").alias("raw"), "error")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, line, raw) of the objects that ``path`` holds; an error names its file, line and column when it is met."""
    found = found_objects(spark, path)
    bad = F.raise_error(F.concat("file", F.lit(": "), "error")).cast("boolean")
    return found.filter(F.when(F.col("error").isNotNull(), bad).otherwise(F.lit(True))).drop("error")


def first_error(found: DataFrame) -> str | None:
    """The first error of found_objects() in the order of files and bytes."""
    row = found.filter("error IS NOT NULL").agg(F.min(F.struct("file", "offset", "error")).alias("e")).first()
    return f"{row['e']['file']}: {row['e']['error']}" if row["e"] else None


def columns_in_order(found: DataFrame) -> list[str]:
    """Names of all objects' members in the order in which they are first seen, by file, byte and place in the object: one row for each name goes to the driver."""
    keys = found.filter("error IS NULL").select("file", "offset", F.posexplode(F.json_object_keys("raw")).alias("place", "name"))
    first = keys.groupBy("name").agg(F.min(F.struct("file", "offset", "place")).alias("at")).collect()
    return [r["name"] for r in sorted(first, key=lambda r: tuple(r["at"]))]
