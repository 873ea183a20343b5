"""Token-ID output: files of independent zstandard frames with a seek table.

A file is a row of zstandard frames, each the whole of some documents, then a skippable frame with the seek
table of the public seekable format: for each frame its compressed and decompressed sizes and the low 32
bits of the XXH64 of its decompressed bytes. A frame decompresses to: uint32 number of documents, uint32
bytes of an id (2 or 4), then per document int64 key, uint8 (1 if the key is not null), int64 number of
ids; then all ids in little-endian order. Readers fetch the seek table and only the frames they need.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import files
from millrace.llm.arrow_docs import bounded_batches, frugal, slices, utf8
from millrace.llm.piece_encoder import PieceEncoder, encoder

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 1 << 20
INDEX = "part long, file string, frame int, offset long, size long, first_key long, last_key long, n_docs long, n_tokens long"


def pack_frame(keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    kind = "<u2" if width == 2 else "<u4"
    return b"".join(
        [
            struct.pack("<II", len(keys), width),
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            np.array([k is not None for k in keys], np.uint8).tobytes(),
            np.array([len(x) for x in ids], "<i8").tobytes(),
            *[x.astype(kind).tobytes() for x in ids],
        ]
    )


def unpack_frame(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    n, width = struct.unpack_from("<II", data)
    keys = np.frombuffer(data, "<i8", n, 8).tolist()
    valid = np.frombuffer(data, np.uint8, n, 8 + 8 * n)
    sizes = np.frombuffer(data, "<i8", n, 8 + 9 * n)
    ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", -1, 8 + 17 * n).astype("<u4")
    return [k if v else None for k, v in zip(keys, valid, strict=True)], np.split(ids, np.cumsum(sizes)[:-1]) if n else []


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(handle) -> list[tuple[int, int, int]]:
    """(compressed size, decompressed size, checksum) of each frame of an open file."""
    size = handle.size()
    count, flags, magic = struct.unpack("<IBI", handle.read_at(9, size - 9))
    if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
        raise ValueError("no seek table with checksums at the end of the file")
    raw = handle.read_at(12 * count, size - 9 - 12 * count)
    return list(struct.iter_unpack("<III", raw))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Write the ids of every row, in ascending key order over files and frames; the index of frames.

    Null texts are encoded as empty texts (the end id alone); null keys come first; rows of equal keys are
    ordered by their text. A document is never parted over frames; one of less than 1 GiB fits into the four bytes that
    the seek table has for a frame's size, whatever the width of an id. An empty table writes no file. The index is a table in ``folder``/index; its rows
    name only files of task attempts that succeeded.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def written(batches: Iterator[pa.RecordBatch], encode: PieceEncoder) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        width = 2 if encode.library.get_vocab_size() <= 0xFFFF and end <= 0xFFFF else 4
        part = TaskContext.get().partitionId()
        out, entries, rows = None, [], []
        keys: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> None:
            nonlocal out
            if not keys:
                return
            out = out or files.NewFile(folder, ".tok.zst")
            raw = pack_frame(keys, held, width)
            packed = tool.compress(raw)
            offset = out.write(packed)
            known = [k for k in keys if k is not None]
            rows.append((part, out.name, len(entries), offset, len(packed), min(known, default=None), max(known, default=None), len(keys), sum(map(len, held))))
            entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            keys.clear()
            held.clear()

        size = 0
        for batch in slices(batches, text):
            for k, ids in zip(batch.column(key).to_pylist(), encode.encode(utf8(batch.column(text)), end), strict=True):
                keys.append(k)
                held.append(ids)
                size += width * len(ids)
                if size >= FRAME_BYTES:
                    flush()
                    size = 0
        flush()
        if out:
            out.write(seek_table(entries))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEX_TYPES, strict=True)], _INDEX_NAMES)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(tokenizer) as encode:
            yield from written(batches, encode)

    placed = docs.select(F.col(key).cast("long").alias(key), text).repartitionByRange(partitions, key).sortWithinPartitions(key, text)
    placed.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


_INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
_INDEX_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in INDEX.split(", ")]


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids in all frames before.

    The totals by file go to the driver: one row for each file, as many as the writer had partitions.
    """
    totals = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n")).orderBy("part", "file").collect()
    starts, at = [], 0
    for row in totals:
        starts.append((row["file"], at))
        at += row["n"]
    before = index.sparkSession.createDataFrame(starts, "file string, __at long")
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.join(F.broadcast(before), "file").withColumn("start", F.col("__at") + inside).drop("__at")


def read_tokens(index: DataFrame, folder: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of the documents in the frames that ``index`` lists.

    ``index`` is with_starts() of a writer's index, filtered to the wanted frames. Each frame is read by its
    byte range, and its checksum is held against the seek table.
    """
    names = [key, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = files.at(folder)
        tool = zstandard.ZstdDecompressor()
        name, handle, table = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name = row["file"]
                    handle = system.open_input_file(f"{path}/{name}")
                    table = read_seek_table(handle)
                size, raw_size, checksum = table[row["frame"]]
                if size != row["size"]:
                    raise ValueError(f"{name}: the index and the seek table disagree on frame {row['frame']}")
                raw = tool.decompress(handle.read_at(size, row["offset"]), max_output_size=raw_size)
                if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
                    raise ValueError(f"{name}: frame {row['frame']} fails its checksum")
                keys, ids = unpack_frame(raw)
                sizes = np.array([len(x) for x in ids], np.int64)
                columns = [pa.array(keys, pa.int64()), pa.array(row["start"] + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a count of its own: rows of the index are small, what they stand for is not
    placed = index.repartition(tasks, "file").sortWithinPartitions("file", "frame")
    return placed.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def read_documents(spark: SparkSession, folder: str, keys: list[int], key: str = "doc_id") -> DataFrame:
    """The listed documents, decompressing only the frames that may hold them."""
    index = with_starts(open_index(spark, folder))
    wanted = F.exists(F.lit(keys).cast("array<bigint>"), lambda k: k.between(F.col("first_key"), F.col("last_key")))
    return read_tokens(index.filter(wanted), folder, key, with_ids=True).filter(F.col(key).isin(keys))
