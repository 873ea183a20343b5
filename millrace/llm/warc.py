"""WARC archives: written with an index of byte ranges, read back by coalesced ranges.

Each record is a gzip member of its own. Pages whose payloads are equal share one response; the others are
revisit records that keep the HTTP headers and refer to it. Payloads count as equal when their SHA-1 and
their lengths are.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import files
from millrace.llm.arrow_docs import bounded_batches, frugal, slices

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2000-01-01T00:00:00Z"

INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
MOST_GAP = 1 << 16
MOST_READ = 8 << 20


def mark_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the page whose response a revisit names, else null."""
    html = F.coalesce(F.col("html"), F.lit(""))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("n"))
    shared = read.filter(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    revisits = read.select("page_id", "digest", "n").join(shared, ["digest", "n"]).filter("page_id < refers_to OR page_id IS NULL").select("page_id", "digest", "refers_to").distinct()
    renamed = revisits.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest"))
    return read.join(renamed, same, "left").select("page_id", "url", "html", "digest", "refers_to")


def _record(row: dict) -> bytes:
    payload = row["html"].encode("utf-8")
    revisit = row["refers_to"] is not None
    digest = base64.b32encode(bytes.fromhex(row["digest"]))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    url = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A").encode("utf-8")
    head = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: <urn:page:%s>" % str(row["page_id"]).encode(), b"WARC-Target-URI: " + url, b"WARC-Date: " + DATE, b"WARC-Payload-Digest: sha1:" + digest]
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <urn:page:%d>" % row["refers_to"]]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block), b"", b""]
    return b"\r\n".join(head) + block + b"\r\n\r\n"


def _parsed(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise ValueError("a byte range does not hold a WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(b": ") for x in lines[1:])}
    block = rest[: int(field[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(field[b"warc-payload-digest"].removeprefix(b"sha1:")).hex()
    kind = field[b"warc-type"].decode()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    page = lambda x: None if x in (None, b"<urn:page:None>") else int(x[len(b"<urn:page:") : -1])
    return {"page_id": page(field[b"warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(field.get(b"warc-refers-to")), "url": field[b"warc-target-uri"].decode("utf-8"), "payload": payload}


def _gzipped(data: bytes) -> bytes:
    tool = zlib.compressobj(1, zlib.DEFLATED, 31)
    return tool.compress(data) + tool.flush()


def write_archives(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Write a record for every row of ``pages``; the index, which is also the table ``folder``/index.

    A null html is the empty payload, a null url the empty one, a null page_id stays null. Of records with
    equal payloads of at least ``least`` bytes, that with the largest page_id is the response (rows that
    repeat that id too) and the others are revisits. An empty table writes no archive.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = None, []
        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                out = out or files.NewFile(folder, ".warc.gz")
                data = _gzipped(_record(row))
                kind = "response" if row["refers_to"] is None else "revisit"
                rows.append((row["page_id"], row["url"], row["digest"], kind, out.name, out.write(data), len(data)))
        if out:
            out.close()
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])

    spark = pages.sparkSession
    bounded_batches(spark)
    mark_revisits(pages, least).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, where: Column | None = None, with_payload: bool = False) -> DataFrame:
    """The records that ``where`` selects from the index, parsed from the archives.

    The selected ranges are sorted by file and offset; ranges that are near each other are fetched in one read of
    MOST_READ bytes at most; a record that is longer is read alone and whole.
    """
    chosen = index if where is None else index.filter(where)
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
    fields += [("payload", pa.binary())] * with_payload

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = files.at(folder)
        handles: dict[str, object] = {}

        def fetch(group: list[tuple[str, int, int]]) -> pa.RecordBatch:
            name, low = group[0][:2]
            if name not in handles:
                handles.clear()
                handles[name] = system.open_input_file(f"{path}/{name}")
            data = handles[name].read_at(group[-1][1] + group[-1][2] - low, low)
            found = [_parsed(zlib.decompress(data[o - low : o - low + n], 31)) for _, o, n in group]
            return pa.RecordBatch.from_arrays([pa.array([x[f] for x in found], t) for f, t in fields], [f for f, _ in fields])

        group: list[tuple[str, int, int]] = []
        for batch in batches:
            for name, offset, length in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True):
                if group and (name != group[0][0] or offset - group[-1][1] - group[-1][2] > MOST_GAP or offset + length - group[0][1] > MOST_READ):
                    yield fetch(group)
                    group = []
                group.append((name, offset, length))
        if group:
            yield fetch(group)

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a count of its own: rows of the index are small, what they stand for is not
    placed = chosen.select("file", "offset", "length").repartition(tasks, "file").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload)
