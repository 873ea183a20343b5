"""Row files: JSON object streams, JSON arrays, CSV, Parquet and plain text, chosen by extension."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.rows import RowError
from millrace.sources import json_stream
from millrace.session import drop_folder

_SPACE = re.compile(r"[ \t\r\n]*")


def json_objects(text: str) -> Iterator[tuple[int, str]]:
    """(line, raw text) of each object of a stream parted by JSON white space only; ValueError names line and column."""
    decoder, at, line = json.JSONDecoder(), _SPACE.match(text).end(), 1
    counted = 0
    while at < len(text):
        line += text.count("\n", counted, at)
        counted = at
        column = at - text.rfind("\n", 0, at)
        try:
            value, end = decoder.raw_decode(text, at)
        except json.JSONDecodeError as error:
            raise ValueError(f"line {error.lineno} column {error.colno}: {error.msg}") from error
        if not isinstance(value, dict):
            raise ValueError(f"line {line} column {column}: a record is a {type(value).__name__}, not an object")
        yield line, text[at:end]
        at = _SPACE.match(text, end).end()


def read_json_stream(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, line, raw) of JSON objects that may span lines or share one; each file whole, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = list(json_objects(content.decode("utf-8")))
                except UnicodeDecodeError as error:
                    raise RowError(f"{name}: not UTF-8; convert the file") from error
                except ValueError as error:
                    raise RowError(f"{name}: {error}") from error
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["file", "record", "line", "raw"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, record long, line long, raw string")


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(raw): the objects of JSON files, over lines or not; files are split and read in parallel."""
    return json_stream.read_objects(spark, path).select("raw")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files with one object on each line, split within files; blank lines are skipped, others must be objects."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNull().alias("bad"), "value")
    checked = F.when(F.col("bad") | ~F.ltrim("value").startswith("{"), F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80))).cast("boolean")).otherwise(F.lit(True))
    return parsed.filter(checked).select("r.*")


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, raw) of the objects of files that hold one array each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = json.loads(content)
                except ValueError as error:
                    raise RowError(f"{name}: {error}") from error
                if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
                    raise RowError(f"{name}: expected an array of objects")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array([json.dumps(r, ensure_ascii=False) for r in rows], pa.string())], ["file", "record", "raw"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, record long, raw string")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all cells text; empty cells are empty texts (a missing cell of a short row too)."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, emptyValue="", nullValue="\0")
    return df.na.fill("")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(text): each file as one row."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def _stream_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an object stream; the scan that finds their schema finds the first bad object too."""
    found = json_stream.found_objects(spark, path)
    wrong = F.min(F.when(F.col("error").isNotNull(), F.struct("file", "offset", "error"))).alias("e")
    seen = found.select(F.schema_of_variant_agg(F.when(F.col("error").isNull(), F.try_parse_json("raw"))).alias("s"), wrong).first()
    if seen["e"]:
        raise RowError(f"{seen['e']['file']}: cannot read: {seen['e']['error']}")
    return _typed(found.select("raw"), seen["s"])


def _typed(raw: DataFrame, schema: str | None = None) -> DataFrame:
    """Rows of JSON texts with the schema that all of them together have."""
    schema = schema or raw.select(F.schema_of_variant_agg(F.parse_json("raw")).alias("s")).first()["s"]
    if not schema or schema == "VOID":
        raise RowError("the input has no rows")
    ddl = schema.removeprefix("OBJECT").replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    return raw.select(F.from_json("raw", "STRUCT" + ddl, {"mode": "FAILFAST"}).alias("r")).select("r.*")


READERS = {
    "jsonl": _stream_rows,
    "json": lambda spark, path: _typed(read_json_array(spark, path)),
    "csv": read_csv,
    "parquet": lambda spark, path: spark.read.parquet(path),
    "txt": read_document,
}


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." not in name:
        raise RowError(f"{path}: the name needs one of the extensions {', '.join(READERS)}")
    found = name.rsplit(".", 1)[1].lower()
    if found not in READERS:
        raise RowError(f"{path}: extension {found!r} is not one of {', '.join(READERS)}")
    return found


def read_rows(spark: SparkSession, path: str, first_seen: bool = False) -> DataFrame:
    """Rows by extension; a missing or empty input is one kind of error that names the path.

    ``first_seen``: the columns of an object stream come in the order in which their names are first seen, as a CSV writer
    that takes the union of all rows' columns has them, instead of by name; this scans the input once more.
    """
    kind = extension(path)
    try:
        df = READERS[kind](spark, path)
        if first_seen and kind == "jsonl":
            df = df.select(*[F.col(f"`{c}`") for c in json_stream.columns_in_order(json_stream.found_objects(spark, path))])
        empty = df.isEmpty()
    except RowError:
        raise
    except Exception as error:
        raise RowError(f"{path}: cannot read: {str(error).splitlines()[0][:300]}; check the path and the format") from error
    if empty:
        raise RowError(f"{path}: the input has no rows")
    return df


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table ``space.name``, or the rows of one split with ``space.name:split``."""
    table, _, split = name.partition(":")
    df = spark.table(table)
    if split:
        return df.filter(F.col("split") == split).drop("split")
    if "split" in df.columns and df.select("split").distinct().limit(2).count() > 1:
        raise RowError(f"{table} has several splits; name one as {table}:split")
    return df.drop("split")


def flat_columns(df: DataFrame) -> None:
    nested = [n for n, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    if nested:
        raise RowError(f"CSV holds no nested values: {', '.join(nested)}")


def _place(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _refuse_existing(spark: SparkSession, path: str, force: bool) -> None:
    system, target = _place(spark, path)
    if system.exists(target) and not force:
        raise RowError(f"{path} exists; use force to replace it")


def write_rows(df: DataFrame, path: str, force: bool = False) -> None:
    """Write by extension through a staged folder of its own that is renamed when complete; an existing output needs
    ``force``, one that another writer put there meanwhile too.

    JSON lines keep null fields. A JSON array is for small results: its rows meet in one task.
    """
    kind, spark = extension(path), df.sparkSession
    jvm = spark.sparkContext._jvm
    _refuse_existing(spark, path, force)
    system, target = _place(spark, path)
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}.staged"
    if kind == "csv":
        flat_columns(df)
        df.write.mode("overwrite").csv(staged, header=True, escape='"')
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(staged)
    elif kind == "json":
        numbered = df.select(F.monotonically_increasing_id().alias("i"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
        rows = F.transform(F.sort_array(F.collect_list(F.struct("i", "j"))), lambda x: x["j"])
        numbered.agg(F.concat(F.lit("[\n"), F.array_join(rows, ",\n"), F.lit("\n]")).alias("value")).coalesce(1).write.mode("overwrite").text(staged)
    elif kind == "jsonl":
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(staged)
    else:
        raise RowError(f"{path}: nothing is written as {kind}")
    try:
        _refuse_existing(spark, path, force)
    except RowError:
        drop_folder(spark, staged)
        raise
    before = f"{path.rstrip('/')}.{uuid.uuid4().hex}.replaced"
    kept = system.exists(target) and system.rename(target, jvm.org.apache.hadoop.fs.Path(before))
    if not system.rename(jvm.org.apache.hadoop.fs.Path(staged), target):
        if kept:
            system.rename(jvm.org.apache.hadoop.fs.Path(before), target)
        raise RowError(f"{path}: the finished output could not be put in place; the old one is back")
    if kept:
        drop_folder(spark, before)


def write_all(outputs: dict[str, DataFrame], force: bool = False) -> list[str]:
    """Several outputs: no path may be another's or lie inside it; all are checked before the first is written."""
    paths = sorted(p.rstrip("/") + "/" for p in outputs)
    for a, b in zip(paths, paths[1:], strict=False):  # what lies inside a path follows it in this order
        if b.startswith(a):
            raise RowError(f"outputs {a[:-1]} and {b[:-1]} are in each other's way")
    for path, df in outputs.items():
        if extension(path) == "csv":
            flat_columns(df)
        _refuse_existing(df.sparkSession, path, force)
    done = []
    for path, df in outputs.items():
        try:
            write_rows(df, path, force)
        except Exception as error:
            raise RowError(f"{path} failed after {', '.join(done) or 'none'} had been written: {error}") from error
        done.append(path)
    return done


def read_metrics(spark: SparkSession, path: str, required: tuple[str, ...] = ("step", "log")) -> DataFrame:
    """Metric records of JSON lines with their place; a last line that is cut off is skipped, other bad lines are errors.

    (seq, raw, step, epoch, time, eval, log)
    """
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\n")).alias("seq", "raw"), F.size(F.split("value", "\n")).alias("n"))
    lines = lines.filter(F.length(F.trim("raw")) > 0).withColumn("v", F.try_parse_json("raw"))
    cut = F.col("v").isNull() & (F.col("seq") == F.col("n") - 1)
    lacks = [F.coalesce(~F.array_contains(F.json_object_keys("raw"), k), F.lit(True)) for k in required]
    wrong = F.col("v").isNull()
    for lack in lacks:
        wrong = wrong | lack
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("bad metric record on line "), (F.col("seq") + 1).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    fields = F.from_json("raw", "step bigint, max_steps bigint, epoch double, time double, eval boolean, log map<string,double>")
    return lines.filter(~cut).filter(checked).select(F.col("seq").cast("long").alias("seq"), "raw", fields.alias("r")).select("seq", "raw", "r.*")


def run_state(spark: SparkSession, folder: str) -> dict:
    """What a run's folder tells: its checkpoints and the phase that its files imply."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [str(s.getPath().getName()) for s in system.listStatus(root)]
    steps = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"checkpoint-(\d+)", n)))
    if "verify.json" in names:
        phase = "verified"
    elif "final" in names:
        phase = "trained"
    else:
        phase = "training" if "metrics.jsonl" in names else "starting"
    return {"checkpoints": steps, "phase": phase}


def reasoning_chats(spark: SparkSession, path: str) -> DataFrame:
    """(messages, reasoning) of JSON lines whose messages are exactly a user's and an assistant's, with a trace that is not empty."""
    df = read_json_lines(spark, path, "messages array<struct<role:string,content:string>>, reasoning string")
    roles = F.transform("messages", lambda m: m["role"])
    good = (roles == F.array(F.lit("user"), F.lit("assistant"))) & (F.length(F.trim("reasoning")) > 0)
    return df.filter(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a row is not a user's and an assistant's message with reasoning")).cast("boolean")))


def tensor_headers(spark: SparkSession, path: str, most: int = 8 << 20) -> DataFrame:
    """(file, name, dtype, begin, end, digest) of tensors in files of a JSON header and payloads.

    Headers are read first; then the tensors are dealt out and each is read by its byte range, ``most`` bytes at once.
    """
    names = ["file", "name", "dtype", "begin", "end"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def opened(name: str):
        system, at = fs.FileSystem.from_uri(name if "://" in name else "file://" + name.removeprefix("file:"))
        return system.open_input_file(at)

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with opened(name) as f:
                    size = int.from_bytes(f.read_at(8, 0), "little")
                    head = json.loads(f.read_at(size, 8))
                rows = [(name, k, v["dtype"], *v["data_offsets"], 8 + size) for k, v in head.items() if k != "__metadata__"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [*names, "base"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                digest = hashlib.sha256()
                with opened(row["file"]) as f:
                    for at in range(row["begin"], row["end"], most):
                        digest.update(f.read_at(min(most, row["end"] - at), row["base"] + at))
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.string())], [*names, "digest"])

    listed = spark.read.format("binaryFile").load(path).select("path")  # the content is not read here
    tensors = listed.mapInArrow(headers, "file string, name string, dtype string, begin long, end long, base long")
    return tensors.repartition("file", "name").mapInArrow(digests, "file string, name string, dtype string, begin long, end long, digest string")
