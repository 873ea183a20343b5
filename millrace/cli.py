"""Commands over row files: python -m millrace COMMAND --help."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import checks, chunking, fields, messages, order, pairs, profile, repair, rows
from millrace.session import local_session
from millrace.sources import files

INDEX = "__row"


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Rows with their place, which is only as good as the file's own order: parts by name, rows within."""
    return files.read_rows(spark, path).withColumn(INDEX, F.monotonically_increasing_id())


def _write(df: DataFrame, path: str, force: bool) -> None:
    files.write_rows(df.orderBy(INDEX).drop(INDEX) if INDEX in df.columns else df, path, force)


def convert(spark, a):
    df = _read(spark, a.input)
    if a.to == "messages":
        df = messages.to_messages(df)
    elif a.to == "prompt-completion":
        bad = df.filter(~messages.convertible(F.col("messages"))).limit(1).count()
        if bad:
            raise rows.RowError("a row's messages do not end with the assistant's, or lack a role or content")
        df = messages.to_prompt_completion(df)
    _write(df, a.output, a.force)


def shuffle(spark, a):
    df = order.dense_index(_read(spark, a.input), INDEX, into="__n").drop(INDEX).withColumnRenamed("__n", INDEX)
    _write(df.withColumn(INDEX, order.seeded(a.seed, INDEX)), a.output, a.force)


def sample(spark, a):
    df = _read(spark, a.input)
    if a.head:
        out = rows.head(df, a.n, INDEX)
    else:
        dense = order.dense_index(df, INDEX, into="__n").drop(INDEX).withColumnRenamed("__n", INDEX)
        out = rows.sample(dense, a.n, a.seed, INDEX)
    _write(out, a.output, a.force)


def split(spark, a):
    df = _read(spark, a.input)
    if a.key:
        count = rows.split_count(df.count(), a.n, a.fraction)
        marked = rows.split_by_key(df, a.key, INDEX, count)
        first, rest = marked.filter("first").drop("first"), marked.filter("NOT first").drop("first")
    else:
        first, rest = rows.split(df, INDEX, n=a.n, fraction=a.fraction)
    files.write_all({a.first: first.orderBy(INDEX).drop(INDEX), a.rest: rest.orderBy(INDEX).drop(INDEX)}, a.force)


def mix(spark, a):
    sources = [(order.dense_index(_read(spark, p), INDEX, into="__n").drop(INDEX).withColumnRenamed("__n", INDEX), float(f)) for p, f in (fields.assignment(s, "input") for s in a.inputs)]
    files.write_rows(rows.mix(sources, a.seed, INDEX).drop(INDEX, "source_no"), a.output, a.force)


def fields_(spark, a):
    named = {k: [fields.assignment(x, f"--{k}") for x in getattr(a, k)] for k in ("add", "rename", "swap")}
    _write(fields.apply_fields(_read(spark, a.input), named["add"], a.remove, named["rename"], named["swap"]), a.output, a.force)


def filter_(spark, a):
    limits = {k: int(v) for k, v in (fields.assignment(x, "--max-length") for x in a.max_length)}
    _write(fields.where(rows.limit_lengths(_read(spark, a.input), limits), *a.where), a.output, a.force)


def cpt(spark, a):
    text = files.read_document(spark, a.input).withColumn("id", F.lit(0))
    files.write_rows(chunking.chunk_texts(text, "id", "text", a.max_tokens).orderBy("chunk_no").select(F.col("chunk").alias("text")), a.output, a.force)


def pairs_(spark, a):
    if not a.rejected:
        return _write(messages.to_prompt_completion(_read(spark, a.input)), a.output, a.force)
    key = messages.user_key(F.col("messages"))
    sides = [_read(spark, p).withColumn("key", F.to_json(key)) for p in (a.input, a.rejected)]
    make = pairs.align_strict if a.strict else pairs.align
    made = make(*sides, "key", INDEX)
    last = lambda c: F.slice(c, F.size(c), F.lit(1))
    out = made.select(F.col(f"chosen.{INDEX}").alias(INDEX), F.slice("chosen.messages", F.lit(1), F.size("chosen.messages") - 1).alias("prompt"), last(F.col("chosen.messages")).alias("chosen"), last(F.col("rejected.messages")).alias("rejected"))
    _write(out, a.output, a.force)
    for r in pairs.unmatched(*sides, "key", INDEX).groupBy("side").count().orderBy("side").collect():
        print(f"{r['count']} rows of {r['side']} have no partner")


def heal(spark, a):
    lines = files.read_document(spark, a.input).select(F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    healed = repair.heal_lines(lines)
    for r in healed.filter("size(repairs) > 0 OR error IS NOT NULL").orderBy("line_no", "part").collect():
        print(f"line {r['line_no'] + 1}: {r['error'] or '; '.join(r['repairs'])}")
    kept = healed.filter("line IS NOT NULL AND length(trim(line)) > 0").orderBy("line_no", "part").select("line")
    kept.coalesce(1).write.mode("overwrite" if a.force else "errorifexists").text(a.output)
    if healed.filter("error IS NOT NULL").limit(1).count():
        raise rows.RowError("some lines could not be repaired")


def stats(spark, a):
    df = _read(spark, a.input).drop(INDEX)
    print("column count min mean median p90 max (estimated tokens)")
    for name in checks.stats_columns(df, a.columns):
        text = F.col(name) if dict(df.dtypes)[name] == "string" else messages.contents(F.col(name))
        print(name, *profile.length_summary(df, chunking.estimated_tokens(text)).first())


def save(spark, a):
    old = files.read_rows(spark, a.table)
    new = _read(spark, a.input)
    done = checks.verified_append(old, new, a.identity or old.columns, INDEX, a.table)
    print(f"{done['added']} rows added, {done['duplicates']} there already")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *positional: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x)
        p.add_argument("--force", action="store_true", help="replace outputs")
        p.set_defaults(run=run)
        return p

    command("convert", convert, "input", "output").add_argument("--to", choices=("messages", "prompt-completion", "format"), default="format")
    command("shuffle", shuffle, "input", "output").add_argument("--seed", type=int, required=True)
    p = command("sample", sample, "input", "output")
    p.add_argument("--n", type=int, required=True)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--head", action="store_true")
    p = command("split", split, "input", "first", "rest")
    p.add_argument("--n", type=int)
    p.add_argument("--fraction", type=float)
    p.add_argument("--key")
    p = command("mix", mix, "output")
    p.add_argument("inputs", nargs="+", metavar="PATH=FRACTION")
    p.add_argument("--seed", type=int, required=True)
    p = command("fields", fields_, "input", "output")
    for flag in ("--add", "--remove", "--rename", "--swap"):
        p.add_argument(flag, action="append", default=[])
    p = command("filter", filter_, "input", "output")
    p.add_argument("--where", action="append", default=[])
    p.add_argument("--max-length", action="append", default=[], metavar="COLUMN=N")
    command("cpt", cpt, "input", "output").add_argument("--max-tokens", type=int, required=True)
    p = command("pairs", pairs_, "input", "output")
    p.add_argument("--rejected")
    p.add_argument("--strict", action="store_true")
    command("heal", heal, "input", "output")
    command("stats", stats, "input").add_argument("--columns", nargs="*", default=[])
    command("save", save, "table", "input").add_argument("--identity", nargs="*", default=[])
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        a.run(spark or local_session(), a)
    except rows.RowError as error:
        print(f"millrace {a.command}: {error}", file=sys.stderr)
        return 1
    return 0
