"""Smaller profiles, identities, settings and verified writes."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import identity_tree
from millrace.operators.profile import ordered_digest
from millrace.operators.rows import RowError, dedup_append


def stats_columns(df: DataFrame, requested: list[str] = ()) -> list[str]:
    """Columns whose lengths are reported: those asked for, or all of texts and message lists."""
    kinds = dict(df.dtypes)
    for name in requested:
        if name not in kinds:
            raise RowError(f"there is no column {name!r}")
    return list(requested) or [n for n, t in kinds.items() if t == "string" or t.startswith("array<struct<") and "role:" in t and "content:" in t]


def row_shape(df: DataFrame) -> Column:
    """pretokenized, conversational or plain_text, by which columns a row fills."""
    filled = lambda *names: [F.col(n).isNotNull() for n in names if n in df.columns]
    ids, turns = filled("input_ids", "chosen_ids", "chosen_input_ids"), filled("messages", "conversations")
    any_of = lambda tests: F.coalesce(F.greatest(F.lit(False), *tests, F.lit(False)), F.lit(False))
    return F.when(any_of(ids), "pretokenized").when(any_of(turns), "conversational").otherwise("plain_text")


def shape_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(row_shape(df).alias("shape")).agg(F.count("*").alias("n_rows"))


def contributions(df: DataFrame, index: str, primary_rows: int, tokens: str) -> DataFrame:
    """(source, n_rows, tokens) of the primary rows in front and the replay rows after them."""
    source = F.when(F.col(index) < primary_rows, "primary").otherwise("replay")
    return df.groupBy(source.alias("source")).agg(F.count("*").alias("n_rows"), F.sum(tokens).cast("long").alias("tokens"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """One row: desirable, undesirable and unlabelled rows, and the ratio of the first two."""
    yes, no = F.count_if(F.col(label)), F.count_if(~F.col(label))
    return df.agg(yes.alias("desirable"), no.alias("undesirable"), F.count_if(F.col(label).isNull()).alias("unlabelled"), F.try_divide(yes.cast("double"), no.cast("double")).alias("ratio"))


def inspect_inputs(df: DataFrame, prompt_tokens: str, new_tokens: int, window: int, *by: str) -> DataFrame:
    """Rows, those whose prompt and answer budget exceed the window, the longest prompt and the largest answer that fits all."""
    n = F.col(prompt_tokens)
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if(n + new_tokens > window).alias("over_limit"), F.max(n).alias("longest"), F.greatest(F.lit(0), F.lit(window) - F.max(n)).alias("largest_budget"))


def input_identity(df: DataFrame, order: str, ids: str) -> DataFrame:
    """SHA-256 over the token ids of all rows as JSON lines, in order: defined from front to back, see ordered_digest(). input_tree() has no task that sees all."""
    return ordered_digest(df, order, F.encode(F.concat(F.to_json(F.col(ids)), F.lit("\n")), "UTF-8"), "identity").select("identity")


def input_tree(df: DataFrame, order: str, ids: str, fan: int = 4096) -> DataFrame:
    """The nodes of an identity_tree over the token ids of each row as a JSON line; another value than input_identity()."""
    return identity_tree.tree(df, order, F.sha2(F.concat(F.to_json(F.col(ids)), F.lit("\n")), 256), fan)


def response_ids(full: Column, prompt_tokens: Column) -> Column:
    """The ids after the prompt's."""
    return F.slice(full, prompt_tokens + 1, F.greatest(F.size(full) - prompt_tokens, F.lit(0)))


def located_field(rendered: Column, marked: Column, marker: str, value: Column) -> Column:
    """struct(start, end) of a field in a rendered text, found from a rendering with the marker in its place; null if the text around differs."""
    at = F.call_function("locate", F.lit(marker), marked) - 1
    tail = F.substring(marked, at + 1 + len(marker), F.length(marked))
    same = (F.substring(rendered, F.lit(1), at) == F.substring(marked, F.lit(1), at)) & (F.substring(rendered, at + F.length(value) + 1, F.length(rendered)) == tail)
    return F.when((at >= 0) & same, F.struct(at.alias("start"), (at + F.length(value)).alias("end")))


def check_plain_text(df: DataFrame) -> None:
    """Rows for continued pretraining have a text column only, and none is empty."""
    extra = sorted(set(df.columns) - {"text"})
    if "text" not in df.columns or extra:
        raise RowError(f"rows have text only; found also {', '.join(extra) or 'no text'}")
    if df.filter(F.coalesce(F.length(F.trim("text")) == 0, F.lit(True))).limit(1).count():
        raise RowError("a text is empty")


def verified_append(existing: DataFrame, new: DataFrame, identity: list[str], order: str, path: str) -> dict:
    """Append what is new to a Parquet table and check that all old rows are there still and the new ones after them."""
    spark = existing.sparkSession
    before = existing.count()
    fresh = dedup_append(existing, new, identity, order).select(*existing.columns)
    added, offered = fresh.count(), new.count()
    if added:
        fresh.write.mode("append").parquet(path)
    after = spark.read.parquet(path)
    lost = existing.exceptAll(after).limit(1).count()
    if lost or after.count() != before + added:
        raise RowError(f"{path}: the table does not hold the old rows and the {added} new ones")
    return {"added": added, "duplicates": offered - added}


def check_ranges(ranges: dict[str, object]) -> dict[str, tuple[float, float]]:
    """Metric ranges [low, high] with low below high; booleans are no numbers."""
    out = {}
    for name, pair in ranges.items():
        good = isinstance(pair, (list, tuple)) and len(pair) == 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in pair)
        if not good or not pair[0] < pair[1]:
            raise RowError(f"range {name!r} must be [low, high] with low below high")
        out[name] = (float(pair[0]), float(pair[1]))
    return out


def merged_settings(base: dict, chosen: dict) -> dict:
    """Nested settings, those chosen in front."""
    out = dict(base)
    for key, value in chosen.items():
        out[key] = merged_settings(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load_env(text: str, environment=os.environ) -> dict[str, str]:
    """KEY=value lines into the environment, which wins; quotes around a value go in pairs; comments and blanks are skipped."""
    found = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip().removeprefix("export ")
        if not line or line.startswith("#"):
            continue
        name, sign, value = line.partition("=")
        if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
            raise RowError(f"line {number}: expected KEY=value")
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        found[name.strip()] = value
        environment.setdefault(name.strip(), value)
    return found


def rendered(messages: Column, formats: dict[str, str], opening: str = "", closing: str = "") -> Column:
    """A conversation as text: each message by its role's format with {content}; other roles are an error."""
    def one(m: Column) -> Column:
        out = F.raise_error(F.concat(F.lit("no format for role "), F.coalesce(m["role"], F.lit("null"))))
        for role, text in formats.items():
            before, _, after = text.partition("{content}")
            out = F.when(m["role"] == role, F.concat(F.lit(before), F.coalesce(m["content"], F.lit("")), F.lit(after))).otherwise(out)
        return out

    return F.concat(F.lit(opening), F.array_join(F.transform(messages, one), ""), F.lit(closing))


def log_tail(spark: SparkSession, path: str, size: int = 65_536) -> str:
    """The end of a text file, from the first whole line of its last ``size`` bytes."""
    part = spark.read.format("binaryFile").load(path).select(F.expr(f"substring(content, greatest(length(content) - {size - 1}, 1), {size})").alias("b"), (F.col("length") > size).alias("cut")).first()
    text = bytes(part["b"]).decode("utf-8", "replace")
    return text.partition("\n")[2] if part["cut"] else text


def register_functions(spark: SparkSession) -> None:
    """Names for SQL: similarity, label_key, answer_key, answer_scores; the table functions chunk_text, md_sections, heal."""
    from millrace.functions import quality, rewards, tables

    spark.udf.register("similarity", rewards.similarity)
    spark.udf.register("label_key", quality.label_column)
    spark.udf.register("answer_key", quality.answer_column)
    spark.udf.register("answer_scores", quality.answer_scores)
    tables.register_tables(spark)
