"""Exact edits of texts, spans of waste in them, and reports by tokens."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a span may be labelled as; the last one only in answers.
CATEGORIES = ("repetition", "abandoned-draft", "same-route-reverification", "rereading", "write-up-narration", "hedge", "beyond-prompt")


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs in ``text`` without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def apply_edits(text: Column, edits: Column) -> Column:
    """struct(text, error): edits (structs old, new) in order; an old span must occur exactly once in the text so far."""
    start = F.struct(text.alias("text"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("n"))

    def one(s: Column, e: Column) -> Column:
        n = occurrences(s["text"], e["old"])
        error = F.when(n != 1, F.concat(F.lit("edit "), s["n"].cast("string"), F.lit(": span occurs "), n.cast("string"), F.lit(" times")))
        done = F.struct(F.when(n == 1, F.replace(s["text"], e["old"], e["new"])).otherwise(s["text"]).alias("text"), error.alias("error"), (s["n"] + 1).alias("n"))
        return F.when(s["error"].isNull(), done).otherwise(s)

    return F.aggregate(edits, start, one, lambda s: F.struct(s["text"].alias("text"), s["error"].alias("error")))


def derived(old: str, new: str) -> list[tuple[str, str]]:
    """(old, new) spans that turn one text into the other, each widened until it occurs once; those that then meet are one."""
    blocks = [[i, j, a, b] for tag, i, j, a, b in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if tag != "equal"]

    def span(i: int, j: int) -> tuple[int, int]:
        reach = 0
        while True:
            low, high = max(0, i - reach), min(len(old), j + reach)
            if high > low and old.find(old[low:high]) == low and old.find(old[low:high], low + 1) < 0:
                return low, high
            if low == 0 and high == len(old):
                return low, high
            reach += 1

    at = 0
    while at + 1 < len(blocks):
        if span(*blocks[at][:2])[1] > span(*blocks[at + 1][:2])[0]:
            blocks[at] = [blocks[at][0], blocks[at + 1][1], blocks[at][2], blocks[at + 1][3]]
            del blocks[at + 1]
            at = max(0, at - 1)  # the wider block may now meet the one before
        else:
            at += 1
    out = []
    for i, j, a, b in blocks:
        low, high = span(i, j)
        out.append((old[low:high], old[low:i] + new[a:b] + old[j:high]))
    return out


def derive_edits(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, edits): an array of structs old and new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("old", pa.string()), ("new", pa.string())]))
        for batch in batches:
            rows = [[{"old": x, "new": y} for x, y in derived(a or "", b or "")] for a, b in zip(batch.column(old).to_pylist(), batch.column(new).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(rows, kind)], [key, "edits"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, old, new).mapInArrow(run, f"`{key}` {kind}, edits array<struct<old:string,new:string>>")


def locate(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """``df``, one row for each label, with start and end of the span, waste_start and waste_end inside it, and fault.

    Labels have field, span (what is looked for), waste (the part of it to count), category, reason and retained.
    A span occurs once in the text, waste once in the span, and spans of a field do not overlap.
    """
    start = F.call_function("locate", F.col("span"), F.col(text)) - 1
    inner = F.call_function("locate", F.col("waste"), F.col("span")) - 1
    fault = (
        F.when(~F.col("category").isin(*CATEGORIES), "unknown category")
        .when((F.col("category") == "beyond-prompt") & (F.col("field") != "answer"), "beyond-prompt is for answers only")
        .when(F.coalesce(F.length(F.trim("reason")) == 0, F.lit(True)), "a reason is needed")
        .when(occurrences(F.col("span"), F.col("waste")) != 1, "the waste does not occur once in its span")
        .when(occurrences(F.col(text), F.col("span")) != 1, "the span does not occur once")
    )
    found = df.withColumn("start", start.cast("long")).withColumn("end", (start + F.length("span")).cast("long"))
    found = found.withColumn("waste_start", (start + inner).cast("long")).withColumn("waste_end", (start + inner + F.length("waste")).cast("long"))
    w = Window.partitionBy(*keys, "field").orderBy("start")
    return found.withColumn("fault", F.coalesce(fault, F.when(F.lead("start").over(w) < F.col("end"), "the span overlaps the next one")))


def removals(located: DataFrame, *keys: str) -> DataFrame:
    """(keys, field, edits): edits that delete the waste that is not retained, in order."""
    left = F.concat(F.substring("span", F.lit(1), (F.col("waste_start") - F.col("start")).cast("int")), F.substring("span", (F.col("waste_end") - F.col("start") + 1).cast("int"), F.length("span")))
    rows = located.filter("fault IS NULL AND NOT coalesce(retained, false)").select(*keys, "field", F.struct("start", F.col("span").alias("old"), left.alias("new")).alias("e"))
    return rows.groupBy(*keys, "field").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: F.struct(e["old"].alias("old"), e["new"].alias("new"))).alias("edits"))


def waste_report(located: DataFrame, offsets: Column, total: int, limit: int, *keys: str) -> DataFrame:
    """(keys, category, removed, retained, share, remaining, budget): tokens that start inside waste, by category."""
    n = F.size(F.filter(offsets, lambda o: (o >= F.col("waste_start")) & (o < F.col("waste_end"))))
    kept = F.coalesce("retained", F.lit(False))
    out = located.filter("fault IS NULL").groupBy(*keys, "category").agg(F.sum(F.when(kept, 0).otherwise(n)).cast("long").alias("removed"), F.sum(F.when(kept, n).otherwise(0)).cast("long").alias("retained"))
    return out.withColumn("share", F.col("removed") / F.lit(float(total))).withColumn("remaining", F.lit(total) - F.col("removed")).withColumn("budget", F.lit(limit))


def span_means(df: DataFrame, log_probs: Column, offsets: Column, spans: dict[str, tuple[Column, Column]], *keys: str) -> DataFrame:
    """Mean log-prob of the tokens in each span and, as ``both``, over all of them by token; nulls are left out."""
    tokens = F.arrays_zip(offsets.alias("o"), log_probs.alias("p"))

    def parts(low: Column, high: Column) -> Column:
        return F.transform(F.filter(tokens, lambda t: (t["o"] >= low) & (t["o"] < high) & t["p"].isNotNull()), lambda t: t["p"])

    def mean(values: Column) -> Column:
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))

    each = {name: parts(*bounds) for name, bounds in spans.items()}
    return df.select(*keys, *[mean(v).alias(name) for name, v in each.items()], mean(F.concat(*each.values())).alias("both"))


def shift(saved: DataFrame, candidate: DataFrame, key: str, *spans: str) -> DataFrame:
    """(key, span shifts): candidate less saved, null where either lacks the span."""
    other = candidate.select(key, *[F.col(s).alias(f"__{s}") for s in spans])
    return saved.join(other, key, "left").select(key, *[(F.col(f"__{s}") - F.col(s)).alias(s) for s in spans])


def body_matches(body: Column, digest: Column) -> Column:
    """Whether the text, with or without a newline at its end, has the recorded SHA-256."""
    bare = F.regexp_replace(body, r"\n\z", "")
    return (F.sha2(body, 256) == digest) | (F.sha2(bare, 256) == digest) | (F.sha2(F.concat(body, F.lit("\n")), 256) == digest)


def fits(tokens: Column, reserve: Column | int, window: Column | int) -> Column:
    return tokens + (reserve if isinstance(reserve, Column) else F.lit(reserve)) <= (window if isinstance(window, Column) else F.lit(window))


def without_outer_newlines(text: Column) -> Column:
    return F.trim(text, F.lit("\n"))


def overlap_mask(offsets: Column, spans: Column) -> Column:
    """For each token (struct start, end), whether it overlaps one of the spans (structs start, end)."""
    return F.transform(offsets, lambda t: F.exists(spans, lambda s: (t["start"] < s["end"]) & (t["end"] > s["start"])))


def crossing_tokens(offsets: Column, spans: Column) -> Column:
    """Tokens that lie partly inside a span."""
    return F.filter(offsets, lambda t: F.exists(spans, lambda s: (t["start"] < s["end"]) & (t["end"] > s["start"]) & ((t["start"] < s["start"]) | (t["end"] > s["end"]))))


def delimiter_bounds(text: Column, opening: str, closing: str, start: Column, end: Column) -> Column:
    """Whether exactly one opening mark ends before the body at [start, end), and a closing one follows it."""
    head, tail = F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
    return (occurrences(head, F.lit(opening)) == 1) & F.contains(tail, F.lit(closing))
