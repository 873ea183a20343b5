"""Identities, duplicates, conflicts, distributions and token budgets of whole sets of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import identity_tree
from millrace.operators.order import running_sum
from millrace.session import settle


def row_digest(*columns: str) -> Column:
    """SHA-256 of the row as JSON with sorted keys, nulls kept: equal rows only have equal digests, whatever the column order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def ordered_digest(df: DataFrame, order: str, piece: Column, into: str) -> DataFrame:
    """One row: SHA-256 over the binary pieces in order (then by piece), and n_rows.

    Such a digest is defined from front to back, so one task must see all pieces. They are sorted and written by ranges
    first, in parallel; the one task only reads these files one after the other, a batch at a time. identity_tree has
    no such task.
    """
    pieces = settle(df.select(F.col(order).alias("o"), piece.alias("piece")).orderBy("o", "piece"), "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n = hashlib.sha256(), 0
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                system, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
                found = system.get_file_info(fs.FileSelector(path))
                for name in sorted(f.path for f in found if f.base_name.startswith("part-")):  # parts are numbered by range
                    with system.open_input_file(name) as handle:
                        for rows in pq.ParquetFile(handle).iter_batches(columns=["piece"]):
                            for x in rows.column("piece").to_pylist():
                                if x is not None:
                                    digest.update(x)
                            n += rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], [into, "n_rows"])

    spark = df.sparkSession
    return spark.range(1).select(F.lit(pieces.settled_at).alias("folder")).coalesce(1).mapInArrow(run, f"`{into}` string, n_rows long")


def fingerprint(df: DataFrame, order: str, *columns: str) -> DataFrame:
    """One row: SHA-256 over the binary row digests in order. tree_fingerprint, another value, needs no task that sees all digests."""
    return ordered_digest(df, order, F.unhex(row_digest(*columns)), "fingerprint")


def tree_fingerprint(df: DataFrame, order: str, *columns: str, chunk: int = 100_000) -> DataFrame:
    """As fingerprint(), over the fingerprints of runs of ``chunk`` order values, and over those of ``chunk`` runs, up to one: no row holds more."""
    return identity_tree.root(identity_tree.tree(df, order, row_digest(*columns), chunk, 1)).select("fingerprint", "n_rows")


def run_fingerprint(df: DataFrame, order: str, *columns: str, chunk: int = 100_000) -> DataFrame:
    """As tree_fingerprint(), of two levels however many runs there are: the fingerprints of all runs are digested from front to back, a ``chunk``-th of what fingerprint() reads."""
    identity_tree.last(df, order)
    runs = settle(identity_tree.leaves(df, order, row_digest(*columns), chunk), "runs")
    return ordered_digest(runs, "node", F.unhex("digest"), "fingerprint").select("fingerprint").crossJoin(runs.agg(F.sum("n").cast("long").alias("n_rows")))


def duplicates(df: DataFrame, digest: Column, index: str) -> DataFrame:
    """(digest, n_rows, first_row, rows): groups of two rows or more, ascending; counts first, so that only rows of groups are gathered."""
    keyed = df.select(digest.alias("digest"), F.col(index).alias("i"))
    groups = keyed.groupBy("digest").agg(F.count("*").alias("n_rows"), F.min("i").alias("first_row")).filter("n_rows > 1")
    rows = keyed.join(groups.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.sort_array(F.collect_list("i")).alias("rows"))
    return groups.join(rows, "digest")


def duplicate_rows(df: DataFrame, digest: Column, index: str) -> DataFrame:
    """(digest, row): the rows of duplicates() one by one, so that a group of any size is never gathered."""
    keyed = df.select(digest.alias("digest"), F.col(index).alias("row"))
    groups = keyed.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    return keyed.join(groups, "digest", "left_semi")


def conflicting_labels(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """Keys with more than one label."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows"), F.min(label).alias("low"), F.max(label).alias("high")).filter("low < high")


def conflicting_preferences(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """(prompt, a, b, n_rows) for pairs of answers that rows prefer both ways."""
    a, b = F.least(chosen, rejected), F.greatest(chosen, rejected)
    sides = df.filter(F.col(chosen) != F.col(rejected)).groupBy(F.col(prompt).alias("prompt"), a.alias("a"), b.alias("b"))
    return sides.agg(F.count("*").alias("n_rows"), F.count_if(F.col(chosen) == a).alias("one"), F.count_if(F.col(chosen) == b).alias("other")).filter("one > 0 AND other > 0").select("prompt", "a", "b", "n_rows")


def identical_preferences(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    return df.filter(F.col(chosen).eqNullSafe(F.col(rejected)))


def _places(df: DataFrame, value: Column, by: tuple[str, ...], wanted: dict[str, Column]) -> DataFrame:
    """(by, count, wanted...): for each name the value at a place, from 0, of a group's sorted values; places may use ``count``.

    Equal values are counted first, and the counts are summed over ranges of (by, value), so no task holds a group.
    """
    counts = df.select(*by, value.cast("double").alias("v")).filter("v IS NOT NULL").groupBy(*by, "v").agg(F.count("*").alias("c"))
    summed = running_sum(counts, "c", *by, "v")
    sizes = summed.groupBy(*by).agg(F.min("before").alias("__base"), F.sum("c").alias("count")).select(*[F.col(c).alias(f"__{c}") for c in by], "__base", "count")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))
    placed = summed.join(sizes, same) if by else summed.crossJoin(F.broadcast(sizes))
    low = F.col("before") - F.col("__base")
    at = [F.max(F.when((low <= place) & (place < low + F.col("c")), F.col("v"))).alias(name) for name, place in wanted.items()]
    return placed.groupBy(*by).agg(F.first("count").alias("count"), *at)


def _joined(a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Both sides' columns, by group; a group may be null."""
    if not by:
        return a.crossJoin(b)
    other = b.select(*[F.col(c).alias(f"__{c}") if c in by else F.col(c) for c in b.columns])
    return a.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])).drop(*[f"__{c}" for c in by])


def length_summary(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """count, min, mean, median, p90 and max; p90 is the sorted value at place min(n - 1, int(0.9 n)), from 0."""
    n = F.col("count")
    places = {"__low": F.floor((n - 1) / 2), "__high": F.ceil((n - 1) / 2), "p90": F.least(n - 1, F.floor(F.lit(0.9) * n).cast("long"))}
    found = _places(df, value, by, places)
    total = df.select(*by, value.cast("double").alias("v")).filter("v IS NOT NULL").groupBy(*by).agg(F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"))
    out = _joined(found, total, by)
    return out.select(*by, "count", "min", "mean", ((F.col("__low") + F.col("__high")) / 2).alias("median"), "p90", "max")


def distribution(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """min, max, mean and linearly interpolated p50, p95 and p99; nulls without values."""
    shares = (0.5, 0.95, 0.99)
    place = lambda p: F.lit(p) * (F.col("count") - 1)
    found = _places(df, value, by, {f"__{end}{int(100 * p)}": whole(place(p)) for p in shares for end, whole in (("low", F.floor), ("high", F.ceil))})
    between = [(F.col(f"__low{int(100 * p)}") + (F.col(f"__high{int(100 * p)}") - F.col(f"__low{int(100 * p)}")) * (place(p) - F.floor(place(p)))).alias(f"p{int(100 * p)}") for p in shares]
    v = value.cast("double")
    total = df.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))
    chosen = found.select(*by, *between)
    if not by:
        return total.join(chosen, F.lit(True), "left")
    other = chosen.select(*[F.col(c).alias(f"__{c}") if c in by else F.col(c) for c in chosen.columns])
    return total.join(other, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]), "left").drop(*[f"__{c}" for c in by])


def kept_window(ids: Column, most: int, mode: str) -> Column:
    """The first or last ``most`` ids."""
    return F.slice(ids, F.lit(1), F.lit(most)) if mode == "keep_start" else F.slice(ids, F.greatest(F.size(ids) - most + 1, F.lit(1)), F.lit(most))


def shifted(ids: Column, prompt_tokens: Column) -> Column:
    """struct(input_ids, labels): all ids but the last, and each one's next id, -100 while that belongs to the prompt."""
    n = F.size(ids)
    labels = F.transform(F.slice(ids, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, i: F.when(i + 1 < prompt_tokens, F.lit(-100)).otherwise(x))
    return F.struct(F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("input_ids"), labels.alias("labels"))


def folded_labels(ids: Column, *masks: Column) -> Column:
    """The ids where all masks are 1, else -100."""
    return F.transform(ids, lambda x, i: F.when(reduce(Column.__and__, [F.get(m, i) == 1 for m in masks], F.lit(True)), x).otherwise(F.lit(-100)))


def loss_positions(labels: Column, document_starts: Column | None = None) -> Column:
    """Labels that count: not -100, and not at the start of a document."""
    if document_starts is None:
        return F.size(F.filter(labels, lambda x, i: (x != -100) & (i > 0)))
    return F.size(F.filter(labels, lambda x, i: (x != -100) & ~F.array_contains(document_starts, i)))


def document_starts(lengths: Column) -> Column:
    """Places at which documents of these lengths begin."""
    return F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x.cast("int")))


def split_totals(df: DataFrame, tokens: str, loss: str, error: str, most: int, method: str, *by: str) -> DataFrame:
    """Token totals of a split; any row error makes them null. ``method`` decides which long rows are dropped:
    sft drops rows left without loss, reward and dpo drop rows over ``most``, kto truncates only."""
    over = F.col(tokens) > most
    lost = {"sft": F.col(loss) == 0, "reward": over, "dpo": over, "kto": F.lit(False)}[method]
    kept = F.when(lost, 0).otherwise(F.least(F.col(tokens), F.lit(most)))
    bad = F.count_if(F.col(error).isNotNull())
    whole = lambda c: F.when(bad == 0, c)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        bad.alias("n_errors"),
        whole(F.sum(tokens)).alias("raw_tokens"),
        whole(F.sum(kept)).alias("retained_tokens"),
        whole(F.sum(F.col(tokens) - kept)).alias("discarded_tokens"),
        whole(F.sum(F.when(lost, 0).otherwise(F.col(loss)))).alias("loss_tokens"),
        whole(F.count_if(over & ~lost)).alias("truncated_rows"),
        whole(F.count_if(lost)).alias("dropped_rows"),
        whole(F.count_if(F.col(loss) == 0)).alias("zero_loss_rows"),
    )


def first_example(df: DataFrame, order: str, ids: str, labels: str) -> DataFrame:
    """One row: the first row's ids, those that are trained (label not -100), their counts and what the mask says."""
    kept = F.filter(F.arrays_zip(F.col(ids).alias("id"), F.col(labels).alias("label")), lambda x: x["label"] != -100)
    first = df.orderBy(order).limit(1).select(F.col(ids).alias("ids"), F.transform(kept, lambda x: x["id"]).alias("trained_ids"))
    n, trained = F.size("ids"), F.size("trained_ids")
    return first.select("ids", "trained_ids", n.alias("tokens"), trained.alias("trained_tokens"), F.when(trained == 0, "nothing is trained").when(trained == n, "all tokens are trained").alias("note"))


def findings(metrics: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(code, severity, evidence) of the rules whose SQL condition holds on the one row of ``metrics``.

    A rule is (code, severity, condition, evidence as SQL).
    """
    made = [F.when(F.expr(condition), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.expr(evidence).cast("string").alias("evidence"))) for code, severity, condition, evidence in rules]
    return metrics.select(F.explode(F.array_compact(F.array(*made))).alias("f")).select("f.*")


def batch_budget(config: DataFrame) -> DataFrame:
    """Effective batch, groups, dropped rows, updates and whether warmup swallows them, from one row of settings."""
    effective = F.col("devices") * F.col("per_device") * F.col("accumulation")
    groups = F.floor(effective / F.col("generations"))
    updates = F.ceil(F.col("n_rows") / effective)
    return config.select("*", effective.alias("effective_batch"), groups.alias("prompts_per_batch"), (F.col("n_rows") % effective).alias("dropped_rows"), updates.alias("updates_per_epoch"), (F.col("warmup") >= updates * F.col("epochs")).alias("warmup_too_long"))


def padding(df: DataFrame, batch: Column, length: Column) -> DataFrame:
    """(batch, n_rows, tokens, slots, padding_percent): slots are rows times the longest."""
    out = df.groupBy(batch.alias("batch")).agg(F.count("*").alias("n_rows"), F.sum(length).cast("long").alias("tokens"), (F.count("*") * F.max(length)).cast("long").alias("slots"))
    return out.withColumn("padding_percent", F.lit(100.0) * (F.col("slots") - F.col("tokens")) / F.col("slots"))


def accounting(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Rows, scored rows, unscored rows and the mean of the scored: no row goes uncounted."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count(value).alias("scored"), F.count_if(F.col(value).isNull()).alias("unscored"), F.avg(value).alias("mean"))


def metric_means(df: DataFrame, metrics: str, *by: str) -> DataFrame:
    """(by, metric, mean, metric_rows) of a map column, over the rows that have each metric; a nonfinite value is an error."""
    rows = df.select(*by, F.explode(metrics).alias("metric", "v")).filter("v IS NOT NULL")
    bad = F.isnan("v") | (F.abs("v") == float("inf"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("nonfinite value of "), F.col("metric"))).cast("double")).otherwise(F.col("v"))
    return rows.groupBy(*by, "metric").agg(F.avg(checked).alias("mean"), F.count("*").alias("metric_rows"))


def corpus_loss(df: DataFrame, nll: str, tokens: str, *by: str) -> DataFrame:
    """Loss by token over the corpus and its perplexity, null where that overflows."""
    out = df.groupBy(*by).agg(F.try_divide(F.sum(nll), F.sum(tokens)).alias("loss"), F.sum(tokens).alias("tokens"))
    return out.withColumn("perplexity", F.when(F.col("loss") < 709.78, F.exp("loss")))


def class_accuracy(df: DataFrame, expected: str, correct: str) -> DataFrame:
    return df.groupBy(expected).agg(F.count("*").alias("support"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def preview(values: Column, n: int = 5) -> Column:
    """struct(count, first): a long list as its size and its first items."""
    return F.struct(F.size(values).cast("long").alias("count"), F.slice(values, 1, n).alias("first"))


def affected_share(hit_rows: Column, source_rows: Column) -> Column:
    """Percent of source rows, never of packed ones."""
    return F.round(F.lit(100.0) * hit_rows / source_rows, 6)


def type_conflicts(df: DataFrame, json: str, index: str) -> DataFrame:
    """(path, kinds, first_a, first_b): fields of JSON objects with values of two kinds, and the first row of either kind."""
    fields = df.select(F.col(index).alias("i"), F.explode(F.from_json(json, "map<string,string>")).alias("path", "v"), F.col(json).alias("j"))
    # the kind is read off the raw value, since from_json gives strings without quotes
    raw = F.try_variant_get(F.try_parse_json("j"), F.concat(F.lit("$['"), F.col("path"), F.lit("']")), "variant")
    kind = F.regexp_replace(F.lower(F.schema_of_variant(raw)), r"[<(].*$", "")
    kind = F.when(kind.isin("bigint", "double", "decimal"), "number").when(kind == "object", "object").otherwise(kind)
    kinds = fields.withColumn("kind", kind).filter("kind <> 'void'").groupBy("path", "kind").agg(F.min("i").alias("first"))
    both = kinds.groupBy("path").agg(F.sort_array(F.collect_list("kind")).alias("kinds"), F.min("first").alias("first_a"), F.max("first").alias("first_b"))
    return both.filter(F.size("kinds") > 1)


def packed_contributions(df: DataFrame, packed: str, source: str, tokens: str) -> DataFrame:
    """Tokens of each source row in packed sequences: (packed, source, tokens)."""
    return df.groupBy(packed, source).agg(F.sum(tokens).cast("long").alias("tokens"))


def retention(before: DataFrame, after: DataFrame, source: str, tokens: str) -> DataFrame:
    """Source rows whose supervised tokens changed between two stages: (source, before, after)."""
    a = before.groupBy(source).agg(F.sum(tokens).alias("before"))
    b = after.groupBy(source).agg(F.sum(tokens).alias("after"))
    return a.join(b, source, "full_outer").na.fill(0, ["before", "after"]).filter("before <> after")


def off_policy(df: DataFrame, order: str, log_prob: str, n: int, low: float) -> DataFrame:
    """Of the first ``n`` rows: mean log-prob, scored rows, those below ``low``, and those without response."""
    return df.orderBy(order).limit(n).agg(F.avg(log_prob).alias("mean"), F.count(log_prob).alias("scored"), F.count_if(F.col(log_prob) < low).alias("below"), F.count_if(F.col(log_prob).isNull()).alias("no_response"))


def response_log_prob(log_probs: Column, context_tokens: Column) -> Column:
    """Mean over the response's tokens, which start at max(context, 1) - 1 in the shifted sequence; null without any."""
    start = F.greatest(context_tokens, F.lit(1)) - 1
    part = F.slice(log_probs, start + 1, F.greatest(F.size(log_probs) - start, F.lit(0)))
    return F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part))


def starts_with(full: Column, prefix: Column) -> Column:
    """Whether a token list begins with another."""
    return F.slice(full, F.lit(1), F.size(prefix)) == prefix


def with_end(text: Column, end: str) -> Column:
    """The text with the end string, added only if it is absent."""
    return F.when(text.endswith(end), text).otherwise(F.concat(text, F.lit(end)))
