"""Queries of metric series over events: user_id as series, event_id as step, value as loss."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import pairs, routing, series
from millrace.plans.registry import register, table
from millrace.streaming import metrics

_V = "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"))


@register(
    "metric_changes",
    f"""WITH e AS (SELECT event_id, user_id, {_V} AS v FROM events)
    SELECT event_id, user_id, round(v - last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS change, coalesce(v < 10 OR v > 90, false) AS out_of_range FROM e""",
)
def metric_changes(spark, sf_dir):
    out = series.changes(_events(spark, sf_dir), "user_id", "event_id", "value", 10.0, 90.0)
    return out.select("event_id", "user_id", F.round("change", 6).alias("change"), F.coalesce("out_of_range", F.lit(False)).alias("out_of_range"))


@register(
    "baseline_delta",
    f"""WITH e AS (SELECT event_id, user_id, {_V} AS v FROM events)
    SELECT event_id, round(first_value(v IGNORE NULLS) OVER w, 6) AS baseline, round(last_value(v IGNORE NULLS) OVER w, 6) AS carried, round(last_value(v IGNORE NULLS) OVER w - first_value(v IGNORE NULLS) OVER w, 6) AS delta FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def baseline_delta(spark, sf_dir):
    out = series.baseline_delta(_events(spark, sf_dir), "user_id", "event_id", "value")
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("baseline", "carried", "delta")])


@register("loss_curves", "SELECT event_type, event_id // 20 AS step, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def loss_curves(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("step", F.floor(F.col("event_id") / 20))
    return series.curve(events, "step", "event_id", "value", "event_type")


@register(
    "metric_recap",
    "SELECT user_id, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, min(event_id) AS first_step, max(event_id) AS last_step, round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS delta, round((arg_max(value, event_id) - arg_min(value, event_id)) / nullif(abs(arg_min(value, event_id)), 0), 6) AS relative FROM events GROUP BY user_id",
)
def metric_recap(spark, sf_dir):
    out = series.recap(table(spark, sf_dir, "events"), "event_id", "value", "user_id")
    return out.withColumn("delta", F.round("delta", 6)).withColumn("relative", F.round("relative", 6))


@register(
    "epoch_running_mean",
    """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, CAST(round(value * 100) AS BIGINT) AS value FROM events), m AS (SELECT event_id, day, avg(value) OVER (PARTITION BY day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM e)
    SELECT event_id, round(r, 6) AS running_mean, round(r - lag(r) OVER (PARTITION BY day ORDER BY event_id), 6) AS mean_change FROM m""",
)
def epoch_running_mean(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    out = series.epoch_means(events, "day", "event_id", "value")
    return out.select("event_id", F.round("running_mean", 6).alias("running_mean"), F.round("mean_change", 6).alias("mean_change"))


@register(
    "best_checkpoint",
    "WITH l AS (SELECT event_id // 100 AS step, round(avg(value), 4) AS eval_loss FROM events GROUP BY 1), c AS (SELECT DISTINCT event_id // 100 AS step FROM events WHERE event_id % 100 < 50) SELECT c.step, l.eval_loss, coalesce(l.eval_loss = (SELECT min(eval_loss) FROM l), false) AS best FROM c LEFT JOIN l USING (step)",
)
def best_checkpoint(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("step", F.floor(F.col("event_id") / 100))
    losses = events.groupBy("step").agg(F.round(F.avg("value"), 4).alias("eval_loss"))
    return pairs.best_steps(events.filter("event_id % 100 < 50").select("step").distinct(), losses)


@register(
    "asof_previous",
    "SELECT a.event_id, (SELECT arg_max(b.value, b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_id <= a.event_id AND b.event_id % 3 = 0) AS before FROM events a WHERE a.event_id % 3 = 1",
)
def asof_previous(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    left, right = events.filter("event_id % 3 = 1").drop("value"), events.filter("event_id % 3 = 0")
    return pairs.as_of(left, right, "user_id", "event_id", "value", "before").select("event_id", "before")


@register(
    "already_recorded",
    "SELECT event_id, user_id FROM events e WHERE EXISTS (SELECT 1 FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'view' AND b.event_id < 200)",
)
def already_recorded(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    known = events.filter("event_id < 200 AND event_type = 'view'").select("user_id", F.lit("baseline").alias("kind"))
    return pairs.already_recorded(events.select("event_id", "user_id"), known, "user_id")


@register(
    "loss_raster_all",
    """WITH p AS (SELECT event_id AS s, value AS v FROM events), e AS (SELECT max(s) AS s1, min(v) AS v0, max(v) AS v1 FROM p)
    SELECT CAST(round_even(s / s1 * 38.0, 0) AS BIGINT) AS x, CAST(round_even((v1 - v) / (v1 - v0) * 12.0, 0) AS BIGINT) AS y, count(*) AS n FROM p, e GROUP BY 1, 2""",
)
def loss_raster_all(spark, sf_dir):
    return series.raster(table(spark, sf_dir, "events"), F.col("event_id"), F.col("value"))


@register("nonfinite_notices", "SELECT event_id, 'ratio' AS metric, count(*) AS n FROM events WHERE value = 0 OR event_id % 50 = 0 GROUP BY 1")
def nonfinite_notices(spark, sf_dir):
    ratio = F.when((F.col("value") == 0) | (F.col("event_id") % 50 == 0), F.lit(float("nan"))).otherwise(F.col("value"))
    maps = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("ratio"), ratio).alias("log"))
    return series.nonfinite_notices(maps, "log", "event_id").groupBy("event_id", "metric").agg(F.count("*").alias("n"))


@register(
    "drift",
    "SELECT event_type, count(*) AS n, round(sum(abs(value - 50)) / count(*), 6) AS mean_drift, round(coalesce(sum(abs(value - 50)) / nullif(sum(abs(value)), 0), 0), 6) AS consistency FROM events GROUP BY event_type",
)
def drift(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("now"), F.lit(50.0).alias("base"), F.col("value").alias("moved"))
    out = series.drift(events, "event_type")
    return out.select("event_type", "n", F.round("mean_drift", 6).alias("mean_drift"), F.round("consistency", 6).alias("consistency"))


@register(
    "warning_counts",
    "SELECT event_type AS logger, 'warning' AS level, CAST(user_id % 5 AS VARCHAR) AS message, count(*) AS n, array_to_string(list_sort(list_distinct(list(CAST(user_id % 3 AS VARCHAR)))), ',') AS sources FROM events GROUP BY 1, 2, 3",
)
def warning_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("logger"), F.lit("warning").alias("level"), (F.col("user_id") % 5).cast("string").alias("message"), (F.col("user_id") % 3).cast("string").alias("source"))
    return series.warnings(events).withColumn("sources", F.array_join("sources", ","))


@register(
    "source_failures",
    "SELECT user_id AS source, arg_max(event_type, event_id) AS last_operation, arg_min('event ' || event_id, event_id) FILTER (value > 90) AS first_failure FROM events GROUP BY user_id",
)
def source_failures(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("operation"), F.col("event_id").alias("seq"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"), (F.col("value") <= 90).alias("cascading"))
    return series.failures(events)


@register("request_states", "SELECT state, count(*) AS n FROM (SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id) GROUP BY state")
def request_states(spark, sf_dir):
    return metrics.request_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), F.col("event_type").alias("state")))


@register(
    "silence_gaps",
    'SELECT user_id, ts AS "from", n AS "to" FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) WHERE epoch(n) - epoch(ts) > 86400 * 3',
)
def silence_gaps(spark, sf_dir):
    return metrics.silences(table(spark, sf_dir, "events"), "user_id", "ts", 86400.0 * 3)


@register("module_counts", "SELECT regexp_extract(n, '^(.*?)(?:\\.\\d+(?:\\.|$)|$)', 1) AS prefix, count(*) AS n FROM (SELECT event_type || '.' || (user_id % 4) || '.w' AS n FROM events) GROUP BY 1")
def module_counts(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.concat_ws(".", "event_type", (F.col("user_id") % 4).cast("string"), F.lit("w")).alias("name"))
    return routing.module_counts(names)


@register(
    "config_difference_all",
    """WITH a AS (SELECT 'f' || doc_id AS path, lang AS v FROM documents), b AS (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS v FROM documents)
    SELECT path, 'different' AS state, a.v AS a_value, b.v AS b_value FROM a JOIN b USING (path) WHERE a.v IS DISTINCT FROM b.v AND path <> 'f5'""",
)
def config_difference_all(spark, sf_dir):
    """All documents as rows of path and value, none gathered in one map."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "lang")
    changed = F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang"))
    return pairs.config_difference(docs.select("path", F.col("lang").alias("value")), docs.select("path", changed.alias("value")), ("f5",))
