"""Queries of operators over rows one by one, ranks, selections, carried values and planted faults."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import quality
from millrace.operators import best_fit, chunking, methods, pairs, profile, quantize, routing, series
from millrace.plans.registry import register, table
from millrace.session import scratch
from millrace.sources import runs, storage
from millrace.streaming import metrics, rounds, stages


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@register("duplicate_rows", "SELECT sha256(text) AS digest, doc_id AS row FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(_docs(spark, sf_dir), F.sha2("text", 256), "doc_id")


@register(
    "overlap_rows",
    """WITH d AS (SELECT sha256(text) AS digest, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'eval' ELSE 'train' END AS side FROM documents), b AS (SELECT digest FROM d GROUP BY 1 HAVING count(DISTINCT side) = 2)
    SELECT digest, side, doc_id AS row FROM d WHERE digest IN (SELECT digest FROM b)""",
)
def overlap_rows(spark, sf_dir):
    keyed = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("digest"))
    return pairs.overlap_rows(keyed.filter("doc_id % 5 <> 0"), keyed.filter("doc_id % 5 = 0"), "digest", "doc_id")


@register(
    "length_summary_by",
    """WITH n AS (SELECT lang, length(text) AS n FROM documents)
    SELECT lang, count(*) AS count, CAST(min(n) AS DOUBLE) AS min, round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS median, CAST(list_sort(list(n))[CAST(least(count(*) - 1, floor(0.9 * count(*))) AS BIGINT) + 1] AS DOUBLE) AS p90, CAST(max(n) AS DOUBLE) AS max FROM n GROUP BY lang""",
)
def length_summary_by(spark, sf_dir):
    found = profile.length_summary(_docs(spark, sf_dir), F.length("text"), "lang")
    return found.withColumn("mean", F.round("mean", 6))


@register(
    "distribution_by",
    """SELECT event_type, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
)
def distribution_by(spark, sf_dir):
    found = profile.distribution(_events(spark, sf_dir), F.col("value"), "event_type")
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in found.columns if c != "event_type"])


@register(
    "evaluation_carried",
    """SELECT event_id, round(last_value(CASE WHEN event_id % 7 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS evaluation FROM events""",
)
def evaluation_carried(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("loss", F.when(F.col("event_id") % 7 == 0, F.col("value")))
    return series.carried_forward(rows, "user_id", "event_id", "loss", "evaluation").select("event_id", F.round("evaluation", 6).alias("evaluation"))


@register(
    "selection_faults",
    """SELECT CAST(n AS BIGINT) AS layer, CAST(NULL AS BIGINT) AS expert, 'no selection' AS fault FROM range(0, 12) t(n) WHERE n NOT IN (SELECT user_id % 10 FROM events)
    UNION ALL SELECT DISTINCT user_id % 10, CAST(floor(value) AS BIGINT) - 3, 'no such expert' FROM events WHERE floor(value) - 3 < 0 OR floor(value) - 3 >= 64""",
)
def selection_faults(spark, sf_dir):
    selected = _events(spark, sf_dir).select((F.col("user_id") % 10).alias("layer"), (F.floor("value") - 3).alias("expert"))
    return routing.selection_faults(selected, spark.range(12).select(F.col("id").alias("layer")), 64)


@register(
    "round_trip_counters",
    """SELECT event_type, count(*) AS tensors, count(*) FILTER (user_id % 2 = 0) AS value_exact, count(*) FILTER (user_id % 3 = 0) AS codes_exact, count(*) FILTER (event_id % 4 = 0) AS scales_exact, CAST(sum(user_id % 5) AS BIGINT) AS negative_zeros, CAST(sum(event_id % 2) AS BIGINT) AS zero_blocks, count(*) FILTER (event_id % 4 = 1) AS one_off FROM events GROUP BY event_type""",
)
def round_trip_counters(spark, sf_dir):
    gap = (F.col("event_id") % 4).cast("int")
    rows = _events(spark, sf_dir).select(
        "event_type",
        (F.col("user_id") % 2 == 0).alias("value_exact"),
        (F.col("user_id") % 3 == 0).alias("codes_exact"),
        F.array(gap, F.lit(5)).alias("scales"),
        F.array(F.lit(0), F.lit(5)).alias("again"),
        (F.col("user_id") % 5).alias("negative_zeros"),
        (F.col("event_id") % 2).alias("zero_blocks"),
    )
    found = quantize.round_trip_counters(rows, "event_type")
    return found.withColumn("one_off", F.coalesce(F.try_element_at("scale_ratios", F.lit(1)), F.lit(0).cast("long"))).drop("scale_ratios")


@register(
    "split_contributions",
    "SELECT CAST(doc_id AS BIGINT) AS doc_id, count(*) AS pieces, CAST(sum(l) AS BIGINT) AS tokens FROM (SELECT doc_id, least(512, n - s) AS l FROM (SELECT doc_id, n, unnest(range(0, n, 512)) AS s FROM (SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS n FROM documents))) GROUP BY doc_id",
)
def split_contributions(spark, sf_dir):
    """Pieces and tokens of each document in best-fit bins of 512 with long rows cut."""
    rows = _docs(spark, sf_dir).select("doc_id", chunking.estimated_tokens(F.col("text")).alias("tokens"))
    found = best_fit.best_fit_pieces(rows, "doc_id", "tokens", 512)
    return found.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("length").cast("long").alias("tokens"))


@register(
    "planted_conflicts",
    """WITH r AS (SELECT CAST(doc_id % 50 AS VARCHAR) AS field, CASE WHEN doc_id % 100 < 50 THEN 'string' ELSE 'number' END AS kind, doc_id FROM documents)
    SELECT 'f' || field AS path, min(doc_id) FILTER (kind = 'string') AS a, min(doc_id) FILTER (kind = 'number') AS b FROM r GROUP BY field HAVING count(DISTINCT kind) = 2""",
)
def planted_conflicts(spark, sf_dir):
    """Fields that one half of the rows writes as numbers and the other as strings."""
    name = F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string"))
    value = F.when(F.col("doc_id") % 100 < 50, F.lit('"x"')).otherwise(F.lit("7"))
    rows = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit('{"'), name, F.lit('": '), value, F.lit("}")).alias("row"))
    found = profile.type_conflicts(rows, "row", "doc_id")
    return found.select("path", F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))


@register(
    "label_disagreements",
    "SELECT text, count(*) AS n_rows FROM (SELECT text, source || '/' || (doc_id % 2) AS label FROM documents) GROUP BY text HAVING min(label) < max(label)",
)
def label_disagreements(spark, sf_dir):
    """Equal texts that carry different labels; repeated texts of both parities make some."""
    rows = _docs(spark, sf_dir).select("text", F.concat_ws("/", "source", (F.col("doc_id") % 2).cast("string")).alias("label"))
    return profile.conflicting_labels(rows, ["text"], "label").select("text", "n_rows")


@register(
    "classification_accuracy",
    """WITH l AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS expected, CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS said FROM labels)
    SELECT expected, count(*) AS support, round(avg(CASE WHEN expected = said THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l GROUP BY expected""",
)
def classification_accuracy(spark, sf_dir):
    """Scores of one column of labels against the other, by class."""
    said = F.when(F.col("toxic") == 1, " BAD ").otherwise("Good")
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("expected"), said.alias("said"))
    scored = rows.select("expected", quality.label_scores(F.col("said"), F.array(F.lit("good"), F.lit("bad")), F.col("expected"))["score"].alias("score"))
    found = profile.class_accuracy(scored, "expected", "score")
    return found.select("expected", "support", F.round("accuracy", 6).alias("accuracy"))


@register(
    "answer_overlap",
    r"""WITH b AS (SELECT item_id, text, lower(regexp_replace(text, '[^a-zA-Z ]', '', 'g')) AS t FROM benchmark), w AS (SELECT item_id, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM b),
    h AS (SELECT item_id, w[1:CAST(ceil(len(w) / 2.0) AS BIGINT)] AS g, w FROM w)
    SELECT item_id, round(2.0 * len(g) / (len(g) + len(w)), 6) AS score FROM h""",
)
def answer_overlap(spark, sf_dir):
    """The first half of each item's words against all of them."""
    clean = F.regexp_replace("text", "[^a-zA-Z ]", "")
    words = F.filter(F.split(clean, " "), lambda x: x != "")
    half = F.slice(words, F.lit(1), F.ceil(F.size(words) / 2).cast("int"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", quality.answer_scores(F.array_join(half, " "), F.array(F.array_join(words, " ")))["score"].alias("score"))
    return rows.select("item_id", F.round("score", 6).alias("score"))


@register("stream_state", "SELECT event_type AS metric, count(*) AS n, round(arg_max(value, event_id), 6) AS last FROM events GROUP BY event_type")
def stream_state(spark, sf_dir):
    """The whole state that a stream has reached, written anew with each batch."""
    folder = scratch(spark, "state")
    record = F.struct(F.col("event_id").alias("step"), F.create_map("event_type", "value").alias("log"))
    _events(spark, sf_dir).select(F.to_json(record, {"ignoreNullFields": "false"}).alias("line")).write.text(folder + "/in")
    lines = spark.readStream.text(folder + "/in").select(F.lit("run").alias("file"), F.lit(0).cast("long").alias("offset"), F.col("value").alias("line"))
    query = metrics.state_view(metrics.metric_values(lines), folder + "/state", folder + "/check")
    query.processAllAvailable()
    query.stop()
    found = spark.read.schema("file string, metric string, n long, step long, last double").parquet(folder + "/state")
    return found.select("metric", "n", F.round("last", 6).alias("last"))


_STAGES_SQL = """WITH RECURSIVE e AS (
  SELECT user_id AS u, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' WHEN 'error' THEN 'fail' WHEN 'click' THEN 'count' ELSE 'note' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), s AS (
  SELECT DISTINCT u, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS depth, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS counted, CAST(0 AS BIGINT) AS waits, false AS shown, '' AS kind FROM e
  UNION ALL
  SELECT u, i, CASE WHEN kind = 'start' THEN depth + 1 WHEN kind IN ('end', 'fail') AND depth > 0 THEN depth - 1 ELSE depth END,
    CASE WHEN shown OR last IS NULL THEN us ELSE last + waits * 21600000000 END, CASE WHEN shown AND kind = 'count' THEN us ELSE counted END, waits, shown, kind
  FROM (
    SELECT e.u, e.i, e.us, e.kind, s.depth, s.last, s.counted, CASE WHEN s.depth > 0 THEN greatest((e.us - s.last - 1) // 21600000000, 0) ELSE 0 END AS waits,
      CASE WHEN e.kind IN ('start', 'note') THEN true WHEN s.depth = 0 THEN false WHEN e.kind = 'count' THEN s.counted IS NULL OR e.us - s.counted >= 7200000000 ELSE true END AS shown
    FROM s JOIN e ON e.u = s.u AND e.i = s.i + 1
  )
), tail AS (
  SELECT s.u, CASE WHEN depth > 0 THEN ((SELECT max(us) FROM e) - last) // 21600000000 ELSE 0 END AS waits FROM s JOIN (SELECT u, max(i) AS i FROM e GROUP BY u) m ON s.u = m.u AND s.i = m.i
), shown AS (
  SELECT u, kind, CAST(1 AS BIGINT) AS n FROM s WHERE shown UNION ALL SELECT u, 'waiting', waits FROM s WHERE waits > 0 UNION ALL SELECT u, 'waiting', waits FROM tail WHERE waits > 0
)
SELECT u AS user_id, kind, CAST(sum(n) AS BIGINT) AS n FROM shown GROUP BY u, kind"""


@register("stage_notices", _STAGES_SQL)
def stage_notices(spark, sf_dir):
    """Rows shown for each user's jobs, by kind: notices of six hours' silence while a job is open, counts once in two hours."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "count").otherwise("note")
    rows = _events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("kind"), F.lit("job").alias("label"), F.col("event_id").alias("completed"), F.lit(None).cast("long").alias("total"), F.lit("events").alias("unit"), F.col("event_type").alias("message")
    )
    folder = scratch(spark, "stage-events")
    rows.write.parquet(folder)
    shown = stages.replayed(spark, folder, scratch(spark, "stage-shown"), scratch(spark, "stage-state"), wait=21600.0, gap=7200.0)
    return shown.groupBy(F.col("source").cast("long").alias("user_id"), "kind").agg(F.count("*").alias("n"))


def _run_folders(spark, sf_dir, checkpoints: bool) -> str:
    """A folder with a run folder for each user: its events as metric records, purchases as evaluations, with ``checkpoints`` one at each fifth
    event of all, a verification of each seventh user's."""
    root = scratch(spark, "runs")
    rows = _events(spark, sf_dir).crossJoin(F.broadcast(_events(spark, sf_dir).agg((F.max("event_id") - 20).alias("most"))))  # one row
    log = F.when(F.col("event_type") == "purchase", F.create_map(F.lit("eval_loss"), "value")).otherwise(F.create_map(F.lit("loss"), "value"))
    quality = F.when(F.col("event_id") % 3 == 0, F.struct(F.lit("scheduled").alias("phase"), F.col("event_type").alias("preset")))
    record = F.to_json(F.struct(F.col("event_id").alias("step"), F.col("most").alias("max_steps"), (F.col("event_type") == "purchase").alias("eval"), log.alias("log"), quality.alias("quality")))

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("event_id")
        user = table.column("user_id")[0].as_py()
        system, path = storage.system_of(f"{root}/user-{user}")
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{runs.METRICS}", compression=None) as f:
            for line in table.column("record").to_pylist():
                f.write(line.encode() + b"\n")
        for step in table.column("event_id").to_pylist():
            if checkpoints and step % 5 == 0:
                system.create_dir(f"{path}/checkpoint-{step}")
        if user % 7 == 0:
            with system.open_output_stream(f"{path}/{runs.VERIFY}", compression=None) as f:
                f.write(b'{"ok": true}')
        return pa.table({"user_id": [user]})

    rows.select("user_id", "event_id", record.alias("record")).groupBy("user_id").applyInArrow(write, "user_id long").count()
    return root


@register(
    "run_records",
    """SELECT 'user-' || user_id AS run, count(*) AS records, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 6) AS eval_loss, round(sum(CASE WHEN event_type <> 'purchase' THEN value END), 6) AS loss, count(*) FILTER (event_id % 3 = 0) AS judged,
    max(event_id) AS last_step FROM events WHERE event_id >= 100 GROUP BY user_id""",
)
def run_records(spark, sf_dir):
    """Totals of the metric records of all run folders from step 100 on."""
    found = runs.read_runs(spark, _run_folders(spark, sf_dir, False), steps=(100, None), most=1 << 16)
    total = lambda name: F.round(F.sum(F.col("log")[name]), 6).alias(name)
    return found.groupBy("run").agg(F.count("*").alias("records"), total("eval_loss"), total("loss"), F.count("preset").alias("judged"), F.max("step").alias("last_step"))


@register(
    "run_states",
    """WITH e AS (SELECT *, max(event_id) OVER () - 20 AS most FROM events), c AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN value END AS loss FROM e WHERE event_id % 5 = 0),
    b AS (SELECT user_id, count(*) AS n, min(loss) AS low FROM c GROUP BY user_id), s AS (SELECT user_id, max(event_id) AS step, max(most) AS most FROM e GROUP BY user_id)
    SELECT 'user-' || s.user_id AS run, CASE WHEN s.user_id % 7 = 0 THEN 'verified' WHEN step >= most THEN 'trained' ELSE 'training' END AS phase, step, CAST(coalesce(n, 0) AS BIGINT) AS checkpoints,
      (SELECT min(event_id) FROM c WHERE c.user_id = s.user_id AND c.loss = b.low) AS best, s.user_id % 7 = 0 AS verified FROM s LEFT JOIN b ON s.user_id = b.user_id""",
)
def run_states(spark, sf_dir):
    """Phase, checkpoints and the best of them for each run folder."""
    states = runs.run_states(spark, _run_folders(spark, sf_dir, True))
    best = F.array_min(F.transform(F.filter("checkpoints", lambda c: c["best"]), lambda c: c["step"]))
    return states.select("run", "phase", "step", F.size("checkpoints").cast("long").alias("checkpoints"), best.alias("best"), F.col("verify").isNotNull().alias("verified"))


@register("published_rounds", "SELECT event_type AS preset, count(*) AS results, round(sum(value), 6) AS total FROM events GROUP BY event_type")
def published_rounds(spark, sf_dir):
    """All events streamed into a folder of rounds, and streamed again after the checkpoint is lost: each is there once."""
    folder, schema = scratch(spark, "rounds"), "event_id long, event_type string, value double"
    _events(spark, sf_dir).select("event_id", "event_type", "value").write.parquet(folder + "/in")
    for attempt in ("first", "again"):
        rounds.append_rounds(spark.readStream.schema(schema).parquet(folder + "/in"), folder + "/out", f"{folder}/{attempt}").awaitTermination()
    found = rounds.read_rounds(spark, folder + "/out", schema)
    return found.groupBy(F.col("event_type").alias("preset")).agg(F.count("*").alias("results"), F.round(F.sum("value"), 6).alias("total"))


_METHODS = ("sft", "dpo", "kto", "reward", "grpo")
_EFFECTS_SQL = """WITH d AS (SELECT doc_id, least(n_chars, 900) AS n, least(n_chars, 900) // 3 AS p, least(n_chars, 900) // 2 AS m FROM documents), w AS (
  SELECT *, least(n, 400) AS nk, least(m, 400) AS mk FROM d
), r AS (
  SELECT 'sft' AS method, n AS raw, nk AS kept, greatest(nk - p, 0) AS loss, nk < n AS cut, greatest(nk - p, 0) = 0 AS gone FROM w
  UNION ALL SELECT 'dpo', n + m, nk + mk, least(n, 400) - greatest(n - 400, p, CASE WHEN n > 400 THEN n - 399 ELSE 1 END) + (n - least(n, 400)) + least(m, 400) - greatest(m - 400, p, CASE WHEN m > 400 THEN m - 399 ELSE 1 END) + (m - least(m, 400)), nk + mk < n + m, false FROM w
  UNION ALL SELECT 'kto', n, nk, greatest(nk - greatest(p, 1), 0), nk < n, p >= 400 FROM w
  UNION ALL SELECT 'reward', n + m, n + m, NULL, false, greatest(n, m) > 400 FROM w
  UNION ALL SELECT 'grpo', n, n, NULL, false, false FROM w
)
SELECT method, count(*) AS n_rows, CAST(sum(raw) AS BIGINT) AS raw_tokens, CAST(sum(CASE WHEN gone THEN 0 ELSE kept END) AS BIGINT) AS retained_tokens, CAST(sum(CASE WHEN loss IS NULL THEN NULL WHEN gone THEN 0 ELSE greatest(loss, 0) END) AS BIGINT) AS loss_tokens,
  count(*) FILTER (cut AND (method = 'sft' OR NOT gone)) AS truncated_rows, count(*) FILTER (gone) AS dropped_rows FROM r GROUP BY method"""


def _effects(spark, sf_dir):
    """For each method, documents as rows of up to 900 tokens, the first third of the first branch a prompt."""
    n = F.least("n_chars", F.lit(900)).cast("int")
    docs = _docs(spark, sf_dir).select("doc_id", n.alias("n"), F.floor(n / 3).cast("int").alias("p"), F.floor(n / 2).cast("int").alias("m"))
    mask = lambda length: F.concat(F.array_repeat(F.lit(0), F.col("p")), F.array_repeat(F.lit(1), F.col(length) - F.col("p")))
    out = None
    for method in _METHODS:
        branches = F.array(mask("n"), mask("m")) if method in ("dpo", "reward") else F.array(mask("n"))
        rows = methods.row_effects(docs.withColumn("masks", branches), method, "masks", "p", 400, keep_end=method == "dpo")
        rows = rows.select(F.lit(method).alias("method"), "effect.*")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("method_rows", _EFFECTS_SQL)
def method_rows(spark, sf_dir):
    """Totals of what each method keeps, cuts and drops; dpo keeps the ends."""
    return _effects(spark, sf_dir).groupBy("method").agg(
        F.count("*").alias("n_rows"), F.sum("raw").alias("raw_tokens"), F.sum("retained").alias("retained_tokens"), F.sum("loss").alias("loss_tokens"), F.count_if("truncated").alias("truncated_rows"), F.count_if("dropped").alias("dropped_rows")
    )


@register(
    "method_findings",
    f"""WITH e AS ({_EFFECTS_SQL}), l AS (SELECT count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM labels), k AS (SELECT n_rows - dropped_rows AS rows FROM e WHERE method = 'kto'), w AS (SELECT n_rows - dropped_rows AS rows, dropped_rows FROM e WHERE method = 'reward'), b AS (SELECT count(*) AS n FROM benchmark)
    SELECT 'kto' AS method, 'kto_kl_batch' AS code, 'warning' AS severity, '1,8,random' AS evidence UNION ALL SELECT 'kto', 'kto_weighted_balance', CASE WHEN good = 0 OR bad = 0 THEN 'warning' ELSE 'info' END, good || ',' || bad FROM l
    UNION ALL SELECT 'dpo', 'dpo_aot_batch', 'info', '4,8' UNION ALL SELECT 'dpo', 'dpo_inactive_smoothing', 'warning', 'ipo,sigmoid' UNION ALL SELECT 'reward', 'reward_filtered_pairs', 'warning', dropped_rows || ',' || rows FROM w WHERE dropped_rows > 0
    UNION ALL SELECT 'sft', 'replay_exposure', 'info', (SELECT count(DISTINCT source) FROM documents) || ',0.25'
    UNION ALL SELECT m, 'evaluation_coverage', CASE WHEN m = 'grpo' THEN 'warning' ELSE 'info' END, (SELECT n FROM b) || ',' || CASE WHEN m = 'grpo' THEN 'no' ELSE 'steps' END FROM (VALUES ('sft'), ('dpo'), ('kto'), ('reward'), ('grpo')) t(m)""",
)
def method_findings(spark, sf_dir):
    """Findings for a row of settings of each method, with counts taken from the tables."""
    seen = method_rows(spark, sf_dir).select("method", (F.col("n_rows") - F.col("dropped_rows")).alias("effective_rows"), "dropped_rows")
    labels = table(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 1).alias("desirable"), F.count_if(F.col("quality") == 0).alias("undesirable"))
    counts = labels.crossJoin(table(spark, sf_dir, "benchmark").agg(F.count("*").alias("eval_rows"))).crossJoin(_docs(spark, sf_dir).agg(F.count_distinct("source").alias("sources")))  # one row each
    method = F.col("method")
    losses = F.when(method == "dpo", F.array(F.lit("sigmoid"), F.lit("aot"), F.lit("ipo"))).otherwise(F.array(F.lit("kto")))
    settings = seen.crossJoin(F.broadcast(counts)).withColumns(
        {
            "per_device": F.when(method == "kto", 1).otherwise(4).cast("long"), "accumulation": F.lit(8).cast("long"), "sampling": F.lit("random"), "loss_types": losses, "workers": F.lit(None).cast("long"), "smoothing": F.lit(0.1), "fused": F.lit(False),
            "row_errors": F.lit(0).cast("long"), "replay_fraction": F.when(method == "sft", 0.25), "synthetic_eval": F.lit(False), "eval_strategy": F.when(method == "grpo", "no").otherwise("steps"),
        }
    )
    return methods.method_findings(settings)
