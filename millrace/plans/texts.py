"""Queries of chunks, repair, markup, edits, packing, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import best_fit, checks, chunking, edits, endpoint, repair
from millrace.plans.registry import register, table
from millrace.session import scratch
from millrace.sources import files, markup
from millrace.streaming import metrics


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@register("token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", chunking.estimated_tokens(F.col("text")).alias("tokens"))


@register(
    "paragraphs",
    r"SELECT doc_id, CAST(len(p) AS INTEGER) AS n, CAST(coalesce(list_max(list_transform(p, lambda x: length(x))), 0) AS INTEGER) AS longest FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', chr(10) || chr(10)), '\n\s*\n'), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '') AS p FROM documents)",
)
def paragraphs(spark, sf_dir):
    """Sentences set apart by blank lines stand in for paragraphs."""
    p = chunking.paragraphs(F.replace("text", F.lit(". "), F.lit("\n\n")))
    made = _docs(spark, sf_dir).select("doc_id", p.alias("p"))
    return made.select("doc_id", F.size("p").alias("n"), F.coalesce(F.array_max(F.transform("p", lambda x: F.length(x))), F.lit(0)).alias("longest"))


@register("chunk_text")
def chunk_text(spark, sf_dir):
    return chunking.chunk_texts(_docs(spark, sf_dir), "doc_id", "text", 256)


@register(
    "question_lists",
    r"SELECT conv_id, turn, array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^\s*(\d+[.)]|[-*])\s*', ''))), lambda x: length(x) > 0), 1, 3), '|') AS questions FROM conversations",
)
def question_lists(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(chunking.questions(F.col("text"), 3), "|").alias("questions"))


@register("strip_reasoning", "SELECT conv_id, turn, CASE WHEN turn % 3 <> 1 THEN text END AS text, CASE WHEN turn % 3 = 1 THEN 'the reasoning block never closes' END AS error FROM conversations")
def strip_reasoning(spark, sf_dir):
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>a < b</think>  "), F.col("text"))).when(F.col("turn") % 3 == 1, F.concat(F.lit(" <think>"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chunking.without_reasoning(reply).alias("r")).select("conv_id", "turn", "r.text", "r.error")


@register(
    "wrapped_packing",
    """WITH d AS (SELECT doc_id, n_chars AS n, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM documents),
    c AS (SELECT doc_id, n, CAST(f AS BIGINT) AS f, unnest(range(CAST(f AS BIGINT) // 4096, (CAST(f AS BIGINT) + n - 1) // 4096 + 1)) AS p FROM d WHERE n > 0)
    SELECT doc_id, CAST(p - f // 4096 AS INTEGER) AS piece, p AS packed, greatest(f, p * 4096) - p * 4096 AS start, least(f + n, (p + 1) * 4096) - greatest(f, p * 4096) AS length FROM c""",
)
def wrapped_packing(spark, sf_dir):
    return chunking.wrapped(_docs(spark, sf_dir), "doc_id", "n_chars", 4096)


@register(
    "wrapped_packing_totals",
    "SELECT CAST(sum(n_chars) AS BIGINT) AS tokens, CAST(ceil(sum(n_chars) / 4096.0) AS BIGINT) AS sequences FROM documents",
)
def wrapped_packing_totals(spark, sf_dir):
    return wrapped_packing(spark, sf_dir).agg(F.sum("length").alias("tokens"), F.countDistinct("packed").alias("sequences"))


def _best_fit_sql(rows: str, size: int, result: str) -> str:
    """Best-fit decreasing one row after the other: the rooms of all bins in a list that each step changes at one place."""
    return f"""WITH RECURSIVE d AS ({rows}), s AS (
      SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS bin, CAST([] AS BIGINT[]) AS rooms
      UNION ALL
      SELECT i, doc_id, n, p - 1, CASE WHEN p <= len(rooms) THEN list_transform(rooms, lambda x, k: CASE WHEN k = p THEN x - n ELSE x END) ELSE list_append(rooms, greatest({size}, n) - n) END
      FROM (SELECT d.i, d.doc_id, d.n, s.rooms, CASE WHEN len(list_filter(s.rooms, lambda x: x >= d.n)) > 0 THEN list_position(s.rooms, list_min(list_filter(s.rooms, lambda x: x >= d.n))) ELSE len(s.rooms) + 1 END AS p FROM s JOIN d ON d.i = s.i + 1)
    ) {result}"""


@register(
    "best_fit_packing",
    _best_fit_sql("SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i, doc_id, CAST(n_chars AS BIGINT) AS n FROM documents", 16384, "SELECT doc_id, CAST(bin AS BIGINT) AS bin FROM s WHERE i > 0"),
)
def best_fit_packing(spark, sf_dir):
    """Bins of 16384 characters over the whole table, the plan made from the histogram of lengths."""
    return best_fit.best_fit(_docs(spark, sf_dir).select("doc_id", "n_chars"), "n_chars", 16384, "doc_id").select("doc_id", "bin")


@register(
    "best_fit_bins",
    _best_fit_sql(
        """SELECT row_number() OVER (ORDER BY l DESC, doc_id, o) AS i, doc_id, l AS n FROM (SELECT doc_id, o, least(2048, n - o) AS l FROM (SELECT doc_id, n, unnest(range(0, n, 2048)) AS o FROM (SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS n FROM documents)))""",
        2048,
        "SELECT CAST(bin AS BIGINT) AS bin, count(*) AS pieces, CAST(sum(n) AS BIGINT) AS tokens, min(doc_id) AS first_doc FROM s WHERE i > 0 GROUP BY bin",
    ),
)
def best_fit_bins(spark, sf_dir):
    """Totals of bins of 2048 tokens; documents over that are cut."""
    rows = _docs(spark, sf_dir).select("doc_id", chunking.estimated_tokens(F.col("text")).alias("tokens"))
    found = best_fit.best_fit_pieces(rows, "doc_id", "tokens", 2048)
    return found.groupBy("bin").agg(F.count("*").alias("pieces"), F.sum("length").cast("long").alias("tokens"), F.min("doc_id").alias("first_doc"))


@register("json_objects_over_lines", "SELECT conv_id, turn, role, text FROM conversations")
def json_objects_over_lines(spark, sf_dir):
    """Objects written over several lines each and read back in parallel."""
    path = scratch(spark, "objects") + ".jsonl"
    rows = table(spark, sf_dir, "conversations")
    rows.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).write.text(path)
    return files.read_rows(spark, path).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


@register(
    "budget_fit",
    "SELECT doc_id, source FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY lang, doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 20000",
)
def budget_fit(spark, sf_dir):
    return chunking.fitted(_docs(spark, sf_dir), "source", "lang", "doc_id", "n_chars", 20000).select("doc_id", "source")


_HEALED_SQL = """WITH l AS (
  SELECT user_id, event_id, regexp_extract(props, '[0-9]+') AS k, event_id % 9 AS c, event_id = max(event_id) OVER (PARTITION BY {file}) AS is_last FROM events
)
SELECT {columns} event_id AS line_no, CAST(CASE WHEN c = 8 AND is_last THEN -1 ELSE p END AS BIGINT) AS part,
  CASE WHEN c = 7 THEN '{{"k": }}' WHEN c = 8 AND is_last THEN NULL WHEN c = 8 THEN '{{"k": "cut' WHEN c = 6 THEN '{{"k": [true, ' || k || ', null]}}' ELSE '{{"k": ' || k || '}}' END AS line,
  CASE c WHEN 1 THEN 'trailing commas (1)' WHEN 2 THEN 'single quotes (1)' WHEN 3 THEN 'unquoted keys (1)' WHEN 4 THEN 'concatenated objects split into 2' WHEN 5 THEN 'unclosed final brace or bracket (1)'
    WHEN 6 THEN 'Python literals (2)' WHEN 8 THEN CASE WHEN is_last THEN 'truncated last line dropped' ELSE '' END ELSE '' END AS repairs,
  c = 7 OR c = 8 AND NOT is_last AS failed
FROM l, (VALUES (0), (1)) t(p) WHERE p = 0 OR c = 4"""


def _broken(spark, sf_dir):
    """Each event's props as a line of JSON, broken in one of eight ways or left whole."""
    k, way = F.regexp_extract("props", "[0-9]+", 0), F.col("event_id") % 9
    forms = ["{'k': %s}", "{k: %s}", '{"k": %s}{"k": %s}', '{"k": %s', '{"k": [True, %s, None]}', '{"k": }', '{"k": "cut']
    line = F.when(way == 0, F.col("props")).when(way == 1, F.format_string('{"k": %s,}', k))
    for i, form in enumerate(forms, 2):
        line = line.when(way == i, F.format_string(form, *[k] * form.count("%s")))
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("line_no"), line.alias("line"))


@register("heal_lines", _HEALED_SQL.format(file="1", columns=""))
def heal_lines(spark, sf_dir):
    """All events' broken lines as those of one file."""
    healed = repair.heal_lines(_broken(spark, sf_dir))
    return healed.select("line_no", "part", "line", F.array_join("repairs", ";").alias("repairs"), F.col("error").isNotNull().alias("failed"))


@register("sql_heal", _HEALED_SQL.format(file="user_id", columns="user_id,"))
def sql_heal(spark, sf_dir):
    """The same from SQL, each user's lines being a file."""
    checks.register_functions(spark)
    healed = spark.sql("SELECT * FROM heal(TABLE({lines}) PARTITION BY user_id ORDER BY line_no, key => 'user_id', number => 'line_no', line => 'line')", lines=_broken(spark, sf_dir))
    return healed.select("user_id", "line_no", "part", "line", F.array_join("repairs", ";").alias("repairs"), F.col("error").isNotNull().alias("failed"))


@register(
    "sql_chunk_text",
    r"""SELECT doc_id, CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT) AS characters, true AS numbered, true AS fits, length(text) <= 3.5 * 256 AND NOT regexp_matches(text, '\n\s*\n') AS one FROM documents WHERE regexp_matches(text, '\S')""",
)
def sql_chunk_text(spark, sf_dir):
    """Chunks from SQL: they keep all characters but white space, are numbered without gaps and hold 256 tokens at most."""
    checks.register_functions(spark)
    found = spark.sql("SELECT doc_id, chunk_no, chunk FROM chunk_text(TABLE({docs}), key => 'doc_id', text => 'text', most => 256)", docs=_docs(spark, sf_dir).select("doc_id", "text"))
    solid = F.length(F.regexp_replace("chunk", r"\s", "")).cast("long")
    chunked = found.groupBy("doc_id").agg(F.sum(solid).alias("characters"), (F.max("chunk_no") + 1 == F.count_distinct("chunk_no")).alias("numbered"), (F.max(chunking.estimated_tokens(F.col("chunk"))) <= 256).alias("fits"), F.count("*").alias("n"))
    small = _docs(spark, sf_dir).select("doc_id", ((F.length("text") <= 3.5 * 256) & ~F.col("text").rlike(r"\n\s*\n")).alias("small"))
    return chunked.join(small, "doc_id").select("doc_id", "characters", "numbered", "fits", (F.col("small") & (F.col("n") == 1)).alias("one"))


@register(
    "sql_md_sections",
    "SELECT doc_id, h AS heading, CAST(l AS BIGINT) AS level, CAST(f AS BIGINT) AS first_line FROM (SELECT doc_id, lang FROM documents), LATERAL (SELECT 'Top ' || lang, 1, 0 UNION ALL SELECT 'Inner', 2, 2 UNION ALL SELECT 'Next', 1, 7) t(h, l, f)",
)
def sql_md_sections(spark, sf_dir):
    """Sections of documents from SQL, the text on a line of its own among headings and a fence."""
    checks.register_functions(spark)
    text = F.concat(F.lit("# Top "), "lang", F.lit("\nx\n## Inner\n```\n# no heading\n```\n."), F.regexp_replace("text", r"[\x0A-\x0D\x1C-\x1E\u0085\u2028\u2029]", " "), F.lit("\n# Next\nend"))
    docs = _docs(spark, sf_dir).select("doc_id", text.alias("text"))
    return spark.sql("SELECT doc_id, heading, level, first_line FROM md_sections(TABLE({docs}), key => 'doc_id', text => 'text')", docs=docs)


@register("html_headings")
def html_headings(spark, sf_dir):
    return markup.headings(table(spark, sf_dir, "pages"), "page_id", "html")


@register(
    "markdown_sections",
    "SELECT item_id, h AS heading, CAST(l AS BIGINT) AS level, CAST(f AS BIGINT) AS first_line FROM (SELECT item_id FROM benchmark), (VALUES ('Top', 1, 0), ('Inner', 2, 2), ('Next', 1, 7)) t(h, l, f)",
)
def markdown_sections(spark, sf_dir):
    text = F.concat(F.lit("# Top\nx\n## Inner\n```\n# no heading\n```\n"), F.regexp_replace("text", "\n", " "), F.lit("\n# Next\nend"))
    return markup.markdown(table(spark, sf_dir, "benchmark").select("item_id", text.alias("text")), "item_id", "text").select("item_id", "heading", "level", "first_line")


@register(
    "span_edits",
    "SELECT doc_id, CASE WHEN n = 1 THEN replace(text, 'the than', 'THAN') ELSE text END AS text, CASE WHEN n <> 1 THEN 'edit 0: span occurs ' || n || ' times' END AS error FROM (SELECT doc_id, text, CAST((length(text) - length(replace(text, 'the than', ''))) / 8 AS INTEGER) AS n FROM documents)",
)
def span_edits(spark, sf_dir):
    listed = F.array(F.struct(F.lit("the than").alias("old"), F.lit("THAN").alias("new")))
    return _docs(spark, sf_dir).select("doc_id", edits.apply_edits(F.col("text"), listed).alias("e")).select("doc_id", "e.text", "e.error")


@register("derived_edits")
def derived_edits(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("old"), F.replace("text", F.lit(" the "), F.lit(" a ")).alias("new"))
    return edits.derive_edits(rows, "item_id", "old", "new").select("item_id", F.to_json("edits").alias("edits"))


@register(
    "waste_spans",
    "SELECT item_id, CAST(0 AS BIGINT) AS start, CAST(12 AS BIGINT) AS \"end\", CAST(4 AS BIGINT) AS waste_start, CAST(8 AS BIGINT) AS waste_end FROM benchmark WHERE (length(text) - length(replace(text, substr(text, 1, 12), ''))) / 12 = 1 AND (12 - length(replace(substr(text, 1, 12), substr(text, 5, 4), ''))) / 4 = 1",
)
def waste_spans(spark, sf_dir):
    labels = table(spark, sf_dir, "benchmark").select("item_id", "text", F.lit("answer").alias("field"), F.substring("text", 1, 12).alias("span"), F.substring("text", 5, 4).alias("waste"), F.lit("hedge").alias("category"), F.lit("why").alias("reason"), F.lit(False).alias("retained"))
    return edits.locate(labels, "text", "item_id").filter("fault IS NULL").select("item_id", "start", "end", "waste_start", "waste_end")


def _echo(request):
    return {"content": "1. " + request[-1]["content"][:20] + "\n2) second", "reasoning": "none"}


@register("endpoint_chat")
def endpoint_chat(spark, sf_dir):
    """The two-pass conversation builder against a stand-in that echoes."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    rows, _ = endpoint.chat_rows(docs, "doc_id", "text", 512, 2, _echo, _echo, "Ask {n} about: {chunk}", "{question} given {chunk}", 1)
    return rows


@register("json_stream_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def json_stream_round_trip(spark, sf_dir):
    """Written as JSON lines and read back as a stream of objects."""
    path = scratch(spark, "rows") + ".jsonl"
    files.write_rows(table(spark, sf_dir, "conversations"), path)
    return files.read_rows(spark, path).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


@register("csv_round_trip", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "rows") + ".csv"
    files.write_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return files.read_rows(spark, path)


@register("stream_metric_tail_all", "SELECT event_type AS metric, count(*) AS n, round(arg_max(value, event_id), 6) AS last FROM events GROUP BY event_type")
def stream_metric_tail_all(spark, sf_dir):
    """All events, written by the executors under the shared folder and tailed from there."""
    folder = scratch(spark, "tail")
    record = F.struct(F.col("event_id").alias("step"), F.create_map("event_type", "value").alias("log"))
    table(spark, sf_dir, "events").select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value")).write.text(folder + "/in")
    values = metrics.metric_values(metrics.shared_tail(spark, folder + "/in/part-*", maxBytes=1 << 20))
    query = values.select("step", "metric", "value").writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/check").start()
    query.processAllAvailable()
    query.stop()
    read = spark.read.schema("step long, metric string, value double").parquet(folder + "/out")
    return read.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.max_by("value", "step"), 6).alias("last"))


@register("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    folder = scratch(spark, "stream")
    table(spark, sf_dir, "events").select("user_id", "event_type").write.parquet(folder + "/in")
    source = spark.readStream.schema("user_id long, event_type string").parquet(folder + "/in")
    out = metrics.distinct_events(source, "user_id", "event_type")
    out.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, event_type string").parquet(folder + "/out")
