"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import chunking, messages, pairs, profile
from millrace.plans.registry import register, table


def _conversations(spark, sf_dir):
    return messages.gather(table(spark, sf_dir, "conversations"), "conv_id", "turn")


_LAST = "SELECT conv_id, arg_max(role, turn) AS r, arg_max(text, turn) AS t, max(turn) AS m, count(*) AS n FROM conversations GROUP BY conv_id"


@register(
    "prompt_length_profile",
    f"""WITH l AS ({_LAST}), p AS (SELECT c.conv_id, sum(length(c.text)) + count(*) - 1 AS chars FROM conversations c JOIN l ON c.conv_id = l.conv_id AND c.turn < l.m WHERE l.r = 'assistant' GROUP BY c.conv_id),
    e AS (SELECT conv_id, ceil(chars / 3.5) AS v FROM p), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM e)
    SELECT count(*) AS count, min(v) AS min, round(avg(v), 6) AS mean, median(v) AS median, max(v) FILTER (i = least(n - 1, CAST(floor(0.9 * n) AS BIGINT))) AS p90, max(v) AS max FROM o""",
)
def prompt_length_profile(spark, sf_dir):
    """Estimated tokens of the prompts of conversations that end with an answer."""
    pairs_ = messages.to_prompt_completion(_conversations(spark, sf_dir).filter(messages.convertible(F.col("messages"))))
    prompts = pairs_.filter(F.size("prompt") > 0)
    return profile.length_summary(prompts, chunking.estimated_tokens(messages.contents(F.col("prompt")))).withColumn("mean", F.round("mean", 6))


@register(
    "convert_prompt_completion",
    f"SELECT conv_id, CAST(n - 1 AS INTEGER) AS prompt_messages, t AS completion FROM ({_LAST}) WHERE r = 'assistant'",
)
def convert_prompt_completion(spark, sf_dir):
    made = messages.to_prompt_completion(_conversations(spark, sf_dir).filter(messages.convertible(F.col("messages"))))
    return made.select("conv_id", F.size("prompt").alias("prompt_messages"), F.col("completion")[0]["content"].alias("completion"))


@register(
    "convert_to_messages",
    f"""WITH l AS ({_LAST}) SELECT c.conv_id, string_agg(c.role || ':' || c.text, chr(10) ORDER BY c.turn) AS flat FROM conversations c JOIN l USING (conv_id) WHERE l.r = 'assistant' GROUP BY c.conv_id""",
)
def convert_to_messages(spark, sf_dir):
    there = messages.to_prompt_completion(_conversations(spark, sf_dir).filter(messages.convertible(F.col("messages"))))
    back = messages.to_messages(there)
    return back.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n").alias("flat"))


@register(
    "prompts_from",
    "WITH u AS (SELECT conv_id, max(turn) AS m FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT c.conv_id, CAST(count(*) AS INTEGER) AS n_messages, arg_max(c.text, c.turn) AS last FROM conversations c JOIN u ON c.conv_id = u.conv_id AND c.turn <= u.m GROUP BY c.conv_id",
)
def prompts_from(spark, sf_dir):
    prompts = _conversations(spark, sf_dir).withColumn("p", messages.prompt_of(F.col("messages"))).filter("p IS NOT NULL")
    return prompts.select("conv_id", F.size("p").alias("n_messages"), F.element_at("p", -1)["content"].alias("last"))


@register(
    "completion_text",
    "SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS answer, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS shown FROM conversations GROUP BY conv_id",
)
def completion_text(spark, sf_dir):
    m = F.col("messages")
    return _conversations(spark, sf_dir).select("conv_id", messages.completion_text(m).alias("answer"), messages.prompt_text(m).alias("shown"))


@register(
    "reasoning_merge",
    f"""WITH a AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS k FROM conversations GROUP BY conv_id)
    SELECT conv_id, t AS answer, 'because ' || conv_id AS reasoning FROM ({_LAST}) JOIN a USING (conv_id) WHERE r = 'assistant' AND k = 1""",
)
def reasoning_merge(spark, sf_dir):
    m = F.col("messages")
    rows = _conversations(spark, sf_dir).filter(messages.can_merge_reasoning(m))
    merged = rows.select("conv_id", messages.merge_reasoning(m, F.concat(F.lit("because "), F.col("conv_id").cast("string"))).alias("m"))
    return merged.select("conv_id", F.element_at("m", -1)["content"].alias("answer"), F.element_at("m", -1)["reasoning"].alias("reasoning"))


@register(
    "merge_runs",
    """WITH f AS (SELECT *, CASE WHEN lag(r) OVER w = r AND r IN ('user', 'tool') THEN 0 ELSE 1 END AS fresh FROM (SELECT conv_id, turn, text, CASE WHEN role = 'system' THEN 'user' ELSE role END AS r FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM f)
    SELECT conv_id, CAST(block AS BIGINT) AS block, min(r) AS role, count(*) AS n_messages, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM b GROUP BY conv_id, block""",
)
def merge_runs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    return messages.merge_runs(turns, "conv_id", "turn")


@register(
    "drop_before_last_user",
    "WITH u AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS m FROM conversations GROUP BY conv_id) SELECT c.conv_id, CAST(count(*) FILTER (NOT (role = 'system' AND turn < coalesce(m, -1))) AS INTEGER) AS kept FROM conversations c JOIN u USING (conv_id) GROUP BY c.conv_id",
)
def drop_before_last_user(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", F.size(messages.drop_before_last_user(F.col("messages"), ("system",))).alias("kept"))


@register(
    "context_outline",
    "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index, role, 'string' AS content_type, length(text) AS characters, substr(text, 1, 40) AS preview FROM conversations",
)
def context_outline(spark, sf_dir):
    return messages.outline(_conversations(spark, sf_dir), "conv_id")


@register(
    "context_edits",
    """WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, string_agg(text, '|' ORDER BY i) FILTER (i <> 1) AS removed, string_agg(text, '|' ORDER BY CASE WHEN i = 0 THEN 1.5 ELSE i END) AS moved, max(text) FILTER (i = 1) AS shown,
      string_agg(CASE WHEN i = 0 THEN 'new' ELSE text END, '|' ORDER BY i) AS replaced, string_agg(CASE WHEN i = 0 THEN 'first|' || text ELSE text END, '|' ORDER BY i) AS inserted
    FROM r WHERE n >= 2 GROUP BY conv_id""",
)
def context_edits(spark, sf_dir):
    m = F.col("messages")
    flat = lambda c: F.array_join(F.transform(c, lambda x: x["content"]), "|")
    rows = _conversations(spark, sf_dir).filter(F.size(m) >= 2)
    return rows.select(
        "conv_id",
        flat(messages.remove_range(m, F.lit(1), F.lit(1))).alias("removed"),
        flat(messages.move_range(m, F.lit(0), F.lit(1), F.lit(1))).alias("moved"),
        flat(messages.show_range(m, F.lit(1), F.lit(1))).alias("shown"),
        flat(messages.replace_content(m, F.lit(0), F.lit("new"))).alias("replaced"),
        flat(messages.insert_at(m, F.lit(0), F.array(messages.message("system", F.lit("first"))))).alias("inserted"),
    )


@register(
    "context_validate",
    "SELECT conv_id, CAST(1 AS BIGINT) AS index, 'only the assistant calls tools' AS error FROM (SELECT conv_id, max(CASE WHEN rn = 1 THEN role END) AS second FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn FROM conversations) GROUP BY conv_id) WHERE second <> 'assistant' UNION ALL SELECT conv_id, k AS index, CASE WHEN k < n THEN 'calls wait for their results' ELSE 'calls lack results' END FROM (SELECT conv_id, CAST(2 AS BIGINT) AS k, count(*) AS n, max(CASE WHEN rn = 1 THEN role END) AS second FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn FROM conversations) GROUP BY conv_id) WHERE second = 'assistant'",
)
def context_validate(spark, sf_dir):
    """Every conversation with a call put into its second message and never answered."""
    call = F.array(F.struct(F.lit("call_0001").alias("id"), F.lit("function").alias("type"), F.lit("look").alias("name"), F.lit("{}").alias("arguments")))
    none = F.lit(None).cast(messages._CALLS)
    with_calls = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.when(i == 1, call).otherwise(none).alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id")))
    return messages.context_errors(_conversations(spark, sf_dir).select("conv_id", with_calls.alias("messages")), "conv_id")


_WHOLE = """WITH s AS (SELECT conv_id, string_agg(length(text) || ':' || text, '' ORDER BY turn) FILTER (role = 'user') AS k, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id),
    a AS (SELECT conv_id, k, row_number() OVER (PARTITION BY k ORDER BY conv_id) AS n FROM s), b AS (SELECT conv_id, k, row_number() OVER (PARTITION BY k ORDER BY conv_id) AS n FROM s WHERE answers > 0)"""


def _whole_sides(spark, sf_dir):
    """All conversations, and those with an answer to replace, by all their user turns; lengths keep the turns apart."""
    users = messages.user_key(F.col("messages"))
    key = F.array_join(F.transform(users, lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t)), "")
    rows = _conversations(spark, sf_dir).select("conv_id", F.when(F.size(users) > 0, key).alias("k"), F.exists("messages", lambda m: m["role"] == "assistant").alias("answered"))
    return rows.select("conv_id", "k"), rows.filter("answered").select("conv_id", "k")


@register("pairs_align_all", f"{_WHOLE} SELECT a.k AS key, CAST(a.n AS INTEGER) AS nth, a.conv_id AS chosen, b.conv_id AS rejected FROM a JOIN b ON a.k = b.k AND a.n = b.n")
def pairs_align_all(spark, sf_dir):
    """By the whole user key."""
    made = pairs.align(*_whole_sides(spark, sf_dir), "k", "conv_id")
    return made.select("key", "nth", F.col("chosen.conv_id").alias("chosen"), F.col("rejected.conv_id").alias("rejected"))


@register(
    "pairs_unmatched_all",
    f"{_WHOLE} SELECT 'chosen' AS side, conv_id, k FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.k = b.k AND a.n = b.n) UNION ALL SELECT 'rejected', conv_id, k FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = b.k AND a.n = b.n)",
)
def pairs_unmatched_all(spark, sf_dir):
    return pairs.unmatched(*_whole_sides(spark, sf_dir), "k", "conv_id")


@register(
    "template_fill",
    "SELECT conv_id, 'Q: ' || coalesce(arg_max(text, turn) FILTER (role = 'user'), 'None') || coalesce(' (system: ' || (arg_max(text, turn) FILTER (role = 'system')) || ')', '') || ' {unknown}' AS filled FROM conversations GROUP BY conv_id",
)
def template_fill(spark, sf_dir):
    m = F.col("messages")
    of = lambda role: F.try_element_at(F.filter(m, lambda x: x["role"] == role), F.lit(-1))["content"]
    filled = messages.fill_template("Q: {question}[[ (system: {system})]] {unknown}", {"question": of("user"), "system": of("system")})
    return _conversations(spark, sf_dir).select("conv_id", filled.alias("filled"))


@register(
    "generation_prompt",
    "WITH l AS (SELECT conv_id, arg_max(role, turn) AS r, arg_max(text, turn) AS t, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(CASE WHEN r = 'user' THEN n ELSE n + 1 END AS INTEGER) AS n_messages, CASE WHEN r = 'user' THEN t || chr(10) || chr(10) || 'Answer briefly.' ELSE 'Answer briefly.' END AS last FROM l",
)
def generation_prompt(spark, sf_dir):
    asked = _conversations(spark, sf_dir).withColumn("p", messages.generation_prompt(F.col("messages"), F.lit("Answer briefly.")))
    return asked.select("conv_id", F.size("p").alias("n_messages"), F.element_at("p", -1)["content"].alias("last"))


@register(
    "attach_tools",
    "WITH l AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'system') AS s, arg_min(text, turn) FILTER (role = 'system') AS t FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(CASE WHEN s > 0 THEN n ELSE n + 1 END AS INTEGER) AS n_messages, CASE WHEN s > 0 THEN t || chr(10) || chr(10) || '[tools]' ELSE '[tools]' END AS head FROM l",
)
def attach_tools(spark, sf_dir):
    made = _conversations(spark, sf_dir).withColumn("p", messages.attach_tools(F.col("messages"), F.lit("[tools]")))
    return made.select("conv_id", F.size("p").alias("n_messages"), F.filter("p", lambda m: m["role"] == "system")[0]["content"].alias("head"))
