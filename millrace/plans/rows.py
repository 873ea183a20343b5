"""Queries of the ordered-row transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import fields, order, routing
from millrace.operators import rows as R
from millrace.plans.registry import register, table


@register("shuffle_seeded", "SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS BIGINT) AS position FROM documents")
def shuffle_seeded(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").withColumn("r", order.seeded(42, "doc_id"))
    return order.dense_index(docs, "r", "doc_id", into="position").select("doc_id", "position")


@register("sample_seeded", "SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def sample_seeded(spark, sf_dir):
    return R.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), 100, 7, "doc_id")


@register("sample_head", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def sample_head(spark, sf_dir):
    return R.head(table(spark, sf_dir, "documents").select("doc_id", "lang"), 50, "doc_id")


@register(
    "split_fraction",
    """WITH c AS (SELECT CAST(round_even(count(*) * 0.3, 0) AS BIGINT) AS k FROM documents),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)
    SELECT CASE WHEN n <= k THEN 'first' ELSE 'rest' END AS side, count(*) AS n_rows, min(doc_id) AS low, max(doc_id) AS high FROM r, c GROUP BY 1""",
)
def split_fraction(spark, sf_dir):
    first, rest = R.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", fraction=0.3)
    sides = first.withColumn("side", F.lit("first")).union(rest.withColumn("side", F.lit("rest")))
    return sides.groupBy("side").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))


@register(
    "split_by_key",
    """WITH g AS (SELECT source, min(doc_id) AS f, count(*) AS n FROM documents GROUP BY source),
    s AS (SELECT source, n, coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 400 AS first FROM g)
    SELECT d.doc_id, d.source, s.first FROM documents d JOIN s ON d.source = s.source""",
)
def split_by_key(spark, sf_dir):
    return R.split_by_key(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 400)


@register(
    "mix_sources",
    """WITH d AS (SELECT doc_id AS id, text, row_number() OVER (ORDER BY md5('5:' || doc_id), doc_id) AS n FROM documents),
    b AS (SELECT item_id AS id, text, row_number() OVER (ORDER BY md5('5:' || item_id), item_id) AS n FROM benchmark)
    SELECT id, text, 0 AS source_no FROM d WHERE n <= (SELECT round_even(count(*) * 0.25, 0) FROM documents)
    UNION ALL SELECT id, text, 1 AS source_no FROM b WHERE n <= (SELECT round_even(count(*) * 0.5, 0) FROM benchmark)""",
)
def mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return R.mix([(docs, 0.25), (items, 0.5)], 5, "id")


@register(
    "eval_split_exact",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS n FROM documents)
    SELECT doc_id, n <= (SELECT ceil(count(*) * CAST('0.07' AS DECIMAL(38, 18))) FROM documents) AS evaluation FROM r""",
)
def eval_split_exact(spark, sf_dir):
    return R.train_eval(table(spark, sf_dir, "documents").select("doc_id"), "0.07", "doc_id")


@register(
    "eval_split_seeded",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) AS n FROM documents)
    SELECT doc_id, n <= (SELECT ceil(count(*) * CAST('0.07' AS DECIMAL(38, 18))) FROM documents) AS evaluation FROM r""",
)
def eval_split_seeded(spark, sf_dir):
    return R.train_eval(table(spark, sf_dir, "documents").select("doc_id"), "0.07", "doc_id", seed=3)


@register(
    "replay_mix",
    """WITH p AS (SELECT doc_id, lang FROM documents WHERE lang = 'en'), q AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE lang <> 'en')
    SELECT doc_id, lang, false AS replay FROM p
    UNION ALL SELECT doc_id, lang, true FROM q WHERE n <= (SELECT greatest(1, round_even(0.2 * count(*) / 0.8, 0)) FROM p)""",
)
def replay_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return R.replay_mix(docs.filter("lang = 'en'"), docs.filter("lang <> 'en'"), 0.2, "doc_id")


@register(
    "fields_pipeline",
    """SELECT CAST(length(text) AS INTEGER) AS size, length(text) > 1000 AND lang = 'en' AS long_en, source AS lang, lang AS origin,
      CASE WHEN n_chars % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, doc_id AS id FROM documents""",
)
def fields_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    adds = [("size", "len(text)"), ("long_en", "size > 1000 and lang == 'en'"), ("parity", "'even' if n_chars % 2 == 0 else 'odd'")]
    return fields.apply_fields(docs, adds, ["text", "n_chars"], [("doc_id", "id"), ("source", "origin")], [("lang", "origin")])


@register("filter_rows", "SELECT doc_id, source FROM documents WHERE length(text) <= 2000 AND lang IN ('en', 'fr') AND n_chars <> 0 AND NOT (doc_id % 3 = 1)")
def filter_rows(spark, sf_dir):
    docs = R.limit_lengths(table(spark, sf_dir, "documents"), {"text": 2000})
    return fields.where(docs, "lang in ('en', 'fr')", "n_chars", "not doc_id % 3 == 1").select("doc_id", "source")


@register(
    "dedup_append",
    """WITH n AS (SELECT doc_id, text, lang, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS k FROM documents WHERE doc_id % 2 = 1)
    SELECT doc_id, lang FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.text IS NOT DISTINCT FROM n.text AND e.lang IS NOT DISTINCT FROM n.lang)""",
)
def dedup_append(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return R.dedup_append(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), ["text", "lang"], "doc_id").select("doc_id", "lang")


@register("single_row_replace", "SELECT item_id, CASE WHEN item_id = 3 THEN 'replaced' ELSE text END AS line FROM benchmark")
def single_row_replace(spark, sf_dir):
    lines = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "line")
    digest = lines.filter("item_id = 3").select(F.sha2("line", 256)).first()[0]
    return R.replace_row(lines, digest, "replaced")


@register("rewind_records", "SELECT event_id, value FROM events WHERE event_id <= 500")
def rewind_records(spark, sf_dir):
    return R.rewind(table(spark, sf_dir, "events").select("event_id", "value"), 500, "event_id")


@register("keep_newest_exports", "SELECT o_orderkey, o_orderdate, o_orderdate IN (SELECT DISTINCT o_orderdate FROM orders ORDER BY 1 DESC LIMIT 3) AS keep FROM orders")
def keep_newest_exports(spark, sf_dir):
    return R.keep_newest(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 3, "o_orderdate")


@register(
    "vocabulary_difference",
    """WITH a AS (SELECT source AS token, min(doc_id) AS id FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT source AS token, min(doc_id) AS id FROM documents WHERE lang <> 'fr' AND doc_id > 20 GROUP BY 1)
    SELECT token, a.id AS a_id, b.id AS b_id FROM a FULL OUTER JOIN b USING (token) WHERE a.id IS DISTINCT FROM b.id""",
)
def vocabulary_difference(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    side = lambda d: d.groupBy(F.col("source").alias("token")).agg(F.min("doc_id").alias("id"))
    return R.vocabulary_difference(side(docs.filter("lang = 'en'")), side(docs.filter("lang <> 'fr' AND doc_id > 20")))


_SLOTS = "SELECT l_linenumber AS layer, l_suppkey % 64 AS expert, l_discount AS weight FROM lineitem"


def _slots(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("layer"), (F.col("l_suppkey") % 64).alias("expert"), F.col("l_discount").alias("weight"))


@register(
    "route_totals",
    f"""WITH t AS (SELECT layer, expert, count(*) AS slots, sum(weight) AS g FROM ({_SLOTS}) GROUP BY ALL)
    SELECT layer, expert, slots, round(g, 4) AS gate_sum, round(slots / sum(slots) OVER (PARTITION BY layer), 6) AS token_score,
      round(g / (sum(slots) OVER (PARTITION BY layer) / 4), 6) AS gate_score FROM t""",
)
def route_totals(spark, sf_dir):
    scored = routing.scores(routing.totals(_slots(spark, sf_dir)), 4)
    return scored.select("layer", "expert", "slots", F.round("gate_sum", 4).alias("gate_sum"), F.round("token_score", 6).alias("token_score"), F.round("gate_score", 6).alias("gate_score"))


@register(
    "route_coverage",
    f"""WITH t AS (SELECT layer, expert, count(*) AS slots FROM ({_SLOTS}) GROUP BY ALL),
    p AS (SELECT layer, slots, coalesce(sum(slots) OVER (PARTITION BY layer ORDER BY slots DESC, expert ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior, sum(slots) OVER (PARTITION BY layer) AS a FROM t)
    SELECT layer, count(*) FILTER (prior < 0.2 * a) AS experts_20, count(*) FILTER (prior < 0.5 * a) AS experts_50, count(*) FILTER (prior < 0.8 * a) AS experts_80 FROM p GROUP BY layer""",
)
def route_coverage(spark, sf_dir):
    return routing.coverage(routing.totals(_slots(spark, sf_dir)))


@register(
    "route_select_top_p",
    f"""WITH t AS (SELECT layer, expert, count(*) AS slots FROM ({_SLOTS}) GROUP BY ALL),
    p AS (SELECT layer, expert, coalesce(sum(slots) OVER (PARTITION BY layer ORDER BY slots DESC, expert ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior, sum(slots) OVER (PARTITION BY layer) AS a FROM t)
    SELECT layer, expert FROM p WHERE prior < 0.3 * a""",
)
def route_select_top_p(spark, sf_dir):
    total = routing.totals(_slots(spark, sf_dir))
    whole = total.groupBy("layer").agg(F.sum("slots").alias("a"))
    # whole numbers of slots keep the threshold exact
    return routing.select_top_p(total.join(whole, "layer"), 0.3 * F.col("a"), "slots").select("layer", "expert")


@register(
    "route_select_per_rank",
    f"""WITH t AS (SELECT layer, expert, count(*) AS slots FROM ({_SLOTS}) GROUP BY ALL)
    SELECT layer, expert, slots FROM t QUALIFY row_number() OVER (PARTITION BY layer, expert // 16 ORDER BY slots DESC, expert) <= 3""",
)
def route_select_per_rank(spark, sf_dir):
    return routing.select_per_rank(routing.totals(_slots(spark, sf_dir)), 3, 4, 64, "slots").select("layer", "expert", "slots")


@register(
    "route_layer_report",
    f"""WITH t AS (SELECT layer, expert, count(*) AS slots FROM ({_SLOTS}) GROUP BY ALL)
    SELECT layer, CAST(sum(slots) // 4 AS BIGINT) AS tokens, round(max(slots) / sum(slots), 6) AS max_token_share, 64 - count(*) AS experts_with_zero_slots FROM t GROUP BY layer""",
)
def route_layer_report(spark, sf_dir):
    return routing.layer_report(routing.totals(_slots(spark, sf_dir)), 4, 64).withColumn("max_token_share", F.round("max_token_share", 6))


@register(
    "flip_grouping_sets",
    """WITH j AS (SELECT l_returnflag AS grp, l_linenumber AS layer, (l_partkey % 16) <> ((l_partkey + CAST(l_quantity AS BIGINT) % 2) % 16) AS f FROM lineitem)
    SELECT grp, layer, count(*) AS elements, count(*) FILTER (f) AS flipped FROM j GROUP BY GROUPING SETS ((grp), (grp, layer))""",
)
def flip_grouping_sets(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("grp", F.col("l_returnflag")).withColumn("layer", F.col("l_linenumber"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    before = items.select(*keys, "grp", "layer", (F.col("l_partkey") % 16).alias("code"))
    after = items.select(*keys, ((F.col("l_partkey") + F.col("l_quantity").cast("long") % 2) % 16).alias("code"))
    return routing.flips(before, after, keys, "grp", "layer")


@register(
    "expert_sums", "SELECT (l_suppkey // 8) AS expert, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1"
)
def expert_sums(spark, sf_dir):
    return routing.summed_entries(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", 8).withColumn("total", F.round("total", 2))


@register(
    "parameter_inventory",
    "SELECT l_returnflag = 'R' AS trainable, l_linestatus AS dtype, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS elements, CAST(sum(CAST(l_quantity AS BIGINT) * 2) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL",
)
def parameter_inventory(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("trainable"), F.col("l_linestatus").alias("dtype"), F.col("l_quantity").cast("long").alias("elements"), F.lit(2).alias("width"))
    return routing.inventory(items)
