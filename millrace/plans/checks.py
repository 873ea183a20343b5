"""Queries of the smaller profiles and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import checks, messages
from millrace.plans.registry import register, table


@register("shape_counts", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'pretokenized' WHEN doc_id % 3 = 1 THEN 'conversational' ELSE 'plain_text' END AS shape, count(*) AS n_rows FROM documents GROUP BY 1")
def shape_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ids = F.when(F.col("doc_id") % 3 == 0, F.array("doc_id"))
    turns = F.when(F.col("doc_id") % 3 == 1, F.array(messages.message("user", F.col("text"))))
    return checks.shape_counts(docs.select("text", ids.alias("input_ids"), turns.alias("messages")))


@register("source_contributions", "SELECT CASE WHEN doc_id < 150 THEN 'primary' ELSE 'replay' END AS source, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def source_contributions(spark, sf_dir):
    return checks.contributions(table(spark, sf_dir, "documents"), "doc_id", 150, "n_chars")


@register("class_counts", "SELECT count(*) FILTER (quality = 1) AS desirable, count(*) FILTER (quality = 0) AS undesirable, count(*) FILTER (quality IS NULL) AS unlabelled, round(count(*) FILTER (quality = 1) / nullif(count(*) FILTER (quality = 0), 0), 6) AS ratio FROM labels")
def class_counts(spark, sf_dir):
    return checks.class_counts(table(spark, sf_dir, "labels").withColumn("good", F.col("quality") == 1), "good").withColumn("ratio", F.round("ratio", 6))


@register("inspect_inputs", "SELECT lang, count(*) AS n_rows, count(*) FILTER (n_chars + 500 > 4000) AS over_limit, max(n_chars) AS longest, greatest(0, 4000 - max(n_chars)) AS largest_budget FROM documents GROUP BY lang")
def inspect_inputs(spark, sf_dir):
    return checks.inspect_inputs(table(spark, sf_dir, "documents"), "n_chars", 500, 4000, "lang")


@register("input_identity", "SELECT sha256(string_agg('[' || doc_id || ',' || n_chars || ']' || chr(10), '' ORDER BY doc_id)) AS identity FROM documents")
def input_identity(spark, sf_dir):
    return checks.input_identity(table(spark, sf_dir, "documents").withColumn("ids", F.array("doc_id", "n_chars")), "doc_id", "ids")


@register("render_conversations", "SELECT conv_id, '<s>' || string_agg(CASE role WHEN 'user' THEN '[U]' || text || chr(10) WHEN 'assistant' THEN '[A]' || text || '</a>' ELSE '[S]' || text || chr(10) END, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def render_conversations(spark, sf_dir):
    made = messages.gather(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return made.select("conv_id", checks.rendered(F.col("messages"), {"user": "[U]{content}\n", "assistant": "[A]{content}</a>", "system": "[S]{content}\n"}, "<s>").alias("text"))


@register("field_locations", "SELECT item_id, CAST(4 AS INTEGER) AS start, CAST(4 + length(text) AS INTEGER) AS \"end\" FROM benchmark")
def field_locations(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    found = checks.located_field(F.concat(F.lit("<q> "), F.col("text"), F.lit(" </q>")), F.lit("<q> @@ </q>"), "@@", F.col("text"))
    return rows.select("item_id", found.alias("f")).select("item_id", "f.start", "f.end")


@register("verified_append", "SELECT count(DISTINCT lang || '/' || source) AS n_rows, count(DISTINCT lang || '/' || source) - (SELECT count(DISTINCT lang || '/' || source) FROM documents WHERE doc_id < 20) AS added FROM documents")
def verified_append(spark, sf_dir):
    from millrace.session import scratch

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    path = scratch(spark, "appended")
    docs.filter("doc_id < 20").dropDuplicates(["lang", "source"]).write.parquet(path)
    done = checks.verified_append(spark.read.parquet(path), docs, ["lang", "source"], "doc_id", path)
    return spark.read.parquet(path).agg(F.count("*").alias("n_rows")).withColumn("added", F.lit(done["added"]).cast("long"))


@register("response_ids", "SELECT item_id, array_to_string(list_slice(w, 4, len(w)), ' ') AS response FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def response_ids(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(checks.response_ids(F.split("text", " "), F.lit(3)), " ").alias("response"))
