"""Queries of rewards and quality scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import quality, rewards
from millrace.operators import order
from millrace.plans.registry import register, table

_W = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@register(
    "repeated_trigrams",
    f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w)
    SELECT doc_id, round(CASE WHEN len(g) > 0 THEN 1.0 - len(list_distinct(g)) / len(g) ELSE 0.0 END, 6) AS share FROM g""",
)
def repeated_trigrams(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(rewards.repeated_trigrams(F.col("text")), 6).alias("share"))


@register(
    "length_window",
    f"WITH n AS (SELECT doc_id, len({_W}) AS n FROM documents) SELECT doc_id, round(greatest(0.0, 1.0 - CASE WHEN n < 100 THEN 100 - n WHEN n > 400 THEN n - 400 ELSE 0 END / 300.0), 6) AS reward FROM n",
)
def length_window(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(rewards.length_window(F.size(rewards.words(F.col("text"))), 100, 400), 6).alias("reward"))


@register(
    "phrases_reward",
    "SELECT doc_id, round((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'of ') THEN 1 ELSE 0 END) / 2.0 - (CASE WHEN contains(lower(text), '|') THEN 1 ELSE 0 END) / 1.0, 6) AS reward FROM documents",
)
def phrases_reward(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(rewards.phrases(F.col("text"), ["The", "OF "], ["|"]), 6).alias("reward"))


@register(
    "reference_match_all",
    r"""WITH i AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark), n AS (SELECT d.doc_id, trim(regexp_replace(translate(lower(d.text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+', ' ', 'g')) AS got, trim(regexp_replace(translate(lower(b.text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '\s+', ' ', 'g')) AS want FROM documents d JOIN i b ON d.doc_id % b.n = b.i)
    SELECT doc_id, CAST(CASE WHEN got = want THEN 1.0 ELSE 0.0 END AS DOUBLE) AS equals, CAST(CASE WHEN contains(got, want) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS contains FROM n""",
)
def reference_match_all(spark, sf_dir):
    """Documents dealt over all items by their count."""
    items = table(spark, sf_dir, "benchmark")
    n = items.count()
    dealt = order.dense_index(items, "item_id", into="i").select("i", F.col("text").alias("want"))
    rows = _docs(spark, sf_dir).join(dealt, F.col("doc_id") % n == F.col("i"))
    return rows.select("doc_id", rewards.reference_match(F.col("text"), F.col("want"), "equals").alias("equals"), rewards.reference_match(F.col("text"), F.col("want"), "contains").alias("contains"))


@register("reference_fuzzy")
def reference_fuzzy(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("want"))
    other = items.select((F.col("item_id") + 1).alias("item_id"), F.col("want").alias("text"))
    rows = items.join(other, "item_id")
    return rows.select("item_id", rewards.reference_match(F.col("text"), F.col("want"), "fuzzy", 0.3).alias("reward"))


@register("regex_reward", "SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{3}-[0-9]{4}') THEN 1.0 ELSE 0.0 END AS found, CASE WHEN lower(regexp_extract(text, '^([A-Z][a-z]+)', 1)) = 'the' THEN 1.0 ELSE 0.0 END AS named FROM documents")
def regex_reward(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", rewards.regex(F.col("text"), "[0-9]{3}-[0-9]{4}").alias("found"), rewards.regex(F.col("text"), "^([A-Z][a-z]+)", 1, F.lit("the")).alias("named"))


@register("json_reward_all", "SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS valid FROM events")
def json_reward_all(spark, sf_dir):
    """Every event."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit(" and more"))).otherwise(F.concat(F.lit(" "), F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", rewards.json_valid(text).alias("valid"))


@register(
    "judge_numbers",
    r"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE CAST(regexp_extract('score: ' || round(value, 2) || ' of 100', '-?\d+(?:\.\d+)?', 0) AS DOUBLE) END AS score FROM events",
)
def judge_numbers(spark, sf_dir):
    reply = F.when(F.col("event_id") % 5 == 0, "no idea").otherwise(F.concat(F.lit("score: "), F.round("value", 2).cast("string"), F.lit(" of 100")))
    return table(spark, sf_dir, "events").select("event_id", rewards.judged(reply).alias("score"))


#: 2 ** _SHIFT neighbouring documents have their words listed in one place, once for each.
_SHIFT = 6


@register(
    "token_f1_all",
    f"""WITH w AS (SELECT doc_id, {_W.replace('text', 'lower(text)')} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS t FROM w), c AS (SELECT doc_id, t, count(*) AS k FROM u GROUP BY ALL)
    , s AS (SELECT a.doc_id, sum(least(a.k, b.k)) AS shared FROM c a JOIN c b ON b.doc_id = a.doc_id + 1 AND a.t = b.t GROUP BY a.doc_id)
    SELECT a.doc_id, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 1.0 ELSE 2.0 * coalesce(shared, 0) / (len(a.w) + len(b.w)) END, 6) AS f1 FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 LEFT JOIN s ON s.doc_id = a.doc_id""",
)
def token_f1_all(spark, sf_dir):
    """Every pair of neighbouring documents, whatever its length."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    block = F.shiftright("doc_id", _SHIFT)
    first = F.when(F.col("doc_id") % (1 << _SHIFT) == 0, F.array(block - 1, block)).otherwise(F.array(block))  # a block's first document follows the one before, too
    dealt = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.explode(first).alias("block"))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "doc_id")  # texts are shuffled and sorted, not lists of words, which are larger
    listed = dealt.select("block", "doc_id", rewards.words(F.lower("text")).alias("w")).select("block", "doc_id", rewards.counted(F.col("w")).alias("c"))
    after = F.collect_list("c").over(Window.partitionBy("block").orderBy("doc_id").rangeBetween(1, 1))
    both = listed.withColumn("after", after).filter(F.col("block") == block).select("doc_id", "c", F.explode("after").alias("d"))
    return both.select("doc_id", F.round(rewards.counted_f1(F.col("c"), F.col("d")), 6).alias("f1"))


@register("classification_scores", "SELECT doc_id, CASE WHEN lang = 'fr' THEN 0.0 ELSE 1.0 END AS score, CASE WHEN lang = 'fr' THEN 1.0 ELSE 0.0 END AS invalid, CASE WHEN lang = 'fr' THEN 1.0 ELSE 0.0 END AS ambiguous FROM documents")
def classification_scores(spark, sf_dir):
    output = F.when(F.col("lang") == "fr", "either FR or en").otherwise(F.concat(F.lit("  "), F.upper("lang"), F.lit(" ")))
    labels = F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")])
    scored = _docs(spark, sf_dir).select("doc_id", quality.label_scores(output, labels, F.col("lang")).alias("s"))
    return scored.select("doc_id", "s.score", "s.invalid", "s.ambiguous")


@register("choice_scores", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 0.0 ELSE 1.0 END AS score FROM documents")
def choice_scores(spark, sf_dir):
    output = F.element_at(F.array(F.lit("(A)"), F.lit("The answer is A."), F.lit("Answer: a)"), F.lit("B, or A")), (F.col("doc_id") % 4 + 1).cast("int"))
    labels = F.array(F.lit("A"), F.lit("B"))
    return _docs(spark, sf_dir).select("doc_id", quality.label_scores(output, labels, F.lit("A"), choice=True)["score"].alias("score"))


@register("answer_scores", "SELECT item_id, 1.0 AS exact_match, text AS best FROM benchmark")
def answer_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", quality.answer_scores(F.concat(F.lit(" "), F.upper("text"), F.lit("!")), F.array(F.lit("something else"), F.col("text"))).alias("s"))
    return rows.select("item_id", "s.exact_match", "s.best")


@register("json_scores", "SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 0.0 ELSE 1.0 END AS json_valid, CASE WHEN event_id % 4 = 0 THEN 1.0 WHEN event_id % 4 = 2 THEN 0.5 ELSE 0.0 END AS reference FROM events")
def json_scores(spark, sf_dir):
    output = F.element_at(F.array(F.lit('{"b": [1, 2], "a": 1.0}'), F.lit('{"a": 1, "a": 1}'), F.lit('{"a": true, "b": [1, 2]}'), F.lit("[1]")), (F.col("event_id") % 4 + 1).cast("int"))
    scored = quality.json_scores(output, F.lit('{"a": 1, "b": [1, 2]}'))
    return table(spark, sf_dir, "events").select("event_id", scored["json_valid"].alias("json_valid"), scored["reference"].alias("reference"))


@register("preference_scores", "SELECT round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN value = 50 THEN 1.0 ELSE 0.0 END), 6) AS ties, round(avg(value - 50), 5) AS margin FROM events")
def preference_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(quality.preference_scores(F.col("value"), F.lit(50.0)).alias("s"))
    return rows.agg(F.round(F.avg("s.accuracy"), 6).alias("accuracy"), F.round(F.avg("s.tie"), 6).alias("ties"), F.round(F.avg("s.margin"), 5).alias("margin"))


@register("row_faults", "SELECT conv_id, turn FROM conversations WHERE turn % 2 = 1")
def row_faults(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    row = F.when(F.col("turn") % 2 == 1, F.to_json(F.struct(F.col("text").alias("prompt")))).otherwise(F.to_json(F.struct(F.col("text").alias("prompt"), F.lit("yes").alias("answer"))))
    keyed = turns.select(F.concat_ws("/", "conv_id", "turn").alias("key"), "conv_id", "turn", row.alias("row"))
    bad = quality.faults(keyed, "qa", "key")
    return keyed.join(bad, "key").select("conv_id", "turn")
