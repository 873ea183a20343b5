"""Importance resampling towards a target: documents drawn by how much likelier their n-grams are in the target.

Words of a document are exploded with their positions; lead() over the positions brings the following words to
each one, so that a row has the runs of one, two and more words that begin there. Their hashes are buckets, counted
over the whole corpus and over the whole target; a bucket's gain is the scaled log of the two rates' ratio. A
document's weight sums the gains of its features, and a Gumbel term that only its id decides turns the highest
scores into a draw without replacement.

A window must not hold a text of any length, so texts are cut into blocks of words, each with the first words of the
next one. The blocks are what is shuffled; words are exploded behind the shuffle, in the order that the window wants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.columns import unused
from millrace.operators.order import dense_index
from millrace.session import settle, unsettle

#: Words: ASCII letters and digits, and all characters beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a block, without those it borrows from the next.
BLOCK = 2000
KEY, ROW = "__key", "__row"


def lower_ascii(word: Column) -> Column:
    """A-Z as a-z, other letters as they are; translate() is slow, and lower() is the same for ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def feature_table(docs: DataFrame, key: str | None, text: str, orders: int, buckets: int) -> DataFrame:
    """(KEY, ROW, b1 ... b<orders>): a row for each word of each row of ``docs``, with the bucket of the run of k words
    that begins there, null where the text ends before. A text without words has one row of nulls."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD), "")
    rows = docs.select((F.col(key) if key else F.lit(0)).alias(KEY), F.monotonically_increasing_id().alias(ROW), words.alias("__words"))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size("__words") - 1) / BLOCK), F.lit(0)).cast("int"))
    cut = rows.select(KEY, ROW, "__words", F.explode(starts).alias("__block"))
    cut = cut.select(KEY, ROW, "__block", F.array_join(F.slice("__words", F.col("__block") * BLOCK + 1, BLOCK + orders - 1), " ").alias("__words"))  # one string is a third of an array to shuffle
    dealt = cut.repartition(ROW, "__block").sortWithinPartitions(ROW, "__block")
    placed = dealt.select(KEY, ROW, "__block", F.posexplode_outer(F.split(F.nullif(F.col("__words"), F.lit("")), " ")).alias("__at", "__word")).withColumn("__word", lower_ascii(F.col("__word")))
    along = Window.partitionBy(ROW, "__block").orderBy("__at")
    following = placed.select("*", *[F.lead("__word", k).over(along).alias(f"__w{k}") for k in range(1, orders)])
    own = following.filter(F.col("__at").isNull() | (F.col("__at") < BLOCK))
    run, features = F.col("__word"), []
    for k in range(1, orders + 1):
        features.append(F.pmod(F.crc32(run.cast("binary")), F.lit(buckets)).cast("int").alias(f"b{k}"))
        run = F.concat(run, F.lit(" "), F.col(f"__w{k}")) if k < orders else run
    return own.select(KEY, ROW, *features)


def bucket_counts(features: DataFrame, orders: int) -> DataFrame:
    """(bucket, n) of all features of a table; at most one row for each bucket."""
    every = features.select(F.explode(F.array(*[f"b{k}" for k in range(1, orders + 1)])).alias("bucket"))
    return every.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from the counts of corpus and target; rates are smoothed by one a bucket."""
    spark = corpus.sparkSession
    s, t = (x.select("bucket", F.col("n").cast("double").alias(c)) for x, c in ((corpus, "s"), (target, "t")))
    totals = s.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("all_s")).crossJoin(t.agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("all_t")))  # one row each
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(s), "bucket", "left").join(F.broadcast(t), "bucket", "left").na.fill(0.0, ["s", "t"])
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return every.crossJoin(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(key: Column, seed: int) -> Column:
    """A scaled Gumbel number that ``seed`` and the key decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, orders: int = 3, buckets: int = 10000, seed: int = 42, least: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of ``docs``; rank 1, 2, ... is set for the ``percent`` of a
    hundred (rounded down) of the rows with ``least`` words or more that score highest, ties to the smaller key.

    ``target`` needs the column ``text`` alone. Words are lower-cased in A-Z only; features are all runs of 1 to
    ``orders`` words, joined by a space, repeats counted. Null and empty texts and texts without words have no
    features and weight 0. Rows that repeat count and are drawn each for itself; rows with the same key and score
    rank in either order. A row with a null key has a null score and is never drawn. Empty tables give no rows; an
    empty target has no counts. Other columns are not read. ``docs`` must give the same rows again when a task is
    repeated, as stored tables do.
    """
    features = settle(feature_table(docs, key, text, orders, buckets), "features")
    corpus = settle(bucket_counts(features, orders), "corpus")
    wanted = settle(bucket_counts(feature_table(target, None, "text", orders, buckets), orders), "target")
    gains = settle(bucket_gains(corpus, wanted, buckets), "gains")  # one row for each bucket, whatever the tables
    own = features
    for k in range(1, orders + 1):
        own = own.join(F.broadcast(gains.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}"))), f"b{k}", "left")
    n_features = sum((F.count(f"b{k}") for k in range(2, orders + 1)), F.count("b1"))
    weight = sum((F.coalesce(F.sum(f"g{k}"), F.lit(0)) for k in range(2, orders + 1)), F.coalesce(F.sum("g1"), F.lit(0)))
    scored = own.groupBy(ROW, KEY).agg(F.count("b1").alias("n_words"), n_features.cast("long").alias("n_features"), weight.cast("long").alias("weight"))
    scored = settle(scored.select(KEY, "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col(KEY), seed)).cast("long").alias("score")), "scored")
    unsettle(features, corpus, wanted, gains)
    long_enough = scored.filter(F.col("n_words") >= least)
    drawn = long_enough.count() * percent // 100
    ranked = dense_index(long_enough.filter("score IS NOT NULL"), F.desc("score"), F.asc(KEY), into="place")
    rest = scored.filter((F.col("n_words") < least) | F.col("score").isNull()).withColumn("place", F.lit(drawn).cast("long"))
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank")
    return ranked.unionByName(rest).select(F.col(KEY).alias(key), "n_features", "weight", "score", rank)


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, key: str = "doc_id", **how) -> DataFrame:
    """Rows of ``docs`` that resampled() draws, with a column ``rank``; a key that several rows share comes as often as it is drawn, with the least of its ranks."""
    name = unused(docs, "rank")
    got = resampled(docs, target, percent, key=key, **how).filter("rank IS NOT NULL").groupBy(key).agg(F.min("rank").alias(name))
    return docs.join(got, key)
