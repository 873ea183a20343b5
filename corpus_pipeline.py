"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_dedup, packing, quality_rules, shingle_join
from millrace.session import drop_folder, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has, give or take the edits of their length; those left without a word go."""
    left = line_dedup.dedup_lines(docs, edits=line_dedup.CLASSES, least=1)
    texts = left.filter((F.col("n_removed") == 0) | F.col("text").rlike(quality_rules.NOT_SPACE))
    own = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return texts.withColumns(own).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group linked by a similarity of 0.8 of five-word shingles."""
    return shingle_join.one_of_each(docs, size=5, threshold=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences of 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2, size=4096, with_ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("sequences", sequences)]

#: No SQL form: edit distances, embeddings and token ids. Tests hold the stages' decisions against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole table documents.

    Null texts and texts without words fail the quality rules; an empty table gives no rows. Rows that repeat go on
    together until the near copies, where rows that share a doc_id stay or go together; rows with a null doc_id
    are no copies and hold no items. Texts of any length are read whole. A stage's folder goes once the next is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return docs
