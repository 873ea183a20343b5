"""Queries of this subpackage, each an operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, decontaminate, importance, line_dedup, minhash_join, packing, quality_rules, repeats, secret_scan, shingle_join, token_counts, token_files, warc
from millrace.session import scratch

WORD_BPE = "word_bpe_49k.json"


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules.assess(_documents(spark, sf_dir).select("doc_id", "text"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return q.select("doc_id", *[F.col("quality")["m"][c].alias(c) for c in base], F.col("quality")["base_failed"].alias("base_failed"), F.col("quality")["kept"].alias("kept"))


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), hot AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g) WHERE n > 1
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hot) GROUP BY doc_id
), m AS (
  SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop
  FROM l LEFT JOIN r ON l.doc_id = r.doc_id
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.1
    AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM b
"""


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = shingle_join.jaccard_components(_documents(spark, sf_dir), size=4, threshold=85)
    return classes.select("doc_id", "n_shingles", "component_id")


def _components_sql(size: int, threshold: int, more: str) -> str:
    """Shingle sets, all pairs that share a shingle, and the least document that links reach."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {size} - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {size} + 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {threshold} * (a.n + b.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y
), f AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT f.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, f.c AS component_id{more} FROM f LEFT JOIN n ON n.doc_id = f.doc_id
"""


OP1_SQL = _components_sql(4, 85, "")
OP11_SQL = _components_sql(3, 85, ", f.doc_id = f.c AS kept")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    index = token_files.write_tokens(_documents(spark, sf_dir), folder, _tokenizer(), end=2)
    return token_files.read_tokens(token_files.with_starts(index), folder)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_documents(spark, sf_dir), least=50)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    index = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, least=1000)
    return warc.read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, n, max(page_id) AS keep FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN p.page_id < k.keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < k.keep THEN k.keep END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n = k.n
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), edits=line_dedup.CLASSES, least=1)
    return docs.select("doc_id", "n_lines", "n_removed", "text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _tokenizer(), end=2, size=4096)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), _tokenizer(), limit=2048)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), share=0.2)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_documents(spark, sf_dir))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = minhash_join.minhash_components(_documents(spark, sf_dir), size=3, threshold=85)
    return classes.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=5)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_tokenizers(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


OP12_SQL = r"""
WITH RECURSIVE t256(i, k, v) AS (
  SELECT i, 0, i FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t256 WHERE k < 8
), crcs AS (SELECT list(v ORDER BY i) AS tab FROM t256 WHERE k = 8),
texts AS (
  SELECT true AS own, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT false, item_id, coalesce(text, '') FROM benchmark
), w AS (
  SELECT own, id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), g AS (
  SELECT own, id, array_to_string(w[i:i + k - 1], ' ') AS f
  FROM (SELECT own, id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) AS r(k))
), f AS (
  SELECT f, list_reduce(list_prepend(4294967295, [CAST(concat('0x', h[2 * j - 1:2 * j]) AS BIGINT) FOR j IN range(1, len(h) // 2 + 1)]), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])) AS c
  FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM g), crcs
), b AS (SELECT g.own, g.id, xor(f.c, 4294967295) % 10000 AS b FROM g JOIN f USING (f)
), n AS (
  SELECT i AS b, CAST(count(b.b) FILTER (own) AS DOUBLE) AS s, CAST(count(b.b) FILTER (NOT own) AS DOUBLE) AS t FROM range(10000) AS r(i) LEFT JOIN b ON b.b = i GROUP BY i
), gain AS (
  SELECT b, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM n
), d AS (
  SELECT id, count(*) AS n_features, sum(gain) AS weight FROM b JOIN gain USING (b) WHERE own GROUP BY id
), s AS (
  SELECT w.id AS doc_id, len(w.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(concat('0x', sha256('42:' || w.id)[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN d ON w.id = d.id WHERE w.own
), r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_token_files": op2_token_files,
        "op3_repeats": op3_repeats,
        "op5_warc": op5_warc,
        "op7_line_dedup": op7_line_dedup,
        "op8_packing": op8_packing,
        "op4_quality_rules": op4_quality_rules,
        "op6_token_counts": op6_token_counts,
        "op9_decontamination": op9_decontamination,
        "op10_secret_scan": op10_secret_scan,
        "op11_minhash": op11_minhash,
        "op12_importance": op12_importance,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op11_minhash": OP11_SQL, "op4_quality_rules": OP4_SQL, "op5_warc": OP5_SQL, "op12_importance": OP12_SQL}
