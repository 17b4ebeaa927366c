"""Registered queries of the corpus operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfare.llm import (
    bpe,
    exact_dedup,
    filter_audit,
    line_dedup,
    near_dedup,
    packing,
    pii,
    quality_model,
    quality_rules,
    secrets,
    sharding,
    spelling,
    token_counts,
)


def bound_batches(spark: SparkSession) -> None:
    """Send at most 500 texts to Python at once, so that long ones need little memory there and in
    the JVM. A setting of the session that runs these queries; the operators leave it alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality_model.score(docs, quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_secret_scan,
        op2_quality_rules,
        op3_bpe,
        op4_near_dedup,
        op5_sharding,
        op6_best_fit_packing,
        op7_quality_model,
        op8_exact_dedup,
        op9_line_dedup,
        op10_token_counts,
        op11_personal_data,
        op12_spelling,
        op13_filter_audit,
    )
    return {f.__name__: f for f in found}


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP_SQL = f"""
WITH hashed AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM hashed WINDOW g AS (PARTITION BY text_sha256)
"""


LINE_DEDUP_SQL = """
WITH lines AS (
    SELECT r, doc_id, source, pos, line, regexp_matches(line, '[^ \\t-\\r]') AS worded
    FROM (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
         LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) u
), spread AS (
    SELECT line FROM lines WHERE worded GROUP BY line HAVING count(DISTINCT source) >= 5
), marked AS (
    SELECT l.*, s.line IS NOT NULL AS hit FROM lines l LEFT JOIN spread s ON l.worded AND l.line = s.line
), judged AS (
    SELECT *, sum(CASE WHEN hit THEN length(line) ELSE 0 END) OVER (PARTITION BY r)
              <= 0.5 * sum(length(line)) OVER (PARTITION BY r) AS few
    FROM marked
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit AND few) AS n_removed,
       bool_or(hit AND NOT few) AS left_whole,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (hit AND few)), '')) AS text_sha256
FROM judged GROUP BY r
"""


FILTER_AUDIT_SQL = """
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS words
    FROM documents
), judged AS (
    SELECT part,
           [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
            100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
            regexp_matches(text, '[#$%&*|]'),
            coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f,
           coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
    FROM docs LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) l
         USING (doc_id)
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 3, 4, 5]) AS pos
), orders(spelled, ats) AS (
    SELECT letter, [pos] FROM letters
    UNION ALL
    SELECT spelled || letter, list_append(ats, pos) FROM orders, letters WHERE NOT list_contains(ats, pos)
), steps AS (
    SELECT spelled AS filter_order, ats, step FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step) WHERE len(ats) = 5
), sets AS (
    SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY ALL
), seen AS (
    SELECT *, f[ats[step]] AS fails, list_bool_or(list_transform(ats[1:step - 1], lambda a: f[a])) AS before
    FROM sets, steps
), summed AS (
    SELECT part, filter_order, step, ats[step] AS pos,
           coalesce(sum(n) FILTER (NOT fails AND NOT coalesce(before, false)), 0) AS kept,
           coalesce(sum(n) FILTER (fails AND NOT coalesce(before, false)), 0) AS removed,
           coalesce(sum(n) FILTER (fails AND coalesce(before, false)), 0) AS redundant,
           coalesce(sum(n) FILTER (fails AND len(list_filter(f, lambda x: x)) = 1), 0) AS unique_fails,
           coalesce(sum(good) FILTER (fails AND NOT coalesce(before, false)), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (fails AND NOT coalesce(before, false)), 0) AS toxic_lost
    FROM seen GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, pos))::BIGINT AS shapley
FROM summed
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": EXACT_DEDUP_SQL, "op9_line_dedup": LINE_DEDUP_SQL, "op13_filter_audit": FILTER_AUDIT_SQL}
