"""Queries over the memory tables outside the training-data package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import epoch_micros, iso_micros, month_name, norm_key
from tessera.operators.orphans import count_orphans, orphan_references
from tessera.sources.tables import table


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Every reference of the memory tables, in the form of orphan_references."""

    def rows(name: str, key: str, parent: str, space: str, at: Column) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("ref_table"), norm_key(key).alias("ref_key"), F.lit(space).alias("space"), norm_key(parent).alias("key"), at.alias("at"))

    unknown = F.lit(None).cast("long")
    return (
        rows("vectors", "memory_id", "memory_id", "memory", unknown)
        .unionByName(rows("relations", "id", "target_memory_id", "memory", epoch_micros("created_at")))
        .unionByName(rows("memory_sources", "memory_id", "memory_id", "memory", epoch_micros("created_at")))
        .unionByName(rows("evidence_state_failure_outcomes", "operation_id", "linked_operation_id", "ask", iso_micros("created_at")))
    )


def _parents(spark: SparkSession, d: str) -> DataFrame:
    memories = table(spark, d, "memories").select(F.lit("memory").alias("space"), norm_key("id").alias("key"), epoch_micros("created_at").alias("since"))
    log = table(spark, d, "evidence_state_failure_outcomes").where(norm_key("event_type") == "ask")
    return memories.unionByName(log.select(F.lit("ask").alias("space"), norm_key("operation_id").alias("key"), iso_micros("created_at").alias("since")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_references(spark, d), _parents(spark, d)).select("ref_table", "ref_key").distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and month."""
    counts = count_orphans(orphan_references(_references(spark, d), _parents(spark, d)))
    return counts.withColumn("month", month_name("month"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p5_found, p5_counts)}

_KEY = r"nullif(lower(regexp_replace({0}, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')), '')".format
_AT = "epoch_us(try_cast(replace(upper(trim(created_at)), 'Z', '+00:00') AS TIMESTAMPTZ))"
_ORPHANS = f"""refs AS (
  SELECT 'vectors' AS ref_table, {_KEY("memory_id")} AS ref_key, 'memory' AS space, {_KEY("memory_id")} AS key, NULL::BIGINT AS at_us FROM vectors
  UNION ALL SELECT 'relations', {_KEY("id")}, 'memory', {_KEY("target_memory_id")}, epoch_us(created_at) FROM relations
  UNION ALL SELECT 'memory_sources', {_KEY("memory_id")}, 'memory', {_KEY("memory_id")}, epoch_us(created_at) FROM memory_sources
  UNION ALL SELECT 'evidence_state_failure_outcomes', {_KEY("operation_id")}, 'ask', {_KEY("linked_operation_id")}, {_AT} FROM evidence_state_failure_outcomes
), parents AS (
  SELECT space, key, min(since) AS since FROM (
    SELECT 'memory' AS space, {_KEY("id")} AS key, epoch_us(created_at) AS since FROM memories
    UNION ALL SELECT 'ask', {_KEY("operation_id")}, {_AT} FROM evidence_state_failure_outcomes WHERE {_KEY("event_type")} = 'ask'
  ) WHERE key IS NOT NULL GROUP BY ALL
), orphans AS (
  SELECT DISTINCT ref_table, ref_key, refs.space, refs.key, strftime(make_timestamp(at_us), '%Y-%m') AS month, p.key IS NULL AS missing
  FROM refs LEFT JOIN parents p ON refs.space = p.space AND refs.key = p.key
  WHERE refs.key IS NOT NULL AND (p.key IS NULL OR since > at_us)
)"""
SQL: dict[str, str] = {
    "p5_found": f"WITH {_ORPHANS} SELECT DISTINCT ref_table, ref_key FROM orphans",
    "p5_counts": f"""WITH {_ORPHANS} SELECT ref_table, coalesce(month, 'unknown') AS month, count(*) AS orphans, count(*) FILTER (missing) AS missing_parent, count(*) FILTER (NOT missing) AS later_parent
FROM orphans GROUP BY ref_table, coalesce(month, 'unknown')""",
}
