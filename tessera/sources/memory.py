"""The memory tables in the form in which operators join them: keys normal, one row per key, logs parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import iso_micros, norm_key, norm_namespace
from tessera.sources.tables import table


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key with the largest order columns, nulls smallest; added up where the rows lie, so that no key is a hot spot. All columns take part after those of order, so the choice is definite."""
    rest = [c for c in rows.columns if c != key and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("best")
    return rows.groupBy(key).agg(best).select(key, *(F.col(f"best.{c}").alias(c) for c in [*order, *rest]))


def memories(spark: SparkSession, d: str) -> DataFrame:
    """One row per id: the version with the latest updated_at, then that not deprecated, then the highest confidence, importance and text."""
    m = table(spark, d, "memories")
    rows = m.select(norm_key("id").alias("id"), "updated_at", (-F.coalesce("deprecated", F.lit(0))).alias("live"), "confidence", "importance", "text", norm_namespace("namespace").alias("namespace"), norm_key("domain_id").alias("domain_id"), "memory_type", "stability", "created_at", "clc_state")
    return latest(rows.where("id is not null"), "id", ["updated_at", "live", "confidence", "importance", "text", "namespace", "domain_id", "memory_type", "stability", "created_at", "clc_state"])


def active(m: DataFrame) -> DataFrame:
    return m.where("live = 0")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct typed links: source, target, type, with their largest weight; ends and type in normal form, none blank, no loops."""
    r = table(spark, d, "relations").select(norm_key("source_memory_id").alias("source"), norm_key("target_memory_id").alias("target"), norm_key("relation_type").alias("type"), "weight")
    return r.dropna(subset=["source", "target", "type"]).where("source <> target").groupBy("source", "target", "type").agg(F.max("weight").alias("weight"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    """One row per memory: source in lower case without blanks at its ends, and chunk_index; of several the largest."""
    s = table(spark, d, "memory_sources").select(norm_key("memory_id").alias("id"), norm_key("source").alias("source"), "chunk_index")
    return s.where("id is not null").groupBy("id").agg(F.max(F.struct("source", "chunk_index")).alias("s")).select("id", "s.*")


_REQUEST = "request struct<query: string, top_k: int, namespace: string, session_id: string, memory_id: string, label: string, rating: double, feedback_scope: string>"
_RESPONSE = "response struct<confidence: double, conflict: boolean, raw_results: array<struct<memory_id: string, rank: int, score: double>>>"


def log(spark: SparkSession, d: str) -> DataFrame:
    """The outcome log, an event once: operation_id, linked_operation_id, event_type, at (microseconds) and payload as a struct, null where it can't be read. Of events logged again the latest counts."""
    e = table(spark, d, "evidence_state_failure_outcomes")
    whole = F.when(F.try_parse_json("payload").isNotNull(), F.col("payload"))
    rows = e.select(norm_key("operation_id").alias("operation_id"), norm_key("linked_operation_id").alias("linked_operation_id"), norm_key("event_type").alias("event_type"), iso_micros("created_at").alias("at"), whole.alias("payload"))
    rows = latest(rows.where("operation_id is not null"), "operation_id", ["at", "event_type", "linked_operation_id", "payload"])
    return rows.withColumn("payload", F.from_json("payload", f"{_REQUEST}, {_RESPONSE}"))


def asks(log_rows: DataFrame) -> DataFrame:
    q = F.col("payload.request")
    return log_rows.where("event_type = 'ask'").select("operation_id", "at", q["query"].alias("query"), norm_namespace(q["namespace"]).alias("namespace"), q["session_id"].alias("session_id"), F.col("payload.response.confidence").alias("confidence"), F.col("payload.response.conflict").alias("conflict"), F.col("payload.response.raw_results").alias("results"))


def feedback(log_rows: DataFrame) -> DataFrame:
    q = F.col("payload.request")
    return log_rows.where("event_type = 'feedback'").select("operation_id", "linked_operation_id", "at", norm_key(q["memory_id"]).alias("memory_id"), norm_key(q["label"]).alias("label"), q["rating"].alias("rating"), norm_key(q["feedback_scope"]).alias("scope"), q["query"].alias("query"))


def uses(ask_rows: DataFrame) -> DataFrame:
    """One row per result of an ask: operation_id, at, query, namespace, memory_id, rank, score."""
    r = ask_rows.select("operation_id", "at", "query", "namespace", F.explode("results").alias("r"))
    return r.select("operation_id", "at", "query", "namespace", norm_key("r.memory_id").alias("memory_id"), F.col("r.rank").alias("rank"), F.col("r.score").alias("score")).where("memory_id is not null")
