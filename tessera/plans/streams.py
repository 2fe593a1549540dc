"""Streaming jobs run over the tables as they are: what a continuous run would have given once everything had arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import iso_micros, norm_key
from tessera.sources.tables import table
from tessera.streaming.log import drain, drain_state, first_seen, last_values, link_feedback, read, sessions, use_counts, window_counts, with_tail


def _events(s: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    return read(s, path, s.read.parquet(path).schema)


def _now(s: SparkSession, d: str) -> DataFrame:
    """The same events as a table."""
    e = table(s, d, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def st_06_event_windows(s: SparkSession, d: str) -> DataFrame:
    """Events per day and type, also of the day that isn't over."""
    run = lambda e: window_counts(e, "event_type")
    return with_tail(drain(run(_events(s, d)), "windows"), _now(s, d), run, "event_type")


def st_07_sessions(s: SparkSession, d: str) -> DataFrame:
    """Sessions of each user, also those still open."""
    run = lambda e: sessions(e, "user_id", gap="6 hours")
    return with_tail(drain(run(_events(s, d)), "sessions"), _now(s, d), run, "user_id")


def st_04_first_seen(s: SparkSession, d: str) -> DataFrame:
    """Events by type, an event that comes again not counted again."""
    rows = drain(first_seen(_events(s, d), ["event_id"]), "first_seen")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


def st_05_linked_feedback(s: SparkSession, d: str) -> DataFrame:
    """Feedback within a week of its ask, from two streams of one log."""
    path = f"{d}/evidence_state_failure_outcomes.parquet"
    log = read(s, path, s.read.parquet(path).schema)
    rows = log.select(norm_key("operation_id").alias("operation_id"), norm_key("linked_operation_id").alias("linked_operation_id"), "event_type", F.timestamp_micros(iso_micros("created_at")).alias("at"), F.get_json_object("payload", "$.request.label").alias("label")).where("at is not null")
    asks, feedback = rows.where("event_type = 'ask'"), rows.where("event_type = 'feedback' and linked_operation_id is not null")
    return drain(link_feedback(asks, feedback), "linked").groupBy("label").agg(F.count("*").alias("n"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    """Asks as they arrive: the time in microseconds and the readable payload."""
    path = f"{d}/evidence_state_failure_outcomes.parquet"
    log = read(s, path, s.read.parquet(path).schema).where(norm_key("event_type") == "ask")
    whole = F.when(F.try_parse_json("payload").isNotNull(), F.col("payload"))
    return log.select(norm_key("operation_id").alias("operation_id"), iso_micros("created_at").alias("at"), F.from_json(whole, "request struct<query: string, session_id: string>, response struct<raw_results: array<struct<memory_id: string>>>").alias("p"))


def st_03_session_topics(s: SparkSession, d: str) -> DataFrame:
    """What each session asked last."""
    rows = _asked(s, d).select("at", F.col("p.request.session_id").alias("session_id"), F.col("p.request.query").alias("topic")).where("topic is not null")
    return drain_state(last_values(rows, "session_id", "at", ["topic"]), "session_id", "topics")


def st_06_use_counts(s: SparkSession, d: str) -> DataFrame:
    """How often each memory has been a result, an ask logged again counting again, and when last."""
    rows = _asked(s, d).select("at", F.explode("p.response.raw_results").alias("r")).select(norm_key("r.memory_id").alias("memory_id"), "at")
    return drain_state(use_counts(rows, "memory_id", "at"), "memory_id", "uses")


QUERIES = {f.__name__: f for f in (st_03_session_topics, st_04_first_seen, st_05_linked_feedback, st_06_event_windows, st_06_use_counts, st_07_sessions)}
_KEY = r"nullif(lower(regexp_replace({0}, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')), '')".format
_ASKED = f"""WITH asked AS (SELECT epoch_us(try_cast(replace(upper(trim(created_at)), 'Z', '+00:00') AS TIMESTAMPTZ)) AS at_us, payload FROM evidence_state_failure_outcomes WHERE {_KEY("event_type")} = 'ask' AND json_valid(payload))"""
SQL = {
    "st_03_session_topics": f"""{_ASKED} SELECT session_id, max(at_us) AS at, first(topic ORDER BY at_us DESC, topic DESC) AS topic FROM (SELECT at_us, payload ->> '$.request.session_id' AS session_id, payload ->> '$.request.query' AS topic FROM asked)
WHERE session_id IS NOT NULL AND at_us IS NOT NULL AND topic IS NOT NULL GROUP BY 1""",
    "st_06_use_counts": f"""{_ASKED} SELECT {_KEY("r ->> '$.memory_id'")} AS memory_id, count(*) AS n, max(at_us) AS last FROM (SELECT at_us, unnest(cast(payload -> '$.response.raw_results' AS JSON[])) AS r FROM asked) WHERE {_KEY("r ->> '$.memory_id'")} IS NOT NULL GROUP BY 1""",
    "st_05_linked_feedback": f"""WITH log AS (SELECT {_KEY("operation_id")} AS op, {_KEY("linked_operation_id")} AS link, event_type, try_cast(replace(upper(trim(created_at)), 'Z', '+00:00') AS TIMESTAMPTZ) AS at, CASE WHEN json_valid(payload) THEN payload ->> '$.request.label' END AS label FROM evidence_state_failure_outcomes)
SELECT f.label, count(*) AS n FROM log f JOIN log a ON a.op = f.link AND a.event_type = 'ask' AND f.event_type = 'feedback' AND f.at >= a.at AND f.at <= a.at + INTERVAL 7 DAY GROUP BY 1""",
    "st_04_first_seen": "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY 1",
    "st_06_event_windows": """SELECT date_trunc('day', ts) AS "from", date_trunc('day', ts) + INTERVAL 1 DAY AS "to", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
GROUP BY 1, 2, 3""",
    "st_07_sessions": """SELECT min(ts) AS "from", max(ts) + INTERVAL 6 HOUR AS "to", user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (
  SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, k""",
}
