"""Streams of the outcome log and of events. Each function takes and gives a streaming DataFrame; the state each keeps is bounded by its watermark."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.storage import cut, shared_dir


def read(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files under path as they arrive; timestamps without zone are read as ones in the session's zone, which a watermark needs."""
    some = f"{path[:-1]}[{path[-1]}]"  # a pattern, since a single file can't be a stream's folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(some)
    return rows.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema))


def window_counts(events: DataFrame, key: str, at: str = "ts", value: str = "value", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their value per key and window; a window comes out when the watermark has passed it, and rows later than that are dropped."""
    rows = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key)
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("from"), F.col("w.end").cast("timestamp_ntz").alias("to"), key, "n", "total")


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events without a gap: first, last window end and number of events."""
    rows = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key)
    return rows.agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("from"), F.col("w.end").cast("timestamp_ntz").alias("to"), key, "n")


def first_seen(events: DataFrame, keys: list[str], at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each combination of keys once per watermark: repeats within ``late`` of each other are dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def link_feedback(asks: DataFrame, feedback: DataFrame, late: str = "7 days") -> DataFrame:
    """Feedback (linked_operation_id, at) joined to its ask (operation_id, at) if it comes within ``late`` after it; state of both sides is kept no longer."""
    a = asks.withWatermark("at", late).select(F.col("operation_id"), F.col("at").alias("asked_at"))
    f = feedback.withWatermark("at", late).select("linked_operation_id", F.col("at").alias("answered_at"), "label")
    near = F.expr(f"linked_operation_id = operation_id AND answered_at >= asked_at AND answered_at <= asked_at + interval {late}")
    return f.join(a, near)


def last_values(rows: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The latest values of each key; of rows at one time the largest count. A state is one row per key, kept as long as the stream runs, since a key may always come again. Null keys and times are left out."""
    return rows.dropna(subset=[key, at]).groupBy(key).agg(F.max(F.struct(at, *columns)).alias("v")).select(key, "v.*")


def use_counts(rows: DataFrame, key: str, at: str) -> DataFrame:
    """How often each key has come and when last; the state is one row per key. Null keys are left out."""
    return rows.dropna(subset=[key]).groupBy(key).agg(F.count("*").alias("n"), F.max(at).alias("last"))


def drain_state(stream: DataFrame, key: str, name: str) -> DataFrame:
    """Runs a stream with one row of state per key over what is there now, and gives the last state of each key.

    Batches write the states that have changed, each into a folder of its own, which a batch that is run again replaces; the one of the last batch counts.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{folder}/rows")
    rest = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct("batch", *rest)).alias("v")).select(key, *(F.col(f"v.{c}").alias(c) for c in rest))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there now into Parquet files in the shared folder and reads them: for backfills and tests."""
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def with_tail(closed: DataFrame, events: DataFrame, result: Callable[[DataFrame], DataFrame], key: str, at: str = "ts", since: str = "2 days") -> DataFrame:
    """What a stream gave, and what it still holds because its watermark hasn't passed: result, applied in batch to all events of the keys with an event in the last since (the longest time between an event and its watermark's end of it), less what came out."""
    last = events.agg(F.max(at).alias("last"))
    recent = events.join(F.broadcast(last), F.col(at) >= F.col("last") - F.expr(f"interval {since}"), "left_semi").select(key).distinct()
    # written, since Spark would push the join below the merging of sessions, whose starts it changes
    tail = cut(result(events.join(recent, key, "left_semi")), "tail").join(closed.select("from", key), ["from", key], "left_anti")
    return closed.unionByName(tail)
