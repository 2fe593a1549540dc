"""States of streams over several batches, and the small measures of the log."""

from __future__ import annotations

from tessera.operators import outcomes
from tessera.streaming.log import drain_state, last_values, read, use_counts


def test_states_over_batches(spark, tmp_path, as_rows):
    path = str(tmp_path / "asks")
    batches = [[("a", 1, "x"), ("a", 3, "y"), ("b", 2, None), (None, 9, "z")], [("a", 2, "late"), ("b", 2, "q"), ("c", None, "t")], [("a", 3, "zz"), ("b", 2, "q")]]
    for rows in batches:
        spark.createDataFrame(rows, "k string, at long, v string").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = lambda: read(spark, path, schema, 1)
    assert as_rows(drain_state(last_values(stream(), "k", "at", ["v"]), "k", "s")) == [("a", 3, "zz"), ("b", 2, "q")]
    assert as_rows(drain_state(use_counts(stream(), "k", "at"), "k", "u")) == [("a", 4, 3), ("b", 3, 2), ("c", 1, None)]


def test_states_of_nothing(spark, tmp_path, as_rows):
    path = str(tmp_path / "none")
    spark.createDataFrame([], "k string, at long, v string").write.parquet(path)
    stream = read(spark, path, spark.read.parquet(path).schema)
    assert as_rows(drain_state(use_counts(stream, "k", "at"), "k", "n")) == []


def test_two_thresholds(spark):
    df = spark.createDataFrame([(0.95, 0.1, True, 1), (0.5, 0.5, False, 1), (1.5, -1.0, True, 1), (None, 0.5, True, 1), (0.5, 0.5, None, 1)], "x double, y double, good boolean, a int")
    got = {(r[0], r[1]): (r[2], r[3]) for r in outcomes.two_thresholds(df, "x", "y", "good", 2).collect()}
    assert len(got) == 9 and got[0, 0] == (3, 2) and got[0.5, 0.5] == (1, 0) and got[1, 0] == (1, 1) and got[1, 1] == (0, 0)
    assert all(r[2] == 0 for r in outcomes.two_thresholds(df.where("false"), "x", "y", "good", 2).collect())


def test_best_pieces_and_source_scores(spark, as_rows):
    uses = spark.createDataFrame([("o1", "m1", 2, "where is the red cache"), ("o1", "m2", 1, "where is the red cache"), ("o2", "m9", 1, "x"), ("o3", "m1", 1, None), ("o4", "m3", None, "")], "operation_id string, memory_id string, rank int, query string")
    memories = spark.createDataFrame([("m1", "Nothing here.  The red cache is warm!\nRed."), ("m2", "A cache. Red cache."), ("m3", "One. Two."), ("m4", None)], "id string, text string")
    got = [tuple(r[:3]) for r in outcomes.best_pieces(uses, memories).sort("operation_id").collect()]
    assert got == [("o1", "m2", "Red cache."), ("o4", "m3", "One.")]
    feedback = spark.createDataFrame([("o1", "m1", 1.0), ("o1", "m3", 1.0), ("o1", "m2", -1.0), ("o2", "m4", 1.0), (None, "m1", 1.0), ("o3", None, 1.0)], "linked_operation_id string, memory_id string, rating double")
    sources = spark.createDataFrame([("m1", "s1"), ("m2", "s1"), ("m3", "s2"), ("m4", None)], "id string, source string")
    assert as_rows(outcomes.source_scores(uses, feedback, sources)) == [("o1", 2, 1)]
    assert as_rows(outcomes.best_pieces(uses.where("false"), memories)) == []
