from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_embeddings
from tessera.operators import aggregates, geometry, joins, outcomes
from tessera.operators.upserts import merged, new_rows


def test_geometry_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) * [5, 3, 1, 0.5, 0.1]
    data = [("g", i, v.tolist()) for i, v in enumerate(x)] + [("one", 900, [1.0, 2.0]), (None, 901, [1.0]), ("h", 902, None), ("h", 903, [])]
    df = spark.createDataFrame(data, "group string, id long, embedding array<double>")
    got = {r["group"]: r for r in geometry.subspace_geometry(df, rank=2).collect()}
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert set(got) == {"g", "one"} and got["one"]["explained"] == 1
    assert got["g"]["n"] == 200 and got["g"]["explained"] == pytest.approx(s[:2].sum() / s.sum(), abs=1e-5)
    assert geometry.subspace_geometry(df.limit(0)).count() == 0


def test_smoothed_against_fold(spark):
    rng = np.random.default_rng(1)
    data = [("hot" if i % 3 else "k", int(i // 40), i, float(v)) for i, v in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(data + [("k", None, 1, 1.0), (None, 1, 1, 1.0), ("k", 1, 1, None)], "k string, b int, t int, v double")
    got = {r["k"]: r["mean"] for r in geometry.smoothed(df, "k", "b", ["t"], "v", 0.9).collect()}
    for key in ("hot", "k"):
        mean = 0.0
        for _, _, _, v in sorted((r for r in data if r[0] == key), key=lambda r: r[2]):
            mean += 0.1 * (v - mean)
        assert got[key] == pytest.approx(mean, abs=1e-6)


def test_hash_embeddings(spark):
    texts = [("a", "The cat, the CAT"), ("b", ""), ("c", None), ("d", "ünï code_1 docs/a-b.md#x " * 50)]
    got = {r["id"]: r["embedding"] for r in hash_embeddings(spark.createDataFrame(texts, "id string, text string"), 16).collect()}
    for i, t in texts:
        want = np.zeros(16)
        for w in re.findall(r"[a-z0-9_#./:+-]+", (t or "").lower()):
            h = hashlib.blake2b(w.encode(), digest_size=16).digest()
            want[int.from_bytes(h[:4], "little") % 16] += (1 if h[4] % 2 == 0 else -1) * (1 + len(w) % 7 / 10)
        assert np.allclose(got[i], want / max(np.linalg.norm(want), 1e-300) if want.any() else want)


def test_upserts(spark, as_rows):
    have = spark.createDataFrame([("a", 1, "x", 5), ("b", 2, "y", None)], "k string, at int, name string, n int")
    new = spark.createDataFrame([("a", 1, None, 7), ("b", 1, "old", 3), ("c", 1, "z", 1)], "k string, at int, name string, n int")
    assert as_rows(merged(have, new, "k", "at")) == [("a", 1, "x", 7), ("b", 2, "y", 3), ("c", 1, "z", 1)]
    assert as_rows(new_rows(new.union(new), have, ["k"]).select("k")) == [("c",)]
    assert new_rows(spark.createDataFrame([(None, 1)], "k string, at int"), have, ["k"]).count() == 0


FEEDBACK = "operation_id string, linked_operation_id string, at long, memory_id string, label string, rating double, scope string, query string"


def test_packets_and_terms(spark, as_rows):
    asks = spark.createDataFrame([("q1", 10, "one", 0.5, False), ("q2", None, "two", None, None)], "operation_id string, at long, query string, confidence double, conflict boolean")
    fb = spark.createDataFrame([("f1", "q1", 15, "m", "stale", -1.0, "memory", "old rule"), ("f2", "q1", 12, "m", "stale", None, "memory", "old plan"), ("f3", "q1", 20, None, None, 1.0, None, "the rule"), ("f4", None, 1, "m", "useful", 1.0, "memory", "rule"), ("f5", "zz", 1, "m", "wrong", None, "memory", None)], FEEDBACK)
    assert as_rows(outcomes.packets(asks, fb)) == [("q1", 0.5, 3, 0.0, "none=1,stale=2", 2), ("q2", None, 0, None, None, None)]
    assert as_rows(outcomes.linked(asks, fb).select("operation_id", "accept")) == [("f1", True), ("f2", True), ("f3", True), ("f4", False), ("f5", False)]
    assert as_rows(outcomes.term_counts(fb, 2)) == [("old", 2, 2, 2, 1, 1.0)]
    assert as_rows(aggregates.feedback_by_memory(fb)) == [("m", 4, 0.0, 1, 1)]
    assert as_rows(outcomes.running_rating(fb)) == [("f1", "m", 2, 0.0), ("f4", "m", 1, 1.0)]
    assert outcomes.packets(asks.limit(0), fb).count() == 0


def test_rerank_prefers_what_supersedes(spark):
    m = spark.createDataFrame([("new", "the rule of the gate", "ns", 0.5, 0.5, 0), ("old", "the rule of the gate", "ns", 0.5, 0.5, 0), ("gone", "rule", "ns", 1.0, 1.0, -1), ("odd", None, "ns", float("nan"), None, 0)], "id string, text string, namespace string, importance double, stability double, live int")
    src = spark.createDataFrame([("new", "notes/gate_rule.md", 0)], "id string, source string, chunk_index int")
    edges = spark.createDataFrame([("new", "old", "supersedes", 1.0)], "source string, target string, type string, weight double")
    uses = spark.createDataFrame([("q", 1, "which gate rule", "ns", i, k, s) for k, (i, s) in enumerate([("old", 0.9), ("gone", 0.9), ("new", 0.8), ("odd", 0.1), ("unknown", 1.0), ("odd", float("nan"))])], "operation_id string, at long, query string, namespace string, memory_id string, rank int, score double")
    out = joins.rerank(uses, m, src, spark.createDataFrame([], FEEDBACK), edges).orderBy("new_rank").collect()
    assert [r["memory_id"] for r in out] == ["new", "old", "odd"]


def test_cube(spark):
    df = spark.createDataFrame([("project:a", "x", 1.0, 0.5), ("project:b", "x", None, float("nan")), (None, None, 0.0, 2.0)], "namespace string, memory_type string, stability double, confidence double")
    out = aggregates.by_namespace_and_type(df)
    assert out.where("level = 3").first()["n"] == 3 and out.where("level = 1 and family = 'project'").first()["mean_confidence"] == 0.5
    assert out.where(F.col("mean_confidence") > 1).count() == 0
