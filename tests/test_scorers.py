"""Scorers over all folds, phrases and loops of groups, against plain computations."""

from __future__ import annotations

import math
import random
from collections import Counter
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.text import phrases
from tessera.operators import outcomes
from tessera.operators.geometry import loops, main_directions


def _fold(key) -> int:
    return int(md5(str(key).encode()).hexdigest()[:8], 16) % 5


def test_naive_bayes_of_all_folds(spark, as_rows):
    r = random.Random(2)
    data = [(f"i{k}", r.choice("ab"), r.sample("uvwxyz", r.randint(0, 4))) for k in range(60)] + [("n", None, ["u"]), ("only", "c", ["q"]), ("none", "a", None)]
    want = []
    for i, label, terms in data:
        train = [d for d in data if d[1] is not None and _fold(d[0]) != _fold(i)]
        vocabulary = {t for d in train for t in d[2] or []}
        score = {}
        for name in {d[1] for d in train}:
            own = [d for d in train if d[1] == name]
            n = Counter(t for d in own for t in d[2] or [])
            score[name] = round(math.log(len(own) / len(train)) + sum(math.log((n[t] + 1) / (sum(n.values()) + len(vocabulary))) for t in terms or [] if t in vocabulary), 6)
        if label is not None:
            want.append((i, label, min(score, key=lambda s: (-score[s], s))))
    df = spark.createDataFrame(data, "id string, label string, terms array<string>").withColumn("fold", F.lit("x"))
    assert as_rows(outcomes.naive_bayes(df)) == sorted(want, key=repr)
    assert as_rows(outcomes.naive_bayes(df.where("false"))) == []


def test_softmax_of_all_folds(spark, as_rows):
    r = np.random.default_rng(4)
    data = [(k, "abc"[k % 3], (np.eye(3)[k % 3] + r.normal(0, 0.1, 3)).tolist()) for k in range(90)]
    data += [(100, None, [1.0, 0.0, 0.0]), (101, "a", None), (102, "a", [1.0]), (103, "a", [None, 1.0, 1.0]), (104, "a", [])]
    df = spark.createDataFrame(data, "vec_id long, label string, embedding array<double>").withColumn("x", F.lit(1))
    out = as_rows(outcomes.softmax(df))
    assert sorted(o[0] for o in out) == list(range(90))
    assert sum(o[1] == o[2] for o in out) >= 88
    assert as_rows(outcomes.softmax(df.where("vec_id = 3"))) == [(3, "a", None)]
    assert as_rows(outcomes.softmax(df.where("false"))) == []


def test_phrases(spark):
    df = spark.createDataFrame([("The red fox, and a RED fox jumps",), ("fox",), ("",), (None,)], "c string")
    got = [r[0] for r in df.select(phrases("c", 3, 1)).collect()]
    assert got[0] == ["red fox red", "fox red fox", "red fox jumps", "red fox", "fox red", "fox jumps", "red", "fox", "jumps"]
    assert got[1:] == [["fox"], [], []]


def test_loops(spark, as_rows):
    r = np.random.default_rng(7)
    rank, dim = 2, 5
    members, base = [], {}
    for g in ("g1", "g2", "g3"):
        q = np.linalg.qr(r.normal(size=(dim, dim)))[0]
        x = r.normal(size=(40, dim)) * [5, 3, 0.3, 0.2, 0.1] @ q.T + 1
        members += [(g, f"{g}{i}", v.tolist()) for i, v in enumerate(x)]
        base[g] = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:rank].T
    members += [("few", "f1", [1.0] * dim), ("few", None, [2.0] * dim), (None, "h", [1.0] * dim), ("g1", "null", None), ("g1", "short", [1.0])]
    df = spark.createDataFrame(members, "group string, id string, embedding array<double>").withColumn("dim", F.lit("x"))
    (got,) = loops(main_directions(df, rank), 2, rank).collect()
    over = lambda a, b: base[b].T @ base[a]
    polar = lambda m: np.linalg.svd(m)[0] @ np.linalg.svd(m)[2]
    ab, bc, ac, ca = over("g1", "g2"), over("g2", "g3"), over("g1", "g3"), over("g3", "g1")
    assert (got["a"], got["b"], got["c"], got["dim"]) == ("g1", "g2", "g3", dim)
    assert abs(got["holonomy"] - np.linalg.norm(polar(ca) @ polar(bc) @ polar(ab) - np.eye(rank)) / np.sqrt(rank)) < 1e-5
    assert abs(got["excess"] - np.linalg.norm(ac - bc @ ab)) < 1e-5
    assert abs(got["turned_excess"] - np.linalg.norm(polar(ac) - polar(bc) @ polar(ab))) < 1e-5
    projector = lambda g: base[g] @ base[g].T
    far = [np.linalg.norm(projector(x) - projector(y)) for x, y in (("g1", "g2"), ("g2", "g3"), ("g1", "g3"))]
    assert abs(got["mean_distance"] - np.mean(far)) < 1e-5
    assert as_rows(loops(main_directions(df.where("false"), rank), 2, rank)) == []
