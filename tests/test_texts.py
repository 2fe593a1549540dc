from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.sources.texts import clean, packed, read_texts, sentence_chunks, sentences, texts_of

TEXTS = [None, "", " \n ", "One two. Three four!\nFive six", 'He said "stop." Then left... (Why?) So.', "a b c d e f g h i j k l m. n o.", "...", "P one.\n\n \nP two? p three.\r\n\r\nLast", "x " * 50, "ünï. çode; 日本 語。 end."]


def by_hand(text, words, overlap):
    """The chunks, word by word."""
    units = []
    for p in re.split(r"\n\s*\n+", text.replace("\r\n", "\n")):
        got = [u.strip() for u in re.findall(r"[^.!?\n]+(?:[.!?]+[\"')\]]*)?", p) if u.strip()] or [p.strip()]
        for u in got:
            w = u.split()
            units += [w[i : i + words] for i in range(0, len(w), words)]
    chunks = []
    for u in units:
        if chunks and len(chunks[-1]) + len(u) <= words:
            chunks[-1] += u
            continue
        carried = chunks[-1][len(chunks[-1]) - overlap :] if chunks and overlap else []
        chunks.append(carried + u if len(carried) + len(u) <= words else u[:])
    return [" ".join(c) for c in chunks if c]


def test_sentence_chunks(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").withColumn("units", F.lit("clash"))
    for words, overlap in ((120, 20), (5, 2), (3, 0), (1, 1)):
        got = {}
        for r in sentence_chunks(df, "k", words=words, overlap=overlap).collect():
            got.setdefault(r["k"], []).append((r["chunk_no"], r["chunk"]))
            assert r["n_words"] == len(r["chunk"].split()) <= words
        for k, t in enumerate(TEXTS):
            assert [c for _, c in sorted(got.get(k, []))] == by_hand(t or "", words, min(overlap, words - 1)), (words, k)
    assert sentence_chunks(df.limit(0), "k").count() == 0 and packed([], 5, 2) == []


def test_sentences_and_clean(spark):
    df = spark.createDataFrame([("﻿it’s “so” — a→b",), ("café".encode().decode("latin1"),), ("café",), ("日本 café",)], "t string")
    assert [r[0] for r in df.select(clean(F.col("t"))).collect()] == ["it's \"so\" - a->b", "café", "café", "日本 café"]
    assert spark.createDataFrame([("A b. C?\n\nD",)], "t string").select(sentences(F.col("t"))).first()[0] == ["A b.", "C?", "D"]


def test_texts_of_values():
    assert texts_of({"text": " ", "content": "c", "body": "b"}) == ["c"]
    assert texts_of({"role": "user", "name": "x"}) == ["user: x"]
    assert texts_of([{"items": ["a", {"summary": "s"}]}, "b", 3, None]) == ["a", "s", "b"]


def test_read_all_endings(spark, tmp_path):
    for name in ("a.yaml", "b.yml", "c.html", "d.sql", "e.xml", "f.md", "g.txt"):
        (tmp_path / name).write_text(f"in {name}")
    (tmp_path / "h.json").write_text(json.dumps({"rows": [{"text": "one"}, {"title": "two"}]}))
    (tmp_path / "bad.json").write_text("{no")
    (tmp_path / "i.jsonl").write_text('{"message": "three"}\nnot json\n\n{"n": 1}\n')
    got = sorted(r["text"] for r in read_texts(spark, str(tmp_path)).collect())
    assert got == sorted([f"in {n}" for n in ("a.yaml", "b.yml", "c.html", "d.sql", "e.xml", "f.md", "g.txt")] + ["one", "two", "three", "not json"])


def test_similarities(spark):
    rows = [("gate rule 7", "the GATE rule 7 holds", 3), ("", "x", 0), (None, None, 0), ("same", "same", 1)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    got = df.select(T.lexical_similarity("a", "b"), T.hit_score("b", T.token_set("a")), T.marker_hits("b", ("gate", "same"))).collect()
    assert [r[0] for r in got] == [0.5238095238095238 if i == 0 else x for i, x in enumerate([0, 0.0, 0.0 if got[2][0] is not None else None, 1.0])] and [r[1] for r in got] == [1.0, 0.0, 0.0, 1.0] and [r[2] for r in got] == [["gate"], [], [], ["same"]]
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(V.weighted_average(F.col("a"), F.col("b"), 0.25)).collect()] == [[0.75, 0.25], None]


def test_logistic(spark):
    import numpy as np

    from tessera.operators.outcomes import leave_one_out, logistic

    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(3, 2, 400), rng.normal(-1, 5, 400), np.full(400, 7.0)])
    y = rng.random(400) < 1 / (1 + np.exp(-(0.8 * (x[:, 0] - 3) - 0.2 * x[:, 1])))
    df = spark.createDataFrame([(*map(float, r), bool(b), "clash") for r, b in zip(x, y, strict=True)] + [(None, 1.0, 1.0, True, ""), (float("nan"), 1.0, 1.0, True, ""), (1.0, 1.0, 1.0, None, "")], "a double, b double, c double, good boolean, y string")
    got = {r["feature"]: r["weight"] for r in logistic(df, "good", ["a", "b", "c"]).collect()}
    # by plain descent
    z = np.column_stack([np.ones(400), (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)])
    w = np.zeros(4)
    for _ in range(20_000):
        w += 0.5 * (z.T @ (y - 1 / (1 + np.exp(-z @ w))) / 400 - 0.001 * np.append(0, w[1:]))
    assert np.allclose([got[f] for f in ("intercept", "a", "b", "c")], w, atol=1e-4)
    assert logistic(df.limit(0), "good", ["a"]).count() == 0
    one = [(1, "p", [1.0, 0.0]), (2, "p", [1.0, 0.1]), (3, "q", [0.0, 1.0]), (4, None, [1.0, 1.0]), (5, "r", [0.0, 2.0])]
    out = {r["vec_id"]: r["predicted"] for r in leave_one_out(spark.createDataFrame(one, "vec_id long, label string, embedding array<double>")).collect()}
    assert out == {1: "p", 2: "p", 3: "r", 5: "q"}
