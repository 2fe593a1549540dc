"""Similar claims, groups and what depends on them, against brute force on small tables."""

from __future__ import annotations

import random

from tessera.functions.text import token_set
from tessera.operators.pairs import candidates, claims, linked_groups, numbered, similar_groups, similar_pairs

SCHEMA = "id string, domain_id string, text string, quality double, text2 string"


def _notes(n: int, seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        w = r.sample(words, r.randint(4, 9))
        rows.append((f"a{i:03}", r.choice(["d1", "d1", "d2", None]), " ".join(w), r.random(), "x"))
        if i % 3 == 0:  # one word more or less, in another order
            other = w[1:] if i % 2 else [*w[::-1], r.choice(words)]
            rows.append((f"b{i:03}", rows[-1][1], ", ".join(other).upper(), None, "x"))
    return [*rows, ("c1", "d1", None, 1.0, "x"), (None, "d1", "w1 w2 w3", 1.0, "x"), ("c2", "d1", "", 1.0, "x"), ("c3", "d1", "w1 " * 5000 + "w2 w3", 1.0, "x"), rows[0]]


def test_similar_pairs_against_all_pairs(spark):
    notes = spark.createDataFrame(_notes(120), SCHEMA)
    c = claims(notes)
    r = random.Random(1)
    kept = [x["keeper_id"] for x in c.collect()]
    near = {k: [1.0, r.random() * 0.3, 0.0] if k[0] != "c" else [0.0, 0.0, 1.0] for k in kept}
    vectors = spark.createDataFrame([(k, v) for k, v in near.items() if k != kept[0]], "id string, embedding array<double>")
    sets = {x["keeper_id"]: (x["domain_id"], set(x["tokens"])) for x in c.collect()}
    for least in (0.35, 0.6, 0.8, 1.0):
        want = set()
        for a in sets:
            for b in sets:
                if a < b and kept[0] not in (a, b) and sets[a][0] == sets[b][0] and (a[0] == "c") == (b[0] == "c"):
                    x, y = sets[a][1], sets[b][1]
                    if round(len(x & y) / len(x | y), 6) >= least:
                        want.add((a, b, round(len(x & y) / len(x | y), 6)))
        have = similar_pairs(c, vectors, 0.5, least).collect()
        assert {(p["left_id"], p["right_id"], p["jaccard"]) for p in have} == want and len(have) == len(want)
        assert least == 1.0 or want


def test_few_candidates_of_few_words(spark):
    """Claims made of the same few words are not all compared; those that are similar are, long ones and ones of other sizes too."""
    r = random.Random(7)
    words, rows = [f"w{i}" for i in range(150)], []
    for i in range(600):
        w = [*r.sample(words, r.choice([12, 20, 30])), f"ticket{i}"] if i % 50 else r.sample(words, 140) + [f"x{j}" for j in range(200)]
        rows.append((f"a{i:03}", "d", " ".join(w), 1.0, "x"))
        if i % 10 == 0:
            r.shuffle(w)
            rows.append((f"b{i:03}", "d", " ".join(w[: -(len(w) // 10)]), 1.0, "x"))
    held = numbered(claims(spark.createDataFrame(rows, SCHEMA)))
    sets = {x["n"]: set(x["tokens"]) for x in held.collect()}
    for least in (0.8, 0.6):
        found = {(x["n_a"], x["n_b"]) for x in candidates(held, least).collect()}
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
        assert len(want) >= 60 and want <= found
        assert least < 0.8 or len(found) < 3 * len(want)


def test_groups_read_written_pairs(spark):
    """Groups don't join vectors again: the pairs they read are written, and those about the limit are right to six decimals."""
    r = random.Random(2)
    notes = [(f"n{i:02}", "d", f"one two three four five six seven eight nine w{i:02}", 1.0, "x") for i in range(30)]
    near = {n[0]: [1.0, *(r.gauss(0, 0.07) for _ in range(23))] for n in notes}
    c = claims(spark.createDataFrame(notes, SCHEMA))
    pairs = similar_pairs(c, spark.createDataFrame(list(near.items()), "id string, embedding array<double>"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    cos = {(a, b): round(dot(near[a], near[b]) / (dot(near[a], near[a]) * dot(near[b], near[b])) ** 0.5, 6) for a in near for b in near if a < b}
    assert {(p["left_id"], p["right_id"]): p["cosine"] for p in pairs.collect()} == {k: v for k, v in cos.items() if v >= 0.9}
    assert 0 < sum(v >= 0.9 for v in cos.values()) < len(cos)


def test_claims_of_copies(spark):
    rows = [(f"k{i:04}", "d1", ("Keep the Cache" if i % 2 else "cache; KEEP the"), 0.5 if i == 77 else 0.1, "x") for i in range(1000)]
    rows += [("z1", None, "keep the cache", None, "x"), ("z2", None, "the cache: keep", None, "x")]
    got = {(c["domain_id"], c["keeper_id"], c["copies"]) for c in claims(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("d1", "k0077", 1000), (None, "z1", 2)}


def test_linked_groups(spark, as_rows):
    r = random.Random(3)
    chain = [f"p{i:02}" for i in range(40)]
    r.shuffle(chain)
    links = [*zip(chain, chain[1:]), *[("hub", f"q{i}") for i in range(50)], ("s1", "s1"), (None, "s2"), ("t1", "t2"), ("t2", "t1"), ("t1", "t2")]
    got = dict(tuple(x) for x in linked_groups(spark.createDataFrame(links, "left_id string, right_id string")).collect())
    want = {p: "p00" for p in chain} | {f"q{i}": "hub" for i in range(50)} | {"hub": "hub", "t1": "t1", "t2": "t1"}
    assert got == want
    assert as_rows(linked_groups(spark.createDataFrame([], "left_id string, right_id string"))) == []


def test_similar_groups_and_empty(spark, as_rows):
    notes = spark.createDataFrame([("a", "d", "one two three four five", 1.0, "x"), ("b", "d", "one two three four five six", 1.0, "x"), ("c", "d", "other words", 1.0, "x")], SCHEMA)
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in "abc"], "id string, embedding array<double>")
    c = claims(notes)
    assert as_rows(similar_groups(c, similar_pairs(c, vectors))) == [("a", "d", 1, 1, "a", 2), ("b", "d", 1, 1, "a", 2), ("c", "d", 1, 0, "c", 1)]
    none = claims(notes.where("false"))
    assert as_rows(similar_groups(none, similar_pairs(none, vectors))) == []
    assert notes.select(token_set("text").alias("t")).count() == 3
