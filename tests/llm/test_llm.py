from __future__ import annotations

import random
import re
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import clusters, components, containers, format_duplicates, hnsw, mixture, neighbours, notes, pieces, survivors, tokens
from tessera.llm import vectors as vec

TOKEN = re.compile(r"\w+|[^\w\s]+")
MEMORY = "id string, text string, namespace string"


def canonical(text):
    """The rule by hand, in Python."""
    plain = lambda s: " ".join(re.findall(r"[^\W_]+", s))
    low = text.lower()
    parts = [p for p in re.split(r"[;|\r\n\x0b\x0c\x1c-\x1e\x85  ]", low) if plain(p)]
    split = [re.split(r"[:=]", p, maxsplit=1) for p in parts]
    if len(parts) >= 2 and all(len(s) == 2 and plain(s[0]) and plain(s[1]) for s in split):
        return "\n".join(sorted(map(plain, parts)))
    return plain(low)


# --- problem 2


@pytest.mark.parametrize("text", ["", "A  b!", "a_b", "x: 1; y=2", "Y = 2 | x:1;;", "x: 1; y", "x: ; y: 2", "x: 1", "Größe: 1\nY: é", "a:b:c; d=e", " ; | \n"])
def test_canonical_text(spark, text):
    assert spark.range(1).select(notes.canonical_text(F.lit(text)).alias("x")).first()["x"] == canonical(text)


def test_copies_against_brute_force(spark, as_rows):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta"]
    data = []
    for i in range(1500):
        # a third of all rows say the same; many begin alike
        note = "the one note" if i % 3 == 0 else "a long beginning that all of these notes share " + " ".join(rng.choices(words, k=rng.randint(1, 4)))
        if rng.random() < 0.5:
            note = note.upper().replace(" ", rng.choice(["  ", " - ", " "])) + rng.choice(["", ".", " !"])
        data.append((f" ID_{i} " if i % 5 == 0 else f"id_{i}", note, rng.choice(["N1", " n1 ", "n2", None])))
    data += data[:50] + [(None, "x", "n"), ("  ", "x", "n"), ("n1", None, "n"), ("e1", "", None), ("e2", "...", "global"), ("long", "z" * 100_000, "n"), ("long2", "Z" * 100_000 + "!", "n")]
    df = spark.createDataFrame(data, MEMORY).withColumn("note", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("copies", F.lit(None).cast("int"))
    groups = {}
    for i, t, n in set(data):
        if i and i.strip() and t is not None:
            groups.setdefault(((n or "").strip().lower() or "global", canonical(t)), set()).add(i.strip().lower())
    want = sorted((min(g), len(g)) for g in groups.values())
    for rows in (format_duplicates.BUCKET_ROWS, 5):
        assert sorted(tuple(r) for r in format_duplicates.unique_records(df, rows).collect()) == want
    members = as_rows(format_duplicates.duplicate_members(df, 5).select("memory_id", "group_id"))
    assert members == sorted(((i, min(g)) for g in groups.values() if len(g) > 1 for i in g), key=repr)
    assert format_duplicates.unique_records(spark.createDataFrame([], MEMORY)).count() == 0


# --- problem 1


def test_survivors(spark, as_rows):
    day = lambda n: datetime(2025, 1, n) if n else None
    cols = "id string, text string, summary string, domain_id string, memory_type string, importance double, confidence double, stability double, clc_state string, created_at timestamp_ntz, updated_at timestamp_ntz, last_recalled timestamp_ntz, deprecated int, live string, score string, at string"
    row = lambda i, imp, conf, upd, dep, summary=None: (i, f"text {i}", summary, None, None, imp, conf, None, None, None, day(upd), None, dep, "clash", "clash", "clash")
    data = [
        row("a1", 0.9, 0.9, 3, 1, "from a1"), row("a2", 0.5, 0.5, None, None), row("a3", 0.5, 0.5, 2, 0), row("a3", 0.5, 0.5, 2, 0),
        row("b1", 0.9, float("nan"), 2, 0), row("b2", 0.9, 1.5, 2, 0), row("B2 ", 0.1, 0.1, 1, 0),
        row("c1", 0.5, 0.5, 2, 1, "old"), row("c1", 0.1, 0.1, 3, 1), row("c2", 0.2, 0.2, 2, 1), row(None, 1.0, 1.0, 1, 0), row("  ", 1.0, 1.0, 1, 0),
    ]
    m = spark.createDataFrame(data, cols)
    members = spark.createDataFrame([("a1", "a1"), ("a2", "a1"), ("a3", "a1"), ("b1", "b1"), ("b2", "b1"), ("c1", "c1"), ("c2", "c1"), ("zz", "zz")], "memory_id string, group_id string")
    out = survivors.best_records(m, members)
    # a1 is deprecated; a3 is newer than a2; b1 and b2 tie; c1's latest row has a low score
    assert as_rows(out.select("group_id", "survivor_id", "copies")) == [("a1", "a3", 3), ("b1", "b1", 2), ("c1", "c2", 2)]
    got = {r["group_id"]: r for r in out.collect()}
    assert got["a1"]["summary"] == "from a1" and got["a1"]["text"] == "text a3" and (got["b1"]["importance"], got["b1"]["confidence"]) == (0.1, 0.1)  # of an older version with a score
    assert survivors.best_records(m.limit(0), members).count() == 0 and survivors.best_records(m, members.limit(0)).count() == 0


# --- problem 3


def brute_components(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for v in near:
        if v not in out:
            seen, todo = {v}, [v]
            while todo:
                for w in near[todo.pop()] - seen:
                    seen.add(w)
                    todo.append(w)
            out |= dict.fromkeys(seen, min(seen))
    return out


@pytest.mark.parametrize("size", [40, 10_000])
def test_components(spark, size):
    rng = random.Random(2)
    path = list(range(300))
    rng.shuffle(path)
    edges = [(f"p{a}", f"p{b}") for a, b in zip(path, path[1:])]
    edges += [("hub", f"leaf{i}") for i in range(400)] + [(f"r{rng.randint(0, 200)}", f"r{rng.randint(0, 200)}") for _ in range(120)]
    edges += edges[:30] + [(b, a) for a, b in edges[:30]] + [(None, "x"), ("y", None), ("loop", "loop")]
    df = spark.createDataFrame(edges, "a string, b string").withColumn("v", F.lit(1)).withColumn("r", F.lit(None).cast("int"))
    got = dict(tuple(r) for r in components.connected_components(df, edges_per_partition=size).collect())
    assert got == brute_components(edges)
    assert components.connected_components(df.limit(0)).count() == 0


def test_components_of_numbers(spark):
    df = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = components.connected_components(df, edges_per_partition=100)
    assert out.count() == 1001 and out.select("component").distinct().collect()[0][0] == 0


def test_components_of_chains(spark):
    # smallest vertices as roots save nothing along an ascending chain
    edges = [(c * 10_000 + i, c * 10_000 + i + 1) for c in range(3) for i in range(700)]
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long"), edges_per_partition=60)
    got = dict(tuple(r) for r in out.collect())
    assert got == {v: v // 10_000 * 10_000 for e in edges for v in e}


def test_fields_of_older_versions(spark):
    at = datetime(2024, 1, 1)
    new, old = at.replace(month=5), at.replace(month=2)
    row = lambda i, t, c, s, d: (i, "t", s, d, "fact", 0.5, c, None, None, at, t, None, 0)
    kinds = "id string, text string, summary string, domain_id string, memory_type string, importance double, confidence double, stability double, clc_state string, created_at timestamp, updated_at timestamp, last_recalled timestamp, deprecated int"
    m = spark.createDataFrame([row("a", old, 0.9, "said before", "d1"), row("a", new, None, None, None), row("b", old, 0.1, None, None)], kinds)
    members = spark.createDataFrame([("a", "a"), ("b", "a")], "memory_id string, group_id string")
    r = survivors.best_records(m, members).first()
    assert (r["survivor_id"], r["copies"], r["summary"], r["domain_id"], r["confidence"]) == ("b", 2, "said before", "d1", 0.9)


# --- problems 4 and 6


def test_encoding_is_exact():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(20, 6)).round(4), rng.normal(size=(20, 6)), rng.integers(-9, 9, (20, 6)), np.full((1, 6), 1e300), rng.normal(size=(5, 6)).round(2) * 100])
    assert (vec.decode(vec.encode(x).to_pylist(), 6) == x).all()


def test_graph_recall():
    rng = np.random.default_rng(4)
    centres = vec.unit(rng.normal(size=(30, 24)))
    x = vec.unit(np.vstack([centres[rng.integers(0, 30, 1800)] + 0.08 * rng.normal(size=(1800, 24)), rng.normal(size=(900, 24))]))
    graph = hnsw.Graph(x[:2400])
    assert len(graph.layers) > 1 and all((layer.links < len(layer.vertices)).all() for layer in graph.layers)
    cos = x[:2400] @ x[:2400].T
    np.fill_diagonal(cos, -1)
    assert np.mean([len(set(a[:5]) & set(b)) for a, b in zip(graph.layers[-1].near, np.argsort(-cos, 1)[:, :5], strict=True)]) / 5 > 0.999
    # strangers, found from the top down
    true = np.argsort(-(x[2400:] @ x[:2400].T), 1)[:, :5]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(graph.nearest(x[2400:], 13), true, strict=True)]) / 5 > 0.9
    for n in (1, 2, 3, 30):
        got = hnsw.Graph(x[:n]).nearest(x[:4], 5)
        assert (got[:, 0] >= 0).all() and all(len(set(r[r >= 0])) == min(n, (r >= 0).sum()) for r in got)


VECTORS = "memory_id string, embedding array<double>, dim int"


def made_vectors(seed=0, topics=12, size=15, noise=200, dim=16):
    rng = np.random.default_rng(seed)
    centres = vec.unit(rng.normal(size=(topics, dim)))
    x = np.vstack([centres.repeat(size, 0) + 0.04 * rng.normal(size=(topics * size, dim)), rng.normal(size=(noise, dim))]).round(3)
    return [(f"m{i:05d}", v.tolist(), dim) for i, v in enumerate(x)]


DIRTY = [(None, [1.0] * 16, 16), ("  ", [1.0] * 16, 16), ("d1", None, 16), ("d2", [1.0] * 15, 16), ("d3", [1.0] * 15 + [None], 16), ("d4", [float("nan")] * 16, 16), ("d5", [0.0] * 16, 16), ("d6", [1.0] * 16, None), ("d7", [], 0), ("alone", [1.0, 2.0], 2), ("d8", [float("inf")] * 16, 16)]


def brute(data, keep=None):
    by = {}
    for i, v, d in data:
        if i and i.strip() and v and d == len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by.setdefault(i.strip().lower(), v)
    ids = sorted(i for i in by if len(by[i]) == 16 and (keep is None or i in keep))
    x = vec.unit(np.array([by[i] for i in ids]))
    return ids, np.round(x @ x.T, 6)


def test_neighbours_against_brute_force(spark, monkeypatch):
    # small cells; vectors with more copies than neighbours, a fifth of all rows; repeated rows
    monkeypatch.setattr(neighbours, "CELL_ROWS", 150)
    monkeypatch.setattr(neighbours, "ASKING_ROWS", 200)
    data = made_vectors()
    data += [(f"copy{i:03d}", data[0][1], 16) for i in range(90)] + data[:20] + [(" M00003 ", data[3][1], 16)] + DIRTY
    df = spark.createDataFrame(data, VECTORS).withColumn("id", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("vec", F.lit(0))
    ids, cos = brute(data)
    got = {}
    for r in neighbours.nearest(df, 5).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"], r["cosine"]))
    assert set(got) == set(ids)
    close = total = 0
    for k, i in enumerate(ids):
        order = [j for j in np.lexsort((np.arange(len(ids)), -cos[k])) if j != k][:5]
        mine = [n for _, n, _ in sorted(got[i])]
        near = [ids[j] for j in order if cos[k, j] >= 0.8]
        total, close = total + len(near), close + len(set(near) & set(mine))
        if i.startswith("copy"):
            assert mine == [ids[j] for j in order], i
    assert close / total > 0.97
    assert neighbours.nearest(df.limit(0)).count() == 0
    pairs = {tuple(r) for r in neighbours.close_pairs(df, 5, 0.97).collect()}
    want = set()
    for k, i in enumerate(ids):
        for j in [j for j in np.lexsort((np.arange(len(ids)), -cos[k])) if j != k][:5]:
            if cos[k, j] >= 0.97:
                want.add(tuple(sorted((i, ids[j]))))
    assert len(pairs & want) >= 0.97 * len(want) and len(pairs - want) <= 0.03 * len(want)


def test_recall_report(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 150)
    monkeypatch.setattr(neighbours, "ASKING_ROWS", 200)
    df = spark.createDataFrame(made_vectors() + DIRTY, VECTORS)
    out = {r["band"]: r for r in neighbours.recall(df, every=3).collect()}
    assert sum(r["wanted"] for r in out.values()) >= 5 * 100
    assert set(out) >= {"0.97 to 1", "below 0.80"} and all(r["found"] >= 0.95 * r["wanted"] for r in out.values())
    assert neighbours.recall(df.limit(0)).count() == 0


def test_recall_with_many_cells(spark, monkeypatch):
    # far neighbours in 75 cells
    monkeypatch.setattr(neighbours, "CELL_ROWS", 20)
    x = np.random.default_rng(4).normal(size=(1500, 16)).round(4)
    df = spark.createDataFrame([(f"m{i:04d}", v.tolist(), 16) for i, v in enumerate(x)], VECTORS)
    out = neighbours.recall(df, every=5).collect()
    assert sum(r["found"] for r in out) >= 0.9 * sum(r["wanted"] for r in out)


def brute_cliques(data, keep):
    ids, cos = brute(data, keep)
    near = cos >= 0.8
    out = {}
    for k in range(len(ids)):
        own = np.flatnonzero(near[k])
        if len(own) >= 6 and all((near[j] == near[k]).all() for j in own):
            out[ids[k]] = ids[own[0]]
    return out


@pytest.mark.parametrize("cell", [60, 5000])
def test_mutual_clusters(spark, monkeypatch, cell):
    monkeypatch.setattr(clusters, "CELL_ROWS", cell)
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 10)
    data = made_vectors(1)
    # a chain, whose ends aren't similar; many copies of one vector; a topic with an outsider
    rng = np.random.default_rng(7)
    u, v = np.linalg.qr(rng.normal(size=(16, 2)))[0].T
    data += [(f"chain{k:02d}", (np.cos(a) * u + np.sin(a) * v).round(4).tolist(), 16) for k, a in enumerate(np.linspace(0, 2, 24))]
    data += [(f"copy{i:03d}", data[0][1], 16) for i in range(40)] + data[:10] + [("ghost", data[30][1], 16)] + DIRTY
    keep = {i.strip().lower() for i, _, _ in data if i} - {"ghost", ""}
    df = spark.createDataFrame(data, VECTORS).withColumn("cluster", F.lit(1))
    ids = spark.createDataFrame([(k,) for k in keep], "id string")
    got = {r["memory_id"]: r["cluster_id"] for r in clusters.mutual_clusters(df, ids).collect()}
    want = brute_cliques(data, keep)
    assert got == want and len(want) > 100
    assert clusters.mutual_clusters(df.limit(0), ids).count() == 0


def test_mutual_clusters_without_copies(spark, monkeypatch):
    # most vectors have nothing similar; with many cells each is still sent to about one task, not to all within a margin
    monkeypatch.setattr(clusters, "CELL_ROWS", 20)
    monkeypatch.setattr(vec, "BROADCAST_ROWS", 0)
    sent = []
    route = vec.route
    monkeypatch.setattr(clusters, "route", lambda *a: sent.append(route(*a).count()) or route(*a))
    rng = np.random.default_rng(13)
    x = rng.normal(size=(900, 16))
    x[:160] = np.repeat(rng.normal(size=(20, 16)), 8, 0) + rng.normal(size=(160, 16)) * 0.15
    # at the edge of a cluster, but not similar to all of it; and a vector of no memory beside another
    x[160], x[161] = x[0] * 0.6 + x[1] * 0.4 + rng.normal(size=16) * 0.5, x[8]
    data = [(f"m{i:04d}", v.round(4).tolist(), 16) for i, v in enumerate(x)]
    keep = {i for i, _, _ in data} - {"m0161"}
    got = clusters.mutual_clusters(spark.createDataFrame(data, VECTORS), spark.createDataFrame([(k,) for k in keep], "id string"))
    want = brute_cliques(data, keep)
    assert {r["memory_id"]: r["cluster_id"] for r in got.collect()} == want and len(want) >= 80
    assert sent and sent[0] < 2 * len(data)


def test_labels_of_groups_are_exact():
    # of the second round too, beside vectors in no group; doubles can't tell these labels apart
    x = np.eye(8).repeat(2, 0)[:15].round(4)
    pdf = clusters.pd.DataFrame({"id": [f"m{i:02d}" for i in range(15)], "vec": vec.encode(x).to_pylist()})
    cells = {8: (np.eye(8, dtype=np.float32)[:2], 0.1, np.ones(2, int), np.arange(2), np.arange(2))}
    out = clusters._groups((8, 1), pdf, 0.8, cells, True)
    assert out["label"].dtype == np.int64
    assert out["label"].tolist() == [(1 << 60) + (8 << 44) + (1 << 22) + 2 * (i // 2) for i in range(14)] + [-1]


def test_typical_members(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 7)
    data = made_vectors(2)
    df = spark.createDataFrame(data + DIRTY, VECTORS)
    ids, cos = brute(data)
    x = vec.unit(np.array([v for _, v, _ in sorted(data)]))
    got = clusters.typical_clusters(df, top=2).collect()
    want = brute_cliques(data, None)
    assert {r["cluster_id"] for r in got} >= set(want.values())
    for r in got:
        own = [k for k, i in enumerate(ids) if want.get(i) == r["cluster_id"]]
        if own:
            score = x[own] @ x[own].sum(0) / len(own)
            assert r["size"] == len(own) and r["typical"] == [ids[own[j]] for j in np.argsort(-score.round(6), kind="stable")[:2]]


def test_typical_members_with_many_copies(spark):
    # 60 copies of a vector at the edge of a cluster count 60 times
    u, v = np.linalg.qr(np.random.default_rng(3).normal(size=(16, 2)))[0].T
    at = [(f"a{k:02d}", a) for k, a in enumerate(np.linspace(0, 0.5, 17))] + [(f"copy{k:02d}", 0.5) for k in range(60)]
    data = [(i, (np.cos(a) * u + np.sin(a) * v).round(4).tolist(), 16) for i, a in at]
    x = vec.unit(np.array([v for _, v, _ in data]))
    score = (x @ x.sum(0) / len(x)).round(6)
    got = clusters.typical_clusters(spark.createDataFrame(data, VECTORS), top=3).collect()
    assert [(r["cluster_id"], r["size"]) for r in got] == [("a00", 77)]
    assert got[0]["typical"] == [data[j][0] for j in np.argsort(-score, kind="stable")[:3]]


def brute_density(ids, cos, min_points=6):
    """Smallest id and size of each density cluster of at least min_points points."""
    near = cos >= 0.8
    core = np.flatnonzero(near.sum(1) >= min_points)
    left, out = set(core.tolist()), []
    while left:
        own = todo = {left.pop()}
        while todo:
            todo = set(np.flatnonzero(near[list(todo)].any(0)).tolist()) & left
            own, left = own | todo, left - todo
        own = np.flatnonzero(near[list(own)].any(0))
        out.append((ids[own[0]], len(own)))
    return sorted(out)


def test_clusters_seen_in_parts(spark, monkeypatch):
    # one cell in blocks, pairs of which are tasks: no task sees all neighbours of a point
    monkeypatch.setattr(vec, "_PER_CELL", 10**6)
    monkeypatch.setattr(clusters, "CELL_ROWS", 3)
    rng = np.random.default_rng(11)
    basis = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    data = []
    for t in range(13):
        for k in range(4 + t % 5):
            data.append((f"t{t:02d}-{k}", (basis[t] + rng.normal(size=16) * 0.02).round(4).tolist(), 16))
    # a chain, whose ends are no core points
    data += [(f"u{k:02d}", (np.cos(a) * basis[14] + np.sin(a) * basis[15]).round(4).tolist(), 16) for k, a in enumerate(np.linspace(0, 3, 18))]
    df = spark.createDataFrame(data, VECTORS)
    want = brute_density(*brute(data))
    assert len(want) == 8 and want[-1] == ("u00", 18)
    assert sorted((r["cluster_id"], r["size"]) for r in clusters.typical_clusters(df).collect()) == want


# --- problems 7 to 9

TEXTS = [None, "", "   ", "one", "a-b c_d é1 ..!", "x" * 5000, "日本 語。次", " ".join(f"w{i}" for i in range(3000)), "Ab. Cd! Ef?\n\nGh: ij\r\nkl " * 200, "— –", "a b", "tab\tand\x0bvt \x1c fs"]


def test_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, t string")
    for r in df.select("t", tokens.n_tokens("t").alias("n")).collect():
        want = [(m.start(), m.end()) for m in TOKEN.finditer(r["t"] or "")]
        _, first, end = tokens.token_spans(r["t"] or "")
        assert r["n"] == len(want) and list(zip(first.tolist(), end.tolist(), strict=True)) == want


@pytest.mark.parametrize(("limit", "overlap"), [(512, 48), (20, 0), (7, 6), (50, 10)])
def test_pieces(spark, limit, overlap):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, piece_no string")
    got = {}
    for r in pieces.split_oversized(df, limit, overlap).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {i for i, t in enumerate(TEXTS) if t is not None}
    for i, parts in got.items():
        parts.sort(key=lambda r: r["piece_no"])
        text = TEXTS[i]
        words = TOKEN.findall(text)
        assert "".join(text[p["char_new"] : p["char_to"]] for p in parts) == text
        assert len(parts) == 1 if len(words) <= limit else len(parts) > 1
        for k, p in enumerate(parts):
            assert TOKEN.findall(p["text"]) == words[p["first_token"] : p["first_token"] + p["n_tokens"]] and p["n_tokens"] <= limit
            assert p["overlap_tokens"] == (min(overlap, p["first_token"] + p["overlap_tokens"]) if k else 0)
            if k:
                before = parts[k - 1]
                assert before["first_token"] + before["n_tokens"] - p["first_token"] == p["overlap_tokens"]
    assert pieces.split_oversized(df.limit(0), limit, overlap).count() == 0


def test_pieces_end_at_natural_boundaries(spark):
    text = "\n\n".join(" ".join(f"p{k}w{i}" for i in range(30)) for k in range(20))
    out = pieces.split_oversized(spark.createDataFrame([(1, text)], "doc_id long, text string"), 100, 10).collect()
    assert len(out) > 5 and all(text[: p["char_new"]].endswith("\n\n") for p in out if p["piece_no"])
    with pytest.raises(ValueError):
        pieces.split_oversized(spark.createDataFrame([(1, text)], "doc_id long, text string"), 10, 10)


def test_best_fit():
    rng = random.Random(0)
    sizes = [rng.randint(0, 60) for _ in range(500)]
    free = {k: rng.randint(0, 50) for k in range(30)}
    used = {}
    for s, c in zip(sizes, containers.best_fit(sizes, free, 100), strict=True):
        used[c] = used.get(c, 0) + s
    assert all(n <= (100 if new else free[c]) for (c, new), n in used.items())
    assert len([1 for _, new in used if new]) <= 1.05 * (sum(sizes) - sum(free.values()) + 100) / 100 + 3


def test_configurations():
    sizes, demand = [51, 34, 26], [100, 200, 150]
    used = containers.configurations(sizes, demand, 100)
    made = sum(np.array(p) * n for p, n in used)
    assert all(np.dot(p, sizes) <= 100 for p, _ in used) and (made <= demand).all() and 170 <= sum(n for _, n in used) <= 184  # at best 183.3


@pytest.mark.parametrize("per_shard", [50_000, 40])
def test_pack(spark, per_shard):
    rng = random.Random(1)
    data = [(i, " ".join("w" for _ in range(n))) for i, n in enumerate([0, 0, 1, 100, 100, 99, 250, 301] + [60] * 100 + [rng.randint(1, 100) for _ in range(200)])] + [(9000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"shard": F.lit("clash"), "container_id": F.lit(0), "n": F.lit(1)})
    out = containers.pack(df, 100, items_per_shard=per_shard)
    rows = out.collect()
    size, load = {i: len((t or "").split()) for i, t in data}, {}
    for r in rows:
        load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
    assert max(load.values()) <= 100
    for i, n in size.items():
        own = sorted((r["first_token"], r["n_tokens"]) for r in rows if r["doc_id"] == i)
        assert own == [(a, min(100, n - a)) for a in range(0, max(n, 1), 100)]
    shards = -(-len(rows) // per_shard)
    # no two of the parts over half a container can share one
    fewest = max(sum(size.values()) / 100, sum(r["n_tokens"] > 50 for r in rows))
    assert len(load) <= fewest * 1.03 + 2 * shards
    r = containers.report(out, 100).first()
    assert r["containers"] == len(load) and r["tokens"] == sum(size.values())
    assert containers.pack(df.limit(0), 100).count() == 0 and containers.report(out.limit(0), 100).first()["fill"] is None


TARGETS = "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("per_range", [20_000, 9])
def test_mix(spark, per_range):
    rng = random.Random(3)
    data = [(i, " A " if i % 2 else "a", "w " * rng.randint(1, 20)) for i in range(300)] + [(1000 + i, "b", "w " * 5) for i in range(8)] + [(2000, "c", "x"), (2001, None, "x y"), (2002, "b", None), (2003, "b", "")]
    df = spark.createDataFrame(data, "doc_id long, source string, text string").withColumns({"key": F.lit("clash"), "n_tokens": F.lit(0), "share": F.lit(1)})
    targets = spark.createDataFrame([("A", 0.7, 1), ("B ", 0.2, 4), ("b", 0.1, None), ("none", 0.1, 2), ("zero", 0.0, 1), (None, 0.5, 1)], TARGETS)
    mixed, shares = mixture.mix(df, targets, docs_per_range=per_range)
    got, share = mixed.collect(), {r["source"]: r for r in shares.collect()}
    assert set(share) == {"a", "b", "none"} and {r["source"] for r in got} == {"a", "b"}
    have = {"a": sum(len(t.split()) for i, s, t in data if s and s.strip().lower() == "a"), "b": 40}
    total = min(have["a"] * 1 / 0.7, have["b"] * 4 / 0.3)
    for s, part in (("a", 0.7), ("b", 0.3)):
        own = [r for r in got if r["source"] == s]
        used = sum(r["n_tokens"] * r["uses"] for r in own)
        assert share[s]["budget"] == int(round(total * part, 6)) and used == share[s]["tokens_used"] and share[s]["budget"] - 20 <= used <= share[s]["budget"]
        assert max(r["uses"] for r in own) <= share[s]["max_repeats"] and len({r["doc_id"] for r in own}) == len(own)
    assert share["none"]["tokens_used"] == 0 and abs(sum(r["actual_share"] for r in share.values()) - 1) < 1e-9
    again = mixed.collect()
    assert sorted(again) == sorted(got)
    m, s = mixture.mix(df.limit(0), targets)
    assert m.count() == 0 and s.where("actual_share is null").count() == 3
    m, s = mixture.mix(df, targets.limit(0))
    assert m.count() == 0 and s.count() == 0


def test_trie_against_counter():
    """Byte strings that are prefixes of one another, repeated, empty and of a single letter."""
    rng = random.Random(1)
    for letters in (b"a", b"ab", b"abcdefgh"):
        for _ in range(50):
            trie, copies, first = format_duplicates.Trie(), Counter(), {}
            for _ in range(60):
                key, i, n = bytes(rng.choice(letters) for _ in range(rng.randrange(40))), str(rng.randrange(1000)), rng.randrange(1, 5)
                trie.add(b"xx" + key, 2, key, n, i)
                copies[key] += n
                first[key] = min(first.get(key, i), i)
            assert sorted(map(tuple, trie.ends())) == sorted((k, copies[k], first[k]) for k in copies)
