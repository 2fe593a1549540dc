"""Problem 4: dense groups of similar vectors, with their size and most typical members.

For clusters of any density, vectors go to the cells of their nearest pivots, with copies in others near their borders. Within each task density clusters are found; what is near a point is added up over its tasks, so it is a core point wherever its neighbours are; clusters of different tasks that share a core point are one. The most typical members (medoids) are those with the highest mean cosine to all members, which is their cosine with the sum of the members' unit vectors.

Where all members must be similar to each other, vectors stay in their nearest cells. There groups of similar vectors are found, and once more, with copies in other cells, among those that have nothing similar in their own; a group whose members aren't all similar is no part of a cluster. Each other group asks once, with its middle and how far its members are from it, in all cells that may hold something similar to a member; what comes back is compared with the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.vectors import Space, decode, prepare, route, route_blocks, route_home, unit
from tessera.storage import cut

#: Vectors that share a home cell, about.
CELL_ROWS = 3000
#: The share of a sample's vectors at the radius, in the directions of their nearest, that share a cell with it; a pair shares one if either is copied into the other's.
COVERED, NEAREST = 0.97, 5
#: Members of a cluster that a task compares with as many others, or adds up.
BLOCK_ROWS = 2000
#: The share of pairs at the radius that must share a cell where vectors with nothing similar in their own are compared again: of the 15 or more pairs of a cluster one is enough.
MET = 0.8
#: Rows that groups found elsewhere, about, that one task compares with the groups; of one group at most so many.
FOUND_ROWS = 10_000
_UNSURE = 1e-5


def similar(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Whether rows of x and y have a cosine of radius or more; products in single precision, and in double where these can't tell."""
    s = x.astype(np.float32) @ y.astype(np.float32).T
    out = s >= radius
    i, j = np.nonzero(np.abs(s - radius) < _UNSURE)
    if len(i):
        out[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= radius - 1e-12
    return out


def local_clusters(x: np.ndarray, radius: float, min_points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Of each row of x: the smallest row of its cluster (-1: none), whether it is a core point, and how many others are similar to it; and the rows similar to each of those that have some but are no core points."""
    n = len(x)
    near = np.empty((n, -(-n // 8)), np.uint8)
    others = np.empty(n, int)
    for a in range(0, n, 1024):
        s = similar(x[a : a + 1024], x, radius)
        s[np.arange(len(s)), np.arange(a, a + len(s))] = False
        others[a : a + len(s)], near[a : a + len(s)] = s.sum(1), np.packbits(s, axis=1)
    core = others + 1 >= min_points
    label = np.where(core, np.arange(n), -1)
    row = lambda i: np.flatnonzero(np.unpackbits(near[i], count=n))
    for i in np.flatnonzero(core & (others > 0)):
        around = row(i)
        found = label[around[core[around]]]
        least = min(label[i], found.min()) if len(found) else label[i]
        if label[i] != least or (found != least).any():
            label[np.isin(label, np.append(found, label[i]))] = least
    few = {}
    for i in np.flatnonzero(~core & (others > 0)).tolist():
        few[i] = around = row(i)
        if (at := around[core[around]]).size:
            label[i] = label[at].min()
    return label, core, others, few


def _task(key: tuple, pdf: pd.DataFrame, radius: float, min_points: int) -> pd.DataFrame:
    pdf = pdf.drop_duplicates("id").sort_values("id", ignore_index=True)
    label, core, others, few = local_clusters(unit(decode(pdf["vec"].tolist(), int(key[0]))), radius, min_points)
    rows = np.flatnonzero(label >= 0)
    size = np.bincount(label[rows], minlength=len(pdf))
    least = np.full(len(pdf), len(pdf))
    np.minimum.at(least, label[rows], others[rows])
    base = (int(key[0]) << 44) + (int(key[1]) << 22)
    ids, whole = pdf["id"].to_numpy(), least == size - 1
    rows = np.union1d(rows, np.fromiter(few, int, len(few)))
    own, there = label[rows], label[rows] >= 0
    near = pd.Series([ids[few[i]].tolist() if i in few else None for i in rows.tolist()], dtype=object)
    return pd.DataFrame({"id": ids[rows], "label": np.where(there, base + own, -1), "core": core[rows], "size": np.where(there, size[own], 0), "whole": there & whole[own], "own": base + rows, "near": near})


#: label: -1 for points that are in no cluster of the task; own: a label that no other row has; near: the few similar points of one that is no core point in the task.
_FOUND = "id string, label long, core boolean, size int, whole boolean, own long, near array<string>"


def _seen_in_parts(found: DataFrame, min_points: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between labels, and labels of points (id, label), that follow from adding up over all tasks what each point has near it.

    A point that is a core point in some task is one. Another is one if the distinct points near it in all its tasks are enough; each task lists less than min_points of them. Whatever is near a core point belongs to its cluster, also where a task didn't see that it is one.
    """
    points = found.groupBy("id").agg(F.bool_or("core").alias("seen"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.min(F.when(F.col("core"), F.col("label"))).alias("label"), F.min("own").alias("own"))
    core = cut(points.where(F.col("seen") | (F.size("near") + 1 >= min_points)).select("id", F.coalesce("label", "own").alias("label"), "near"), "core")
    pairs = core.select("label", F.explode("near").alias("id")).join(core.select("id", F.col("label").alias("other")), "id", "left")
    pairs = cut(pairs, "pairs")
    more = pairs.where("other is null").select("id", "label").unionByName(core.select("id", "label"))
    return pairs.where("other <> label").select(F.col("label").alias("a"), F.col("other").alias("b")), more


def density_clusters(space: Space, radius: float, min_points: int, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, cluster) and clusters (cluster, cluster_id: the smallest id, size, whole: whether all members are similar to each other; null where no single task saw them all)."""
    routed = route(space, CELL_ROWS)
    found = routed.groupBy("dim", "task").applyInPandas(lambda key, pdf: _task(key, pdf, radius, min_points), _FOUND)
    found = cut(found, "local")
    labels = found.where("label >= 0")
    # the labels of a core point, one for each of its few tasks
    shared = labels.where("core").groupBy("id").agg(F.collect_set("label").alias("labels")).where("size(labels) > 1")
    links = shared.select(F.array_min("labels").alias("a"), F.explode("labels").alias("b")).where("a <> b")
    more = None
    if min_points > 2:  # else one similar vector, in any task, makes a core point
        further, more = _seen_in_parts(found, min_points)
        links = links.unionByName(further)
    links = links.distinct()
    joined = cut(connected_components(cut(links, "links")).withColumnRenamed("id", "label"), "joined")
    labelled = labels.join(joined, "label", "left").withColumn("cluster", F.coalesce("component", "label"))
    members = labelled.select("id", "cluster")
    if more is not None:
        members = members.unionByName(more.join(joined, "label", "left").select("id", F.coalesce("component", "label").alias("cluster")))
    members = members.groupBy("id").agg(F.min("cluster").alias("cluster"))
    if space.followers is not None:
        more = space.followers.join(members.withColumnRenamed("id", "leader"), "leader").select("id", "cluster")
        members = members.unionByName(more)
    members = cut(members, "members")
    counted = members.groupBy("cluster").agg(F.min("id").alias("cluster_id"), F.count("*").alias("size")).where(F.col("size") >= min_size)
    seen = labelled.groupBy("cluster", "label").agg(F.first("size").alias("seen"), F.first("whole").alias("whole"))
    if space.followers is not None:
        # copies left out are similar to whatever their leader is
        left = space.followers.join(members, "id").groupBy("cluster").agg(F.count("*").alias("more"))
        seen = seen.join(left, "cluster", "left").withColumn("seen", F.col("seen") + F.coalesce("more", F.lit(0)))
    verdict = seen.join(counted.select("cluster", F.col("size").alias("n")), "cluster").where("seen = n").groupBy("cluster").agg(F.bool_and("whole").alias("whole"))
    return members.join(counted.select("cluster"), "cluster", "left_semi"), cut(counted.join(verdict, "cluster", "left"), "clusters")


def _far(batches: Iterator[pd.DataFrame], radius: float) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        far = []
        for dim, own in pdf.groupby("dim"):
            x, y = (unit(decode(own[c].tolist(), int(dim))) for c in ("vec", "anchor"))
            far.append(own.loc[np.einsum("ij,ij->i", x, y) < radius - 1e-12, ["cluster"]])
        yield pd.concat(far).drop_duplicates() if far else pdf[["cluster"]].head(0)


def _apart(pdf: pd.DataFrame, radius: float) -> pd.DataFrame:
    x = unit(decode(pdf["vec"].tolist(), int(pdf["dim"].iloc[0])))
    apart = any(not similar(x[a : a + 1024], x, radius).all() for a in range(0, len(x), 1024))
    return pdf[["cluster"]].head(int(apart))


def _groups(key: tuple, pdf: pd.DataFrame, radius: float, cells: dict[int, tuple], again: bool = False) -> pd.DataFrame:
    """The groups of a task: rows of _GROUPED, and the vectors in none, with label -1. again: the task is one of the second round, which doesn't have all rows of its cell. The first row of a group whose members are all similar has its middle, in bytes, the lowest cosine to it that something similar to a member can have, and the tasks to ask."""
    dim, task = int(key[0]), int(key[1])
    pdf = pdf.drop_duplicates("id").sort_values("id", ignore_index=True)
    x = unit(decode(pdf["vec"].tolist(), dim))
    label, _, others, _ = local_clusters(x, radius, 2)
    alone = pdf.loc[others == 0, ["id", "vec"]].assign(dim=dim, label=-1, whole=False, size=0)
    rows = np.flatnonzero((label >= 0) & (others > 0))
    rows = rows[np.argsort(label[rows], kind="stable")]
    out = pdf.iloc[rows][["id", "vec"]].assign(dim=dim, label=(int(again) << 60) + (dim << 44) + (task << 22) + label[rows])
    middle, ask = np.full(len(rows), None, object), np.full(len(rows), None, object)
    far, whole, size = np.zeros(len(rows)), np.zeros(len(rows), bool), np.zeros(len(rows), int)
    if len(rows):
        first = np.flatnonzero(np.diff(label[rows], prepend=-1))
        count = np.diff(first, append=len(rows))
        every = np.minimum.reduceat(others[rows], first) == count - 1
        of = np.repeat(np.arange(len(first)), count)
        whole, size = every[of], count[of]
        sums = np.add.reduceat(x[rows], first, axis=0)
        sums = np.rint(sums / np.maximum(np.abs(sums).max(1), 1e-30)[:, None] * 127).astype(np.int8)
        low = np.minimum.reduceat(np.einsum("ij,ij->i", x[rows], unit(sums.astype(float))[of]), first)
        angle = np.arccos(np.clip(low, -1, 1)) + np.arccos(radius)
        far[first] = np.where(angle < np.pi, np.cos(angle), -1) - _UNSURE
        pivots, margin, blocks, first_task, cell_of = cells[dim]
        asked = []
        at = np.flatnonzero(whole)
        for a in range(0, len(at), 1024):
            some = at[a : a + 1024]
            c = x[rows[some]].astype(np.float32) @ pivots.T
            r, cell = np.nonzero(c >= c.max(1)[:, None] - margin)
            asked.append(np.unique(of[some[r]] * len(pivots) + cell))
        asked = np.unique(np.concatenate(asked)) if asked else np.array([], int)
        if not again:
            asked = asked[asked % len(pivots) != cell_of[task]]
        ends = np.searchsorted(asked, np.arange(len(first) + 1) * len(pivots))
        for g in np.flatnonzero(every):
            middle[first[g]] = sums[g].tobytes()
            own = asked[ends[g] : ends[g + 1]] % len(pivots)
            ask[first[g]] = np.concatenate([np.arange(first_task[c], first_task[c] + blocks[c]) for c in own] or [np.array([], int)]).astype(np.int32)
    out = out.assign(whole=whole, size=size, middle=middle, far=far, ask=pd.Series(ask, index=out.index, dtype=object))
    out = pd.concat([out, alone], ignore_index=True)
    return out.assign(**{c: out[c].astype(object).where(out[c].notna(), None) for c in ("middle", "ask")})


_GROUPED = "id string, vec binary, dim int, label long, whole boolean, size int, middle binary, far double, ask array<int>"


def _answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """label, id, dim, vec: the rows of a task that are near enough to the middle of each asking group."""
    asks = pdf["label"].to_numpy() >= 0
    rows, asks = pdf[~asks], pdf[asks]
    found = {"label": [], "at": []}
    if len(rows) and len(asks):
        dim = int(key[0])
        x = unit(decode(rows["vec"].tolist(), dim)).astype(np.float32).T
        q = unit(np.frombuffer(b"".join(asks["vec"].tolist()), np.int8).reshape(-1, dim).astype(float)).astype(np.float32)
        labels, far = asks["label"].to_numpy(), asks["far"].to_numpy().astype(np.float32)
        for a in range(0, len(q), 1024):
            i, j = np.nonzero(q[a : a + 1024] @ x >= far[a : a + 1024, None])
            found["label"].append(labels[a + i])
            found["at"].append(j)
    label, at = (np.concatenate([np.array([], np.int64), *v]) for v in found.values())
    return rows.iloc[at][["id", "vec"]].assign(label=label, dim=int(key[0]))[["label", "id", "dim", "vec"]]


def _linked(pdf: pd.DataFrame, radius: float) -> pd.DataFrame:
    """label, id, dim, vec, whole: what was found by a group and is similar to a member; whole: to all of them."""
    out = [pdf.head(0).assign(whole=True)]
    for (dim, _, _), own in pdf.groupby(["dim", "label", "part"], sort=False):
        at = own["member"].to_numpy()
        if not at.all():
            x = unit(decode(own["vec"].tolist(), int(dim)))
            m, y = x[at], x[~at]
            some, every = np.zeros(len(y), bool), np.ones(len(y), bool)
            for a in range(0, len(m), 1024):
                s = similar(m[a : a + 1024], y, radius)
                some |= s.any(0)
                every &= s.all(0)
            out.append(own[~at].assign(whole=every)[some])
    return pd.concat(out)[["label", "id", "dim", "vec", "whole"]]


def similar_groups(space: Space, radius: float, min_size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (id, cluster) of the sets of at least min_size vectors with nothing similar outside, as far as these may be similar to each other; the sets (cluster, cluster_id: the smallest id, size, whole: true if their members are, null if that isn't known); and rows (id, dim, vec, cluster) of the members that weren't left out as copies."""
    home, first, n = route_home(space)
    # no copies at first
    near = {dim: replace(c, meet=-1.0, asking=c.blocks * 2.0 * CELL_ROWS) for dim, c in space.cells.items()}
    cells = {}
    for dim, c in near.items():
        tasks = route_blocks(c, CELL_ROWS)[1]
        cells[dim] = (c.pivots, c.margin, c.blocks, first[dim], np.repeat(np.arange(len(tasks)), tasks))
    grouped = route(replace(space, cells=near), CELL_ROWS).groupBy("dim", "task").applyInPandas(lambda key, pdf: _groups(key, pdf, radius, cells), _GROUPED)
    grouped = cut(grouped, "groups")
    alone = grouped.where("label < 0").select("id", "dim", F.xxhash64("vec").alias("h"), "vec")
    again = route(replace(space, rows=alone), CELL_ROWS).groupBy("dim", "task").applyInPandas(lambda key, pdf: _groups(key, pdf, radius, cells, True), _GROUPED)
    grouped = grouped.where("label >= 0").unionByName(cut(again.where("label >= 0"), "again"))
    asks = grouped.where("ask is not null").select("dim", F.explode("ask").alias("task"), F.lit(None).cast("string").alias("id"), F.col("middle").alias("vec"), "label", "far")
    both = home.withColumns({"label": F.lit(-1).cast("long"), "far": F.lit(None).cast("double")}).unionByName(asks).repartition(max(1, n), "dim", "task")
    found = cut(both.groupBy("dim", "task").applyInPandas(_answer, "label long, id string, dim int, vec binary"), "found")
    per = cut(found.groupBy("label").agg(F.ceil(F.count("*") / FOUND_ROWS).cast("int").alias("parts"), F.count("*").alias("n")), "asked")
    buckets = max(1, (per.agg(F.sum("n")).first()[0] or 0) // FOUND_ROWS)
    parts = per.select("label", "parts")
    theirs = found.join(parts, "label").withColumns({"part": F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), "member": F.lit(False)})
    own = grouped.select("label", "id", "dim", "vec").join(parts, "label").withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "member": F.lit(True)})
    compared = theirs.unionByName(own).select("label", "id", "dim", "vec", "part", "member", F.pmod(F.xxhash64("label", "part"), F.lit(buckets)).alias("bucket"))
    linked = cut(compared.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(lambda pdf: _linked(pdf, radius), "label long, id string, dim int, vec binary, whole boolean"), "linked")
    labels = grouped.select("id", "label").unionByName(linked.select("id", "label"))
    shared = labels.groupBy("id").agg(F.collect_set("label").alias("labels")).where("size(labels) > 1")
    links = shared.select(F.array_min("labels").alias("a"), F.explode("labels").alias("b")).where("a <> b").distinct()
    joined = cut(connected_components(cut(links, "links")).withColumnRenamed("id", "label"), "joined")
    cluster = lambda df: df.join(joined, "label", "left").withColumn("cluster", F.coalesce("component", "label"))
    bad = cluster(grouped.where("not whole").select("label").unionByName(linked.where("not whole").select("label"))).select("cluster").distinct()
    members = cluster(labels).select("id", "cluster").distinct()
    if space.followers is not None:
        more = space.followers.join(members.withColumnRenamed("id", "leader"), "leader").select("id", "cluster")
        members = members.unionByName(more)
    members = cut(members.join(bad, "cluster", "left_anti"), "members")
    counted = members.groupBy("cluster").agg(F.min("id").alias("cluster_id"), F.count("*").alias("size")).where(F.col("size") >= min_size)
    seen = cluster(grouped.where("ask is not null").select("label", F.col("size").alias("seen"))).groupBy("cluster").agg(F.max("seen").alias("seen"))
    if space.followers is not None:
        # copies left out are similar to whatever their leader is
        left = space.followers.join(members, "id").groupBy("cluster").agg(F.count("*").alias("more"))
        seen = seen.join(left, "cluster", "left").withColumn("seen", F.col("seen") + F.coalesce("more", F.lit(0)))
    counted = counted.join(seen, "cluster").select("cluster", "cluster_id", "size", F.when(F.col("seen") == F.col("size"), True).alias("whole"))
    rows = cluster(grouped.select("id", "dim", "vec", "label").unionByName(linked.select("id", "dim", "vec", "label"))).select("id", "dim", "vec", "cluster")
    return members, cut(counted, "clusters"), rows


def mutual_clusters(vectors: DataFrame, ids: DataFrame | None = None, radius: float = 0.8, min_size: int = 6) -> DataFrame:
    """memory_id, cluster_id of the clusters of at least min_size vectors that are all similar (of one dim, cosine of radius or more) to each other and to nothing else.

    A cluster whose members are all in one group of similar vectors is known to be one. The others are compared with their first member, and those that this leaves as blocks against blocks. Of vectors: memory_id, embedding, dim; of ids: id, those that take part, in normal form. Unusable and repeated vectors: see :func:`tessera.llm.vectors.prepare`.
    """
    space = prepare(vectors, CELL_ROWS, min_size, NEAREST, radius, COVERED, ids, meet=MET)
    members, clusters, rows = similar_groups(space, radius, min_size)
    open_ = cut(clusters.where("whole is null").select("cluster", "cluster_id", "size"), "open")
    good = clusters.where("whole").select("cluster", "cluster_id")
    if not open_.isEmpty():
        rows = cut(rows.join(open_, "cluster").dropDuplicates(["id"]), "open_rows")
        anchors = rows.where("id = cluster_id").select("cluster", F.col("vec").alias("anchor"))
        far = rows.join(anchors, "cluster").mapInPandas(partial(_far, radius=radius), "cluster long").distinct()
        rows = rows.join(far, "cluster", "left_anti")
        m = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
        b = F.pmod(F.xxhash64("id"), m).cast("int")
        other = F.explode(F.sequence(F.lit(0), m - 1)).alias("k")
        pairs = rows.select("cluster", "dim", "vec", b.alias("b"), other).select("cluster", "dim", "vec", F.least("b", "k").alias("i"), F.greatest("b", "k").alias("j"))
        apart = pairs.groupBy("cluster", "i", "j").applyInPandas(lambda pdf: _apart(pdf, radius), "cluster long").distinct()
        good = good.unionByName(open_.join(far, "cluster", "left_anti").join(apart, "cluster", "left_anti").select("cluster", "cluster_id"))
    return members.join(good, "cluster").select(F.col("id").alias("memory_id"), "cluster_id")


def _sums(pdf: pd.DataFrame) -> pd.DataFrame:
    x = pdf["weight"].to_numpy() @ unit(decode(pdf["vec"].tolist(), int(pdf["dim"].iloc[0])))
    return pd.DataFrame({"cluster": pdf["cluster"].head(1).to_numpy(), "total": [x.tolist()]})


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"cluster": pdf["cluster"].head(1).to_numpy(), "total": [np.stack(pdf["total"].to_list()).sum(0).tolist()]})


def _typical(batches: Iterator[pd.DataFrame], top: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        score = np.empty(len(pdf))
        for dim, at in pdf.groupby("dim").indices.items():
            own = pdf.iloc[at]
            x, y = unit(decode(own["vec"].tolist(), int(dim))), np.stack(own["total"].to_list())
            score[at] = np.einsum("ij,ij->i", x, y) / own["size"].to_numpy()
        out = pdf[["cluster", "id"]].assign(typical=np.round(score, 6)).sort_values(["typical", "id"], ascending=[False, True])
        yield out.groupby("cluster", sort=False).head(top)


def typical_clusters(vectors: DataFrame, ids: DataFrame | None = None, radius: float = 0.8, min_points: int = 6, min_size: int = 6, top: int = 3) -> DataFrame:
    """cluster_id (its smallest id), size and typical (the top most typical members, most typical first) of each density cluster: core points have min_points - 1 others within the radius.

    A cluster of any size is added up in blocks; of every batch of members only its most typical ones go on. Ties go to the smaller id. Vectors and ids are as in :func:`mutual_clusters`; copies beyond the first min_points of one vector count in size and belong to the cluster, but only the first are candidates for typical members; their first one stands for them in the cluster's sum.
    """
    space = prepare(vectors, CELL_ROWS, max(min_points, min_size), NEAREST, radius, COVERED, ids, mutual=True)
    members, clusters = density_clusters(space, radius, min_points, min_size)
    rows = members.join(clusters.select("cluster", "size"), "cluster").join(space.rows.select("id", "dim", "vec").dropDuplicates(["id"]), "id")
    weight = F.lit(1.0)
    if space.followers is not None:
        rows = rows.join(space.followers.groupBy(F.col("leader").alias("id")).agg(F.count_distinct("id").alias("more")), "id", "left")
        weight = 1.0 + F.coalesce("more", F.lit(0))
    rows = cut(rows.select("cluster", "size", "id", "dim", "vec", weight.alias("weight")), "cluster_rows")
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK_ROWS))
    sums = rows.withColumn("block", block).groupBy("cluster", "block").applyInPandas(_sums, "cluster long, total array<double>").groupBy("cluster").applyInPandas(_add, "cluster long, total array<double>")
    best = rows.join(sums, "cluster").mapInPandas(partial(_typical, top=top), "cluster long, id string, typical double")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("typical"), "id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("typical"))
    return clusters.join(best, "cluster").select("cluster_id", "size", "typical")
