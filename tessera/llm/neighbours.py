"""Problem 6: the most similar vectors of every vector.

Each cell is a shard with a hierarchical navigable small-world graph of its own, held as flat neighbour arrays. A vector is stored in the cell of its nearest centre. It is looked for there, where its neighbours are the candidates that its own vertex has in the graph's lowest layer, and in those other cells whose centres are hardly farther, by searches from the graph's top down; how much farther they may be is read from a sample's neighbours. The shards' lists of a vector are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.hnsw import BEAM, LINKS, Graph
from tessera.llm.vectors import Space, decode, prepare, route_asking, unit
from tessera.storage import cut

#: Vectors that are stored in a cell, about.
CELL_ROWS = 4096
#: The share of the nearest of a sample's vectors that the cells in which a vector is looked for must hold; the table's own nearest are nearer, so more of them are there.
COVERED = 0.985
#: Vectors searched for in one task, about; a cell that is asked for more has several tasks.
ASKING_ROWS = 32_768
#: Vertices that a search keeps in view if only close neighbours are wanted, which narrow searches find as well.
CLOSE_BEAM = 13
#: Neighbours looked at beyond those wanted, so that ties go to the smaller id.
_SPARE = 8


def shard_graph(x: np.ndarray, k: int, beam: int = BEAM) -> Graph:
    """The graph of the unit vectors x with enough candidates at each vertex for its k nearest."""
    return Graph(x, candidates=max(2 * LINKS, k + _SPARE), beam=beam)


def ranked(x: np.ndarray, q: np.ndarray, near: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of x in near (-1: none; skip: true where one is not wanted) the k nearest to each row of q and their cosines in doubles, rounded to 6 decimals (-inf: none), ties to the smaller row."""
    cos = np.full(near.shape, -np.inf)
    for a in range(0, len(q), 1024):
        some = near[a : a + 1024]
        cos[a : a + 1024] = np.where(some >= 0, np.round(np.einsum("ijk,ik->ij", x[some], q[a : a + 1024]), 6), -np.inf)
    if skip is not None:
        cos[skip] = -np.inf
    order = np.lexsort((near, -cos), axis=1)[:, :k]
    return np.take_along_axis(near, order, 1), np.take_along_axis(cos, order, 1)


def _listed(asking: np.ndarray, ids: np.ndarray, near: np.ndarray, cos: np.ndarray, good: np.ndarray) -> pd.DataFrame:
    rows = np.flatnonzero(good.any(1))
    lists = [[{"far": -c, "id": i} for c, i in zip(cos[r][good[r]].tolist(), ids[near[r][good[r]]].tolist(), strict=True)] for r in rows]
    return pd.DataFrame({"id": asking[rows], "near": pd.Series(lists, dtype=object)})


def _ask_shard(key: tuple, pdf: pd.DataFrame, k: int, least: float, beam: int = BEAM) -> pd.DataFrame:
    """The k nearest stored rows of a task to each asking one, itself left out."""
    pdf = pdf.sort_values(["id", "stored"], ignore_index=True)
    stored = pdf[pdf["stored"]].drop_duplicates("id", keep="last", ignore_index=True)
    asking = pdf[pdf["asking"]].drop_duplicates("id", keep="last")
    if not len(stored) or not len(asking):
        return pd.DataFrame({"id": [], "near": []}, dtype=object)
    dim = int(key[0])
    ids = stored["id"].to_numpy()
    x = unit(decode(stored["vec"].tolist(), dim))
    graph = shard_graph(x, k, beam)
    own = np.flatnonzero(stored["asking"].to_numpy())
    near = graph.layers[-1].near[own]
    near, cos = ranked(x, x[own], near, k)
    out = [_listed(ids[own], ids, near, cos, cos >= least)]
    strangers = asking[~asking["stored"]]
    vecs, sids = strangers["vec"].to_numpy(), strangers["id"].to_numpy()
    for a in range(0, len(sids), 4096):
        q = unit(decode(vecs[a : a + 4096].tolist(), dim))
        near, cos = ranked(x, q, graph.nearest(q, k + _SPARE), k)
        out.append(_listed(sids[a : a + 4096], ids, near, cos, cos >= least))
    return pd.concat(out, ignore_index=True)


_LISTS = "id string, near array<struct<far: double, id: string>>"


def _prepared(vectors: DataFrame, k: int, least: float) -> Space:
    return prepare(vectors, CELL_ROWS, k + 1, k, least, COVERED)


def neighbour_lists(space: Space, k: int, least: float = -1.0, beam: int = BEAM) -> DataFrame:
    """id and near (far: the cosine with its sign turned, id), nearest first, of the k nearest others of each vector of space (as _prepared() makes it for the same k and least) that have a cosine of least or more; ids without one are left out."""
    lists = route_asking(space, ASKING_ROWS).groupBy("dim", "task", "part").applyInPandas(lambda key, pdf: _ask_shard(key, pdf, k, least, beam), _LISTS)
    best = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k)
    # a vector is in few tasks, each with k neighbours at most
    lists = lists.groupBy("id").agg(best(F.flatten(F.collect_list("near"))).alias("near"))
    if space.followers is None:
        return lists
    lists = cut(lists, "lists")  # read twice from here on
    # a copy's neighbours are its leader, and its leader's
    own = F.array(F.struct(F.lit(-1.0).alias("far"), F.col("leader").alias("id")))
    other = F.filter(F.coalesce("near", F.array().cast("array<struct<far: double, id: string>>")), lambda n: n["id"] != F.col("follower"))
    copies = space.followers.select(F.col("id").alias("follower"), "leader").join(lists.withColumnRenamed("id", "leader"), "leader", "left")
    return lists.unionByName(copies.select(F.col("follower").alias("id"), best(F.concat(own, other)).alias("near")))


def nearest(vectors: DataFrame, k: int = 5, least: float = -1.0, beam: int = BEAM) -> DataFrame:
    """id, neighbour_id, cosine (rounded to 6 decimals) and rank of the k vectors most similar to each usable vector of vectors (memory_id, embedding, dim), among those of its dim.

    Usable vectors, and what is done about repeated ids, are as in :func:`tessera.llm.vectors.prepare`. Ties go to the smaller id. least: only neighbours with this cosine or more; the closer these are, the fewer cells a vector is looked for in. beam: the vertices that a search keeps in view. The lists are those an approximate index finds: of neighbours that are far from each other, which lie in all directions, some are missed (see the README for the measured recall). A vector alone in its dim has no row; an empty table gives an empty result; other columns are ignored.
    """
    lists = neighbour_lists(_prepared(vectors, k, least), k, least, beam)
    out = lists.select("id", F.posexplode("near").alias("pos", "n"))
    return out.select("id", F.col("n.id").alias("neighbour_id"), (-F.col("n.far")).alias("cosine"), (F.col("pos") + 1).alias("rank"))


def close_pairs(vectors: DataFrame, k: int = 5, least: float = 0.97) -> DataFrame:
    """memory_id_a, memory_id_b, a < b: pairs of which one is among the other's k nearest, with a cosine of least or more."""
    near = nearest(vectors, k, least, CLOSE_BEAM)
    a, b = F.least("id", "neighbour_id"), F.greatest("id", "neighbour_id")
    return near.select(a.alias("memory_id_a"), b.alias("memory_id_b")).distinct()


def _scan(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of a part to each query that came with it."""
    asked = pdf["asked"].to_numpy()
    queries, rows = pdf[asked].drop_duplicates("id"), pdf[~asked].drop_duplicates("id").sort_values("id")
    if not len(queries) or not len(rows):
        return pd.DataFrame({"id": [], "neighbour_id": [], "cosine": []}, dtype=object)
    dim = int(pdf["dim"].iloc[0])
    qid, ids = queries["id"].to_numpy(), rows["id"].to_numpy()
    q, x = unit(decode(queries["vec"].tolist(), dim)), unit(decode(rows["vec"].tolist(), dim))
    found: dict[str, list[np.ndarray]] = {"id": [], "neighbour_id": [], "cosine": []}
    for a in range(0, len(q), 256):
        s = np.round(q[a : a + 256] @ x.T, 6)
        s[qid[a : a + 256][:, None] == ids[None, :]] = -2
        some = min(k + _SPARE, len(ids))
        top = np.argpartition(-s, some - 1, 1)[:, :some]
        best = np.take_along_axis(s, top, 1)
        order = np.lexsort((top, -best), axis=1)[:, :k]
        top, best = np.take_along_axis(top, order, 1), np.take_along_axis(best, order, 1)
        for c, v in (("id", np.repeat(qid[a : a + 256], top.shape[1])), ("neighbour_id", ids[top].ravel()), ("cosine", best.ravel())):
            found[c].append(v[best.ravel() > -2])
    return pd.DataFrame({c: np.concatenate(v) for c, v in found.items()})


#: Vectors that a task of :func:`recall` compares with the queries.
_PART_ROWS = 20_000


def recall(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """How much of the exact answer :func:`nearest` finds: band of the exact cosine, wanted, found and recall (null if nothing is wanted).

    The queries are the ids whose hash every divides; each is compared with all vectors of its dim, which are divided into parts, and the queries, 1 / every of the rows, into blocks. Ties go to the smaller id, as in the lists.
    """
    space = _prepared(vectors, k, -1.0)
    rows = cut(space.rows.select("id", "dim", "vec").dropDuplicates(["id"]), "rows")
    n = rows.count()
    parts, blocks = max(1, n // _PART_ROWS), max(1, n // every // 4096)
    is_query = F.pmod(F.xxhash64("id"), F.lit(every)) == 0
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))
    stored = rows.withColumns({"asked": F.lit(False), "part": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    asked = rows.where(is_query).withColumns({"asked": F.lit(True), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))), "block": block})
    exact = stored.unionByName(asked).groupBy("dim", "part", "block").applyInPandas(lambda pdf: _scan(pdf, k), "id string, neighbour_id string, cosine double")
    by = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour_id")
    exact = exact.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("id", "neighbour_id", F.col("cosine").alias("exact"))
    lists = neighbour_lists(space, k).select("id", F.explode("near").alias("n")).select("id", F.col("n.id").alias("neighbour_id"), F.lit(1).alias("hit"))
    band = F.when(F.col("exact") >= 0.97, "0.97 to 1").when(F.col("exact") >= 0.8, "0.80 to 0.97").otherwise("below 0.80")
    both = exact.join(lists, ["id", "neighbour_id"], "left").groupBy(band.alias("band"))
    return both.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), F.try_divide(F.count("hit"), F.count("*")).alias("recall"))
