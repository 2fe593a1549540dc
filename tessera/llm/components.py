"""Problem 3: one group identifier for all records linked directly or through others.

Union-find runs within each partition of edges and keeps only a spanning forest, a star from each vertex to the root of its tree. A vertex keeps its smallest root as its parent; the roots it has in other partitions are linked to that one, and only these links go on to the next round, in fewer partitions of the same bounded size. Where smallest vertices as roots save little, as along a chain in ascending order, the next rounds take random ones, which leave out a share of the vertices on every path. When what is left fits into one partition the parents are followed back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import cut

#: Edges of one partition, about; the last round's only partition holds no more.
EDGES_PER_PARTITION = 50_000


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of the edges and the smallest vertex of each one's tree, by union-find."""
    codes, words = pd.factorize(np.concatenate([a, b]), sort=True)
    root = list(range(len(words)))
    half = len(a)
    for x, y in zip(codes[:half].tolist(), codes[half:].tolist(), strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x < y:
            root[y] = x
        elif y < x:
            root[x] = y
    roots = np.array(root, dtype=np.int64)
    while (roots != roots[roots]).any():
        roots = roots[roots]
    words = np.asarray(words)
    return words, words[roots]


def _forest(batches: Iterator[pd.DataFrame], size: int, salt: int) -> Iterator[pd.DataFrame]:
    """Merges the batches of a partition into one forest, at most two batches' worth of edges at a time. salt: 0 for the smallest vertices as roots, else for random ones."""
    a = b = np.array([], dtype=object)
    for pdf in batches:
        a, b = np.concatenate([a, pdf["a"].to_numpy()]), np.concatenate([b, pdf["b"].to_numpy()])
        if len(a) > size:
            a, b = spanning_forest(a, b)
    if len(a):
        v, r = spanning_forest(a, b)
        if salt:
            tree, _ = pd.factorize(r)
            order = np.lexsort((pd.util.hash_array(v, hash_key=f"{salt:016d}"), tree))
            first = np.flatnonzero(np.diff(tree[order], prepend=-1))
            r = v[order[first]][tree]
        yield pd.DataFrame({"v": v, "r": r})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", edges_per_partition: int = EDGES_PER_PARTITION) -> DataFrame:
    """id and component (the smallest id reachable) of every vertex of edges, whose columns a and b have one sortable type.

    Edges with a null end are left out; loops make their vertex a component of its own; repeated and reversed edges change nothing. Without edges the result is empty. A vertex with any number of edges is no hot spot, since edges are spread without regard to their ends and every partition keeps one row of it.
    """
    kind = dict(edges.dtypes)[a]
    schema = f"v {kind}, r {kind}"
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    n, salt = left.count(), 0
    parents: list[DataFrame] = []
    while True:
        parts = max(1, -(-n // edges_per_partition))
        # every round mixes the edges anew
        spread = left.repartition(parts, F.xxhash64("a", "b", F.lit(len(parents)))) if parts > 1 else left.coalesce(1)
        forest = spread.mapInPandas(partial(_forest, size=2 * edges_per_partition, salt=salt if parts > 1 else 0), schema)
        if parts == 1:
            labels = forest.select(F.col("v").alias("id"), F.col("r").alias("component"))
            break
        # a vertex has at most one root in each partition
        stars = cut(forest.groupBy("v").agg(F.min("r").alias("p"), F.collect_set("r").alias("roots")), "forest")
        parents.append(stars.select("v", "p"))
        left = stars.select(F.col("p").alias("a"), F.explode("roots").alias("b")).where("a <> b").distinct()
        left = cut(left, "links")
        m = left.count()
        if salt or m > 0.8 * n:
            salt += 1
        n = m
    for level in reversed(parents):
        p = level.join(labels.withColumnRenamed("id", "p"), "p", "left")
        labels = p.select(F.col("v").alias("id"), F.coalesce("component", "p").alias("component"))
    if salt:
        labels = cut(labels, "labels")
        least = labels.groupBy("component").agg(F.min("id").alias("least"))
        labels = labels.join(least, "component").select("id", F.col("least").alias("component"))
    return labels
