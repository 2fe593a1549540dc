"""Shape and movement of the vectors of a domain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.search import top_k
from tessera.storage import cut

_MEASURES = ["holonomy", "excess", "turned_excess", "mean_angle", "largest_angle", "mean_distance"]
#: Rows that a task adds up for one group at a time.
BLOCK_ROWS = 5_000


def _moments(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(pdf["embedding"].to_list()).astype(np.float64)
    return pd.DataFrame({"group": [pdf["group"].iloc[0]], "dim": [x.shape[1]], "n": [len(x)], "total": [x.sum(0).tolist()], "gram": [(x.T @ x).ravel().tolist()]})


def _scatter(pdf: pd.DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """n, length, sum, and sums of products about the mean, of a group's blocks."""
    n, dim = int(pdf["n"].sum()), int(pdf["dim"].iloc[0])
    total = np.sum(pdf["total"].to_list(), axis=0)
    gram = np.sum(pdf["gram"].to_list(), axis=0).reshape(dim, dim)
    return n, dim, total, gram - np.outer(total, total) / n


def _geometry(pdf: pd.DataFrame, rank: int) -> pd.DataFrame:
    n, dim, total, scatter = _scatter(pdf)
    spread = np.clip(np.linalg.eigvalsh(scatter)[::-1], 0, None)
    all_ = spread.sum()
    explained = float(spread[:rank].sum() / all_) if all_ > 1e-12 else 1.0
    return pd.DataFrame({"group": [pdf["group"].iloc[0]], "dim": [dim], "n": [n], "explained": [round(explained, 6)], "defect": [round(1 - explained, 6)], "mean_norm": [round(float(np.linalg.norm(total / n)), 6)]})


def _block_moments(members: DataFrame) -> DataFrame:
    """Counts, sums and second moments of blocks of the vectors of each group and length: a group of any size is one small matrix per block."""
    kind = dict(members.dtypes)["group"]
    rows = members.dropna(subset=["group", "embedding"]).where(F.size("embedding") > 0).select("group", "embedding", F.size("embedding").alias("dim"), F.xxhash64("id").alias("h"))
    counts = rows.groupBy("group", "dim").agg(F.count("*").alias("m"))
    blocks = rows.join(counts, ["group", "dim"]).withColumn("block", F.pmod("h", F.ceil(F.col("m") / BLOCK_ROWS)))
    return blocks.groupBy("group", "dim", "block").applyInPandas(_moments, f"group {kind}, dim int, n long, total array<double>, gram array<double>")


def subspace_geometry(members: DataFrame, rank: int = 8) -> DataFrame:
    """Per group and length of members (group, id, embedding): n, the part of the variance along the rank main directions (1 for no variance), what is left (defect), and the length of the mean.

    The second moments of blocks of rows are added up. Null groups and vectors are left out.
    """
    kind = dict(members.dtypes)["group"]
    return _block_moments(members).groupBy("group", "dim").applyInPandas(lambda pdf: _geometry(pdf, rank), f"group {kind}, dim int, n long, explained double, defect double, mean_norm double")


def _directions(pdf: pd.DataFrame, rank: int) -> pd.DataFrame:
    n, dim, total, scatter = _scatter(pdf)
    if n <= rank or dim < rank:
        return pd.DataFrame({"group": [], "dim": [], "n": [], "mean": [], "basis": []}, dtype=object)
    main = np.linalg.eigh(scatter)[1][:, ::-1][:, :rank]
    return pd.DataFrame({"group": [pdf["group"].iloc[0]], "dim": [dim], "n": [n], "mean": [(total / n).tolist()], "basis": [main.ravel().tolist()]})


def main_directions(members: DataFrame, rank: int = 8) -> DataFrame:
    """group, dim, n, mean and basis (dim x rank, row by row, orthonormal) of the groups and lengths of members (group, id, embedding) that have more than rank vectors, of rank elements or more; the others are left out. Directions without variance are any."""
    kind = dict(members.dtypes)["group"]
    return _block_moments(members).groupBy("group", "dim").applyInPandas(lambda pdf: _directions(pdf, rank), f"group {kind}, dim int, n long, mean array<double>, basis array<double>")


def _turn(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotation nearest to m, and m's singular values."""
    u, s, v = np.linalg.svd(m)
    return u @ v, s


def _round_trip(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> dict[str, float]:
    ab, bc, ac = b.T @ a, c.T @ b, c.T @ a
    (q_ab, s_ab), (q_bc, s_bc), (q_ac, s_ac) = map(_turn, (ab, bc, ac))
    s = np.clip(np.concatenate([s_ab, s_bc, s_ac]), 0, 1)
    k = a.shape[1]
    out = {
        "holonomy": np.linalg.norm(q_ac.T @ q_bc @ q_ab - np.eye(k)) / np.sqrt(k),
        "excess": np.linalg.norm(ac - bc @ ab),
        "turned_excess": np.linalg.norm(q_ac - q_bc @ q_ab),
        "mean_angle": np.arccos(s).mean(),
        "largest_angle": np.arccos(s).max(),
        "mean_distance": np.mean([np.sqrt(max(0.0, 2 * k - 2 * (x**2).sum())) for x in (s_ab, s_bc, s_ac)]),
    }
    return {name: round(float(x), 6) for name, x in out.items()}


def loops(directions: DataFrame, neighbours: int = 3, rank: int = 8) -> DataFrame:
    """What a vector's coordinates come to when they are carried round three groups that are neighbours of one another: a < b < c, dim, holonomy (0: they come back as they were), excess and turned_excess (the way over b less the direct one, with overlaps and with rotations), mean and largest angle between the main directions, and the mean distance of the projectors on them.

    directions is what :func:`main_directions` gives. Groups are neighbours if the mean of one is among the most similar ones to that of the other, neighbours of them; so there are at most as many links as groups times neighbours, and loops are joins of links. None of the numbers depends on which basis stands for the directions.
    """
    kind = dict(directions.dtypes)["group"]
    held = cut(directions, "directions")
    key = F.concat_ws("|", F.col("dim").cast("string"), F.col("group").cast("string"))
    means = held.select(key.alias("id"), F.col("mean").alias("embedding"))
    near = top_k(means, means, neighbours)
    links = cut(near.select(F.least("query_id", "id").alias("x"), F.greatest("query_id", "id").alias("y")).distinct(), "links")
    ab, bc, ac = (links.toDF(*n) for n in (("a", "b"), ("b", "c"), ("a", "c")))
    found = ab.join(bc, "b").join(ac, ["a", "c"])
    for s in "abc":
        found = found.join(held.select(key.alias(s), F.col("group").alias(f"group_{s}"), F.col("basis").alias(f"basis_{s}"), *([F.col("dim")] if s == "a" else [])), s)

    def carry(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            bases = zip(*(pdf[f"basis_{s}"] for s in "abc"), strict=True)
            made = [_round_trip(*(np.asarray(x, float).reshape(-1, rank) for x in row)) for row in bases]
            yield pd.concat([pdf[["group_a", "group_b", "group_c", "dim"]].set_axis(["a", "b", "c", "dim"], axis=1).reset_index(drop=True), pd.DataFrame(made, columns=_MEASURES)], axis=1)

    return found.mapInPandas(carry, f"a {kind}, b {kind}, c {kind}, dim int, " + ", ".join(f"{m} double" for m in _MEASURES))


def smoothed(series: DataFrame, key: str, block: str, order: list[str], value: str, beta: float = 0.95) -> DataFrame:
    """Per key the exponential mean of value in the order of block and order, from 0: each value moves it by 1 - beta of the difference.

    A block (a month, say) has one row of its own weighted sum and count; the blocks of a key, which must be few, are then put one after another. So a key with a large part of all rows is spread over its blocks. Null keys, blocks and values are left out.
    """
    rows = series.dropna(subset=[key, block, value])
    back = F.row_number().over(Window.partitionBy(key, block).orderBy(*[F.col(c).desc() for c in order])) - 1
    per = rows.withColumn("back", back).groupBy(key, block).agg(F.count("*").alias("n"), F.sum(F.col(value) * (1 - beta) * F.pow(F.lit(beta), F.col("back"))).alias("part"))
    steps = F.array_sort(F.collect_list(F.struct(F.col(block).alias("b"), "n", "part")))
    mean = F.aggregate(steps, F.lit(0.0), lambda m, s: m * F.pow(F.lit(beta), s["n"]) + s["part"])
    return per.groupBy(key).agg(F.sum("n").alias("n"), F.round(mean, 6).alias("mean"))
