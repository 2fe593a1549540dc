"""Exact search: the stored vectors most similar to each query, in blocks.

Stored vectors are divided into parts and queries into blocks; a task compares one block with one part by one matrix product and keeps k rows per query, and the lists of a query are merged. No pair beyond these is ever a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import top_per_key

PART_ROWS, BLOCK_ROWS = 50_000, 2_000


def _unit(values: pd.Series) -> np.ndarray:
    x = np.stack(values.to_list()).astype(np.float64)
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(n > 0, n, 1)[:, None]


def _scan(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    asked = pdf["asked"].to_numpy()
    q, s = pdf[asked], pdf[~asked].sort_values("id")
    if not len(q) or not len(s):
        return pd.DataFrame({"query_id": [], "id": [], "cosine": []}, dtype=object)
    cos = np.round(_unit(q["embedding"]) @ _unit(s["embedding"]).T, 6)
    qid, ids = q["id"].to_numpy(), s["id"].to_numpy()
    cos[qid[:, None] == ids[None, :]] = -2
    order = np.argsort(-cos, axis=1, kind="stable")[:, :k]
    best = np.take_along_axis(cos, order, 1)
    good = best.ravel() > -2
    return pd.DataFrame({"query_id": np.repeat(qid, order.shape[1])[good], "id": ids[order].ravel()[good], "cosine": best.ravel()[good]})


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, cosine (6 decimals) and rank of the k rows of vectors (id, embedding) most similar to each row of queries (id, embedding) of the same length, but itself; ties to the smaller id. Null vectors and ids are left out, zero vectors have cosine 0."""
    kind = dict(vectors.dtypes)["id"]
    parts, blocks = max(1, -(-vectors.count() // PART_ROWS)), max(1, -(-queries.count() // BLOCK_ROWS))

    def shaped(df: DataFrame, asked: bool) -> DataFrame:
        rows = df.dropna(subset=["id", "embedding"]).select("id", "embedding", F.size("embedding").alias("dim"), F.lit(asked).alias("asked"))
        own, n, other, m = ("block", blocks, "part", parts) if asked else ("part", parts, "block", blocks)
        return rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))

    pairs = shaped(queries, True).unionByName(shaped(vectors, False))
    found = pairs.groupBy("dim", "part", "block").applyInPandas(lambda pdf: _scan(pdf, k), f"query_id {kind}, id {kind}, cosine double")
    return top_per_key(found, "query_id", [F.desc("cosine"), F.col("id")], k)


def nearest_anchor(vectors: DataFrame, anchors: DataFrame, most: int = 10_000) -> DataFrame:
    """id, anchor_id and cosine (6 decimals) of the anchor (anchor_id, anchor) most similar to each vector (id, embedding) of its length; ties to the smaller anchor_id; vectors without such an anchor are left out.

    Anchors are sent to every task, at most ``most`` of them; with more, use :func:`top_k`.
    """
    rows = anchors.dropna().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} anchors")
    by: dict[int, list[tuple[str, list[float]]]] = {}
    for r in sorted(rows, key=lambda r: r["anchor_id"]):
        by.setdefault(len(r["anchor"]), []).append((r["anchor_id"], r["anchor"]))
    packed = {n: (np.array([a for a, _ in v], object), _unit(pd.Series([x for _, x in v]))) for n, v in by.items()}

    def assign(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            size = pdf["embedding"].map(len)
            for n, at in pdf.groupby(size, sort=False).indices.items():
                if n in packed:
                    names, a = packed[n]
                    cos = np.round(_unit(pdf["embedding"].iloc[at]) @ a.T, 6)
                    best = cos.argmax(1)
                    yield pd.DataFrame({"id": pdf["id"].to_numpy()[at], "anchor_id": names[best], "cosine": cos[np.arange(len(at)), best]})

    kind = dict(vectors.dtypes)["id"]
    return vectors.select("id", "embedding").dropna().mapInPandas(assign, f"id {kind}, anchor_id string, cosine double")
