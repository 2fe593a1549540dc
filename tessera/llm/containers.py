"""Problem 7: documents of all lengths packed into containers of fixed capacity.

Linear grouping: large sizes fall into groups of about equal numbers and are rounded up to their group's largest, so that only a few sizes remain, for which patterns of a container and their numbers are optimised from the histogram of sizes, which has at most one entry per size up to the capacity. Documents then take the places of their group in the patterns by rank, and the small ones fill what space is left, best fit first, in shards of containers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import n_tokens
from tessera.storage import cut

#: Groups of large sizes.
GROUPS = 48
#: Sizes over this part of the capacity are large.
LARGE = 1 / 8
#: Column generation ends when the relaxation is this near to its best value, as its dual bound shows.
_CLOSE = 1e-3
#: Items, large and small, for each shard of the last step.
ITEMS_PER_SHARD = 50_000


def group_sizes(histogram: dict[int, int], groups: int) -> list[tuple[int, int, int]]:
    """(smallest, largest, number) of at most groups groups of sizes with about equal numbers; a size isn't divided."""
    left, total, out = groups, sum(histogram.values()), []
    sizes = sorted(histogram)
    lo, n = None, 0
    for k, s in enumerate(sizes):
        lo = s if lo is None else lo
        n += histogram[s]
        if n * left >= total or k == len(sizes) - 1:
            out.append((lo, s, n))
            total, left, lo, n = total - n, max(1, left - 1), None, 0
    return out


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest worth that fits a container, by the unbounded knapsack over capacities."""
    value = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, w = sizes[order], worth[order]
    for c in range(1, capacity + 1):
        value[c], took[c] = value[c - 1], -1
        fit = np.searchsorted(s, c, side="right")
        if fit:
            got = value[c - s[:fit]] + w[:fit]
            j = int(got.argmax())
            if got[j] > value[c] + 1e-12:
                value[c], took[c] = got[j], j
    pattern, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        j = took[c]
        if j < 0:
            c -= 1
        else:
            pattern[order[j]] += 1
            c -= int(s[j])
    return float(value[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, for a few sizes: the linear relaxation by column generation, rounded down. At most as many patterns as sizes come out, so what rounding leaves is less than one container per size."""
    s, d = np.array(sizes), np.array(demand, float)
    columns = [np.eye(len(s), dtype=int)[i] * (capacity // s[i]) for i in range(len(s))]
    basis = np.array(columns, float).T
    inverse = np.linalg.inv(basis)
    x = inverse @ d
    for _ in range(rounds):
        value, pattern = _best_pattern(s, inverse.sum(axis=0), capacity)
        if value <= 1 + _CLOSE:
            break
        step = inverse @ pattern
        ratios = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratios.argmin())
        basis[:, out], columns[out] = pattern, pattern
        inverse = np.linalg.inv(basis)
        x = np.maximum(inverse @ d, 0)
    left, used = np.array(demand), []
    for i in np.argsort(-x):
        n = int(x[i] + 1e-6)
        n = min([n, *(left[j] // columns[i][j] for j in np.flatnonzero(columns[i]))])
        if n:
            left = left - n * columns[i]
            used.append((columns[i], int(n)))
    return used


def _places(patterns: list[tuple[np.ndarray, int]], groups: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(group, first place, places, first container, places per container) and the number of containers."""
    out, first, container = [], [0] * groups, 0
    for pattern, n in patterns:
        for g in np.flatnonzero(pattern).tolist():
            out.append((g, first[g], int(pattern[g]) * n, container, int(pattern[g])))
            first[g] += int(pattern[g]) * n
        container += n
    return out, container


def best_fit(sizes: list[int], free: dict[int, int], capacity: int) -> list[tuple[int, bool]]:
    """The container of each item, largest first, in the fullest container that it fits into: (container, whether it is a new one). New ones are numbered from 0."""
    by_free: list[list[tuple[int, bool]]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for c, f in free.items():
        by_free[f].append((c, False))
        mask |= 1 << f
    out: list[tuple[int, bool]] = [(0, False)] * len(sizes)
    new = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = mask >> sizes[i]
        if fits:
            f = sizes[i] + (fits & -fits).bit_length() - 1
            c = by_free[f].pop()
            if not by_free[f]:
                mask &= ~(1 << f)
        else:
            f, c, new = capacity, (new, True), new + 1
        out[i] = c
        by_free[f - sizes[i]].append(c)
        mask |= 1 << (f - sizes[i])
    return out


_ITEM = ("doc_id", "part", "first_token", "n_tokens")


def _fill(pdf: pd.DataFrame, capacity: int, containers: int, shards: int) -> pd.DataFrame:
    """The small items of a shard put into its containers and new ones."""
    is_item = pdf["doc_id"].notna().to_numpy()
    bins, items = pdf[~is_item], pdf[is_item].sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True])
    got = best_fit(items["n_tokens"].tolist(), dict(zip(bins["container_id"].astype("int64").tolist(), bins["n_tokens"].tolist(), strict=True)), capacity)
    shard = int(pdf["shard"].iloc[0])
    out = items[list(_ITEM)].copy()
    out["container_id"] = [containers + shards * c + shard if new else c for c, new in got]
    return out


def pack(documents: DataFrame, capacity: int, groups: int = GROUPS, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """A container for every document (doc_id, unique; text): doc_id, part, first_token, n_tokens, container_id.

    A document of more than capacity tokens is divided into parts of capacity tokens and a rest; no other is. Documents without tokens, of a null text too, take a place without space. No container holds more than capacity tokens. Container ids are unique but not dense. Other columns are ignored; an empty table gives an empty result. The driver sees the histogram of sizes only, which has capacity entries at most.
    """
    sizes = documents.select("doc_id", n_tokens("text").alias("n"))
    part = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(capacity)))
    items = sizes.select("doc_id", "n", part.alias("first_token"))
    items = items.select("doc_id", F.expr(f"cast(first_token div {capacity} as int)").alias("part"), "first_token", F.least(F.col("n") - F.col("first_token"), F.lit(capacity)).alias("n_tokens"))
    items = cut(items, "items")
    spark = items.sparkSession
    histogram = {int(r["n_tokens"]): int(r["n"]) for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    shards = max(1, -(-sum(histogram.values()) // items_per_shard))
    large = group_sizes({s: n for s, n in histogram.items() if s > capacity * LARGE}, groups)
    patterns = configurations([hi for _, hi, _ in large], [n for _, _, n in large], capacity) if large else []
    places, containers = _places(patterns, len(large))

    group = F.lit(None).cast("int")
    for g, (lo, hi, _) in reversed(list(enumerate(large))):
        group = F.when(F.col("n_tokens").between(lo, hi), g).otherwise(group)
    shard = F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int")
    known = items.withColumns({"g": group, "shard": shard})
    per = known.where("g is not null").groupBy("g", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = known.where("g is not null").withColumn("rn", F.row_number().over(Window.partitionBy("g", "shard").orderBy("doc_id", "part")) - 1).join(per.select("g", "shard", before.alias("before")), ["g", "shard"])
    ranked = ranked.withColumn("place", F.col("rn") + F.col("before"))
    plan = spark.createDataFrame(places, "pg int, place_from long, places long, container_from long, per long")
    # at most groups x groups rows
    fits = (F.col("g") == F.col("pg")) & (F.col("place") >= F.col("place_from")) & (F.col("place") < F.col("place_from") + F.col("places"))
    placed = ranked.join(F.broadcast(plan), fits, "left").withColumn("container_id", F.expr("container_from + (place - place_from) div per"))
    placed = cut(placed.select(*_ITEM, "shard", "container_id"), "placed")

    put = placed.where("container_id is not null")
    free = put.groupBy("container_id").agg((F.lit(capacity) - F.sum("n_tokens")).cast("int").alias("n_tokens"))
    bins = free.select(F.lit(None).cast(dict(items.dtypes)["doc_id"]).alias("doc_id"), F.lit(0).alias("part"), F.lit(0).alias("first_token"), "n_tokens", "container_id", F.pmod("container_id", F.lit(shards)).cast("int").alias("shard"))
    nothing = F.lit(None).cast("long").alias("container_id")
    rest = placed.where("container_id is null").select(*_ITEM, nothing, "shard").unionByName(known.where("g is null").select(*_ITEM, nothing, "shard"))
    schema = f"doc_id {dict(items.dtypes)['doc_id']}, part int, first_token int, n_tokens int, container_id long"
    filled = bins.unionByName(rest).groupBy("shard").applyInPandas(lambda pdf: _fill(pdf, capacity, containers, shards), schema)
    return put.select(*_ITEM, "container_id").unionByName(filled)


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, fewest (no packing has fewer containers), fill (part of the space that is used; null without containers), full (containers without free space)."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    tokens = F.coalesce(F.sum("n"), F.lit(0))
    return each.agg(F.count("*").alias("containers"), tokens.alias("tokens"), F.ceil(tokens / capacity).alias("fewest"), F.try_divide(tokens, F.count("*") * capacity).alias("fill"), F.count_if(F.col("n") == capacity).alias("full"))
