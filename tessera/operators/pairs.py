"""Texts of one domain that say nearly the same, by the words they share and by their vectors, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import token_set
from tessera.functions.vectors import cosine, norm
from tessera.storage import cut

#: Rare words that two claims share to be compared, at most; fewer where their combinations would be more than so many for each word.
LEVEL, KEYS_PER_TOKEN = 3, 8
#: Words of domains, the most frequent ones, whose order tasks get by value; all others count as rarer.
COMMON = 200_000
#: Rows up to which a list of wanted ones is broadcast.
BROADCAST_ROWS = 100_000
#: Steps from 0 to 1 of the rounded unit vectors by which pairs are sifted before their cosine is computed.
_STEPS = 127
_KEYS_AT_ONCE = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BETWEEN = "\x1f"


def _needed(size: Column, least: float) -> Column:
    """How many of size tokens another set must share to be as similar as least; the small amount keeps products such as 0.8 * 5 whole."""
    return F.ceil(size * F.lit(least) - F.lit(1e-9))


def _level(size: int, least: float) -> int:
    """How many of their rarest words two sets must share to be compared, if the smaller has this size: as many as LEVEL, unless these are more than they must have in common or have too many combinations."""
    need = ceil(size * least - 1e-9)
    return next((n for n in range(min(LEVEL, need), 1, -1) if comb(size - need + n, n) <= KEYS_PER_TOKEN * size), 1)


def _keys(batches: Iterator[pa.RecordBatch], common: list[str], whole: bool, least: float) -> Iterator[pa.RecordBatch]:
    """key, n, size and bits of sets (n, domain, tokens): a key for every combination of its rarest tokens, the number of its tokens, and for each of 64 classes of tokens whether it has an odd number of them.

    common: the tokens of domains that are in several sets, rarest first; whole: whether these are all, so that others are in one set only and no key needs them.
    """
    names = pa.array(common, pa.string())
    for batch in batches:
        n, lists = batch.column("n").to_numpy(), batch.column("tokens")
        sizes = lists.value_lengths().to_numpy()
        flat, row = lists.flatten(), np.repeat(np.arange(len(n)), sizes)
        place = pc.fill_null(pc.index_in(pc.binary_join_element_wise(batch.column("domain").take(pa.array(row)), flat, _BETWEEN), value_set=names), -1).to_numpy()
        h = pd.util.hash_array(flat.to_numpy(zero_copy_only=False))
        bits = np.bitwise_xor.reduceat(np.uint64(1) << (h >> np.uint64(58)), np.cumsum(sizes) - sizes) if len(n) else np.zeros(0, np.uint64)
        order = np.lexsort((h, place, row))
        h, place = h[order], place[order]
        start, skip = np.cumsum(sizes) - sizes, np.bincount(row[place < 0], minlength=len(n)) * whole
        domain = pd.util.hash_array(batch.column("domain").to_numpy(zero_copy_only=False))
        for size in np.unique(sizes).tolist():
            need = ceil(size * least - 1e-9)
            for level in sorted({_level(x, least) for x in range(need, size + 1)}):
                if level > need:
                    continue
                left = np.where(sizes == size, size - need + level - skip, 0)
                for k in np.unique(left[left >= level]).tolist():
                    at = np.flatnonzero(left == k)
                    first = h[(start[at] + skip[at])[:, None] + np.arange(k)]
                    some = max(1, _KEYS_AT_ONCE // comb(k, level))
                    which = np.array(list(combinations(range(k), level)))
                    for i in range(0, len(at), some):
                        key = np.broadcast_to((domain[at[i : i + some]] + np.uint64(level))[:, None], (len(at[i : i + some]), len(which)))
                        for j in range(level):
                            key = (key ^ first[i : i + some][:, which[:, j]]) * _ODD
                            key = key ^ (key >> np.uint64(29))
                        own = np.repeat(at[i : i + some], len(which))
                        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(n[own]), pa.array(np.full(len(own), size, np.int32)), pa.array(bits[own].view(np.int64))], ["key", "n", "size", "bits"])


def numbered(claim_rows: DataFrame) -> DataFrame:
    """Claims, written once, each with a number n."""
    return cut(claim_rows.withColumn("n", F.monotonically_increasing_id()), "claims")


def candidates(held: DataFrame, least: float) -> DataFrame:
    """n_a < n_b of the sets (n, domain_id, tokens) of one domain that may have a jaccard of least or more; all that have are among them.

    Tokens of a domain are ordered, rarest first. Two sets that have many tokens in common have the first of these among their own first ones, so sets meet at the combinations of their rarest tokens (see :func:`_level`). What they have an odd number of shows how much they differ at least, so that few of those that meet and aren't similar are passed on.
    """
    sets = held.select("n", F.coalesce("domain_id", F.lit("")).alias("domain"), "tokens")
    frequent = sets.select("domain", F.explode("tokens").alias("token")).select(F.concat_ws(_BETWEEN, "domain", "token").alias("name")).groupBy("name").agg(F.count("*").alias("docs")).where("docs > 1")
    top = frequent.orderBy(F.desc("docs"), "name").limit(COMMON + 1).collect()
    common = [r["name"] for r in reversed(top[:COMMON])]
    keys = sets.mapInArrow(partial(_keys, common=common, whole=len(top) <= COMMON, least=least), "key long, n long, size int, bits long")
    a, b = (keys.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("n", "size", "bits"))) for s in "ab")
    small, large, both = F.least("size_a", "size_b"), F.greatest("size_a", "size_b"), F.col("size_a") + F.col("size_b")
    apart = both - 2 * F.ceil(both * F.lit(least / (1 + least)) - F.lit(1e-9))
    met = a.join(b, "key").where(F.col("n_a") < F.col("n_b")).where(F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= apart)
    return met.where(small >= _needed(large, least)).select("n_a", "n_b").distinct()


def _only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in wanted; where these are few they go to the rows."""
    wanted = cut(wanted.distinct(), "wanted")
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, key, "left_semi")


def claims(rows: DataFrame) -> DataFrame:
    """Rows (id, domain_id, text, quality) with the same set of words in one domain are one claim: domain_id, tokens (in order), keeper_id (highest quality, then smallest id) and copies.

    A null domain is one of its own; a null quality is lowest; null ids and texts, and texts without words, are in no claim. Copies are counted where they lie, by a digest of the words.
    """
    tokens = F.array_sort(token_set("text"))
    named = rows.where("id is not null and text is not null").select("id", "domain_id", tokens.alias("tokens"), "quality").where(F.size("tokens") > 0)
    best = F.min(F.struct((-F.coalesce("quality", F.lit(float("-inf")))).alias("q"), "id"))
    return named.groupBy("domain_id", F.md5(F.array_join("tokens", " ")).alias("digest")).agg(best["id"].alias("keeper_id"), F.first("tokens").alias("tokens"), F.count("*").alias("copies"))


def similar_pairs(claim_rows: DataFrame, vectors: DataFrame, least_cosine: float = 0.9, least_jaccard: float = 0.8) -> DataFrame:
    """left_id < right_id, cosine and jaccard (6 decimals) of the keepers of two claims of one domain that reach both limits, by vectors (id, embedding) and words. Keepers without a vector, or of different lengths, are in no pair.

    Two claims are compared if they share some of their rarest words (see :func:`candidates`); nothing is lost. Claims differ in their words, so a group of copies is a single one here. Pairs that are left get their vectors rounded to bytes, and only those that may reach the limit within that error the vectors themselves. The result is written, so that reading it again costs nothing.
    """
    if not 0 < least_jaccard <= 1:
        raise ValueError("least_jaccard is above 0 and at most 1")
    held = claim_rows if "n" in claim_rows.columns else numbered(claim_rows)
    near = cut(candidates(held, least_jaccard), "near")
    texts = cut(_only(held.select("n", F.col("keeper_id").alias("id"), F.coalesce("domain_id", F.lit("")).alias("domain"), "tokens"), near.select(F.explode(F.array("n_a", "n_b")).alias("n")), "n"), "texts")
    for s in "ab":
        near = near.join(texts.select(*(F.col(c).alias(f"{c}_{s}") for c in texts.columns)), f"n_{s}")
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    alike = near.where("domain_a = domain_b").withColumn("jaccard", F.round(both / (F.size("tokens_a") + F.size("tokens_b") - both), 6)).where(F.col("jaccard") >= least_jaccard)
    alike = cut(alike.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "jaccard"), "alike")
    embedded = _only(vectors.select("id", "embedding"), alike.select(F.explode(F.array("id_a", "id_b")).alias("id")), "id")
    embedded = cut(embedded.withColumn("norm", F.greatest(norm(F.col("embedding")), F.lit(1e-12))), "embedded")
    brief = embedded.select("id", F.size("embedding").alias("dim"), F.transform("embedding", lambda x: F.round(x / F.col("norm") * _STEPS).try_cast("tinyint")).alias("e"))
    close = alike
    for s in "ab":
        close = close.join(brief.select(*(F.col(c).alias(f"{c}_{s}") for c in brief.columns)), f"id_{s}")
    # each rounded vector is off by half a step in every element at most
    off = F.sqrt("dim_a") * F.lit(0.5 / _STEPS) + F.lit(1e-6)
    about = F.aggregate(F.zip_with("e_a", "e_b", lambda x, y: x.cast("int") * y), F.lit(0), lambda t, x: t + x) / F.lit(_STEPS**2)
    close = close.where("dim_a = dim_b").where(F.coalesce(about >= F.lit(least_cosine) - 2 * off - off * off, F.lit(True)))
    close = cut(close.select("id_a", "id_b", "jaccard"), "close")
    exact = _only(embedded, close.select(F.explode(F.array("id_a", "id_b")).alias("id")), "id")
    for s in "ab":
        close = close.join(exact.select(F.col("id").alias(f"id_{s}"), F.col("embedding").alias(f"embedding_{s}")), f"id_{s}")
    found = close.withColumn("cosine", F.round(cosine(F.col("embedding_a"), F.col("embedding_b")), 6)).where(F.col("cosine") >= least_cosine)
    return cut(found.select(F.col("id_a").alias("left_id"), F.col("id_b").alias("right_id"), "cosine", "jaccard"), "found")


def linked_groups(pairs: DataFrame) -> DataFrame:
    """id and group_id of every id in pairs (left_id, right_id): the smallest id that links lead to, in either direction. Nulls and loops link nothing.

    Each round hangs all neighbours of an id below their smallest, first the larger ones and then the smaller ones, until every id hangs on its root: as many rounds as the logarithm of the longest way, a few aggregations and joins each. Minima are formed where the rows lie, so an id with very many links is one row per task.
    """
    flat = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    known = cut(flat(pairs.select(F.col("left_id").alias("u"), F.col("right_id").alias("v"))), "links")
    before = None
    while True:
        ways = known.union(known.select("v", "u"))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(flat(large), "links")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        known = cut(flat(small), "links")
        state = known.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = known.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct()
    return known.select(F.col("u").alias("id"), F.col("v").alias("group_id")).union(roots)


def similar_groups(claim_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per claim: keeper_id, domain_id, copies, links (pairs it is in), group_id (smallest keeper linked to it, directly or through others; its own if none) and group_claims, the claims of its group."""
    links = pairs.select(F.explode(F.array("left_id", "right_id")).alias("keeper_id")).groupBy("keeper_id").agg(F.count("*").alias("links"))
    group = linked_groups(pairs).withColumnRenamed("id", "keeper_id")
    sizes = group.groupBy("group_id").agg(F.count("*").alias("group_claims"))
    rows = claim_rows.select("keeper_id", "domain_id", "copies").join(links, "keeper_id", "left").join(group.join(sizes, "group_id"), "keeper_id", "left")
    return rows.select("keeper_id", "domain_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "keeper_id").alias("group_id"), F.coalesce("group_claims", F.lit(1)).alias("group_claims"))
