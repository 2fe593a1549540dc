"""References to records that do not exist, or that come later.

Keys are split into ranges by hash. Within a range the keys are dictionary-encoded as integers; the references of each table and month are one compressed bitmap over these integers, and so are the parents known before and in that month. References AND NOT parents leaves the orphans, whose bits are decoded to keys again. Only references of months up to the one in which their parent first appears are then compared by their exact times.

A range never holds more than one row per key, table and month, however often one key is referred to, since references are aggregated before they are shuffled by range.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import month_of
from tessera.storage import cut

#: Month of a reference whose time is not known; the time is then not tested.
_NO_MONTH = -1
_NEVER_LATER = -(2**62)
_NONE = -(2**63)
#: Aggregated rows of a key range, roughly.
ROWS_PER_RANGE = 250_000

_GROUPS = "ref_table string, space string, key string, month int, since long"


#: Integers that a container of a bitmap covers, and up to how many it holds as a list.
_SPAN, _LISTED = 1 << 16, 4096


class Bitmap:
    """A set of non-negative integers in containers of 65,536 each, none where there is nothing: a sorted list of 16-bit offsets where there are few, the runs' starts and ends where these are fewer still, packed bits otherwise."""

    def __init__(self, codes: np.ndarray) -> None:
        codes = np.unique(codes)
        high = codes >> 16
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        self.parts = {int(high[a]): self._packed((codes[a:b] & (_SPAN - 1)).astype(np.uint16)) for a, b in zip(starts, np.append(starts[1:], len(codes))[: len(starts)], strict=True)}

    @staticmethod
    def _packed(low: np.ndarray) -> tuple[str, np.ndarray]:
        breaks = np.flatnonzero(np.diff(low.astype(np.int32)) != 1)
        if 2 * (len(breaks) + 1) < min(len(low), _LISTED):
            return "runs", np.stack([low[np.append(0, breaks + 1)], low[np.append(breaks, len(low) - 1)]])
        if len(low) <= _LISTED:
            return "list", low
        bits = np.zeros(_SPAN, bool)
        bits[low] = True
        return "bits", np.packbits(bits)

    @staticmethod
    def _offsets(part: tuple[str, np.ndarray]) -> np.ndarray:
        kind, data = part
        if kind == "list":
            return data
        if kind == "bits":
            return np.flatnonzero(np.unpackbits(data)).astype(np.uint16)
        first, last = data.astype(np.int64)
        sizes = last - first + 1
        return (np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())).astype(np.uint16)

    @staticmethod
    def _has(part: tuple[str, np.ndarray] | None, low: np.ndarray) -> np.ndarray:
        if part is None:
            return np.zeros(len(low), bool)
        kind, data = part
        if kind == "bits":
            return (data[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1).astype(bool)
        if kind == "list":
            return np.isin(low, data, assume_unique=True)
        at = np.searchsorted(data[0], low, "right") - 1
        return (at >= 0) & (low <= data[1][np.maximum(at, 0)])

    def __sub__(self, other: Bitmap) -> np.ndarray:
        """The members that other hasn't, in ascending order."""
        out = [np.array([], np.int64)]
        for high, part in sorted(self.parts.items()):
            low = self._offsets(part)
            out.append((high << 16) + low[~self._has(other.parts.get(high), low)].astype(np.int64))
        return np.concatenate(out)


def _range_orphans(pdf: pd.DataFrame) -> pd.DataFrame:
    """The orphans of one key range: groups (ref_table, key, month) that have no parent at all, since null, or a parent that may come later, since set."""
    codes, words = pd.factorize(pdf["space"] + "\x1f" + pdf["key"])
    n = len(words)
    is_ref = pdf["ref_table"].notna().to_numpy()
    month, at = pdf["month"].to_numpy(), pdf["at"].to_numpy()
    since = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(since, codes[~is_ref], at[~is_ref])
    since_month = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(since_month, codes[~is_ref], month[~is_ref])
    there = Bitmap(codes[~is_ref])
    # the parents known before each month
    before = cache(lambda m: Bitmap(np.flatnonzero(since_month < m)))
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("ref_table", "space", "key", "month", "since")}
    refs = pdf[is_ref]
    ref_codes = codes[is_ref]
    for (table, m), rows in refs.groupby(["ref_table", "month"], sort=False).indices.items():
        wanted = Bitmap(ref_codes[rows])
        none = wanted - there
        maybe = none[:0] if m == _NO_MONTH else np.setdiff1d(wanted - before(m), none, assume_unique=True)
        for found, time in ((none, _NONE), (maybe, since)):
            pairs = [words[i].split("\x1f", 1) for i in found.tolist()]
            out["ref_table"].append(np.full(len(found), table, object))
            out["space"].append(np.array([p[0] for p in pairs], object))
            out["key"].append(np.array([p[1] for p in pairs], object))
            out["month"].append(np.full(len(found), m))
            out["since"].append(np.full(len(found), _NONE) if time is _NONE else time[found])
    got = pd.DataFrame({c: np.concatenate(v) if v else np.array([], object) for c, v in out.items()})
    if len(got):
        got["since"] = pd.arrays.IntegerArray(got["since"].to_numpy(np.int64), got["since"].to_numpy() == _NONE)
    return got


def orphan_references(references: DataFrame, parents: DataFrame, ranges: int | None = None) -> DataFrame:
    """The rows of references whose parent is missing or comes later.

    references: ref_table (the table), ref_key (the row's own key), space (the kind of parent), key (the parent's key), at (microseconds, null: unknown). parents: space, key, since (microseconds, null: unknown). Keys are compared as they are given, so bring them into one form before.

    A reference is an orphan if parents have no row with its space and key, or if the earliest known since of those rows is later than at. If either is unknown the time isn't tested. Rows with a null ref_table, space or key are no references. The result has ref_table, ref_key, space, key, month (:func:`month_of` at, null if unknown) and missing (true: no such parent, false: it comes later), one row per distinct input row and in any order. Empty inputs give an empty result, other columns are ignored, and repeated rows count once.
    """
    spark = references.sparkSession
    refs = references.select("ref_table", "ref_key", "space", "key", "at", F.coalesce(month_of("at"), F.lit(_NO_MONTH)).alias("month")).dropna(subset=["ref_table", "space", "key"])
    groups = refs.groupBy("ref_table", "space", "key", "month").agg(F.min("at").alias("at"))
    known = parents.dropna(subset=["space", "key"]).groupBy("space", "key").agg(F.min("since").alias("at"))
    known = known.select(F.lit(None).cast("string").alias("ref_table"), "space", "key", F.coalesce(month_of("at"), F.lit(_NO_MONTH)).alias("month"), F.coalesce("at", F.lit(_NEVER_LATER)).alias("at"))
    both = cut(groups.withColumn("at", F.coalesce("at", F.lit(0))).select(known.columns).unionByName(known), "keys")
    if ranges is None:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // ROWS_PER_RANGE))
    found = both.groupBy(F.pmod(F.xxhash64("space", "key"), F.lit(ranges)).alias("range")).applyInPandas(_range_orphans, _GROUPS)
    same = [refs[c] == found[c] for c in ("ref_table", "space", "key", "month")]
    late = found["since"].isNull() | (refs["at"] < found["since"])
    joined = refs.join(found, [*same, late])
    return joined.select(refs["ref_table"], refs["ref_key"], refs["space"], refs["key"], F.nullif(refs["month"], F.lit(_NO_MONTH)).alias("month"), found["since"].isNull().alias("missing")).distinct()


def count_orphans(orphans: DataFrame) -> DataFrame:
    """Orphans per table and month: ref_table, month, orphans, missing_parent, later_parent; of :func:`orphan_references`."""
    return orphans.groupBy("ref_table", "month").agg(F.count("*").alias("orphans"), F.count_if("missing").alias("missing_parent"), F.count_if(~F.col("missing")).alias("later_parent"))
