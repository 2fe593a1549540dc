"""Problem 1: the best representative of each group of duplicates, chosen as a whole and built field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import epoch_micros, norm_key

#: Fields of the record built from a group.
FIELDS = ("text", "summary", "domain_id", "memory_type", "importance", "confidence", "stability", "clc_state", "created_at", "updated_at", "last_recalled")


def _factor(name: str) -> Column:
    """The factor if it lies in 0..1, null otherwise."""
    c = F.col(name)
    return F.when(~F.isnan(c) & c.between(0, 1), c)


def versions(memories: DataFrame) -> DataFrame:
    """The rows with an id, which is brought into normal form, with deprecated 0 for null, confidence and importance null unless in 0..1, at (updated_at in microseconds), live and score: confidence times importance rounded to 6 decimals, 0 without one of them."""
    rows = memories.select(norm_key("id").alias("id"), F.coalesce("deprecated", F.lit(0)).alias("deprecated"), *(_factor(f).alias(f) if f in ("confidence", "importance") else F.col(f) for f in FIELDS)).where("id is not null")
    return rows.withColumns({"at": epoch_micros("updated_at"), "live": (F.col("deprecated") == 0).cast("int"), "score": F.round(F.coalesce("confidence", F.lit(0.0)) * F.coalesce("importance", F.lit(0.0)), 6)})


def best_records(memories: DataFrame, members: DataFrame) -> DataFrame:
    """One row per group of members (memory_id, group_id): group_id, copies (ids), survivor_id and the surviving value of each of FIELDS.

    An id counts with its latest version (null updated_at is oldest; of equal times the larger in the order of live, score). The survivor is not deprecated if any of the group isn't, then has the highest score, then the latest updated_at, then the smallest id. A field is taken from all versions of all ids of the group: the value of the row that, first, has one, then isn't deprecated, then has the highest score, then the latest updated_at; equal rows give the larger value. Ids that memories doesn't have are no candidates; a group without candidates is left out.

    All are maxima of structs: of an id over its versions, then of a group over its ids, so groups of any size are added up where the rows lie.
    """
    field = lambda f: F.max(F.struct(F.col(f).isNotNull().alias("there"), "live", "score", "at", F.col(f).alias("value"))).alias(f)
    ids = versions(memories).groupBy("id").agg(F.max(F.struct("at", "live", "score")).alias("last"), *(field(f) for f in FIELDS))
    rows = ids.join(members.select(F.col("memory_id").alias("id"), "group_id"), "id")
    never = F.lit(2**62)
    survivor = F.min(F.struct((1 - F.col("last.live")).alias("d"), (-F.col("last.score")).alias("s"), F.coalesce(-F.col("last.at"), never).alias("t"), F.col("id").alias("survivor_id")))
    grouped = rows.groupBy("group_id").agg(F.count("*").alias("copies"), survivor.alias("survivor"), *(F.max(f).alias(f) for f in FIELDS))
    return grouped.select("group_id", "copies", "survivor.survivor_id", *(F.col(f"{f}.value").alias(f) for f in FIELDS))
