"""What an update of a table would write: new rows, changed rows, rows to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_rows(rows: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, none null, the table doesn't have, once each."""
    return rows.dropna(subset=keys).dropDuplicates(keys).join(have.select(*keys), keys, "left_anti")


def merged(have: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """The table after an upsert: per key the row with the largest order, an update winning a tie; columns that an update has null keep their value."""
    columns = [c for c in have.columns if c != key]
    both = have.withColumn("_new", F.lit(0)).unionByName(updates.select(*have.columns).withColumn("_new", F.lit(1)))
    at = F.struct(F.col(order), "_new")
    return both.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns))
