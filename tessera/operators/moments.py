"""Sums over the elements of vectors, formed where the rows lie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def element_sums(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, i (from 0), n, x and xx: of each element of the vectors of a group how many there are, their sum and the sum of their squares.

    Tasks add up their batches, so what is shuffled are a few rows per group and batch and not one per element of every vector. Null elements count nowhere; null vectors are left out; vectors of different lengths are added up as far as they go.
    """
    kinds = dict(rows.dtypes)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, at in pdf.groupby([*keys, "size"], dropna=False, sort=False).indices.items():
                x = np.array(pdf[column].iloc[at].tolist(), np.float64).reshape(len(at), -1)
                first = pdf[keys].iloc[at[0]]
                out.append([*(None if pd.isna(first[k]) else first[k] for k in keys), (~np.isnan(x)).sum(0).tolist(), np.nansum(x, 0).tolist(), np.nansum(x * x, 0).tolist()])
            yield pd.DataFrame(out, columns=[*keys, "n", "x", "xx"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    parts = rows.where(F.col(column).isNotNull()).select(*keys, column, F.size(column).alias("size")).mapInPandas(add, f"{schema}, n array<long>, x array<double>, xx array<double>")
    each = parts.select(*keys, F.posexplode(F.arrays_zip("n", "x", "xx")).alias("i", "s"))
    return each.groupBy(*keys, "i").agg(F.sum("s.n").alias("n"), F.sum("s.x").alias("x"), F.sum("s.xx").alias("xx"))
