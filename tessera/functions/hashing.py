"""Embeddings by hashing tokens, for tables without a model's."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: words keep the signs of paths, versions and tags; other signs, and letters beyond ASCII, divide them.
_WORD = re.compile(r"[A-Za-z0-9_#./:+-]+")


def _place(word: str, dim: int) -> tuple[int, float]:
    """The element that a word's digest names, and the word's weight, 1 + (length mod 7) / 10, with the digest's sign."""
    h = hashlib.blake2b(word.encode(), digest_size=16).digest()
    return int.from_bytes(h[:4], "little") % dim, (1 if h[4] % 2 == 0 else -1) * (1 + len(word) % 7 / 10)


def hash_embeddings(texts: DataFrame, dim: int = 128) -> DataFrame:
    """id and embedding of texts (id, text): the unit vector of the sum of the words' weights. Words are runs of ASCII letters, digits and the signs of paths and versions, in lower case; a text without words, a null one too, has zeros. A word is hashed once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = lru_cache(100_000)(lambda w: _place(w, dim))
        for pdf in batches:
            out = np.zeros((len(pdf), dim))
            for row, text in zip(out, pdf["text"], strict=True):
                for w in _WORD.findall(text.lower()) if isinstance(text, str) else ():
                    at, weight = place(w)
                    row[at] += weight
            n = np.linalg.norm(out, axis=1)
            yield pd.DataFrame({"id": pdf["id"], "embedding": list(out / np.where(n > 0, n, 1)[:, None])})

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").mapInPandas(run, f"id {kind}, embedding array<double>")
