"""Tokens of the public "wordpunct" tokenizer: the longest runs of letters, digits and underscores, and the longest runs of other characters that are no blanks."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"\p{L}\p{N}_"
_BLANKS = r"\s\x1c-\x1f\u0085\p{Z}"
TOKEN = rf"[{_WORD}]+|[^{_WORD}{_BLANKS}]+"


def n_tokens(c: Column | str) -> Column:
    """Number of tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(c) if isinstance(c, str) else c, F.lit(TOKEN)), F.lit(0))


BLANK, WORD, OTHER = 0, 1, 2


@cache
def _kinds() -> np.ndarray:
    kind = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isspace():
            kind[i] = BLANK
        elif c.isalnum() or c == "_":
            kind[i] = WORD
    return kind


def token_spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a text, and its tokens' first characters and ends, as positions of code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[points]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(BLANK), append=np.uint8(BLANK)))
    runs = kind[edge[:-1]] != BLANK if len(edge) else np.array([], bool)
    return points, edge[:-1][runs], edge[1:][runs]
