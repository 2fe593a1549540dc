"""Problem 9: texts over a limit cut into pieces at natural boundaries, with overlap.

A text over the limit is cut by recursive bisection: at the strongest boundary near its middle, then both halves in the same way while they exceed the limit less the overlap; each piece but the first then begins with the last tokens of what precedes it. Every text is cut in one go where it lies, so the work needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import token_spans

INSIDE, GAP, SENTENCE, LINE, PARAGRAPH = range(5)
_ENDERS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)
_BREAKS = np.array([10, 11, 12, 28, 29, 30, 0x85, 0x2028], np.uint32)


def boundaries(points: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Strength of the boundary before each token: the end of a paragraph, line or sentence, a gap, or none."""
    breaks = np.isin(points, _BREAKS) | ((points == 13) & (np.append(points[1:], 0) != 10))
    lines = np.concatenate([[0], np.cumsum(breaks.astype(np.int64) + 2 * (points == 0x2029))])
    between = lines[first[1:]] - lines[end[:-1]]
    gap = first[1:] > end[:-1]
    ends = np.isin(points[end[:-1] - 1], _ENDERS)
    strength = np.select([between >= 2, between == 1, gap & ends, gap], [PARAGRAPH, LINE, SENTENCE, GAP], INSIDE)
    return np.concatenate([[PARAGRAPH], strength])


def bisect(strength: np.ndarray, limit: int, overlap: int) -> list[int]:
    """First tokens of the pieces of a text over the limit.

    A cut is taken in the middle half if a paragraph, line or sentence ends there, else wherever in the part one ends, else at a gap, else anywhere; among equals the nearest to the middle.
    """
    most = limit - overlap
    starts, parts = [], [(0, len(strength))]
    while parts:
        lo, hi = parts.pop()
        n = hi - lo
        if n <= most:
            starts.append(lo)
            continue
        mid = (lo + hi) / 2
        for a, b, least in ((lo + n // 4, hi - n // 4, SENTENCE), (lo + 1, hi, SENTENCE), (lo + n // 4, hi - n // 4, GAP), (lo + n // 4, hi - n // 4, INSIDE)):
            a, b = max(a, lo + 1), max(b, lo + 2)
            near = strength[a:b]
            best = near.max()
            if best >= least:
                at = a + np.flatnonzero(near == best)
                cut_at = int(at[np.abs(at - mid).argmin()])
                break
        parts += [(cut_at, hi), (lo, cut_at)]
    return starts


def _split(batches: Iterator[pd.DataFrame], limit: int, overlap: int, texts: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            points, first, end = token_spans(text)
            n = len(first)
            if n <= limit:
                starts = [0]
            else:
                starts = bisect(boundaries(points, first, end), limit, overlap)
            for k, s in enumerate(starts):
                stop = starts[k + 1] if k + 1 < len(starts) else n
                begin = max(0, s - overlap) if k else 0
                a = int(first[begin]) if begin else 0
                b = int(first[stop]) if stop < n else len(points)
                new = int(first[s]) if s else 0
                rows.append((doc_id, k, len(starts), begin, stop - begin, s - begin, a, new, b, text[a:b] if texts else None))
        yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "pieces", "first_token", "n_tokens", "overlap_tokens", "char_from", "char_new", "char_to", "text"])


def split_oversized(documents: DataFrame, max_tokens: int, overlap_tokens: int, texts: bool = True) -> DataFrame:
    """The pieces of documents (doc_id, text): doc_id, piece_no, pieces, first_token, n_tokens, overlap_tokens (shared with the piece before), char_from, char_new (where what is new begins), char_to, and text unless texts is false.

    No piece has more than max_tokens tokens, and a piece but the first shares exactly overlap_tokens with the one before. The spans from char_new to char_to make up the whole text, blanks included. A document within the limit, an empty one too, is one piece; a null text has none. A token is never cut, however long. Repeated rows give repeated pieces; other columns are ignored.
    """
    if not 0 <= overlap_tokens < max_tokens:
        raise ValueError("overlap_tokens must be at least 0 and under max_tokens")
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece_no int, pieces int, first_token int, n_tokens int, overlap_tokens int, char_from int, char_new int, char_to int, text string"
    rows = documents.select("doc_id", "text").where("text is not null")
    out = rows.mapInPandas(partial(_split, limit=max_tokens, overlap=overlap_tokens, texts=texts), schema)
    return out if texts else out.drop("text")
