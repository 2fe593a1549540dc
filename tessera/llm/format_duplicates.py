"""Problem 2: records that differ only in white space, letter case, punctuation or the order of fields, and their number of copies.

Canonical notes are counted by recursive radix partitioning: a bucket is a prefix of the note's bytes; one with too many rows is split by further bytes until each fits; within a bucket a trie with counters at its ends counts the notes. Before that each task adds up its own copies, so a note that a third of all rows repeat is a few rows per task in its bucket. Which prefixes have too many rows is a table that is joined, at each number of bytes; the driver sees only whether there are any.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.notes import notes_of
from tessera.storage import cut

#: Rows, added up per task before, that a bucket may hold.
BUCKET_ROWS = 20_000
#: Bytes of prefix after the namespace at the first level; each further level has twice as many, up to the ends of the notes.
FIRST_BYTES = 8
#: Distinct notes that a task adds up before it passes them on.
_HELD = 100_000
#: Counters that a task passes on at a time, at least.
_BATCH = 10_000
#: Bytes an edge of the trie spans.
_EDGE = 8

_PARTIAL = "note binary, digest binary, copies long, first_id string"


def _add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The notes of a task with their ids counted: one row per note, as long as there are not too many of them."""
    held: dict[bytes, list] = {}
    for pdf in batches:
        for note, digest, i in zip(pdf["note"].tolist(), pdf["digest"].tolist(), pdf["id"].tolist(), strict=True):
            got = held.get(note)
            if got is None:
                held[note] = [digest, 1, i]
            else:
                got[1] += 1
                got[2] = min(got[2], i)
        if len(held) > _HELD:
            yield _frame(held)
            held = {}
    if held:
        yield _frame(held)


def _frame(held: dict[bytes, list]) -> pd.DataFrame:
    digests, copies, ids = zip(*held.values(), strict=True)
    return pd.DataFrame({"note": list(held), "digest": digests, "copies": copies, "first_id": ids})


class Trie:
    """Counts byte strings; an edge spans up to ``_EDGE`` bytes. Under an edge there is the counter of the only string below it, with the string, or, once there are several, a node, a dict of edges."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, start: int, digest: bytes, copies: int, first_id: str) -> None:
        node, i = self.root, start
        while True:
            edge = key[i : i + _EDGE]
            below = node.get(edge)
            i += _EDGE
            if below is None:
                node[edge] = [key, digest, copies, first_id]
                return
            if type(below) is dict:
                node = below
            elif below[0] == key:
                below[2] += copies
                below[3] = min(below[3], first_id)
                return
            else:
                node[edge] = node = {below[0][i : i + _EDGE]: below}

    def ends(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            for below in stack.pop().values():
                if type(below) is dict:
                    stack.append(below)
                else:
                    yield below[1:]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts the buckets of a task, which come one after another; counters are passed on in batches of many buckets."""
    bucket, trie, ready = None, Trie(), []
    for pdf in batches:
        for b, key, digest, copies, first_id in zip(*(pdf[c].tolist() for c in ("bucket", "note", "digest", "copies", "first_id")), strict=True):
            if b != bucket:
                ready.extend(trie.ends())
                bucket, trie = b, Trie()
            trie.add(key, len(b), digest, copies, first_id)
        if len(ready) >= _BATCH:
            yield pd.DataFrame(ready, columns=["digest", "copies", "group_id"])
            ready = []
    ready.extend(trie.ends())
    yield pd.DataFrame(ready, columns=["digest", "copies", "group_id"])


def _bucketed(partial: DataFrame, most: int) -> DataFrame:
    """The rows of partial with bucket, the prefix of note that names it: of the fewest bytes at which the bucket has at most most rows or a single note."""
    skip = F.octet_length(F.substring_index(F.col("note").cast("string"), "\x00", 1)) + 1
    left, ready, n = partial.withColumn("skip", skip), None, FIRST_BYTES
    while True:
        rows = left.withColumn("bucket", F.expr(f"substring(note, 1, skip + {n})"))
        large = cut(rows.groupBy("bucket").count().where(F.col("count") > most).select("bucket", F.lit(True).alias("large")), "large")
        if large.isEmpty():
            return rows if ready is None else ready.unionByName(rows)
        rows = rows.join(large, "bucket", "left")
        further = F.coalesce("large", F.lit(False)) & (F.length("note") > F.length("bucket"))
        fits = rows.where(~further).drop("large")
        ready = fits if ready is None else ready.unionByName(fits)
        left, n = cut(rows.where(further).drop("bucket", "large"), "oversized"), 2 * n


def _distinct(notes: DataFrame) -> DataFrame:
    """One row per id and note of :func:`notes_of`."""
    return notes.dropDuplicates(["id", "digest"]).select("id", F.col("note").cast("binary").alias("note"), "digest")


def count_copies(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """digest, copies (distinct ids) and group_id (the smallest id) of every note of rows, which have each id and note once."""
    partial = cut(rows.mapInPandas(_add_up, _PARTIAL), "notes")
    named = _bucketed(partial, bucket_rows).select("bucket", "note", "digest", "copies", "first_id")
    return named.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_count, "digest binary, copies long, group_id string")


def unique_records(memories: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per note of memories (id, text, namespace): group_id (its smallest id) and copies (its distinct ids).

    Rows without an id (null, blank) or text (null) have no note and are left out; an empty text is a note. Repeated rows and versions of an id count once. An id with two different notes is in both. Null and blank namespaces are ``global``. Other columns are ignored; an empty table gives an empty result.
    """
    return count_copies(_distinct(notes_of(memories)), bucket_rows).select("group_id", "copies")


def duplicate_members(memories: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """memory_id, group_id and copies of every id whose note is that of another id too; see :func:`unique_records`.

    The canonical notes are written once; what is counted and the ids that the groups are joined to by digest are read from there. One digest with many ids is split by Spark's skew join.
    """
    rows = cut(_distinct(notes_of(memories)), "distinct")
    groups = count_copies(rows, bucket_rows).where("copies > 1")
    return rows.select("id", "digest").join(groups, "digest").select(F.col("id").alias("memory_id"), "group_id", "copies").distinct()
