"""The form in which two notes are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import norm_key, norm_namespace

_CUTS = r"[;|\r\n\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
_SIGN = r"[\p{L}\p{N}]"
#: A name with a letter or digit, the first ':' or '=', a value with a letter or digit.
_FIELD = rf"(?s)^[^:=]*{_SIGN}[^:=]*[:=].*{_SIGN}"


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def canonical_text(c: Column | str) -> Column:
    """The text in lower case with each run of characters other than letters and digits as one blank, none at the ends.

    A text of two or more pieces, cut at ``;``, ``|`` and line breaks, that all have a name and a value is its pieces in order of their letters, one to a line; the line breaks keep it apart from plain texts. Null stays null, a text without letters and digits is empty.
    """
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    pieces = F.filter(F.split(low, _CUTS), lambda p: p.rlike(_SIGN))
    record = (F.size(pieces) >= 2) & F.forall(pieces, lambda p: p.rlike(_FIELD))
    return F.when(record, F.array_join(F.array_sort(F.transform(pieces, _plain)), "\n")).otherwise(_plain(low))


def notes_of(memories: DataFrame, id: str = "id", text: str = "text", namespace: str = "namespace") -> DataFrame:
    """id, note and digest of every row with an id and a text: note is namespace, a zero byte, and canonical text; digest its MD5. Repeated rows are kept."""
    note = F.concat(F.regexp_replace(norm_namespace(namespace), r"\s+", " "), F.lit("\x00"), canonical_text(text))
    rows = memories.select(norm_key(id).alias("id"), note.alias("note")).where("id is not null and note is not null")
    return rows.withColumn("digest", F.unhex(F.md5(F.col("note").cast("binary"))))
