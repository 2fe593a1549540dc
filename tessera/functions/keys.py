"""Keys, names and instants in their comparable form.

Two ids are equal if they are equal without letter case and surrounding white space, where white space is every Unicode blank, not only what SQL's ``trim`` removes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One blank, as Java's regular expressions write it: ASCII blanks, separators of lines and records, and Unicode's space separators.
BLANK = r"[\s\x1c-\x1f\u0085\p{Z}]"
_ENDS = f"^{BLANK}+|{BLANK}+$"


def strip(c: Column | str) -> Column:
    """The string without blanks at its ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, _ENDS, "")


def norm_key(c: Column | str) -> Column:
    """Lower case without surrounding blanks; null where nothing is left, so that blank and null keys are alike."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def norm_namespace(c: Column | str) -> Column:
    """Lower case without surrounding blanks; null and blank are ``global``."""
    return F.coalesce(norm_key(c), F.lit("global"))


def epoch_micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone; one without zone is read as UTC, whatever the session's zone."""
    c = F.col(c) if isinstance(c, str) else c
    start = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", start, c.cast("timestamp_ntz"))


#: An ISO 8601 date and time with an explicit offset: date, time, offset.
_ISO = r"^(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?) ?(?:[Zz]|([+-]\d{2}):?(\d{2})?)$"


def iso_micros(c: Column | str) -> Column:
    """Microseconds since 1970 of an ISO 8601 string with an offset (``Z``, ``+02``, ``+0200`` or ``+02:00``); null if it is none.

    The offset is taken off by arithmetic, so the result is the instant whatever the session's zone.
    """
    c = strip(c)
    part = lambda i: F.regexp_extract(c, _ISO, i)
    local = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit("Z")))
    hours = F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0))
    minutes = F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(0))
    sign = F.when(part(3).startswith("-"), -1).otherwise(1)
    return F.when(c.rlike(_ISO), F.unix_micros(local) - (hours * 60 + sign * minutes).cast("long") * 60_000_000)


def month_of(micros: Column | str) -> Column:
    """The month of an instant in microseconds, as months since year 0; null stays null."""
    c = F.col(micros) if isinstance(micros, str) else micros
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(c / F.lit(86_400_000_000)).cast("int"))
    return F.year(day) * 12 + F.month(day) - 1


def month_name(month: Column | str) -> Column:
    """``YYYY-MM`` of :func:`month_of`; null is ``unknown``."""
    c = F.col(month) if isinstance(month, str) else month
    return F.when(c.isNull(), "unknown").otherwise(F.format_string("%04d-%02d", F.floor(c / 12).cast("int"), (c % 12 + 1).cast("int")))
