"""Text as tokens, keys and short forms, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.keys import BLANK

#: Words too common to say what a text is about.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_set(c: Column | str) -> Column:
    """Distinct lower-case runs of letters and digits of two or more characters, in order of first appearance; empty for null."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 1))


def content_tokens(c: Column | str, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """token_set without stopwords."""
    return F.array_except(token_set(c), F.array(*[F.lit(w) for w in stopwords]))


def stem(token: Column) -> Column:
    """A token without a common English ending: ies becomes y; ing, es and s go, each only from words long enough."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return F.when(token.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y"))).when(token.endswith("ing") & (n > 5), cut(3)).when(token.endswith("es") & (n > 4), cut(2)).when(token.endswith("s") & (n > 3), cut(1)).otherwise(token)


def stems(c: Column | str) -> Column:
    """Distinct stems of content_tokens."""
    return F.array_distinct(F.transform(content_tokens(c), stem))


def coverage(asked: Column, there: Column) -> Column:
    """The part of the first set that is in the second; 0 for an empty first set."""
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, there)) / F.size(asked)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Common members by all members of two sets; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def squeeze(c: Column | str) -> Column:
    """Lower case, with each run of blanks as one and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), f"{BLANK}+", " "))


def preview(c: Column | str, limit: int = 240) -> Column:
    """The text on one line, cut to the limit with an ellipsis."""
    line = F.trim(F.regexp_replace(_c(c), f"{BLANK}+", " "))
    return F.when(F.length(line) > limit, F.concat(F.rtrim(F.substring(line, 1, limit - 3)), F.lit("..."))).otherwise(line)


def source_stem(c: Column | str) -> Column:
    """File name of a path without folders and ending, in lower case."""
    name = F.element_at(F.split(F.replace(F.lower(_c(c)), F.lit("\\"), F.lit("/")), "/"), -1)
    return F.regexp_replace(name, r"\.[a-z0-9]+$", "")


def source_version(c: Column | str) -> tuple[Column, Column]:
    """(group, version) of a name that ends in ``_v`` and a number; nulls for others."""
    name = source_stem(c)
    group, version = (F.nullif(F.regexp_extract(name, r"^(.*)_v(\d{1,9})$", i), F.lit("")) for i in (1, 2))
    return group, version.cast("int")


def name_family(c: Column | str, parts: int = 1) -> Column:
    """The first parts of a name whose parts are divided by colons or slashes."""
    return F.array_join(F.slice(F.split(_c(c), "[:/]"), 1, parts), ":")


def entities(c: Column | str, most: int = 24) -> Column:
    """Up to most distinct words of three or more letters with a capital first, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(r"\b[A-Z][A-Za-z0-9_-]{2,}"), 0)), 1, most)


def lexical_similarity(a: Column | str, b: Column | str) -> Column:
    """The larger of the jaccard of the words and, where one text contains the other, the shorter's length by the longer's; 0 for empty ones."""
    x, y = squeeze(a), squeeze(b)
    inside = (F.length(x) > 0) & (F.length(y) > 0) & (x.contains(y) | y.contains(x))
    ratio = F.when(inside, F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))).otherwise(F.lit(0.0))
    return F.greatest(jaccard(token_set(a), token_set(b)), ratio)


def marker_hits(c: Column | str, markers: tuple[str, ...]) -> Column:
    """Those of the markers that the text contains in any case; empty for null."""
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    return F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: low.contains(m))


def hit_score(c: Column | str, expected: Column) -> Column:
    """The part of the expected strings, in lower case, that the text contains; 0 for none expected."""
    low = F.lower(F.coalesce(_c(c), F.lit("")))
    return F.when(F.size(expected) > 0, F.size(F.filter(expected, lambda w: low.contains(w))) / F.size(expected)).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Common members of two sets by those of the smaller; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def phrases(c: Column | str, most: int = 3, least: int = 1, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct runs of least to most neighbouring words, stopwords and words of one letter dropped before, the longer runs first; empty for null."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords))
    runs = lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(kept), F.lit(1))), lambda i: i <= F.size(kept) - n + 1), lambda i: F.array_join(F.slice(kept, i, n), " "))
    return F.array_distinct(F.concat(*[runs(n) for n in range(most, least - 1, -1)]))


def pieces(c: Column | str) -> Column:
    """A text's sentences: parts that end in a full stop, an exclamation or a question mark before a blank, or at a line break, without blanks at their ends; none is empty."""
    lines = F.regexp_replace(F.coalesce(_c(c), F.lit("")), f"([.!?]){BLANK}+", "$1\n")
    return F.filter(F.transform(F.split(lines, r"[\r\n]+"), lambda p: F.regexp_replace(p, f"^{BLANK}+|{BLANK}+$", "")), lambda p: F.length(p) > 0)
