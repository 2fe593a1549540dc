"""Text files as rows, cleaned and cut into chunks of words or of sentences."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import BLANK, strip

#: Fields that hold the text of a record, in order of preference, and those that name it where none does.
TEXT_FIELDS = ("text", "content", "message", "body", "summary")
NAME_FIELDS = ("role", "title", "name")
#: A sentence is a run of other characters than these ends and line feeds, with the ends and closing marks after it; a line without letters between them is none.
_SENTENCE = "[^.!?\n]+(?:[.!?]+[\"')\\]]*)?"


def line_ends(c: Column) -> Column:
    """Line ends as line feeds."""
    return F.regexp_replace(c, r"\r\n?", "\n")


def clean(c: Column) -> Column:
    """Without a byte order mark, with line ends as line feeds, UTF-8 that was read as Latin-1 read right where all of it can be, typographic quotes, dashes, arrows and blanks as plain ones."""
    c = line_ends(F.regexp_replace(c, "\ufeff", ""))
    bytes_ = F.encode(c, "ISO-8859-1")
    # only a text of Latin-1 characters, whose bytes are valid UTF-8, was read wrongly
    wrong = c.rlike(r"[\x80-\xff]") & ~c.rlike(r"[^\x00-\xff]") & F.coalesce(F.is_valid_utf8(bytes_.cast("string")), F.lit(False))
    c = F.when(wrong, bytes_.cast("string")).otherwise(c)
    c = F.regexp_replace(F.regexp_replace(c, "\u2192", "->"), "\u00c2", "")
    return F.translate(c, "\u2018\u2019\u201c\u201d\u2013\u2014\u00a0\u2003", "''\"\"--  ")


def texts_of(value: object) -> list[str]:
    """The texts of a parsed JSON value: a string, or of a record the first of TEXT_FIELDS that isn't blank, else its NAME_FIELDS, else what its values hold; of a list what its items hold."""
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, dict):
            said = lambda fields: [v[f].strip() for f in fields if isinstance(v.get(f), str) and v[f].strip()]  # noqa: B023, E731
            text = next(iter(said(TEXT_FIELDS)), ": ".join(said(NAME_FIELDS)))
            if text:
                out.append(text)
            else:
                stack.extend(reversed(v.values()))
        elif isinstance(v, list):
            stack.extend(reversed(v))
    return out


def _parsed(batches: Iterator[pd.DataFrame], lines: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = []
        for path, value in zip(pdf["path"], pdf["value"], strict=True):
            try:
                texts = texts_of(json.loads(value))
            except ValueError:
                texts = [value] if lines else []
            found += [(path, t) for t in (texts[:1] if lines else texts)]
        yield pd.DataFrame(found, columns=["path", "text"])


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of every file under path, whatever its ending: .json files are read as values (see :func:`texts_of`; what can't be parsed has no text), .jsonl files as one record a line (a line that can't be parsed is its own text), all others whole. Blank texts are left out."""
    name = F.lower(F.col("_metadata.file_name"))

    def read(where: Column, whole: bool) -> DataFrame:
        return spark.read.text(path, wholetext=whole, recursiveFileLookup=True).where(where).select(F.col("_metadata.file_path").alias("path"), "value")

    plain = read(~name.endswith(".json") & ~name.endswith(".jsonl"), True).withColumnRenamed("value", "text")
    values = read(name.endswith(".json"), True).mapInPandas(partial(_parsed, lines=False), "path string, text string")
    lines = read(name.endswith(".jsonl"), False).where(F.length(F.trim("value")) > 0).mapInPandas(partial(_parsed, lines=True), "path string, text string")
    return plain.unionByName(values).unionByName(lines).select("path", clean(F.col("text")).alias("text")).where(F.length(F.trim("text")) > 0)


def words_of(c: Column) -> Column:
    """The parts between blanks."""
    return F.filter(F.split(c, f"{BLANK}+"), lambda w: w != "")


def sentences(c: Column) -> Column:
    """The sentences of a text whose line ends are line feeds: of each paragraph (divided by blank lines) its sentences without blanks at their ends, or all of it where it has none."""
    found = lambda p: F.filter(F.transform(F.regexp_extract_all(p, F.lit(_SENTENCE), F.lit(0)), strip), lambda u: u != "")
    paragraphs = F.filter(F.transform(F.split(c, rf"\n{BLANK}*\n+"), strip), lambda p: p != "")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.size(found(p)) > 0, found(p)).otherwise(F.array(p))))


def packed(units: list[list[str]], words: int, overlap: int) -> list[list[str]]:
    """Units of words, put into chunks of up to words words in order; a chunk begins with the last overlap words of the one before, unless its first unit then doesn't fit. A unit of more words is cut into windows."""
    fitting = [u[a : a + words] for u in units for a in range(0, len(u), words)]
    chunks, now = [], []
    for u in fitting:
        if now and len(now) + len(u) > words:
            chunks.append(now)
            now = now[-overlap:] if overlap else []
            if len(now) + len(u) > words:
                now = []
        now = now + u
    return [*chunks, now] if now else chunks


def _packed(batches: Iterator[pd.DataFrame], key: str, words: int, overlap: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(k, i, len(c), " ".join(c)) for k, units in zip(pdf[key], pdf["units"], strict=True) for i, c in enumerate(packed([u.split() for u in units], words, overlap))]
        yield pd.DataFrame(out, columns=[key, "chunk_no", "n_words", "chunk"])


def sentence_chunks(texts: DataFrame, key: str, text: str = "text", words: int = 120, overlap: int = 20) -> DataFrame:
    """key, chunk_no, n_words and chunk of every text: whole sentences (see :func:`sentences`) of up to words words, each chunk but the first beginning with the last overlap words of the one before where there is room. A sentence of more words is cut into windows. Blanks between words become one; a text without words, or a null one, has no chunk."""
    overlap = max(0, min(overlap, words - 1))
    rows = texts.select(key, sentences(clean(F.col(text))).alias("units")).where(F.size("units") > 0)
    return rows.mapInPandas(partial(_packed, key=key, words=words, overlap=overlap), f"{key} {dict(texts.dtypes)[key]}, chunk_no int, n_words int, chunk string")


def chunks(texts: DataFrame, key: str, text: str = "text", words: int = 120, overlap: int = 20) -> DataFrame:
    """key, chunk_no, n_words and chunk of every text: windows of words words, each but the first beginning with the last overlap words of the one before, ending with the window that reaches the end. A text without words has no chunk."""
    step = max(1, words - overlap)
    all_ = words_of(F.col(text))
    rows = texts.select(F.col(key), all_.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - words) / F.lit(float(step)))).cast("int")
    cut = rows.select(key, "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    part = F.slice("w", F.col("chunk_no") * step + 1, F.lit(words))
    return cut.select(key, "chunk_no", F.size(part).alias("n_words"), F.array_join(part, " ").alias("chunk"))
