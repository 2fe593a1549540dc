"""Problem 8: records of several sources mixed to target shares of all tokens.

The size of the mixture is the largest that no source's cap on repeats forbids. Documents have a pseudo-random key; within each source they are cut into ranges of the key, the ranges' token sums give each range its offset, and sums within a range give each document its place. A document is used once for every whole epoch that the source's budget holds, and once more if it lies within the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.keys import norm_key
from tessera.llm.tokens import n_tokens
from tessera.storage import cut

#: Documents that one range of the key holds, about.
DOCS_PER_RANGE = 20_000
_KEY_BITS = 60


def random_key(doc_id: Column | str, seed: int) -> Column:
    """A pseudo-random key of 60 bits, the same on every run and engine: the first digits of an MD5."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")).cast("binary")), 1, _KEY_BITS // 4), 16, 10).cast("long")


def _recipe(targets: DataFrame) -> DataFrame:
    """One row per source of targets: share, repeats; sources without a name or a positive share are none."""
    t = targets.select(norm_key("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("repeats"))
    return t.where("source is not null and share > 0 and repeats > 0").groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats"))


def _budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of targets: share, repeats, tokens and docs it has, and its budget of tokens. One row per source of the recipe, whatever the number of documents."""
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    both = _recipe(targets).join(have, "source", "left").na.fill(0, ["tokens", "docs"])
    whole = Window.partitionBy(F.lit(0))
    most = F.min(F.when(F.col("tokens") > 0, F.col("tokens") * F.col("repeats") / F.col("share"))).over(whole)
    budget = F.floor(F.round(most * F.col("share"), 6)).cast("long")
    return both.withColumn("budget", F.when(F.col("tokens") > 0, F.least(budget, F.col("tokens") * F.col("repeats"))).otherwise(F.lit(0).cast("long")))


def _sizes(documents: DataFrame, targets: DataFrame) -> DataFrame:
    named = documents.select("doc_id", norm_key("source").alias("source"), "text").join(F.broadcast(_recipe(targets).select("source")), "source", "left_semi")
    return named.select("doc_id", "source", n_tokens("text").cast("long").alias("n_tokens")).where("n_tokens > 0")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 0, docs_per_range: int = DOCS_PER_RANGE) -> tuple[DataFrame, DataFrame]:
    """The mixture and the shares reached.

    documents: doc_id (unique), source, text; targets: source, target_share, max_repeats (null: 1), at most some thousands of rows. Sources are compared without case and surrounding blanks; targets that are then equal are one, with their shares added and the larger cap. A source without tokens in documents gets nothing, and its share is spread over the others in proportion; documents of no source or one that isn't in targets, and documents without tokens, aren't used.

    The mixture: doc_id, source, n_tokens and uses (1 to max_repeats), of the documents used. The shares: source, target_share, max_repeats, docs, tokens (of the source), budget, docs_used, tokens_used, actual_share (of all tokens used; null for an empty mixture), a row per source of targets. A source stays below its budget by less than its next document.
    """
    sizes = cut(_sizes(documents, targets), "sizes")
    budgets = cut(_budgets(sizes, targets), "budgets")
    ranges = max(1, -(-sizes.count() // docs_per_range))
    keyed = sizes.withColumn("key", random_key("doc_id", seed)).withColumn("range", F.floor(F.col("key") / F.lit(float(2**_KEY_BITS)) * ranges).cast("int"))
    sums = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("source", "range", before.alias("before")).join(budgets.select("source", "tokens", "budget"), "source")
    place = F.sum("n_tokens").over(Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = keyed.withColumn("upto", place).join(offsets, ["source", "range"])
    epochs = F.expr("budget div tokens")
    uses = epochs + (F.col("before") + F.col("upto") <= F.col("budget") - epochs * F.col("tokens")).cast("long")
    mixture = placed.select("doc_id", "source", "n_tokens", uses.alias("uses")).where("uses > 0")
    used = mixture.groupBy("source").agg(F.count("*").alias("docs_used"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens_used"))
    shares = budgets.join(used, "source", "left").na.fill(0, ["docs_used", "tokens_used"])
    total = F.sum("tokens_used").over(Window.partitionBy(F.lit(0)))
    shares = shares.select("source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), "docs", "tokens", "budget", "docs_used", "tokens_used", F.when(total > 0, F.col("tokens_used") / total).alias("actual_share"))
    return mixture, shares
