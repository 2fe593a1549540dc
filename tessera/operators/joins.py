"""Joins and rankings over memories, links, sources, domains and the outcome log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import content_tokens, coverage, source_stem, stems
from tessera.operators.aggregates import feedback_by_memory, link_summary, use_by_memory

#: Link types by which a newer memory takes the place of an older one.
SUPERSEDING = ("supersedes", "corrects")


def top_per_key(rows: DataFrame, key: str, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark keeps n of a key in each task before it shuffles them."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= n)


def superseded_targets(edges: DataFrame, memories: DataFrame, sources: DataFrame, types: tuple[str, ...] = (*SUPERSEDING, "updates"), n: int = 5) -> DataFrame:
    """The n heaviest active targets of each memory's links of these types, with their sources."""
    linked = edges.where(F.col("type").isin(*types)).groupBy("source", "target").agg(F.max("weight").alias("weight"))
    rows = linked.join(memories.select(F.col("id").alias("target"), "live", "domain_id"), "target").where("live = 0")
    top = top_per_key(rows, "source", [F.col("weight").desc_nulls_last(), F.col("target")], n)
    return top.join(sources.select(F.col("id").alias("target"), F.col("source").alias("target_source")), "target", "left").select(F.col("source").alias("memory_id"), "target", "rank", "weight", "domain_id", "target_source")


def reliability(feedback: DataFrame, memories: DataFrame, key: str) -> DataFrame:
    """Number and mean rating of the feedback on memories with each value of key; feedback is added up per memory before it is joined."""
    rated = feedback.where("memory_id is not null and rating is not null").groupBy("memory_id").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))
    rows = rated.join(memories.select(F.col("id").alias("memory_id"), key), "memory_id").where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean_rating"))


def use_report(uses: DataFrame, memories: DataFrame, domains: DataFrame, sources: DataFrame) -> DataFrame:
    """Use of each memory with its namespace, the name of its domain, and its source."""
    rows = use_by_memory(uses).join(memories.select(F.col("id").alias("memory_id"), "namespace", "domain_id"), "memory_id")
    rows = rows.join(domains.select("domain_id", F.col("name").alias("domain_name")), "domain_id", "left")
    return rows.join(sources.select(F.col("id").alias("memory_id"), "source"), "memory_id", "left").select("memory_id", "namespace", "domain_name", "source", "uses", "last_used", "mean_score", "best_rank")


def domain_counters(memories: DataFrame, edges: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per domain its memories, active ones, namespaces, linked ones and links, and its feedback. Both ends of a link are rows of one equi-join instead of an OR condition."""
    own = memories.where("domain_id is not null")
    base = own.groupBy("domain_id").agg(F.count("*").alias("memories"), F.count_if(F.col("live") == 0).alias("active"), F.count_distinct("namespace").alias("namespaces"))
    ends = link_summary(edges).groupBy("id").agg(F.sum(F.col("links_out") + F.col("links_in")).alias("links"))
    linked = own.join(ends, "id").groupBy("domain_id").agg(F.count("*").alias("linked"), F.sum("links").alias("link_ends"))
    rated = own.join(feedback_by_memory(feedback).withColumnRenamed("memory_id", "id"), "id").groupBy("domain_id").agg(F.sum("n").alias("feedback"), F.sum("bad").alias("bad_feedback"))
    return base.join(linked, "domain_id", "left").join(rated, "domain_id", "left").na.fill(0, ["linked", "link_ends", "feedback", "bad_feedback"])


def protected(edges: DataFrame, feedback: DataFrame) -> DataFrame:
    """Ids that consolidation leaves alone: superseded or summarised ones, and those whose mean rating is negative."""
    targets = edges.where(F.col("type").isin(*SUPERSEDING, "summarizes")).select(F.col("target").alias("id"))
    bad = feedback_by_memory(feedback).where("mean_rating < 0").select(F.col("memory_id").alias("id"))
    return targets.union(bad).distinct()


def consolidation_plan(memories: DataFrame, protected_ids: DataFrame, least: int = 4, most: int = 8) -> DataFrame:
    """The most stable and important active memories of each domain with at least least of them, without protected ones."""
    rows = memories.where("live = 0 and domain_id is not null").join(protected_ids, "id", "left_anti")
    size = rows.groupBy("domain_id").agg(F.count("*").alias("candidates")).where(F.col("candidates") >= least)
    order = [F.col(c).desc_nulls_last() for c in ("stability", "importance", "id")]
    return top_per_key(rows.select("id", "domain_id", "stability", F.nanvl("importance", F.lit(0.0)).alias("importance")), "domain_id", order, most).join(size, "domain_id").select("domain_id", "rank", "id", "candidates")


def session_turns(asks: DataFrame, n: int, newest: bool) -> DataFrame:
    """The n oldest or newest asks of each session, numbered from the oldest of them."""
    rows = asks.where("session_id is not null and at is not null").select("session_id", "operation_id", "at", "query")
    if not newest:
        return top_per_key(rows, "session_id", [F.col("at"), F.col("operation_id")], n, "turn")
    late = top_per_key(rows, "session_id", [F.col("at").desc(), F.col("operation_id").desc()], n)
    return late.withColumn("turn", F.row_number().over(Window.partitionBy("session_id").orderBy("at", "operation_id"))).drop("rank")


def last_evidence(asks: DataFrame) -> DataFrame:
    """The results of each session's latest ask that has any, as ids in order of rank."""
    rows = asks.where("session_id is not null and at is not null and size(results) > 0")
    last = rows.groupBy("session_id").agg(F.max(F.struct("at", "operation_id", "results")).alias("l"))
    ids = F.transform(F.array_sort(F.transform("l.results", lambda r: F.struct(r["rank"].alias("rank"), r["memory_id"].alias("id")))), lambda r: r["id"])
    return last.select("session_id", "l.operation_id", F.array_join(ids, ",").alias("evidence"))


#: Weights of the parts of a reranked score.
WEIGHTS = {"score": 0.38, "importance": 0.08, "stability": 0.08, "text": 0.12, "source": 0.18, "feedback": 0.10, "superseding": 0.16, "reliability": 0.03}


def rerank(uses: DataFrame, memories: DataFrame, sources: DataFrame, feedback: DataFrame, edges: DataFrame, weights: dict[str, float] = WEIGHTS, n: int = 5) -> DataFrame:
    """The results of each ask ranked anew, the first n: the logged score with the memory's importance and stability, how much of the query its text and its source's name cover, its feedback, what supersedes it or it supersedes, and how reliable its source is.

    Everything that depends on a memory alone is joined once per memory, not per result. Results whose memory is unknown or deprecated are left out.
    """
    f = feedback_by_memory(feedback)
    mean, n_ = F.coalesce("mean_rating", F.lit(0.0)), F.coalesce("n", F.lit(0))
    rating = F.when(mean >= 0, F.least(F.lit(1.0), mean / 2)).otherwise(F.greatest(F.lit(-1.0), mean)) * F.least(F.lit(1.0), n_ / 3)
    s = link_summary(edges.where(F.col("type").isin(*SUPERSEDING))).groupBy("id").agg(F.sum("weight_out").alias("out"), F.sum("weight_in").alias("in"))
    superseding = F.least(F.lit(0.8), F.coalesce("out", F.lit(0.0)) / 4) - F.least(F.lit(0.9), F.coalesce("in", F.lit(0.0)) / 4)
    trust = reliability(feedback, sources, "source").select("source", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("mean_rating") / 2)).alias("trust"))
    inside = lambda c: F.when(~F.isnan(c) & F.col(c).between(0, 1), F.col(c)).otherwise(F.lit(0.0))
    known = memories.where("live = 0").join(sources.select("id", "source"), "id", "left").join(trust, "source", "left").join(f.withColumnRenamed("memory_id", "id"), "id", "left").join(s, "id", "left")
    known = known.select(F.col("id").alias("memory_id"), stems("text").alias("terms"), content_tokens(F.regexp_replace(source_stem("source"), "_", " ")).alias("names"), inside("importance").alias("importance"), inside("stability").alias("stability"), rating.alias("feedback"), superseding.alias("superseding"), F.coalesce("trust", F.lit(0.0)).alias("reliability"))
    rows = uses.where("score is not null and not isnan(score)").join(known, "memory_id")
    words = content_tokens("query")
    named = F.when(F.size("names") > 0, F.least(F.lit(1.0), F.size(F.array_intersect("names", words)) / F.least(F.lit(2), F.size("names")))).otherwise(F.lit(0.0))
    rows = rows.withColumns({"text": coverage(stems("query"), F.col("terms")), "source": named})
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    rows = rows.groupBy("operation_id", "memory_id").agg(F.max(F.round(total, 6)).alias("new_score"), F.min("rank").alias("old_rank"))
    return top_per_key(rows, "operation_id", [F.desc("new_score"), F.col("memory_id")], n, "new_rank")


def scope_report(uses: DataFrame, memories: DataFrame, sources: DataFrame) -> DataFrame:
    """How well each ask's results lie in its namespace: results, those in scope (its own namespace or global), distinct sources."""
    rows = uses.join(memories.select(F.col("id").alias("memory_id"), F.col("namespace").alias("of")), "memory_id").join(sources.select(F.col("id").alias("memory_id"), "source"), "memory_id", "left")
    scope = (F.col("of") == F.col("namespace")) | (F.col("of") == "global")
    return rows.groupBy("operation_id").agg(F.count("*").alias("results"), F.count_if(scope).alias("in_scope"), F.count_distinct("source").alias("sources"))
