"""Counts and summaries over memories, links, feedback and use. Groups are added up before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import name_family, source_version, squeeze
from tessera.operators.moments import element_sums


def source_counts(sources: DataFrame) -> DataFrame:
    return sources.where("source is not null").groupBy("source").agg(F.count("*").alias("memories"), F.min("chunk_index").alias("first_chunk"), F.max("chunk_index").alias("last_chunk"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 4).alias("mean_rating"))


def feedback_by_memory(feedback: DataFrame) -> DataFrame:
    """Per memory the number, mean, good and bad ratings of its feedback."""
    rated = feedback.where("memory_id is not null").groupBy("memory_id")
    return rated.agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.count_if(F.col("rating") > 0).alias("good"), F.count_if(F.col("rating") < 0).alias("bad"))


def use_by_memory(uses: DataFrame) -> DataFrame:
    return uses.groupBy("memory_id").agg(F.count("*").alias("uses"), F.max("at").alias("last_used"), F.round(F.avg("score"), 6).alias("mean_score"), F.min("rank").alias("best_rank"))


def link_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"))


def link_summary(edges: DataFrame) -> DataFrame:
    """Per memory and type the number and weight of its links out and in; each link is turned into two rows, so no memory is joined."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("out")), F.struct(F.col("target").alias("id"), F.lit(0).alias("out"))))
    rows = edges.select("type", "weight", ends.alias("e")).select("type", "weight", "e.*")
    total = lambda out: F.round(F.coalesce(F.sum(F.when(F.col("out") == out, F.col("weight"))), F.lit(0.0)), 6)
    return rows.groupBy("id", "type").agg(F.sum("out").alias("links_out"), F.sum(1 - F.col("out")).alias("links_in"), total(1).alias("weight_out"), total(0).alias("weight_in"))


def exact_claims(memories: DataFrame) -> DataFrame:
    """Memories with the same text but for case and blanks: how many, the keeper (highest confidence × importance, then latest created_at, then largest id), the namespaces and domains they are in, and the span of created_at. NaN counts as 0."""
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    rows = memories.where("text is not null").select("id", "namespace", "domain_id", "created_at", squeeze("text").alias("claim"), F.round(zero("confidence") * zero("importance"), 6).alias("quality"))
    key = F.unhex(F.md5(F.col("claim").cast("binary"))).alias("digest")
    # grouped by digest, so no text is shuffled; the keeper's is joined
    parts = rows.groupBy(key, "namespace", "domain_id").agg(F.count("*").alias("copies"), F.max(F.struct("quality", "created_at", "id")).alias("best"), F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created"))
    claims = parts.groupBy("digest").agg(F.sum("copies").alias("copies"), F.max("best")["id"].alias("keeper_id"), F.count_distinct("namespace").alias("namespaces"), F.count_distinct("domain_id").alias("domains"), F.min("first_created").alias("first_created"), F.max("last_created").alias("last_created"))
    return claims.join(rows.select(F.col("id").alias("keeper_id"), "claim"), "keeper_id").select("claim", "copies", "keeper_id", "namespaces", "domains", "first_created", "last_created")


def duplicate_spread(claims: DataFrame) -> DataFrame:
    """One row: claims, duplicated ones, extra copies, and how many duplicated claims are in several namespaces or domains."""
    many = F.col("copies") > 1
    return claims.agg(F.count("*").alias("claims"), F.count_if(many).alias("duplicated"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("extra"), F.count_if(many & (F.col("namespaces") > 1)).alias("across_namespaces"), F.count_if(many & (F.col("domains") > 1)).alias("across_domains"))


def latest_versions(sources: DataFrame) -> DataFrame:
    """The highest version of each group of source names that end in ``_v`` and a number, and the memories from it and from older ones."""
    group, version = source_version("source")
    rows = sources.select("id", group.alias("name"), version.alias("version")).where("name is not null").groupBy("name", "version").agg(F.count("*").alias("n"))
    top = rows.groupBy("name").agg(F.max(F.struct("version", "n")).alias("top"), F.sum("n").alias("all"))
    return top.select("name", F.col("top.version").alias("version"), F.col("top.n").alias("current_memories"), (F.col("all") - F.col("top.n")).alias("older_memories"))


def effective_dimensions(members: DataFrame) -> DataFrame:
    """Per domain_id of members (domain_id, embedding): vectors, and the participation ratio of the variances of their elements, (Σv)² / Σv², at least 1."""
    n = F.col("n")
    v = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("xx") - F.col("x") * F.col("x") / n) / (n - 1)))
    per = element_sums(members, ["domain_id"], "embedding").select("domain_id", "n", v.alias("v"))
    total, squares = F.sum("v"), F.sum(F.col("v") * F.col("v"))
    return per.groupBy("domain_id").agg(F.max("n").alias("vectors"), F.round(F.greatest(F.lit(1.0), F.coalesce(F.when(squares > 0, total * total / squares), F.lit(1.0))), 4).alias("effective_dimension"))


def by_namespace_and_type(memories: DataFrame) -> DataFrame:
    """Counts and means for every namespace family and memory type, each alone, and all: grouping sets."""
    rows = memories.select(name_family("namespace").alias("family"), "memory_type", "stability", "confidence")
    good = F.when(~F.isnan("confidence") & F.col("confidence").between(0, 1), F.col("confidence"))
    cubed = rows.cube("family", "memory_type").agg(F.count("*").alias("n"), F.round(F.avg("stability"), 6).alias("mean_stability"), F.round(F.avg(good), 6).alias("mean_confidence"), F.grouping_id().cast("int").alias("level"))
    return cubed
