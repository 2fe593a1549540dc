"""What the links between memories say about which is current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import SUPERSEDING, top_per_key
from tessera.storage import cut


def _stretches(links: DataFrame) -> DataFrame:
    """id, up and dist of every memory with a single source: the nearest memory above it that hasn't a single one, and the links to it.

    A chain of n links takes log2(n) joins. In and below loops of such memories alone there is no such memory; there up has a single source itself.
    """
    one = cut(links.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"), F.min("source").alias("up")).where("n = 1").select("id", "up", F.lit(1).cast("long").alias("dist")), "stretches")
    for _ in range(max(one.count(), 1).bit_length() + 1):
        further = one.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"))
        rows = cut(one.join(further, "up", "left").select("id", F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.col("up2").isNotNull().alias("moved")), "stretches")
        moved, one = rows.where("moved"), rows.drop("moved")
        if moved.isEmpty():
            break
    return one


def _currents(links: DataFrame, one: DataFrame) -> DataFrame:
    """id, first, last, near and far of the memories with no source or several: see :func:`authority`. Each round only those pass something on that have changed."""
    ends = links.select(F.col("source").alias("id"), F.lit(0).alias("n")).union(links.select("target", F.lit(1))).groupBy("id").agg(F.sum("n").alias("n")).where("n <> 1")
    into = links.join(ends.where("n > 1").select(F.col("id").alias("target")), "target", "left_semi").join(one.withColumnRenamed("id", "source"), "source", "left")
    w = F.coalesce("dist", F.lit(0)) + 1
    steps = cut(into.groupBy(F.coalesce("up", "source").alias("source"), "target").agg(F.min(w).alias("least"), F.max(w).alias("most")), "steps")
    todo = steps.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("todo"))
    top = F.col("n") == 0
    own, zero = F.when(top, F.col("id")), F.when(top, F.lit(0).cast("long"))
    state = cut(ends.join(todo, "id", "left").select("id", own.alias("first"), own.alias("last"), zero.alias("near"), zero.alias("far"), F.coalesce("todo", F.lit(0)).cast("long").alias("todo"), top.alias("moved"), top.alias("done")), "currents")
    while not state.where("moved or done").isEmpty():
        sent = steps.join(state.where("moved or done").withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id"))
        sent = sent.agg(F.min("first").alias("f"), F.max("last").alias("l"), F.min(F.col("near") + F.col("least")).alias("a"), F.max(F.when(F.col("done"), F.col("far") + F.col("most"))).alias("b"), F.count_if("done").alias("c"))
        moved = ~F.least("first", "f").eqNullSafe(F.col("first")) | ~F.greatest("last", "l").eqNullSafe(F.col("last")) | ~F.least("near", "a").eqNullSafe(F.col("near"))
        left = F.col("todo") - F.coalesce("c", F.lit(0))
        state = cut(state.join(sent, "id", "left").select("id", F.least("first", "f").alias("first"), F.greatest("last", "l").alias("last"), F.least("near", "a").alias("near"), F.greatest("far", "b").alias("far"), left.alias("todo"), moved.alias("moved"), ((F.col("todo") > 0) & (left == 0)).alias("done")), "currents")
    return state.select("id", "first", "last", "near", F.when(F.col("todo") == 0, F.col("far")).alias("far"))


def authority(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """What stands in the place of every active memory with a superseding link from or to another active one.

    id; state: ``current`` if no memory supersedes or corrects it, ``superseded`` if such links lead to it from a current memory, however many, ``loop`` if they come from loops only; links_out and links_in; first_current_id and last_current_id: the smallest and largest current memories from which links lead to it (equal if one alone replaces it; its own id if current, null in ``loop``); near: links of the shortest way from a current memory; chain: links of the longest way to it, null where a loop leads to it, as there is no longest. Memories without such links are not listed; links of types other than those in SUPERSEDING, of unknown and of deprecated memories don't count. No links give no rows.

    Stretches of memories with a single source are followed in doubled steps; between the others each round joins the links of those that have changed, up to the fixed point. All current memories of each are not listed: in a large group these are as many as pairs.
    """
    live = memories.where("live = 0").select(F.col("id").alias("source"))
    links = edges.where(F.col("type").isin(*SUPERSEDING) & (F.col("source") != F.col("target"))).select("source", "target").distinct()
    links = cut(links.join(live, "source", "left_semi").join(live.withColumnRenamed("source", "target"), "target", "left_semi").select("source", "target"), "links")
    out, into = links.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("links_out")), links.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("links_in"))
    one = _stretches(links)
    tops = _currents(links, one)
    below = one.join(tops.withColumnRenamed("id", "up"), "up", "left").select("id", "first", "last", (F.col("near") + F.col("dist")).alias("near"), (F.col("far") + F.col("dist")).alias("far"))
    rows = out.join(into, "id", "full").join(tops.unionByName(below), "id").na.fill(0, ["links_out", "links_in"])
    state = F.when(F.col("links_in") == 0, "current").when(F.col("first").isNull(), "loop").otherwise("superseded")
    return rows.select("id", state.alias("state"), "links_out", "links_in", F.col("first").alias("first_current_id"), F.col("last").alias("last_current_id"), "near", F.col("far").alias("chain"))


def current_of_asks(uses: DataFrame, edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Per ask with active results: results (distinct, active), superseded (those that current memories replace), and current_id: the one memory that stands in the place of all of them, null if there are several or only loops.

    A result without superseding links, or a current one, stands for itself. Missing and deprecated results are left out. Whether there is one follows from the smallest and the largest, so no lists are formed.
    """
    rows = uses.select("operation_id", F.col("memory_id").alias("id")).distinct().join(memories.where("live = 0").select("id"), "id", "left_semi")
    known = authority(edges, memories).select("id", "state", "first_current_id", "last_current_id")
    own = lambda c: F.when(F.col("state").isNull(), F.col("id")).otherwise(F.col(c))
    per = rows.join(known, "id", "left").groupBy("operation_id").agg(F.count("*").alias("results"), F.count_if(F.coalesce(F.col("state") == "superseded", F.lit(False))).alias("superseded"), F.min(own("first_current_id")).alias("a"), F.max(own("last_current_id")).alias("b"))
    return per.select("operation_id", "results", "superseded", F.when(F.col("a") == F.col("b"), F.col("a")).alias("current_id"))


def stale_companions(uses: DataFrame, edges: DataFrame, memories: DataFrame, n: int = 3) -> DataFrame:
    """The active memories that each ask's results supersede, correct or update and that aren't results of it themselves; the n heaviest links' of each ask."""
    linked = edges.where(F.col("type").isin(*SUPERSEDING, "updates")).groupBy("source", "target").agg(F.max("weight").alias("weight"))
    results = uses.select("operation_id", F.col("memory_id").alias("source")).distinct()
    there = results.withColumnRenamed("source", "target")
    rows = results.join(linked, "source").groupBy("operation_id", "target").agg(F.max("weight").alias("weight")).join(there, ["operation_id", "target"], "left_anti")
    rows = rows.join(memories.where("live = 0").select(F.col("id").alias("target")), "target", "left_semi")
    return top_per_key(rows, "operation_id", [F.col("weight").desc_nulls_last(), F.col("target")], n)


def link_shape(edges: DataFrame) -> DataFrame:
    """Per type the number of links, of links both ways, and of ends that are sources and targets."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "type").withColumn("back", F.lit(1))
    both = edges.join(back, ["source", "target", "type"], "left").groupBy("type").agg(F.count("*").alias("links"), F.count("back").alias("both_ways"))
    ends = edges.select("type", F.col("source").alias("id"), F.lit(1).alias("s"), F.lit(0).alias("t")).union(edges.select("type", "target", F.lit(0), F.lit(1)))
    middle = ends.groupBy("type", "id").agg(F.max("s").alias("s"), F.max("t").alias("t")).groupBy("type").agg(F.count("*").alias("memories"), F.sum(F.col("s") * F.col("t")).alias("middle"))
    return both.join(middle, "type")
