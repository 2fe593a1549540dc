"""Queries over scopes, sessions, results and their feedback, measures of texts and vectors, and chunks of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.functions.keys import month_name, month_of
from tessera.operators import aggregates as A
from tessera.operators import outcomes as O
from tessera.operators.search import nearest_anchor
from tessera.plans import memory as P
from tessera.plans.memory import _CONTENT, _CTE, _TOKENS, _USABLE_SQL, _asks, _fb, _usable, _with
from tessera.plans.more import _ANCHORS, _NEAREST, _anchors
from tessera.sources import memory as M
from tessera.sources import texts as X
from tessera.sources.tables import table

QUERIES: dict[str, P.Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):  # noqa: ANN201
    def add(f: P.Query) -> P.Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (_with(*ctes) if ctes else "") + sql
        return f

    return add


@query("fp_06_links_in_scope", "SELECT source, target, type, weight FROM edges WHERE source IN (SELECT id FROM mem WHERE namespace = 'global') OR target IN (SELECT id FROM mem WHERE namespace = 'global')", "edges", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """Links with an end in a namespace."""
    scope = M.memories(s, d).where("namespace = 'global'").select("id")
    a, b = (scope.select(F.col("id").alias(c), F.lit(True).alias(f"in_{c}")) for c in ("source", "target"))
    return M.edges(s, d).join(a, "source", "left").join(b, "target", "left").where("in_source or in_target").select("source", "target", "type", "weight")


@query("fp_07_known_texts", r"""SELECT mem.id, namespace FROM mem JOIN (SELECT trim(regexp_replace(lower(text), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS claim, min(namespace) AS a, max(namespace) AS b FROM mem WHERE live = 0 AND text IS NOT NULL GROUP BY 1) k ON claim = trim(regexp_replace(lower(text), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) WHERE a <> namespace OR b <> namespace""", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """Memories whose text, but for case and blanks, an active memory of another namespace has. Texts are compared by digest, and of each only the first and last namespace are kept."""
    m = M.memories(s, d).where("text is not null").withColumn("k", F.sha2(T.squeeze("text").cast("binary"), 256))
    known = M.active(m).groupBy("k").agg(F.min("namespace").alias("a"), F.max("namespace").alias("b"))
    return m.join(known, "k").where("a <> namespace or b <> namespace").select("id", "namespace")


@query("fp_09_recent_feedback", "SELECT fb.operation_id, fb.memory_id, label, rating, namespace, left(text, 40) AS start FROM fb LEFT JOIN mem ON id = fb.memory_id WHERE rating <= 0 AND at_us IS NOT NULL ORDER BY at_us DESC, fb.operation_id LIMIT 20", "fb", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """The 20 latest feedback rows with a rating of 0 or less, with the memory they name."""
    last = _fb(s, d).where("rating <= 0 and at is not null").orderBy(F.desc("at"), "operation_id").limit(20)
    return last.join(M.memories(s, d).select(F.col("id").alias("memory_id"), "namespace", F.left("text", F.lit(40)).alias("start")), "memory_id", "left").select("operation_id", "memory_id", "label", "rating", "namespace", "start")


@query("fp_10_invalid_targets", "SELECT DISTINCT memory_id FROM fb WHERE memory_id IS NOT NULL AND memory_id NOT IN (SELECT id FROM mem WHERE live = 0)", "fb", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """Memories that feedback names and that are missing or deprecated."""
    return _fb(s, d).select("memory_id").dropna().distinct().join(M.active(M.memories(s, d)).select(F.col("id").alias("memory_id")), "memory_id", "left_anti")


@query("fp_11_unique_results", "SELECT operation_id, count(*) AS results, count(DISTINCT memory_id) AS distinct_results FROM uses GROUP BY 1", "uses")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.uses(_asks(s, d)).groupBy("operation_id").agg(F.count("*").alias("results"), F.count_distinct("memory_id").alias("distinct_results"))


@query("sc_12_used_vectors", f"{_with('uses', 'mem')}, {_USABLE_SQL} SELECT id, dim FROM usable WHERE id IN (SELECT memory_id FROM uses) AND id IN (SELECT id FROM mem WHERE live = 0)")
def _(s: SparkSession, d: str) -> DataFrame:
    """Vectors of active memories that some ask returned."""
    asked = M.uses(_asks(s, d)).select(F.col("memory_id").alias("id")).distinct()
    return _usable(s, d).select("id", "dim").join(asked, "id", "left_semi").join(M.active(M.memories(s, d)).select("id"), "id", "left_semi")


@query("jn_04_sessions", "SELECT session_id, count(*) AS turns, min(at_us) AS first_at, max(at_us) AS last_at, count(*) FILTER (conflict) AS conflicts FROM asks WHERE session_id IS NOT NULL GROUP BY 1", "asks")
def _(s: SparkSession, d: str) -> DataFrame:
    """Sessions with their number of turns."""
    return _asks(s, d).where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("turns"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_if("conflict").alias("conflicts"))


@query("sk_11_session_memory", "SELECT lower(trim(session_id)) AS key, min(at_us) AS created_us, max(at_us) AS updated_us, max(struct_pack(a := at_us, o := operation_id)).o AS operation_id FROM asks WHERE trim(session_id) <> '' AND at_us IS NOT NULL GROUP BY 1", "asks")
def _(s: SparkSession, d: str) -> DataFrame:
    """Per session the last ask, with the time of the first kept: what upserts by key leave."""
    rows = _asks(s, d).where("trim(session_id) <> '' and at is not null").groupBy(F.lower(F.trim("session_id")).alias("key"))
    return rows.agg(F.min("at").alias("created_us"), F.max("at").alias("updated_us"), F.max_by("operation_id", F.struct("at", "operation_id")).alias("operation_id"))


@query("sk_18_deprecated", "SELECT id, CASE WHEN id IN (SELECT target FROM edges WHERE type = 'supersedes') THEN 1 ELSE -live END AS deprecated FROM mem", "mem", "edges")
def _(s: SparkSession, d: str) -> DataFrame:
    """All memories, those that another supersedes marked as deprecated."""
    gone = M.edges(s, d).where("type = 'supersedes'").select(F.col("target").alias("id"), F.lit(1).alias("gone")).distinct()
    return M.memories(s, d).join(gone, "id", "left").select("id", F.coalesce("gone", -F.col("live")).alias("deprecated"))


@query("ag_11_both_directions", "SELECT id, max(weight) AS weight, count(DISTINCT other) AS others, min(other) AS first_other FROM (SELECT source AS id, target AS other, weight FROM edges UNION ALL SELECT target, source, weight FROM edges) GROUP BY 1", "edges")
def _(s: SparkSession, d: str) -> DataFrame:
    """Per memory the heaviest link and the memories linked to it, in either direction. Pairs are made distinct before they are counted, so no memory with many links is a hot spot."""
    e = M.edges(s, d)
    pairs = e.select(F.col("source").alias("id"), F.col("target").alias("other"), "weight").union(e.select("target", "source", "weight")).groupBy("id", "other").agg(F.max("weight").alias("weight"))
    return pairs.groupBy("id").agg(F.max("weight").alias("weight"), F.count("*").alias("others"), F.min("other").alias("first_other"))


@query("ag_26_phase_means", "SELECT CASE WHEN at_us IS NULL THEN 'unknown' ELSE strftime(make_timestamp(at_us), '%Y-%m') END AS month, count(*) AS asks, round(avg(confidence), 6) AS confidence, round(avg(confidence) FILTER (conflict), 6) AS confidence_in_conflict, round(avg(CASE WHEN conflict THEN 1.0 WHEN NOT conflict THEN 0.0 END), 6) AS conflict_share FROM asks GROUP BY 1", "asks")
def _(s: SparkSession, d: str) -> DataFrame:
    """Means per month, some over asks with a conflict only."""
    rows = _asks(s, d).groupBy(month_name(month_of("at")).alias("month"))
    return rows.agg(F.count("*").alias("asks"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(F.when(F.col("conflict"), F.col("confidence"))), 6).alias("confidence_in_conflict"), F.round(F.avg(F.col("conflict").cast("double")), 6).alias("conflict_share"))


@query("ag_28_family_summary", "SELECT coalesce(split_part(replace(namespace, '/', ':'), ':', 1), 'none') AS family, count(*) AS total, count(*) FILTER (rating > 0) AS good, count(*) FILTER (label = 'stale') AS stale, count(*) FILTER (label = 'wrong') AS wrong, round(count(*) FILTER (rating > 0) / count(*), 6) AS match_rate FROM fb LEFT JOIN mem ON id = memory_id GROUP BY 1", "fb", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """Feedback per family of the namespaces of the memories it names."""
    rows = _fb(s, d).join(M.memories(s, d).select(F.col("id").alias("memory_id"), "namespace"), "memory_id", "left")
    good = F.count_if(F.coalesce(F.col("rating") > 0, F.lit(False)))
    return rows.groupBy(F.coalesce(T.name_family("namespace"), F.lit("none")).alias("family")).agg(F.count("*").alias("total"), good.alias("good"), F.count_if(F.col("label") == "stale").alias("stale"), F.count_if(F.col("label") == "wrong").alias("wrong"), F.round(good / F.count("*"), 6).alias("match_rate"))


@query("la_22_standardized", """SELECT id, round((c - avg(c) OVER ()) / coalesce(nullif(stddev_pop(c) OVER (), 0), 1), 6) AS confidence, round((i - avg(i) OVER ()) / coalesce(nullif(stddev_pop(i) OVER (), 0), 1), 6) AS importance
FROM (SELECT id, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS c, CASE WHEN importance BETWEEN 0 AND 1 THEN importance END AS i FROM mem)""", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """Confidence and importance as distances from their means in standard deviations; the means are one row, which is joined to all."""
    in_range = lambda c: F.when(F.col(c).between(0, 1) & ~F.isnan(c), F.col(c)).alias(c)
    rows = M.memories(s, d).select("id", in_range("confidence"), in_range("importance"))
    moments = rows.agg(*(f(c).alias(f"{c}_{n}") for c in ("confidence", "importance") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))
    z = lambda c: F.round((F.col(c) - F.col(f"{c}_mean")) / F.coalesce(F.nullif(f"{c}_sd", F.lit(0.0)), F.lit(1.0)), 6).alias(c)
    one = F.lit(1).alias("one")
    return rows.select("*", one).join(F.broadcast(moments.select("*", one)), "one").select("id", z("confidence"), z("importance"))


@query("mf_09_scaled_weights", "SELECT source, target, type, CASE WHEN hi - lo > 1e-12 THEN round((weight - lo) / (hi - lo), 6) WHEN weight IS NOT NULL THEN 0.0 END AS scaled FROM edges JOIN (SELECT type, max(weight) AS hi, min(weight) AS lo FROM edges WHERE NOT isnan(weight) GROUP BY 1) USING (type) WHERE weight IS NULL OR NOT isnan(weight)", "edges")
def _(s: SparkSession, d: str) -> DataFrame:
    """Link weights from 0 to 1 within their type; a type with one weight has zeros. Joined with the types' bounds, so no window sorts a type in one task."""
    e = M.edges(s, d).where("weight is null or not isnan(weight)")
    bounds = e.groupBy("type").agg(F.max("weight").alias("hi"), F.min("weight").alias("lo")).where("hi is not null")
    span = F.col("hi") - F.col("lo")
    return e.join(bounds, "type").select("source", "target", "type", F.when(span > 1e-12, F.round((F.col("weight") - F.col("lo")) / span, 6)).when(F.col("weight").isNotNull(), F.lit(0.0)).alias("scaled"))


@query("in_09_directional_drift", f"WITH {_CTE['mem']}, {_USABLE_SQL}, {_ANCHORS} SELECT id, round(least(2.0, greatest(0.0, 1 - list_cosine_similarity(e, anchor_vector))), 6) AS angular, round(abs(sqrt(list_sum(list_transform(e, lambda x: x * x))) - sqrt(list_sum(list_transform(anchor_vector, lambda x: x * x)))), 6) AS radial FROM mem JOIN usable USING (id) JOIN anchors a ON a.anchor_id = domain_id AND len(anchor_vector) = dim WHERE sqrt(list_sum(list_transform(anchor_vector, lambda x: x * x))) > 1e-6")
def _(s: SparkSession, d: str) -> DataFrame:
    """How far each memory's vector turned from its domain's anchor, and how much longer or shorter it is."""
    rows = _usable(s, d).join(M.memories(s, d).select("id", "domain_id"), "id").join(_anchors(s, d).withColumnRenamed("anchor_id", "domain_id"), "domain_id").where(F.size("anchor") == F.size("embedding"))
    e, a = F.col("embedding"), F.col("anchor")
    return rows.where(V.norm(a) > 1e-6).select("id", F.round(V.clamp(1 - V.cosine(e, a), 0.0, 2.0), 6).alias("angular"), F.round(F.abs(V.norm(e) - V.norm(a)), 6).alias("radial"))


@query("mf_08_moved_anchors", f"SELECT {P._KEY('id')} AS domain_id, round(sqrt(list_sum(list_transform(range(1, len(anchor_vector) + 1), lambda i: pow(0.9 * anchor_vector[i] + 0.1 * previous_update_direction[i], 2)))), 6) AS length FROM domains WHERE {P._KEY('id')} IS NOT NULL AND len(anchor_vector) = len(previous_update_direction) AND len(list_filter(anchor_vector, lambda x: x IS NULL)) = 0 AND len(list_filter(previous_update_direction, lambda x: x IS NULL)) = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    """Anchors moved a tenth of the way to the last direction of change: their lengths."""
    a, b = F.col("anchor_vector"), F.col("previous_update_direction")
    rows = table(s, d, "domains").where((F.size(a) == F.size(b)) & ~F.exists(a, lambda x: x.isNull()) & ~F.exists(b, lambda x: x.isNull()))
    return rows.select(P.norm_key("id").alias("domain_id"), F.round(V.norm(V.weighted_average(a, b, 0.1)), 6).alias("length")).where("domain_id is not null")


@query("gr_06_island_ratio", """SELECT domain_id, internal, boundary, round(inner_weight / outer_weight, 6) AS ratio FROM (SELECT domain_id, count(*) FILTER (inside) AS internal, count(*) FILTER (NOT inside) AS boundary, avg(weight) FILTER (inside) AS inner_weight, nullif(avg(weight) FILTER (NOT inside), 0) AS outer_weight FROM (
  SELECT a.domain_id, a.domain_id IS NOT DISTINCT FROM b.domain_id AS inside, abs(weight) AS weight FROM edges JOIN mem a ON a.id = source JOIN mem b ON b.id = target WHERE a.domain_id IS NOT NULL AND weight IS NOT NULL AND NOT isnan(weight)
  UNION ALL SELECT b.domain_id, false, abs(weight) FROM edges JOIN mem a ON a.id = source JOIN mem b ON b.id = target WHERE b.domain_id IS NOT NULL AND a.domain_id IS DISTINCT FROM b.domain_id AND weight IS NOT NULL AND NOT isnan(weight)) GROUP BY 1)""", "edges", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """Per domain the mean weight of links within it by that of links across its border."""
    m = M.memories(s, d).select("id", "domain_id")
    e = M.edges(s, d).where("weight is not null and not isnan(weight)").join(m.select(F.col("id").alias("source"), F.col("domain_id").alias("a")), "source").join(m.select(F.col("id").alias("target"), F.col("domain_id").alias("b")), "target")
    inside, w = F.col("a").eqNullSafe(F.col("b")), F.abs("weight").alias("weight")
    rows = e.select(F.col("a").alias("domain_id"), inside.alias("inside"), w).unionByName(e.where(~inside).select(F.col("b").alias("domain_id"), F.lit(False).alias("inside"), w)).where("domain_id is not null")
    means = rows.groupBy("domain_id").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("boundary"), F.avg(F.when(F.col("inside"), F.col("weight"))).alias("i"), F.avg(F.when(~F.col("inside"), F.col("weight"))).alias("o"))
    return means.select("domain_id", "internal", "boundary", F.round(F.try_divide("i", "o"), 6).alias("ratio"))


@query("og_07_top_domains", f"WITH {_CTE['mem']}, {_NEAREST}, n AS (SELECT anchor_id, domain_id, count(*) AS n FROM near JOIN mem USING (id) WHERE domain_id IS NOT NULL GROUP BY 1, 2) SELECT anchor_id, first(domain_id ORDER BY n DESC, domain_id) AS top_domain, max(n) AS members, round(max(n) / sum(n), 6) AS share FROM n GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """The domain that most memories around each anchor have."""
    near = nearest_anchor(_usable(s, d), _anchors(s, d)).join(M.memories(s, d).select("id", "domain_id"), "id").where("domain_id is not null")
    n = near.groupBy("anchor_id", "domain_id").agg(F.count("*").alias("n"))
    return n.groupBy("anchor_id").agg(F.min_by("domain_id", F.struct(-F.col("n"), "domain_id")).alias("top_domain"), F.max("n").alias("members"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def _used_texts(s: SparkSession, d: str) -> DataFrame:
    """Results of asks with a query and the text of their memory."""
    return M.uses(_asks(s, d)).where("query is not null").join(M.memories(s, d).select(F.col("id").alias("memory_id"), "text"), "memory_id").where("text is not null")


_USED = "used AS (SELECT operation_id, query, memory_id, rank, score, text FROM uses JOIN mem ON id = memory_id WHERE query IS NOT NULL AND text IS NOT NULL)"


@query("rt_12_identifiers", f", {_USED} SELECT operation_id, memory_id, rank, ids, CASE WHEN ids > 0 THEN round(hits / ids, 6) ELSE 0.0 END AS affinity FROM (SELECT operation_id, memory_id, rank, len(q) AS ids, len(list_intersect(q, t)) AS hits FROM (SELECT *, list_filter({_TOKENS('query')}, lambda w: regexp_matches(w, '[0-9]')) AS q, {_TOKENS('text')} AS t FROM used))", "uses", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """The share of the identifiers (words with a digit) of each query that its results contain."""
    ids = F.filter(T.token_set("query"), lambda w: w.rlike("[0-9]"))
    return _used_texts(s, d).select("operation_id", "memory_id", "rank", F.size(ids).cast("long").alias("ids"), F.round(T.coverage(ids, T.token_set("text")), 6).alias("affinity"))


@query("tf_34_lexical_similarity", f""", {_USED} SELECT operation_id, memory_id, rank, round(greatest(CASE WHEN len(q) + len(t) > 0 THEN len(list_intersect(q, t)) / (len(q) + len(t) - len(list_intersect(q, t))) ELSE 0 END,
  CASE WHEN a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) THEN least(length(a), length(b)) / greatest(length(a), length(b)) ELSE 0 END), 6) AS similarity
  FROM (SELECT *, {_TOKENS('query')} AS q, {_TOKENS('text')} AS t, trim(regexp_replace(lower(query), '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS a, trim(regexp_replace(lower(text), '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS b FROM used)""", "uses", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """How alike each query and result are: common words, or the shorter's share of the longer that contains it."""
    return _used_texts(s, d).select("operation_id", "memory_id", "rank", F.round(T.lexical_similarity("query", "text"), 6).alias("similarity"))


@query("so_04_term_sets", f", {_USED} SELECT operation_id, memory_id, rank, len(list_intersect(q, t)) AS shared, len(q) - len(list_intersect(q, t)) AS only_query, len(t) - len(list_intersect(q, t)) AS only_text FROM (SELECT *, {_CONTENT('query')} AS q, {_CONTENT('text')} AS t FROM used)", "uses", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """Terms that query and result share, and those only one has."""
    rows = _used_texts(s, d).select("operation_id", "memory_id", "rank", T.content_tokens("query").alias("q"), T.content_tokens("text").alias("t"))
    n = lambda c: F.size(c).cast("long")
    return rows.select("operation_id", "memory_id", "rank", n(F.array_intersect("q", "t")).alias("shared"), n(F.array_except("q", "t")).alias("only_query"), n(F.array_except("t", "q")).alias("only_text"))


@query("la_41_hit_scores", f", {_USED} SELECT operation_id, round(max(hit), 6) AS best, round(avg(hit), 6) AS mean, count(*) AS results FROM (SELECT operation_id, CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda w: contains(lower(text), w))) / len(q) ELSE 0 END AS hit FROM (SELECT *, {_CONTENT('query')} AS q FROM used)) GROUP BY 1", "uses", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """The part of each query's terms that its results' texts contain, also within words."""
    rows = _used_texts(s, d).select("operation_id", T.hit_score("text", T.content_tokens("query")).alias("hit"))
    return rows.groupBy("operation_id").agg(F.round(F.max("hit"), 6).alias("best"), F.round(F.avg("hit"), 6).alias("mean"), F.count("*").alias("results"))


_MARKERS = ("must", "never", "always", "instead", "no longer")


@query("tf_12_markers", f"SELECT marker, count(*) AS memories, count(DISTINCT namespace) AS namespaces FROM (SELECT namespace, unnest(list_filter([{', '.join(repr(m) for m in _MARKERS)}], lambda m: contains(lower(text), m))) AS marker FROM mem WHERE text IS NOT NULL) GROUP BY 1", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """Memories that contain each of some phrases."""
    rows = M.memories(s, d).where("text is not null").select("namespace", F.explode(T.marker_hits("text", _MARKERS)).alias("marker"))
    return rows.groupBy("marker").agg(F.count("*").alias("memories"), F.count_distinct("namespace").alias("namespaces"))


@query("la_27_retrieval_stats", "SELECT operation_id, count(*) AS results, round(max(score), 6) AS best, round(avg(score), 6) AS mean, round(min(score), 6) AS worst, round(avg(CASE WHEN memory_id IN (SELECT target FROM edges WHERE type IN ('supersedes', 'corrects')) THEN 1.0 ELSE 0.0 END), 6) AS superseded_share FROM uses GROUP BY 1", "uses", "edges")
def _(s: SparkSession, d: str) -> DataFrame:
    """Scores of each ask's results, and the share of them that others supersede."""
    old = M.edges(s, d).where("type in ('supersedes', 'corrects')").select(F.col("target").alias("memory_id"), F.lit(1.0).alias("old")).distinct()
    rows = M.uses(_asks(s, d)).join(old, "memory_id", "left").groupBy("operation_id")
    return rows.agg(F.count("*").alias("results"), F.round(F.max("score"), 6).alias("best"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("worst"), F.round(F.avg(F.coalesce("old", F.lit(0.0))), 6).alias("superseded_share"))


_RATED = "rated AS (SELECT u.operation_id, u.memory_id, u.rank, avg(rating) AS rating FROM (SELECT operation_id, memory_id, min(rank) AS rank FROM uses GROUP BY 1, 2) u JOIN fb ON fb.linked_operation_id = u.operation_id AND fb.memory_id = u.memory_id WHERE rating IS NOT NULL AND rank IS NOT NULL GROUP BY 1, 2, 3)"


def _rated(s: SparkSession, d: str) -> DataFrame:
    """Results with the mean rating of the feedback on them, which is added up before it is joined."""
    asks = _asks(s, d)
    u = M.uses(asks).groupBy("operation_id", "memory_id").agg(F.min("rank").alias("rank")).where("rank is not null")
    f = _fb(s, d).where("rating is not null").groupBy(F.col("linked_operation_id").alias("operation_id"), "memory_id").agg(F.avg("rating").alias("rating"))
    return u.join(f, ["operation_id", "memory_id"])


@query("la_47_precision_at_k", f", {_RATED} SELECT cast(k AS INTEGER) AS k, count(*) AS rated, round(avg(CASE WHEN rating > 0 THEN 1.0 ELSE 0.0 END), 6) AS precision, round(avg(CASE WHEN rating < 0 THEN 1.0 ELSE 0.0 END), 6) AS negative FROM rated JOIN (SELECT unnest([1, 3, 5, 10]) AS k) ON rank <= k GROUP BY 1", "uses", "fb")
def _(s: SparkSession, d: str) -> DataFrame:
    """The share of rated results up to rank k that are good, and bad."""
    ks = F.explode(F.filter(F.array(*[F.lit(k) for k in (1, 3, 5, 10)]), lambda k: F.col("rank") <= k))
    rows = _rated(s, d).select("rating", ks.alias("k"))
    return rows.groupBy("k").agg(F.count("*").alias("rated"), F.round(F.avg((F.col("rating") > 0).cast("double")), 6).alias("precision"), F.round(F.avg((F.col("rating") < 0).cast("double")), 6).alias("negative"))


@query("la_50_feedback_targets", f", {_RATED} SELECT operation_id, struct_extract(min(struct_pack(r := rank, m := memory_id)) FILTER (rating > 0), 'm') AS first_good, struct_extract(max(struct_pack(r := rank, m := memory_id)) FILTER (rating <= 0), 'm') AS last_bad FROM rated GROUP BY 1", "uses", "fb")
def _(s: SparkSession, d: str) -> DataFrame:
    """Of each ask the first good and the last other rated result."""
    at = F.struct("rank", "memory_id")
    good = F.col("rating") > 0
    return _rated(s, d).groupBy("operation_id").agg(F.min(F.when(good, at))["memory_id"].alias("first_good"), F.max(F.when(~good, at))["memory_id"].alias("last_bad"))


@query("la_24_match_rates", "SELECT label, count(*) AS n, count(*) FILTER (p = y) AS matches, count(*) FILTER (p AND NOT y) AS false_positives, count(*) FILTER (NOT p AND y) AS false_negatives, round(count(*) FILTER (p = y) / count(*), 6) AS match_rate FROM (SELECT label, confidence >= 0.5 AS p, rating > 0 AS y FROM fb JOIN asks ON asks.operation_id = fb.linked_operation_id WHERE rating IS NOT NULL AND confidence IS NOT NULL) GROUP BY 1", "fb", "asks")
def _(s: SparkSession, d: str) -> DataFrame:
    """How often the asks' confidence agrees with their feedback, per label."""
    log = M.log(s, d)
    p, y = F.col("confidence") >= 0.5, F.col("rating") > 0
    rows = O.linked(M.asks(log), M.feedback(log)).where("accept and rating is not null and confidence is not null").groupBy("label")
    return rows.agg(F.count("*").alias("n"), F.count_if(p == y).alias("matches"), F.count_if(p & ~y).alias("false_positives"), F.count_if(~p & y).alias("false_negatives"), F.round(F.count_if(p == y) / F.count("*"), 6).alias("match_rate"))


@query("wf_06_source_diverse", """, firsts AS (SELECT operation_id, source, min(struct_pack(r := rank, m := memory_id)) AS f FROM uses JOIN src ON id = memory_id WHERE source IS NOT NULL AND rank IS NOT NULL GROUP BY 1, 2),
ranked AS (SELECT operation_id, source, f.m AS memory_id, f.r AS rank, row_number() OVER (PARTITION BY operation_id ORDER BY f.r, f.m) AS place FROM firsts) SELECT operation_id, source, memory_id, rank, cast(place AS INTEGER) AS place FROM ranked WHERE place <= 4""", "uses", "src")
def _(s: SparkSession, d: str) -> DataFrame:
    """The best result of each source of an ask, of the four best sources."""
    rows = M.uses(_asks(s, d)).where("rank is not null").join(M.sources(s, d).where("source is not null").select(F.col("id").alias("memory_id"), "source"), "memory_id")
    firsts = rows.groupBy("operation_id", "source").agg(F.min(F.struct("rank", "memory_id")).alias("f")).select("operation_id", "source", "f.memory_id", "f.rank")
    place = F.row_number().over(Window.partitionBy("operation_id").orderBy("rank", "memory_id"))
    return firsts.withColumn("place", place).where("place <= 4")


@query("sc_08_sentences", r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[\s\x1c-\x1f\x{85}\p{Z}]*\n+')) AS p FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, len(list_filter(string_split_regex(unnest(CASE WHEN len(x) > 0 THEN x ELSE [p] END), '[\s\x1c-\x1f\x{85}\p{Z}]+'), lambda w: w <> '')) AS n FROM (SELECT doc_id, p, list_filter(regexp_extract_all(p, '[^.!?\n]+(?:[.!?]+["'')\]]*)?'), lambda t: regexp_matches(t, '[^\s\x1c-\x1f\x{85}\p{Z}]')) AS x FROM p))
SELECT doc_id, count(*) AS units, cast(sum(n) AS BIGINT) AS words, max(n) AS longest FROM u WHERE n > 0 GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Sentences of each document, and their words."""
    rows = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(X.sentences(X.line_ends(F.col("text")))).alias("u")).select("doc_id", F.size(X.words_of(F.col("u"))).cast("long").alias("n"))
    return rows.where("n > 0").groupBy("doc_id").agg(F.count("*").alias("units"), F.sum("n").alias("words"), F.max("n").alias("longest"))


@query("sc_07_chunks")
def _(s: SparkSession, d: str) -> DataFrame:
    """Documents in chunks of whole sentences of up to 120 words, with 20 carried over."""
    return X.sentence_chunks(table(s, d, "documents"), "doc_id")


@query("sc_09_windows", r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\s\x1c-\x1f\x{85}\p{Z}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, w, unnest(range(0, cast(greatest(0, ceil((len(w) - 120) / 100.0)) AS BIGINT) + 1)) AS chunk_no FROM w WHERE len(w) > 0)
SELECT doc_id, cast(chunk_no AS INTEGER) AS chunk_no, cast(len(w[chunk_no * 100 + 1 : chunk_no * 100 + 120]) AS INTEGER) AS n_words, array_to_string(w[chunk_no * 100 + 1 : chunk_no * 100 + 120], ' ') AS chunk FROM c""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Documents in windows of 120 words with 20 in common."""
    return X.chunks(table(s, d, "documents"), "doc_id")


_SPACE = f"sp AS (SELECT {P._KEY('id')} AS id, anchor_vector AS a, coalesce({P._KEY('namespace')}, 'global') AS ns, stability FROM domains WHERE {P._KEY('id')} IS NOT NULL AND len(list_filter(anchor_vector, lambda x: x IS NULL)) = 0 AND stability IS NOT NULL AND NOT isnan(stability))"


@query("mf_10_anchor_similarities", f"WITH {_SPACE}, b AS (SELECT min(stability) AS lo, max(stability) - min(stability) AS span FROM sp) SELECT x.id AS domain_a, y.id AS domain_b, round(list_cosine_similarity(x.a, y.a), 6) AS cosine, round(CASE WHEN span > 1e-12 THEN 1 - abs(x.stability - y.stability) / span ELSE 1.0 END, 6) AS scalar, CASE WHEN x.ns = y.ns THEN 1.0 ELSE 0.0 END AS label FROM sp x JOIN sp y ON len(x.a) = len(y.a) AND x.id < y.id CROSS JOIN b")
def _(s: SparkSession, d: str) -> DataFrame:
    """How alike each two domains are: by their anchors, by their stability scaled to 0..1, and by namespace. The domains are a fixed small table, so their pairs are too."""
    a = F.col("anchor_vector")
    rows = P._domains(s, d).where(a.isNotNull() & ~F.exists(a, lambda x: x.isNull()) & F.col("stability").isNotNull() & ~F.isnan("stability")).select("domain_id", a.alias("v"), F.size(a).alias("dim"), "namespace", "stability")
    bounds = rows.agg(F.min("stability").alias("lo"), F.max("stability").alias("hi")).select(F.lit(1).alias("one"), (F.col("hi") - F.col("lo")).alias("span"))
    x, y = rows.alias("x"), rows.alias("y")
    pairs = x.join(y, (F.col("x.dim") == F.col("y.dim")) & (F.col("x.domain_id") < F.col("y.domain_id"))).select(F.lit(1).alias("one"), F.col("x.domain_id").alias("domain_a"), F.col("y.domain_id").alias("domain_b"), F.round(V.cosine(F.col("x.v"), F.col("y.v")), 6).alias("cosine"), F.abs(F.col("x.stability") - F.col("y.stability")).alias("far"), (F.col("x.namespace") == F.col("y.namespace")).cast("double").alias("label"))
    return pairs.join(F.broadcast(bounds), "one").select("domain_a", "domain_b", "cosine", F.round(F.when(F.col("span") > 1e-12, 1 - F.col("far") / F.col("span")).otherwise(1.0), 6).alias("scalar"), "label")


@query("tf_09_topic_overlap", f", {_USED} SELECT operation_id, memory_id, rank, CASE WHEN len(q) > 0 AND len(t) > 0 THEN round(len(list_intersect(q, t)) / least(len(q), len(t)), 6) ELSE 0.0 END AS overlap FROM (SELECT *, {_CONTENT('query')} AS q, {_CONTENT('text')} AS t FROM used)", "uses", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """The common terms of query and result by the terms of the shorter."""
    rows = _used_texts(s, d).select("operation_id", "memory_id", "rank", T.content_tokens("query").alias("q"), T.content_tokens("text").alias("t"))
    return rows.select("operation_id", "memory_id", "rank", F.round(T.overlap(F.col("q"), F.col("t")), 6).alias("overlap"))


@query("sc_19_sample", "SELECT id, domain_id FROM mem ORDER BY md5(id), id LIMIT 100", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """A hundred memories, drawn by hash: the same ones on every run."""
    return M.memories(s, d).orderBy(F.md5(F.col("id").cast("binary")), "id").limit(100).select("id", "domain_id")


@query("sk_03_newest_source", f"SELECT id, s.source AS source, s.chunk_index AS chunk_index FROM (SELECT {P._KEY('memory_id')} AS id, first({{'source': {P._KEY('source')}, 'chunk_index': chunk_index}} ORDER BY created_at DESC NULLS LAST, {P._KEY('source')} DESC NULLS LAST, chunk_index DESC NULLS LAST) AS s FROM memory_sources GROUP BY 1) WHERE id IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    """The source that each memory has after all of them were set in order of time."""
    rows = table(s, d, "memory_sources").select(P.norm_key("memory_id").alias("id"), "created_at", P.norm_key("source").alias("source"), "chunk_index").where("id is not null")
    return rows.groupBy("id").agg(F.max(F.struct("created_at", "source", "chunk_index")).alias("s")).select("id", "s.source", "s.chunk_index")


@query("sc_15_domains_of_memories", f"SELECT mem.id, domain_id, name, name IS NOT NULL OR domain_id IN (SELECT {P._KEY('id')} FROM domains WHERE {P._KEY('id')} IS NOT NULL) AS known FROM mem LEFT JOIN (SELECT {P._KEY('id')} AS k, max(name) AS name FROM domains GROUP BY 1) d ON k = domain_id WHERE domain_id IS NOT NULL", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """Memories with the name of their domain, and whether it exists."""
    names = P._domains(s, d).groupBy("domain_id").agg(F.max("name").alias("name"), F.lit(True).alias("there"))
    rows = M.memories(s, d).where("domain_id is not null").select("id", "domain_id")
    return rows.join(names, "domain_id", "left").select("id", "domain_id", "name", F.coalesce("there", F.lit(False)).alias("known"))


@query("ag_15_claim_support", r""", k AS (SELECT id, trim(regexp_replace(lower(text), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS claim FROM mem WHERE text IS NOT NULL) SELECT DISTINCT operation_id, memory_id, copies, keeper_id = memory_id AS is_keeper FROM uses JOIN k ON k.id = memory_id JOIN claims USING (claim)""", "uses", "mem", "claims")
def _(s: SparkSession, d: str) -> DataFrame:
    """How many memories say what each result says, and whether it is the one kept."""
    m = M.memories(s, d)
    digest = lambda c: F.md5(c.cast("binary")).alias("digest")
    claims = A.exact_claims(m).select(digest(F.col("claim")), "copies", "keeper_id")
    of = m.where("text is not null").select(F.col("id").alias("memory_id"), digest(T.squeeze("text")))
    rows = M.uses(_asks(s, d)).select("operation_id", "memory_id").distinct()
    return rows.join(of, "memory_id").join(claims, "digest").select("operation_id", "memory_id", "copies", (F.col("keeper_id") == F.col("memory_id")).alias("is_keeper"))


_FOLDS = P.SQL["la_35_nearest_centroid"]


@query("la_28_cross_validation", f"SELECT cast(concat('0x', substr(md5(cast(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS fold, count(*) AS n, round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_FOLDS}) GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """Accuracy of the nearest centroid on each fold, trained on the others."""
    rows = O.nearest_centroid(table(s, d, "embeddings"))
    return rows.groupBy(O._fold("vec_id", 5).alias("fold")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


@query("la_36_leave_one_out", """WITH x AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL), m AS (SELECT label, list(v ORDER BY i) AS total FROM (SELECT label, i, sum(x) AS v FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM x) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id, x.label, m.label AS l, CASE WHEN x.label = m.label THEN list_transform(range(1, len(e) + 1), lambda i: total[i] - e[i]) ELSE total END AS t, e FROM x CROSS JOIN m),
c AS (SELECT vec_id, label, l, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: t[i] * e[i])) / nullif(sqrt(list_sum(list_transform(t, lambda v: v * v))) * sqrt(list_sum(list_transform(e, lambda v: v * v))), 0), 6) AS c FROM s)
SELECT label, count(*) AS n, round(avg(CASE WHEN label = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT vec_id, label, first(l ORDER BY c DESC NULLS LAST, l) AS p FROM c GROUP BY 1, 2) GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Accuracy of the nearest centroid per label when each vector is left out of its own label's mean."""
    return O.leave_one_out(table(s, d, "embeddings")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


@query("la_23_logistic")
def _(s: SparkSession, d: str) -> DataFrame:
    """How confidence, rank and score of a result tell whether its feedback is good: coefficients of a logistic model."""
    asks = _asks(s, d)
    rows = _rated(s, d).join(M.uses(asks).groupBy("operation_id", "memory_id").agg(F.max("score").alias("score")), ["operation_id", "memory_id"]).join(asks.select("operation_id", "confidence"), "operation_id")
    return O.logistic(rows.select((F.col("rating") > 0).alias("good"), "confidence", F.col("rank").cast("double").alias("rank"), "score"), "good", ["confidence", "rank", "score"])
