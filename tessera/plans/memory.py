"""Queries over memories, links, sources, domains and the outcome log, each named after the operation it covers, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.functions.keys import norm_key, norm_namespace
from tessera.operators import aggregates as A
from tessera.operators import graph as G
from tessera.operators import joins as J
from tessera.operators import outcomes as O
from tessera.operators.search import nearest_anchor, top_k
from tessera.sources import memory as M
from tessera.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_KEY = r"nullif(lower(regexp_replace({0}, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')), '')".format
_AT = "epoch_us(try_cast(replace(upper(trim(created_at)), 'Z', '+00:00') AS TIMESTAMPTZ))"
_ORDER = "live DESC NULLS LAST, confidence DESC NULLS LAST, importance DESC NULLS LAST, text DESC NULLS LAST, namespace DESC, domain_id DESC NULLS LAST, memory_type DESC NULLS LAST, stability DESC NULLS LAST, created_at DESC NULLS LAST, clc_state DESC NULLS LAST"
_CTE = {
    "mem": f"""mem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, {_ORDER}) AS v FROM (
  SELECT {_KEY("id")} AS id, updated_at, -coalesce(deprecated, 0) AS live, confidence, importance, text, coalesce({_KEY("namespace")}, 'global') AS namespace, {_KEY("domain_id")} AS domain_id, memory_type, stability, created_at, clc_state FROM memories)
  WHERE id IS NOT NULL) WHERE v = 1)""",
    "edges": f"""edges AS (SELECT * FROM (SELECT {_KEY("source_memory_id")} AS source, {_KEY("target_memory_id")} AS target, {_KEY("relation_type")} AS type, max(weight) AS weight FROM relations GROUP BY 1, 2, 3)
  WHERE source <> target AND type IS NOT NULL)""",
    "src": f"""src AS (SELECT id, s.source AS source, s.chunk_index AS chunk_index FROM (
  SELECT {_KEY("memory_id")} AS id, first({{'source': {_KEY("source")}, 'chunk_index': chunk_index}} ORDER BY {_KEY("source")} DESC NULLS LAST, chunk_index DESC NULLS LAST) AS s FROM memory_sources GROUP BY 1) WHERE id IS NOT NULL)""",
    "log": f"""log AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY operation_id ORDER BY at_us DESC NULLS LAST, event_type DESC NULLS LAST, linked_operation_id DESC NULLS LAST, payload DESC NULLS LAST) AS v FROM (
  SELECT {_KEY("operation_id")} AS operation_id, {_KEY("linked_operation_id")} AS linked_operation_id, {_KEY("event_type")} AS event_type, {_AT} AS at_us, CASE WHEN json_valid(payload) THEN payload END AS payload FROM evidence_state_failure_outcomes)
  WHERE operation_id IS NOT NULL) WHERE v = 1)""",
    "asks": f"""asks AS (SELECT operation_id, at_us, payload ->> '$.request.query' AS query, payload ->> '$.request.session_id' AS session_id, coalesce({_KEY("payload ->> '$.request.namespace'")}, 'global') AS namespace,
  cast(payload ->> '$.response.confidence' AS DOUBLE) AS confidence, cast(payload ->> '$.response.conflict' AS BOOLEAN) AS conflict, payload FROM log WHERE event_type = 'ask')""",
    "fb": f"""fb AS (SELECT operation_id, linked_operation_id, at_us, {_KEY("payload ->> '$.request.memory_id'")} AS memory_id, {_KEY("payload ->> '$.request.label'")} AS label, cast(payload ->> '$.request.rating' AS DOUBLE) AS rating,
  {_KEY("payload ->> '$.request.feedback_scope'")} AS scope, payload ->> '$.request.query' AS query FROM log WHERE event_type = 'feedback')""",
    "uses": f"""uses AS (SELECT * FROM (SELECT operation_id, at_us, query, namespace, {_KEY("r ->> '$.memory_id'")} AS memory_id, cast(r ->> '$.rank' AS INTEGER) AS rank, cast(r ->> '$.score' AS DOUBLE) AS score FROM (
  SELECT operation_id, at_us, query, namespace, unnest(cast(payload -> '$.response.raw_results' AS JSON[])) AS r FROM asks)) WHERE memory_id IS NOT NULL)""",
    "fbm": "fbm AS (SELECT memory_id, count(*) AS n, round(avg(rating), 6) AS mean_rating, count(*) FILTER (rating > 0) AS good, count(*) FILTER (rating < 0) AS bad FROM fb WHERE memory_id IS NOT NULL GROUP BY 1)",
    "ends": "ends AS (SELECT id, type, cast(sum(o) AS BIGINT) AS links_out, cast(sum(1 - o) AS BIGINT) AS links_in, round(coalesce(sum(weight) FILTER (o = 1), 0.0), 6) AS weight_out, round(coalesce(sum(weight) FILTER (o = 0), 0.0), 6) AS weight_in FROM (SELECT source AS id, type, weight, 1 AS o FROM edges UNION ALL SELECT target, type, weight, 0 FROM edges) GROUP BY 1, 2)",
    "claims": r"""claims AS (SELECT claim, count(*) AS copies, first(id ORDER BY quality DESC, created_at DESC NULLS LAST, id DESC) AS keeper_id, count(DISTINCT namespace) AS namespaces, count(DISTINCT domain_id) AS domains, min(created_at) AS first_created, max(created_at) AS last_created FROM (
  SELECT *, trim(regexp_replace(lower(text), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS claim, round(coalesce(CASE WHEN isnan(confidence) THEN 0 ELSE confidence END, 0) * coalesce(CASE WHEN isnan(importance) THEN 0 ELSE importance END, 0), 6) AS quality FROM mem WHERE text IS NOT NULL) GROUP BY claim)""",
}
_NEEDS = {"asks": ["log"], "fb": ["log"], "uses": ["log", "asks"], "fbm": ["log", "fb"], "ends": ["edges"], "claims": ["mem"]}
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOKENS = r"list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) > 1))".format
_CONTENT = lambda c: f"list_filter({_TOKENS(c)}, lambda w: w NOT IN ({_STOP}))"
_STEM = "CASE WHEN w LIKE '%ies' AND length(w) > 5 THEN w[:-4] || 'y' WHEN w LIKE '%ing' AND length(w) > 5 THEN w[:-4] WHEN w LIKE '%es' AND length(w) > 4 THEN w[:-3] WHEN w LIKE '%s' AND length(w) > 3 THEN w[:-2] ELSE w END"
_STEMS = lambda c: f"list_distinct(list_transform({_CONTENT(c)}, lambda w: {_STEM}))"


def _with(*names: str) -> str:
    need: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in need:
                need.append(x)
    return "WITH " + ", ".join(_CTE[x] for x in need) + " "


def query(name: str, sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (_with(*ctes) if ctes else "") + sql
        return f

    return add


def _fb(s: SparkSession, d: str) -> DataFrame:
    return M.feedback(M.log(s, d))


def _asks(s: SparkSession, d: str) -> DataFrame:
    return M.asks(M.log(s, d))


def _domains(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "domains").select(norm_key("id").alias("domain_id"), "updated_at", "name", norm_namespace("namespace").alias("namespace"), "memory_count", "stability", "drift_ema", "curvature_ema", "effective_dimension", "anchor_vector")
    return rows.where("domain_id is not null")


def _usable(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "vectors").where(V.usable(F.col("embedding"), F.col("dim")))
    return v.select(norm_key("memory_id").alias("id"), "embedding", "dim").where("id is not null").groupBy("id").agg(F.min(F.struct("embedding", "dim")).alias("v")).select("id", "v.embedding", "v.dim")


_USABLE_SQL = f"""usable AS (SELECT id, min(e) AS e, len(min(e)) AS dim FROM (SELECT {_KEY("memory_id")} AS id, embedding AS e, dim FROM vectors
  WHERE len(embedding) = dim AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) WHERE id IS NOT NULL GROUP BY id)"""


@query("sc_11_memory_vectors", f"WITH {_CTE['mem']}, {_USABLE_SQL} SELECT id, namespace, domain_id, dim FROM mem JOIN usable USING (id) WHERE live = 0 AND namespace LIKE 'project:%'")
def _(s: SparkSession, d: str) -> DataFrame:
    """Active memories of the projects with a usable vector."""
    m = M.active(M.memories(s, d)).where(F.col("namespace").startswith("project:"))
    return m.join(_usable(s, d).select("id", "dim"), "id").select("id", "namespace", "domain_id", "dim")


@query("sc_13_newest_of_domain", "SELECT domain_id, id, cast(rank AS INTEGER) AS rank FROM (SELECT domain_id, id, row_number() OVER (PARTITION BY domain_id ORDER BY created_at DESC NULLS LAST, id) AS rank FROM mem WHERE domain_id IS NOT NULL AND live = 0) WHERE rank <= 16", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = M.active(M.memories(s, d)).where("domain_id is not null")
    return J.top_per_key(rows, "domain_id", [F.col("created_at").desc_nulls_last(), F.col("id")], 16).select("domain_id", "id", "rank")


@query("sc_14_domains", f"SELECT {_KEY('id')} AS domain_id, name, coalesce({_KEY('namespace')}, 'global') AS namespace, memory_count, n.members FROM domains LEFT JOIN (SELECT domain_id, count(*) AS members FROM mem WHERE live = 0 GROUP BY 1) n ON {_KEY('domains.id')} = n.domain_id", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """Domains with the members they say and those they have."""
    n = M.active(M.memories(s, d)).groupBy("domain_id").agg(F.count("*").alias("members"))
    return _domains(s, d).join(n, "domain_id", "left").select("domain_id", "name", "namespace", "memory_count", "members")


@query("sc_16_domain_by_name", f"SELECT namespace, name, domain_id FROM (SELECT coalesce({_KEY('namespace')}, 'global') AS namespace, name, {_KEY('id')} AS domain_id, row_number() OVER (PARTITION BY coalesce({_KEY('namespace')}, 'global'), name ORDER BY updated_at DESC NULLS LAST, {_KEY('id')} DESC) AS r FROM domains) WHERE r = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    best = F.max(F.struct("updated_at", "domain_id"))
    return _domains(s, d).groupBy("namespace", "name").agg(best["domain_id"].alias("domain_id"))


@query("sc_18_memory_rows", r"SELECT mem.id, namespace, source, trim(regexp_replace(lower(text), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS claim FROM mem LEFT JOIN src USING (id)", "mem", "src")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.memories(s, d).join(M.sources(s, d), "id", "left").select("id", "namespace", "source", T.squeeze("text").alias("claim"))


@query("ag_01_source_counts", "SELECT source, count(*) AS memories, min(chunk_index) AS first_chunk, max(chunk_index) AS last_chunk FROM src WHERE source IS NOT NULL GROUP BY source", "src")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.source_counts(M.sources(s, d))


@query("ag_02_feedback_counts", "SELECT label, count(*) AS n, round(avg(rating), 4) AS mean_rating FROM fb GROUP BY label", "fb")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.feedback_counts(_fb(s, d))


@query("ag_03_feedback_by_memory", "SELECT * FROM fbm", "fbm")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.feedback_by_memory(_fb(s, d))


@query("ag_04_use_by_memory", "SELECT memory_id, count(*) AS uses, max(at_us) AS last_used, round(avg(score), 6) AS mean_score, min(rank) AS best_rank FROM uses GROUP BY 1", "uses")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.use_by_memory(M.uses(_asks(s, d)))


@query("ag_05_link_counts", "SELECT type, count(*) AS n, round(avg(weight), 6) AS mean_weight FROM edges GROUP BY 1", "edges")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.link_counts(M.edges(s, d))


@query("ag_06_namespace_counts", "SELECT namespace, count(*) AS n FROM mem WHERE live = 0 GROUP BY 1", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.active(M.memories(s, d)).groupBy("namespace").agg(F.count("*").alias("n"))


@query("ag_07_dimensions", "SELECT dim, len(embedding) AS length, count(*) AS n FROM vectors GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "vectors")
    return v.groupBy("dim", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("length")).agg(F.count("*").alias("n"))


@query("ag_08_stats", "SELECT (SELECT count(*) FROM mem) AS memories, (SELECT count(*) FROM mem WHERE live = 0) AS active, (SELECT count(*) FROM edges) AS links, (SELECT count(*) FROM src) AS sources, (SELECT count(*) FROM asks) AS asks, (SELECT count(*) FROM fb) AS feedback", "mem", "edges", "src", "asks", "fb")
def _(s: SparkSession, d: str) -> DataFrame:
    """One row of counts."""
    m, log = M.memories(s, d), M.log(s, d)
    one = lambda df, **c: df.agg(*(e.alias(n) for n, e in c.items())).withColumn("k", F.lit(1))
    parts = [one(m, memories=F.count("*"), active=F.count_if(F.col("live") == 0)), one(M.edges(s, d), links=F.count("*")), one(M.sources(s, d), sources=F.count("*")), one(log, asks=F.count_if(F.col("event_type") == "ask"), feedback=F.count_if(F.col("event_type") == "feedback"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "k")
    return out.drop("k")


@query("ag_09_link_summary", "SELECT * FROM ends WHERE type IN ('supersedes', 'corrects')", "ends")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.link_summary(M.edges(s, d).where(F.col("type").isin(*J.SUPERSEDING)))


@query("ag_14_exact_claims", "SELECT * FROM claims", "claims")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.exact_claims(M.memories(s, d))


@query("ag_23_duplicate_spread", "SELECT count(*) AS claims, count(*) FILTER (copies > 1) AS duplicated, cast(sum(copies - 1) AS BIGINT) AS extra, count(*) FILTER (copies > 1 AND namespaces > 1) AS across_namespaces, count(*) FILTER (copies > 1 AND domains > 1) AS across_domains FROM claims", "claims")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.duplicate_spread(A.exact_claims(M.memories(s, d)))


@query("ag_16_latest_versions", r"""SELECT name, max(version) AS version, count(*) FILTER (version = top) AS current_memories, count(*) FILTER (version < top) AS older_memories FROM (
  SELECT *, max(version) OVER (PARTITION BY name) AS top FROM (SELECT regexp_extract(stem, '^(.*)_v([0-9]{1,9})$', 1) AS name, try_cast(regexp_extract(stem, '^(.*)_v([0-9]{1,9})$', 2) AS INTEGER) AS version FROM (
    SELECT regexp_replace(list_last(string_split(replace(lower(source), '\', '/'), '/')), '\.[a-z0-9]+$', '') AS stem FROM src)) WHERE name <> '') GROUP BY name""", "src")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.latest_versions(M.sources(s, d))


@query("ag_22_effective_dimension", f"""WITH {_CTE['mem']}, {_USABLE_SQL}, x AS (SELECT domain_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM usable JOIN mem USING (id) WHERE domain_id IS NOT NULL),
v AS (SELECT domain_id, i, var_samp(x) AS v, count(*) AS n FROM x GROUP BY 1, 2) SELECT domain_id, max(n) AS vectors, round(greatest(1.0, coalesce(CASE WHEN sum(v * v) > 0 THEN sum(v) * sum(v) / sum(v * v) END, 1.0)), 4) AS effective_dimension FROM v GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = _usable(s, d).join(M.memories(s, d).select("id", "domain_id"), "id").where("domain_id is not null")
    return A.effective_dimensions(rows)


@query("ag_25_cube", """SELECT family, memory_type, count(*) AS n, round(avg(stability), 6) AS mean_stability, round(avg(CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END), 6) AS mean_confidence, cast(grouping(family, memory_type) AS INTEGER) AS level
  FROM (SELECT *, regexp_split_to_array(namespace, '[:/]')[1] AS family FROM mem) GROUP BY CUBE (family, memory_type)""", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.by_namespace_and_type(M.memories(s, d))


@query("ag_31_spread", "SELECT memory_type, count(*) AS n, round(quantile_cont(stability, 0.5), 6) AS median, round(min(stability), 6) AS low, round(max(stability), 6) AS high FROM mem GROUP BY 1", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    x = F.col("stability")
    return M.memories(s, d).groupBy("memory_type").agg(F.count("*").alias("n"), F.round(F.percentile(x, F.lit(0.5)), 6).alias("median"), F.round(F.min(x), 6).alias("low"), F.round(F.max(x), 6).alias("high"))


@query("jn_01_memories_of_source", "SELECT id, source, chunk_index FROM src JOIN mem USING (id) WHERE source LIKE 'handover/%'", "src", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.sources(s, d).where(F.col("source").startswith("handover/")).join(M.memories(s, d).select("id"), "id", "left_semi").select("id", "source", "chunk_index")


_TARGETS = """SELECT memory_id, target, cast(rank AS INTEGER) AS rank, weight, domain_id, src.source AS target_source FROM (
  SELECT e.source AS memory_id, target, weight, domain_id, row_number() OVER (PARTITION BY e.source ORDER BY weight DESC NULLS LAST, target) AS rank FROM (SELECT source, target, max(weight) AS weight FROM edges WHERE type IN ({0}) GROUP BY 1, 2) e JOIN mem ON mem.id = target WHERE live = 0
) LEFT JOIN src ON src.id = target WHERE rank <= {1}""".format


@query("jn_02_superseded_targets", _TARGETS("'supersedes', 'corrects', 'updates'", 5), "edges", "mem", "src")
def _(s: SparkSession, d: str) -> DataFrame:
    return J.superseded_targets(M.edges(s, d), M.memories(s, d), M.sources(s, d))


@query("jn_03_summarized_targets", _TARGETS("'summarizes'", 8), "edges", "mem", "src")
def _(s: SparkSession, d: str) -> DataFrame:
    return J.superseded_targets(M.edges(s, d), M.memories(s, d), M.sources(s, d), ("summarizes",), 8)


_REL = "SELECT {0}, count(*) AS n, round(avg(rating), 6) AS mean_rating FROM fb JOIN {1} x ON x.id = memory_id WHERE rating IS NOT NULL AND {0} IS NOT NULL GROUP BY {0}".format


@query("jn_05_domain_reliability", _REL("domain_id", "mem"), "fb", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    return J.reliability(_fb(s, d), M.memories(s, d), "domain_id")


@query("jn_05_source_reliability", _REL("source", "src"), "fb", "src")
def _(s: SparkSession, d: str) -> DataFrame:
    return J.reliability(_fb(s, d), M.sources(s, d), "source")


@query("jn_06_use_report", f"SELECT memory_id, mem.namespace, dom.name AS domain_name, source, count(*) AS uses, max(at_us) AS last_used, round(avg(score), 6) AS mean_score, min(rank) AS best_rank FROM uses JOIN mem ON mem.id = memory_id LEFT JOIN (SELECT {_KEY('id')} AS did, name FROM domains) dom ON dom.did = domain_id LEFT JOIN src ON src.id = memory_id GROUP BY ALL", "uses", "mem", "src")
def _(s: SparkSession, d: str) -> DataFrame:
    return J.use_report(M.uses(_asks(s, d)), M.memories(s, d), _domains(s, d), M.sources(s, d))


@query("jn_08_domain_counters", """SELECT domain_id, count(*) AS memories, count(*) FILTER (live = 0) AS active, count(DISTINCT namespace) AS namespaces, count(l.links) AS linked, cast(coalesce(sum(l.links), 0) AS BIGINT) AS link_ends, cast(coalesce(sum(n), 0) AS BIGINT) AS feedback, cast(coalesce(sum(bad), 0) AS BIGINT) AS bad_feedback
  FROM mem LEFT JOIN (SELECT id, sum(links_out + links_in) AS links FROM ends GROUP BY 1) l USING (id) LEFT JOIN fbm ON memory_id = mem.id WHERE domain_id IS NOT NULL GROUP BY 1""", "mem", "ends", "fbm")
def _(s: SparkSession, d: str) -> DataFrame:
    return J.domain_counters(M.memories(s, d), M.edges(s, d), _fb(s, d))


_PROTECTED = "SELECT target AS id FROM edges WHERE type IN ('supersedes', 'corrects', 'summarizes') UNION SELECT memory_id FROM fbm WHERE mean_rating < 0"


@query("jn_09_protected", _PROTECTED, "edges", "fbm")
def _(s: SparkSession, d: str) -> DataFrame:
    return J.protected(M.edges(s, d), _fb(s, d))


@query("jn_10_vector_top_k", "SELECT query_id, id, cosine, cast(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) AS rank FROM (SELECT vec_id, cast(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0) a JOIN (SELECT vec_id, cast(embedding AS DOUBLE[]) AS e FROM embeddings) b ON a.vec_id <> b.vec_id) WHERE rank <= 8")
def _(s: SparkSession, d: str) -> DataFrame:
    """The 8 most similar of all embeddings for every one whose id 50 divides."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return top_k(v.where("id % 50 = 0"), v, 8)


@query("jn_11_nearest_anchor", f"WITH {_USABLE_SQL} SELECT id, first(anchor_id ORDER BY c DESC, anchor_id) AS anchor_id, max(c) AS cosine FROM (SELECT u.id, {_KEY('d.id')} AS anchor_id, round(list_cosine_similarity(e, anchor_vector), 6) AS c FROM usable u JOIN domains d ON len(anchor_vector) = dim) GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """The domain whose anchor is most similar to each memory's vector."""
    anchors = _domains(s, d).select(F.col("domain_id").alias("anchor_id"), F.col("anchor_vector").alias("anchor"))
    return nearest_anchor(_usable(s, d), anchors)


_TURNS = "SELECT session_id, operation_id, at_us AS at, query, cast(row_number() OVER (PARTITION BY session_id ORDER BY at_us, operation_id) AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_us {0}, operation_id {0}) AS r FROM asks WHERE session_id IS NOT NULL AND at_us IS NOT NULL) WHERE r <= {1}".format


@query("wf_01_session_history", _TURNS("ASC", 50), "asks")
def _(s: SparkSession, d: str) -> DataFrame:
    return J.session_turns(_asks(s, d), 50, newest=False)


@query("wf_02_recent_turns", _TURNS("DESC", 8), "asks")
def _(s: SparkSession, d: str) -> DataFrame:
    return J.session_turns(_asks(s, d), 8, newest=True)


@query("wf_03_last_evidence", """SELECT session_id, operation_id, (SELECT string_agg(r ->> '$.memory_id', ',' ORDER BY cast(r ->> '$.rank' AS INTEGER)) FROM (SELECT unnest(cast(payload -> '$.response.raw_results' AS JSON[])) AS r)) AS evidence FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_us DESC, operation_id DESC) AS r FROM asks WHERE session_id IS NOT NULL AND at_us IS NOT NULL AND json_array_length(payload -> '$.response.raw_results') > 0) WHERE r = 1""", "asks")
def _(s: SparkSession, d: str) -> DataFrame:
    return J.last_evidence(_asks(s, d))


@query("wf_04_consolidation_plan", f"""SELECT domain_id, cast(rank AS INTEGER) AS rank, id, candidates FROM (SELECT *, count(*) OVER (PARTITION BY domain_id) AS candidates, row_number() OVER (PARTITION BY domain_id ORDER BY stability DESC NULLS LAST, CASE WHEN isnan(importance) THEN 0 ELSE importance END DESC NULLS LAST, id DESC) AS rank
  FROM mem WHERE live = 0 AND domain_id IS NOT NULL AND id NOT IN ({_PROTECTED})) WHERE candidates >= 4 AND rank <= 8""", "mem", "edges", "fbm")
def _(s: SparkSession, d: str) -> DataFrame:
    return J.consolidation_plan(M.memories(s, d), J.protected(M.edges(s, d), _fb(s, d)))


@query("rt_01_rerank", f"""SELECT operation_id, memory_id, new_score, old_rank, cast(new_rank AS INTEGER) AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY operation_id ORDER BY new_score DESC, memory_id) AS new_rank FROM (
  SELECT operation_id, u.memory_id, max(round(0.38 * score + 0.08 * k.importance + 0.08 * k.stability + 0.12 * CASE WHEN len(q) > 0 THEN len(list_intersect(q, terms)) / len(q) ELSE 0 END + 0.18 * CASE WHEN len(names) > 0 THEN least(1.0, len(list_intersect(names, w)) / least(2, len(names))) ELSE 0 END + 0.10 * rating + 0.16 * superseding + 0.03 * trust, 6)) AS new_score, min(rank) AS old_rank
  FROM (SELECT *, {_STEMS("query")} AS q, {_CONTENT("query")} AS w FROM uses WHERE score IS NOT NULL AND NOT isnan(score)) u JOIN (
    SELECT mem.id, {_STEMS("text")} AS terms, {_CONTENT("replace(regexp_replace(list_last(string_split(replace(lower(src.source), chr(92), '/'), '/')), '[.][a-z0-9]+$', ''), '_', ' ')")} AS names, CASE WHEN importance BETWEEN 0 AND 1 THEN importance ELSE 0 END AS importance, CASE WHEN stability BETWEEN 0 AND 1 THEN stability ELSE 0 END AS stability,
      CASE WHEN coalesce(mean_rating, 0) >= 0 THEN least(1.0, coalesce(mean_rating, 0) / 2) ELSE greatest(-1.0, mean_rating) END * least(1.0, coalesce(fbm.n, 0) / 3) AS rating,
      least(0.8, coalesce(o, 0) / 4) - least(0.9, coalesce(i, 0) / 4) AS superseding, CASE WHEN r.m IS NULL THEN 0 ELSE greatest(-1.0, least(1.0, r.m / 2)) END AS trust
    FROM mem LEFT JOIN src ON src.id = mem.id LEFT JOIN fbm ON fbm.memory_id = mem.id LEFT JOIN (SELECT id, sum(weight_out) AS o, sum(weight_in) AS i FROM ends WHERE type IN ('supersedes', 'corrects') GROUP BY 1) s ON s.id = mem.id
      LEFT JOIN (SELECT source, round(avg(rating), 6) AS m FROM fb JOIN src ON src.id = memory_id WHERE rating IS NOT NULL AND source IS NOT NULL GROUP BY 1) r ON r.source = src.source
    WHERE live = 0) k ON k.id = u.memory_id GROUP BY 1, 2)) WHERE new_rank <= 5""", "mem", "src", "fbm", "ends", "uses")
def _(s: SparkSession, d: str) -> DataFrame:
    log = M.log(s, d)
    return J.rerank(M.uses(M.asks(log)), M.memories(s, d), M.sources(s, d), M.feedback(log), M.edges(s, d)).select("operation_id", "memory_id", "new_score", "old_rank", "new_rank")


@query("fp_03_scope_report", "SELECT operation_id, count(*) AS results, count(*) FILTER (mem.namespace = uses.namespace OR mem.namespace = 'global') AS in_scope, count(DISTINCT source) AS sources FROM uses JOIN mem ON mem.id = memory_id LEFT JOIN src ON src.id = memory_id GROUP BY 1", "uses", "mem", "src")
def _(s: SparkSession, d: str) -> DataFrame:
    return J.scope_report(M.uses(_asks(s, d)), M.memories(s, d), M.sources(s, d))


@query("gr_02_authority", """, sup AS (SELECT DISTINCT source, target FROM edges WHERE type IN ('supersedes', 'corrects') AND source IN (SELECT id FROM mem WHERE live = 0) AND target IN (SELECT id FROM mem WHERE live = 0)),
counted AS (SELECT id, sum(o) AS links_out, sum(1 - o) AS links_in FROM (SELECT source AS id, 1 AS o FROM sup UNION ALL SELECT target, 0 FROM sup) GROUP BY 1),
above AS (SELECT id AS current_id, id FROM counted WHERE links_in = 0 UNION SELECT current_id, target FROM above JOIN sup ON source = id),
ways AS (SELECT id, 0 AS k FROM counted WHERE links_in = 0 UNION SELECT target, k + 1 FROM ways JOIN sup ON source = id WHERE k < 64),
walks AS (SELECT id, 0 AS k FROM counted UNION SELECT target, k + 1 FROM walks JOIN sup ON source = id WHERE k < 64)
SELECT id, CASE WHEN links_in = 0 THEN 'current' WHEN a IS NULL THEN 'loop' ELSE 'superseded' END AS state, cast(links_out AS BIGINT) AS links_out, cast(links_in AS BIGINT) AS links_in, a AS first_current_id, b AS last_current_id, cast(near AS BIGINT) AS near, cast(nullif(k, 64) AS BIGINT) AS chain
FROM counted LEFT JOIN (SELECT id, min(current_id) AS a, max(current_id) AS b FROM above GROUP BY 1) USING (id) LEFT JOIN (SELECT id, min(k) AS near FROM ways GROUP BY 1) USING (id) LEFT JOIN (SELECT id, max(k) AS k FROM walks GROUP BY 1) USING (id)""", "edges", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    return G.authority(M.edges(s, d), M.memories(s, d))


SQL["gr_02_authority"] = SQL["gr_02_authority"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("gr_03_current_of_asks", """, sup AS (SELECT DISTINCT source, target FROM edges WHERE type IN ('supersedes', 'corrects') AND source IN (SELECT id FROM mem WHERE live = 0) AND target IN (SELECT id FROM mem WHERE live = 0)),
above AS (SELECT id AS current_id, id FROM mem WHERE live = 0 AND id NOT IN (SELECT target FROM sup) UNION SELECT current_id, target FROM above JOIN sup ON source = id)
SELECT operation_id, count(DISTINCT u.id) AS results, count(DISTINCT u.id) FILTER (current_id <> u.id) AS superseded, CASE WHEN count(DISTINCT current_id) = 1 THEN min(current_id) END AS current_id
FROM (SELECT DISTINCT operation_id, memory_id AS id FROM uses WHERE memory_id IN (SELECT id FROM mem WHERE live = 0)) u LEFT JOIN above USING (id) GROUP BY 1""", "uses", "edges", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    return G.current_of_asks(M.uses(_asks(s, d)), M.edges(s, d), M.memories(s, d))


SQL["gr_03_current_of_asks"] = SQL["gr_03_current_of_asks"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("gr_04_stale_companions", """SELECT operation_id, target, weight, cast(rank AS INTEGER) AS rank FROM (SELECT operation_id, target, weight, row_number() OVER (PARTITION BY operation_id ORDER BY weight DESC NULLS LAST, target) AS rank FROM (
  SELECT operation_id, e.target, max(e.weight) AS weight FROM (SELECT DISTINCT operation_id, memory_id FROM uses) u JOIN edges e ON e.source = memory_id AND type IN ('supersedes', 'corrects', 'updates') GROUP BY 1, 2) c
  WHERE (operation_id, target) NOT IN (SELECT operation_id, memory_id FROM uses) AND target IN (SELECT id FROM mem WHERE live = 0)) WHERE rank <= 3""", "uses", "edges", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    return G.stale_companions(M.uses(_asks(s, d)), M.edges(s, d), M.memories(s, d))


@query("gr_09_link_shape", """SELECT type, links, both_ways, memories, middle FROM (SELECT e.type, count(*) AS links, count(b.source) AS both_ways FROM edges e LEFT JOIN edges b ON b.source = e.target AND b.target = e.source AND b.type = e.type GROUP BY 1)
  JOIN (SELECT type, count(*) AS memories, count(*) FILTER (links_out > 0 AND links_in > 0) AS middle FROM ends GROUP BY 1) USING (type)""", "edges", "ends")
def _(s: SparkSession, d: str) -> DataFrame:
    return G.link_shape(M.edges(s, d))


@query("tf_01_tokens", f"SELECT id, len({_TOKENS('text')}) AS tokens, len({_CONTENT('text')}) AS content_tokens, len({_STEMS('text')}) AS stems FROM mem", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.size(c).cast("long")
    return M.memories(s, d).select("id", n(T.token_set("text")).alias("tokens"), n(T.content_tokens("text")).alias("content_tokens"), n(T.stems("text")).alias("stems"))


@query("tf_16_entities", r"SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[:24], ',') AS entities FROM (SELECT id, regexp_extract_all(coalesce(text, ''), '\b[A-Z][A-Za-z0-9_-]{2,}') AS l FROM mem)", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.memories(s, d).select("id", F.array_join(T.entities("text"), ",").alias("entities"))


@query("tf_26_preview", r"SELECT id, CASE WHEN length(t) > 80 THEN rtrim(t[:77]) || '...' ELSE t END AS preview FROM (SELECT id, trim(regexp_replace(text, '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS t FROM mem)", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    return M.memories(s, d).select("id", T.preview("text", 80).alias("preview"))


@query("tf_10_query_overlap", f"SELECT operation_id, memory_id, round(CASE WHEN len(list_distinct(list_concat(q, t))) > 0 THEN len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))) ELSE 0 END, 6) AS jaccard, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END, 6) AS coverage FROM (SELECT operation_id, memory_id, {_STEMS('query')} AS q, {_STEMS('text')} AS t FROM uses JOIN mem ON mem.id = memory_id)", "uses", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = M.uses(_asks(s, d)).select("operation_id", "memory_id", T.stems("query").alias("q")).join(M.memories(s, d).select(F.col("id").alias("memory_id"), T.stems("text").alias("t")), "memory_id")
    q, t = F.col("q"), F.col("t")
    return rows.select("operation_id", "memory_id", F.round(T.jaccard(q, t), 6).alias("jaccard"), F.round(T.coverage(q, t), 6).alias("coverage"))


@query("mf_06_anchor_distance", f"WITH {_CTE['mem']}, {_USABLE_SQL} SELECT mem.id, domain_id, round(list_cosine_similarity(e, anchor_vector), 6) AS cosine, round(list_distance(e, anchor_vector), 6) AS distance, round(sqrt(list_inner_product(e, e)), 6) AS norm FROM mem JOIN usable USING (id) JOIN (SELECT {_KEY('id')} AS did, anchor_vector FROM domains WHERE len(list_filter(anchor_vector, lambda x: x IS NULL)) = 0) ON did = domain_id AND len(anchor_vector) = dim")
def _(s: SparkSession, d: str) -> DataFrame:
    """Cosine and distance of each memory's vector to its own domain's anchor, where both have one length."""
    rows = _usable(s, d).join(M.memories(s, d).select("id", "domain_id"), "id").join(_domains(s, d).select("domain_id", "anchor_vector"), "domain_id").where((F.size("anchor_vector") == F.size("embedding")) & ~F.exists("anchor_vector", lambda x: x.isNull()))
    e, a = F.col("embedding"), F.col("anchor_vector")
    return rows.select("id", "domain_id", F.round(V.cosine(e, a), 6).alias("cosine"), F.round(V.euclidean(e, a), 6).alias("distance"), F.round(V.norm(e), 6).alias("norm"))


@query("la_39_linked_feedback", "SELECT fb.operation_id, fb.linked_operation_id, label, rating, asks.confidence, asks.operation_id IS NOT NULL AS accept FROM fb LEFT JOIN asks ON asks.operation_id = fb.linked_operation_id", "fb", "asks")
def _(s: SparkSession, d: str) -> DataFrame:
    log = M.log(s, d)
    return O.linked(M.asks(log), M.feedback(log)).select("operation_id", "linked_operation_id", "label", "rating", "confidence", "accept")


@query("jn_17_packets", """SELECT operation_id, confidence, cast(coalesce(feedback, 0) AS BIGINT) AS feedback, mean_rating, labels, first_us - at_us AS micros_to_first FROM asks LEFT JOIN (
  SELECT op, sum(n) AS feedback, round(sum(total) / nullif(sum(rated), 0), 6) AS mean_rating, string_agg(coalesce(label, 'none') || '=' || n, ',' ORDER BY coalesce(label, 'none') || '=' || n) AS labels, min(f) AS first_us FROM (SELECT linked_operation_id AS op, label, count(*) AS n, sum(rating) AS total, count(rating) AS rated, min(at_us) AS f FROM fb GROUP BY 1, 2) WHERE op IS NOT NULL GROUP BY 1) ON op = operation_id""", "asks", "fb")
def _(s: SparkSession, d: str) -> DataFrame:
    log = M.log(s, d)
    return O.packets(M.asks(log), M.feedback(log))


@query("la_01_bad_terms", f"""SELECT term, count(*) FILTER (bad) AS bad, count(*) AS events, count(DISTINCT query) FILTER (bad) AS queries, count(DISTINCT label) FILTER (bad) AS labels, round(count(*) FILTER (bad) / count(*), 6) AS bad_share FROM (
  SELECT label, query, label IN ('missing_source', 'stale', 'wrong', 'wrong_domain') AS bad, unnest({_CONTENT("query")}) AS term FROM fb WHERE query IS NOT NULL AND label IS NOT NULL) GROUP BY term HAVING count(*) FILTER (bad) >= 3""", "fb")
def _(s: SparkSession, d: str) -> DataFrame:
    return O.term_counts(_fb(s, d))


@query("tk_07_frequent_terms", f"SELECT memory_type, term, n, cast(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY n DESC, term) AS rank FROM (SELECT memory_type, term, count(*) AS n FROM (SELECT memory_type, unnest({_CONTENT('text')}) AS term FROM mem WHERE memory_type IS NOT NULL) GROUP BY 1, 2)) WHERE rank <= 10", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    return O.frequent_terms(M.memories(s, d), "memory_type", "text")


_MONTH = "(year(make_timestamp(at_us)) * 12 + month(make_timestamp(at_us)))"


@query("la_09_readiness", f"""SELECT label, scope, events, queries, months, CASE WHEN events >= 3 AND queries >= 2 AND months >= 2 THEN 'ready' WHEN events >= 3 AND queries >= 2 THEN 'hold' ELSE 'reject' END AS verdict FROM (
  SELECT label, scope, count(*) AS events, count(DISTINCT query) AS queries, count(DISTINCT {_MONTH}) AS months FROM fb WHERE label IS NOT NULL GROUP BY 1, 2)""", "fb")
def _(s: SparkSession, d: str) -> DataFrame:
    return O.readiness(_fb(s, d))


_LABELS = ("missing_source", "sensitive_lookup", "should_be_current", "stale", "useful", "wrong", "wrong_domain")


@query("la_65_monthly_labels", "SELECT coalesce(strftime(make_timestamp(at_us), '%Y-%m'), 'unknown') AS month, " + ", ".join(f"count(*) FILTER (label = '{x}') AS {x}" for x in _LABELS) + " FROM fb GROUP BY 1", "fb")
def _(s: SparkSession, d: str) -> DataFrame:
    return O.monthly_labels(_fb(s, d), _LABELS)


@query("la_68_running_rating", "SELECT operation_id, memory_id, count(*) OVER w AS so_far, round(avg(rating) OVER w, 6) AS mean_so_far FROM fb WHERE memory_id IS NOT NULL AND rating IS NOT NULL AND at_us IS NOT NULL WINDOW w AS (PARTITION BY memory_id ORDER BY at_us, operation_id ROWS UNBOUNDED PRECEDING)", "fb")
def _(s: SparkSession, d: str) -> DataFrame:
    return O.running_rating(_fb(s, d))


@query("la_30_threshold_sweep", """SELECT threshold, tp AS true_positives, fp AS false_positives, p - tp AS false_negatives, n - fp AS true_negatives, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(p, 0), 6) AS recall FROM (
  SELECT t.k / 10 AS threshold, count(*) FILTER (positive AND step >= k) AS tp, count(*) FILTER (NOT positive AND step >= k) AS fp, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM (SELECT unnest(range(11)) AS k) t LEFT JOIN (
    SELECT least(10, greatest(0, floor(round(a.confidence * 10, 9)))) AS step, rating > 0 AS positive FROM fb JOIN asks a ON a.operation_id = fb.linked_operation_id WHERE a.confidence IS NOT NULL AND rating IS NOT NULL) x ON true GROUP BY 1)""", "fb", "asks")
def _(s: SparkSession, d: str) -> DataFrame:
    """How well an ask's confidence tells that its feedback is good."""
    log = M.log(s, d)
    rows = O.linked(M.asks(log), M.feedback(log)).where("accept").select("confidence", (F.col("rating") > 0).alias("positive"))
    return O.threshold_sweep(rows, "confidence", "positive")


@query("la_19_naive_bayes", f""", x AS (SELECT id, memory_type AS label, {_CONTENT("text")} AS t, cast(concat('0x', substr(md5(id), 1, 8)) AS BIGINT) % 5 AS fold FROM mem WHERE memory_type IS NOT NULL), f AS (SELECT unnest(range(5)) AS f), u AS (SELECT id, fold, label, unnest(t) AS w FROM x),
c AS (SELECT f AS fold, label, w, count(*) AS n FROM u JOIN f ON fold <> f GROUP BY 1, 2, 3), l AS (SELECT f AS fold, label, count(*) AS docs FROM x JOIN f ON fold <> f GROUP BY 1, 2),
m AS (SELECT fold, label, ln(docs / sum(docs) OVER (PARTITION BY fold)) AS prior, coalesce(terms, 0) AS terms, v FROM l LEFT JOIN (SELECT fold, label, sum(n) AS terms FROM c GROUP BY 1, 2) USING (fold, label) LEFT JOIN (SELECT fold, count(DISTINCT w) AS v FROM c GROUP BY 1) USING (fold)),
h AS (SELECT id, fold, w FROM u WHERE (fold, w) IN (SELECT (fold, w) FROM c)), k AS (SELECT id, count(*) AS words FROM h GROUP BY 1),
g AS (SELECT id, m.label AS p, sum(ln((n + 1) / (terms + v)) - ln(1 / (terms + v))) AS gain FROM h JOIN c USING (fold, w) JOIN m ON m.fold = h.fold AND m.label = c.label GROUP BY 1, 2),
s AS (SELECT x.id, x.label, m.label AS p, round(prior + coalesce(gain, 0) + coalesce(words, 0) * ln(1 / (terms + v)), 6) AS s FROM x JOIN m USING (fold) LEFT JOIN g ON g.id = x.id AND g.p = m.label LEFT JOIN k ON k.id = x.id)
SELECT label, predicted, count(*) AS n FROM (SELECT id, label, first(p ORDER BY s DESC, p) AS predicted FROM s GROUP BY 1, 2) GROUP BY 1, 2""", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """Memory types told from terms: how often each is taken for which."""
    samples = M.memories(s, d).select("id", F.col("memory_type").alias("label"), T.content_tokens("text").alias("terms"))
    return O.confusion(O.naive_bayes(samples))


@query("la_35_nearest_centroid", """WITH x AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS e, cast(concat('0x', substr(md5(cast(vec_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS fold FROM embeddings),
f AS (SELECT unnest(range(5)) AS f), m AS (SELECT f, label, list(v ORDER BY i) AS mean FROM (SELECT f, label, i, avg(x) AS v FROM (SELECT label, fold, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM x) JOIN f ON fold <> f GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT vec_id, x.label, m.label AS l, round(list_cosine_similarity(e, mean), 6) AS c FROM x JOIN m ON f = fold) SELECT vec_id, label, first(l ORDER BY c DESC, l) AS predicted, round(max(c) - list_sort(list(c), 'DESC')[2], 6) AS margin FROM s GROUP BY 1, 2""")
def _(s: SparkSession, d: str) -> DataFrame:
    return O.nearest_centroid(table(s, d, "embeddings"))
