"""Queries that combine operators: drift, geometry, votes, conflicts, upserts, measures, and reports over the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.functions.hashing import hash_embeddings
from tessera.functions.keys import epoch_micros, month_of, strip
from tessera.operators import aggregates as A
from tessera.operators import joins as J
from tessera.operators import outcomes as O
from tessera.operators.geometry import smoothed, subspace_geometry
from tessera.operators.search import nearest_anchor, top_k
from tessera.operators.upserts import merged, new_rows
from tessera.plans import memory as P
from tessera.plans.memory import _CTE, _KEY, _USABLE_SQL, _asks, _domains, _fb, _usable, _with
from tessera.sources import memory as M
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


_ANCHORS = f"anchors AS (SELECT {_KEY('id')} AS anchor_id, anchor_vector, effective_dimension FROM domains WHERE len(list_filter(anchor_vector, lambda x: x IS NULL)) = 0)"
_NEAREST = f"{_USABLE_SQL}, {_ANCHORS}, near AS (SELECT id, first(anchor_id ORDER BY c DESC, anchor_id) AS anchor_id, max(c) AS cosine FROM (SELECT u.id, anchor_id, round(list_cosine_similarity(e, anchor_vector), 6) AS c FROM usable u JOIN anchors ON len(anchor_vector) = dim) GROUP BY 1)"


def _anchors(s: SparkSession, d: str) -> DataFrame:
    return _domains(s, d).where(F.col("anchor_vector").isNotNull() & ~F.exists("anchor_vector", lambda x: x.isNull())).select(F.col("domain_id").alias("anchor_id"), F.col("anchor_vector").alias("anchor"))


@query("in_01_drift_signals", f"""WITH {_CTE['mem']}, {_NEAREST} SELECT mem.id, round(list_distance(e, anchor_vector), 6) AS raw_drift, round(list_distance(e, anchor_vector) / (sqrt(effective_dimension) + 1e-9), 6) AS semantic_drift, round(1 - greatest(0, cosine), 6) AS domain_shift
FROM mem JOIN usable USING (id) JOIN near USING (id) JOIN anchors a ON a.anchor_id = domain_id AND len(anchor_vector) = dim""")
def _(s: SparkSession, d: str) -> DataFrame:
    """How far each memory lies from its own domain's anchor, and from the nearest anchor."""
    v = _usable(s, d)
    own = _domains(s, d).join(_anchors(s, d), F.col("domain_id") == F.col("anchor_id")).select("domain_id", "anchor", "effective_dimension")
    rows = v.join(M.memories(s, d).select("id", "domain_id"), "id").join(own, "domain_id").where(F.size("anchor") == F.size("embedding"))
    far = V.euclidean(F.col("embedding"), F.col("anchor"))
    rows = rows.join(nearest_anchor(v, _anchors(s, d)).select("id", "cosine"), "id")
    return rows.select("id", F.round(far, 6).alias("raw_drift"), F.round(far / (F.sqrt("effective_dimension") + 1e-9), 6).alias("semantic_drift"), F.round(1 - F.greatest(F.lit(0.0), "cosine"), 6).alias("domain_shift"))


@query("wf_09_domain_drift", f"""WITH {_CTE['mem']}, {_USABLE_SQL}, {_ANCHORS}, x AS (SELECT domain_id, list_distance(e, anchor_vector) AS x, row_number() OVER (PARTITION BY domain_id ORDER BY created_at DESC, id DESC) - 1 AS back
  FROM mem JOIN usable USING (id) JOIN anchors ON anchor_id = domain_id AND len(anchor_vector) = dim WHERE created_at IS NOT NULL) SELECT domain_id, count(*) AS n, round(sum(x * 0.05 * pow(0.95, back)), 6) AS mean FROM x GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Exponential mean of the distance from the domain's anchor, in order of creation."""
    rows = _usable(s, d).join(M.memories(s, d).select("id", "domain_id", "created_at"), "id").join(_anchors(s, d).withColumnRenamed("anchor_id", "domain_id"), "domain_id").where(F.size("anchor") == F.size("embedding"))
    far = V.euclidean(F.col("embedding"), F.col("anchor"))
    at = epoch_micros("created_at")
    return smoothed(rows.select("domain_id", "id", at.alias("at"), month_of(at).alias("month"), far.alias("far")), "domain_id", "month", ["at", "id"], "far")


@query("og_02_domain_geometry")
def _(s: SparkSession, d: str) -> DataFrame:
    """Main directions of each domain's vectors."""
    rows = _usable(s, d).join(M.memories(s, d).select("id", F.col("domain_id").alias("group")), "id")
    return subspace_geometry(rows)


@query("og_05_bridges", f"WITH {_CTE['mem']}, {_NEAREST} SELECT anchor_id, count(*) AS n, count(DISTINCT domain_id) AS domains, count(*) FILTER (domain_id = anchor_id) AS own, count(DISTINCT domain_id) >= 5 AS bridge FROM near LEFT JOIN mem USING (id) GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """Regions around the anchors whose memories come from many domains."""
    near = nearest_anchor(_usable(s, d), _anchors(s, d)).join(M.memories(s, d).select("id", "domain_id"), "id", "left")
    return near.groupBy("anchor_id").agg(F.count("*").alias("n"), F.count_distinct("domain_id").alias("domains"), F.count_if(F.col("domain_id") == F.col("anchor_id")).alias("own")).withColumn("bridge", F.col("domains") >= 5)


@query("ps_03_votes", """WITH v AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT a.vec_id AS q, b.label, round(list_cosine_similarity(a.e, b.e), 6) AS c, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
t AS (SELECT q, label, round(sum(1 / (1 - c + 0.05)), 6) AS vote FROM n WHERE r <= 5 GROUP BY 1, 2) SELECT q AS vec_id, first(label ORDER BY vote DESC, label) AS predicted, max(vote) AS vote, round(max(vote) / sum(vote), 6) AS share FROM t GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """The label that the 5 nearest embeddings vote for, a vote weighing as much as it is near, for every embedding whose id 50 divides."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    near = top_k(e.where("id % 50 = 0"), e, 5).join(e.select("id", "label"), "id")
    votes = near.groupBy("query_id", "label").agg(F.round(F.sum(1 / (1 - F.col("cosine") + 0.05)), 6).alias("vote"))
    best = F.min(F.struct((-F.col("vote")).alias("v"), "label"))
    return votes.groupBy(F.col("query_id").alias("vec_id")).agg(best["label"].alias("predicted"), F.max("vote").alias("vote"), F.round(F.max("vote") / F.sum("vote"), 6).alias("share"))


@query("rs_15_field_conflicts", r"""SELECT namespace, field, count(DISTINCT value) AS "values", count(*) AS memories, min(value) AS first_value, max(value) AS last_value FROM (
  SELECT namespace, trim(regexp_extract(p, '^([^:=]*)[:=](.*)$', 1)) AS field, trim(regexp_extract(p, '^([^:=]*)[:=](.*)$', 2)) AS value FROM (SELECT namespace, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^\S\r\n]+|\x{a0}|\x{2003}', ' ', 'g'), '[;|\r\n]')) AS p FROM mem WHERE live = 0) WHERE regexp_matches(p, '^[^:=]*[:=].*$')) WHERE field <> '' AND value <> '' GROUP BY 1, 2 HAVING count(DISTINCT value) > 1""", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """Fields that active memories of one namespace give different values."""
    line = F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^\S\r\n]+|\xa0|\u2003", " "), r"[;|\r\n]")).alias("p")
    pair = M.active(M.memories(s, d)).select("namespace", line)
    part = lambda i: F.trim(F.regexp_extract("p", r"^([^:=]*)[:=](.*)$", i))
    rows = pair.select("namespace", part(1).alias("field"), part(2).alias("value")).where("field <> '' and value <> ''")
    return rows.groupBy("namespace", "field").agg(F.count_distinct("value").alias("values"), F.count("*").alias("memories"), F.min("value").alias("first_value"), F.max("value").alias("last_value")).where(F.col("values") > 1)


@query("la_26_probabilities", "SELECT label, count(*) AS n, round(avg(CASE WHEN (confidence >= 0.5) = (rating > 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(pow(confidence - CASE WHEN rating > 0 THEN 1 ELSE 0 END, 2)), 6) AS brier FROM fb JOIN asks ON asks.operation_id = fb.linked_operation_id WHERE rating IS NOT NULL AND confidence IS NOT NULL GROUP BY 1", "fb", "asks")
def _(s: SparkSession, d: str) -> DataFrame:
    """Accuracy and Brier score of the asks' confidence, per label of their feedback."""
    log = M.log(s, d)
    rows = O.linked(M.asks(log), M.feedback(log)).where("accept and rating is not null and confidence is not null")
    y = (F.col("rating") > 0).cast("double")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("confidence") >= 0.5) == (F.col("rating") > 0)).cast("double")), 6).alias("accuracy"), F.round(F.avg(F.pow(F.col("confidence") - y, F.lit(2))), 6).alias("brier"))


@query("la_51_rank_of_feedback", "SELECT coalesce(cast(u.rank AS VARCHAR), 'none') AS rank, count(*) AS feedback, count(*) FILTER (rating > 0) AS good FROM fb JOIN asks ON asks.operation_id = fb.linked_operation_id LEFT JOIN (SELECT operation_id, memory_id, min(rank) AS rank FROM uses GROUP BY 1, 2) u ON u.operation_id = fb.linked_operation_id AND u.memory_id = fb.memory_id GROUP BY 1", "fb", "asks", "uses")
def _(s: SparkSession, d: str) -> DataFrame:
    """At which rank of the ask's results the memory was that its feedback names."""
    log = M.log(s, d)
    asks = M.asks(log)
    ranks = M.uses(asks).groupBy(F.col("operation_id").alias("linked_operation_id"), "memory_id").agg(F.min("rank").alias("rank"))
    rows = O.linked(asks, M.feedback(log)).where("accept").join(ranks, ["linked_operation_id", "memory_id"], "left")
    return rows.groupBy(F.coalesce(F.col("rank").cast("string"), F.lit("none")).alias("rank")).agg(F.count("*").alias("feedback"), F.count_if(F.col("rating") > 0).alias("good"))


@query("la_33_bigrams", f"SELECT bigram, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS bigram FROM (SELECT {P._TOKENS('query').replace('list_distinct(', '(', 1)} AS t FROM asks)) GROUP BY 1 HAVING count(*) >= 5", "asks")
def _(s: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbouring words that five or more asks contain."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("query", F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: F.length(w) > 1)
    pairs = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    rows = _asks(s, d).select(words.alias("t")).select(F.explode(F.array_distinct(pairs)).alias("bigram"))
    return rows.groupBy("bigram").agg(F.count("*").alias("n")).where("n >= 5")


@query("jn_07_weak_memories", """SELECT id, round(least(1.0, w), 6) AS weakness, reasons FROM (SELECT mem.id,
  CASE WHEN source IS NULL THEN 0.2 ELSE 0 END + CASE WHEN confidence < 0.45 THEN 0.2 ELSE 0 END + CASE WHEN mean_rating < 0 THEN 0.3 ELSE 0 END + CASE WHEN coalesce(links_in, 0) > 0 THEN 0.25 ELSE 0 END AS w,
  concat_ws(',', CASE WHEN source IS NULL THEN 'no_source' END, CASE WHEN confidence < 0.45 THEN 'low_confidence' END, CASE WHEN mean_rating < 0 THEN 'bad_feedback' END, CASE WHEN coalesce(links_in, 0) > 0 THEN 'superseded' END) AS reasons
  FROM mem LEFT JOIN src USING (id) LEFT JOIN fbm ON memory_id = mem.id LEFT JOIN (SELECT id, sum(links_in) AS links_in FROM ends WHERE type IN ('supersedes', 'corrects') GROUP BY 1) l USING (id) WHERE live = 0) WHERE w > 0""", "mem", "src", "fbm", "ends")
def _(s: SparkSession, d: str) -> DataFrame:
    """Active memories with something against them, and what: sources, feedback and links are added up per memory before they are joined."""
    links = A.link_summary(M.edges(s, d).where(F.col("type").isin(*J.SUPERSEDING))).groupBy("id").agg(F.sum("links_in").alias("links_in"))
    rows = M.active(M.memories(s, d)).join(M.sources(s, d), "id", "left").join(A.feedback_by_memory(_fb(s, d)).withColumnRenamed("memory_id", "id"), "id", "left").join(links, "id", "left")
    signs = {"no_source": (F.col("source").isNull(), 0.2), "low_confidence": (F.col("confidence") < 0.45, 0.2), "bad_feedback": (F.col("mean_rating") < 0, 0.3), "superseded": (F.coalesce("links_in", F.lit(0)) > 0, 0.25)}
    weight = sum((F.when(c, w).otherwise(0.0) for c, w in signs.values()), F.lit(0.0))
    out = rows.select("id", F.round(F.least(F.lit(1.0), weight), 6).alias("weakness"), F.concat_ws(",", *(F.when(c, n) for n, (c, _) in signs.items())).alias("reasons"))
    return out.where("weakness > 0")


_COPIES = r"copies AS (SELECT id, claim, keeper_id FROM (SELECT id, trim(regexp_replace(lower(text), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS claim FROM mem WHERE text IS NOT NULL) JOIN claims USING (claim))"


@query("sk_19_exact_unique", f", {_COPIES} SELECT id, claim FROM copies WHERE id = keeper_id", "claims")
def _(s: SparkSession, d: str) -> DataFrame:
    """The memories that a copy of the table without exact duplicates keeps."""
    return A.exact_claims(M.memories(s, d)).select(F.col("keeper_id").alias("id"), "claim")


@query("sk_04_new_links", f", {_COPIES} SELECT keeper_id AS source, id AS target FROM copies WHERE id <> keeper_id AND (keeper_id, id) NOT IN (SELECT source, target FROM edges WHERE type = 'supersedes')", "claims", "edges")
def _(s: SparkSession, d: str) -> DataFrame:
    """Links from keepers to their exact copies that the table doesn't have yet."""
    m = M.memories(s, d)
    copies = m.where("text is not null").select(F.col("id").alias("target"), T.squeeze("text").alias("claim")).join(A.exact_claims(m).where("copies > 1").select("claim", F.col("keeper_id").alias("source")), "claim").where("source <> target")
    return new_rows(copies.select("source", "target"), M.edges(s, d).where("type = 'supersedes'"), ["source", "target"])


@query("sk_02_merged_domains", f"SELECT {_KEY('id')} AS domain_id, cast(coalesce(n.m, memory_count) AS BIGINT) AS memory_count, name FROM domains LEFT JOIN (SELECT domain_id, count(*) AS m FROM mem WHERE live = 0 GROUP BY 1) n ON n.domain_id = {_KEY('id')}", "mem")
def _(s: SparkSession, d: str) -> DataFrame:
    """The domains after an upsert of the numbers of their active memories."""
    have = _domains(s, d).select("domain_id", F.lit(0).alias("version"), F.col("memory_count").cast("long").alias("memory_count"), "name")
    counts = M.active(M.memories(s, d)).groupBy("domain_id").agg(F.count("*").alias("memory_count")).join(have.select("domain_id"), "domain_id", "left_semi")
    updates = counts.select("domain_id", F.lit(1).alias("version"), "memory_count", F.lit(None).cast("string").alias("name"))
    return merged(have, updates, "domain_id", "version").select("domain_id", "memory_count", "name")


@query("sc_23_hash_embeddings")
def _(s: SparkSession, d: str) -> DataFrame:
    """Hashed embeddings of the memories' texts."""
    return hash_embeddings(M.memories(s, d).select("id", "text"), 64)


@query("sc_02_json_lines", r"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^[\s\x1c-\x1f\x{85}\p{Z}]+|[\s\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') AS line FROM documents), j AS (SELECT doc_id, line FROM l WHERE line LIKE '{%' AND NOT regexp_matches(line, '\}\s*\{') AND json_valid(line))
SELECT line ->> '$.event' AS event, count(*) AS lines, count(DISTINCT doc_id) AS documents, round(avg(try_cast(line ->> '$.score' AS DOUBLE)), 6) AS mean_score FROM j GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Lines of the documents that are one JSON record each, by event."""
    lines = table(s, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim(strip("line")).alias("line"))
    good = lines.where(F.col("line").startswith("{") & ~F.col("line").rlike(r"\}\s*\{") & F.try_parse_json("line").isNotNull())
    return good.groupBy(F.get_json_object("line", "$.event").alias("event")).agg(F.count("*").alias("lines"), F.count_distinct("doc_id").alias("documents"), F.round(F.avg(F.get_json_object("line", "$.score").try_cast("double")), 6).alias("mean_score"))


def _revenue() -> Column:
    return F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")


@query("gen_01_pricing", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), _revenue(), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


@query("gen_05_regional_revenue", "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(s, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(_revenue())


@query("gen_18_large_orders", "SELECT o_orderkey, o_custkey, o_totalprice, qty, cast(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY qty DESC, o_orderkey) AS rank FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 150) ON l_orderkey = o_orderkey) WHERE rank <= 2")
def _(s: SparkSession, d: str) -> DataFrame:
    """The two largest orders over 150 pieces of each customer."""
    qty = table(s, d, "lineitem", "l_orderkey", "l_quantity").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty")).where("qty > 150")
    rows = table(s, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").join(qty, "o_orderkey")
    return J.top_per_key(rows, "o_custkey", [F.desc("qty"), F.col("o_orderkey")], 2)
