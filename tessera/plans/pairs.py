"""Queries over similar claims, texts that asks have missed, phrases, and trained scorers over all folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import phrases
from tessera.operators import outcomes as O
from tessera.operators.geometry import loops, main_directions
from tessera.operators.pairs import claims, numbered, similar_groups, similar_pairs
from tessera.plans import memory as P
from tessera.plans.memory import _CTE, _STEMS, _STOP, _TOKENS, _USABLE_SQL, _asks, _usable, _with
from tessera.sources import memory as M
from tessera.sources.tables import table

QUERIES: dict[str, P.Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f: P.Query) -> P.Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_CLAIMS_SQL = f"""WITH RECURSIVE {_CTE["mem"]}, {_USABLE_SQL},
c AS (SELECT domain_id, t, first(id ORDER BY q DESC, id) AS id, count(*) AS copies FROM (SELECT id, domain_id, list_sort({_TOKENS("text")}) AS t, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence ELSE 0 END AS q FROM mem WHERE live = 0 AND text IS NOT NULL) WHERE len(t) > 0 GROUP BY 1, 2),
v AS (SELECT c.id, coalesce(domain_id, '') AS g, t, e, dim FROM c JOIN usable USING (id)),
pairs AS (SELECT * FROM (SELECT a.id AS left_id, b.id AS right_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS jaccard
  FROM v a JOIN v b ON a.g = b.g AND a.dim = b.dim AND a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.89) WHERE cosine >= 0.9 AND jaccard >= 0.8)"""


def _claims(s: SparkSession, d: str) -> DataFrame:
    q = F.when(F.col("confidence").between(0, 1), F.col("confidence")).otherwise(F.lit(0.0))
    return claims(M.active(M.memories(s, d)).select("id", "domain_id", "text", q.alias("quality")))


@query("jn_12_similar_claims", f"{_CLAIMS_SQL} SELECT * FROM pairs")
def _(s: SparkSession, d: str) -> DataFrame:
    """Claims of active memories in one domain that are near by vector and share most words."""
    return similar_pairs(_claims(s, d), _usable(s, d))


@query("jn_13_similar_groups", f"""{_CLAIMS_SQL}, ways AS (SELECT left_id AS a, right_id AS b FROM pairs UNION ALL SELECT right_id, left_id FROM pairs),
r AS (SELECT id, id AS o FROM c UNION SELECT b, o FROM r JOIN ways ON a = r.id), g AS (SELECT id, min(o) AS group_id FROM r GROUP BY 1), n AS (SELECT group_id, count(*) AS group_claims FROM g GROUP BY 1)
SELECT c.id AS keeper_id, domain_id, copies, coalesce(k, 0) AS links, group_id, group_claims FROM c JOIN g ON g.id = c.id JOIN n USING (group_id) LEFT JOIN (SELECT a, count(*) AS k FROM ways GROUP BY 1) w ON w.a = c.id""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Every claim with the group of similar ones it belongs to."""
    rows = numbered(_claims(s, d))
    return similar_groups(rows, similar_pairs(rows, _usable(s, d)))


_WORDS = f"list_filter({_TOKENS('query').replace('list_distinct(', '(', 1)}, lambda w: w NOT IN ({_STOP}))"
_RUNS = lambda n: f"list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(t[i:i + {n - 1}], ' '))"


@query("wf_08_phrases", f"{_with('asks')} SELECT phrase, count(*) AS asks FROM (SELECT unnest(list_distinct(list_concat({_RUNS(1)}, {_RUNS(2)}, {_RUNS(3)}))) AS phrase FROM (SELECT {_WORDS} AS t FROM asks)) GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """In how many asks each phrase of one to three words is."""
    return _asks(s, d).select(F.explode(phrases("query")).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("asks"))


@query("wf_07_longest_phrases", f"{_with('asks')} SELECT operation_id, list_distinct(list_concat({_RUNS(3)}, {_RUNS(2)})).list_sort().array_to_string('|') AS phrases FROM (SELECT operation_id, {_WORDS} AS t FROM asks)")
def _(s: SparkSession, d: str) -> DataFrame:
    """The phrases of two and three words of each ask, in alphabetical order."""
    return _asks(s, d).select("operation_id", F.array_join(F.array_sort(phrases("query", 3, 2)), "|").alias("phrases"))


@query("la_20_softmax")
def _(s: SparkSession, d: str) -> DataFrame:
    """How often each label of embeddings is taken for which by a softmax model of the other folds."""
    return O.confusion(O.softmax(table(s, d, "embeddings")))


@query("og_01_loops")
def _(s: SparkSession, d: str) -> DataFrame:
    """Loops of three neighbouring domains, and how far their main directions fail to fit."""
    rows = _usable(s, d).join(M.memories(s, d).select("id", F.col("domain_id").alias("group")), "id")
    return loops(main_directions(rows))


@query("la_32_two_thresholds", f"""{_with("fb", "asks", "uses")}, r AS (SELECT confidence, score, rating > 0 AS good FROM fb JOIN asks ON asks.operation_id = linked_operation_id JOIN (SELECT operation_id, memory_id, max(score) AS score FROM uses GROUP BY 1, 2) u ON u.operation_id = linked_operation_id AND u.memory_id = fb.memory_id WHERE rating IS NOT NULL AND confidence IS NOT NULL AND score IS NOT NULL),
g AS (SELECT a / 10 AS first_threshold, b / 10 AS second_threshold FROM (SELECT unnest(range(11)) AS a), (SELECT unnest(range(11)) AS b)) SELECT first_threshold, second_threshold, count(confidence) AS passed, count(*) FILTER (good) AS passed_positive FROM g LEFT JOIN r
ON least(greatest(floor(round(confidence * 10, 9)), 0), 10) >= round(first_threshold * 10) AND least(greatest(floor(round(score * 10, 9)), 0), 10) >= round(second_threshold * 10) GROUP BY 1, 2""")
def _(s: SparkSession, d: str) -> DataFrame:
    """How much of the rated results, and of the good ones, two thresholds let through: the ask's confidence and the result's score."""
    log = M.log(s, d)
    asks = M.asks(log)
    u = M.uses(asks).groupBy("operation_id", "memory_id").agg(F.max("score").alias("score"))
    rated = M.feedback(log).where("rating is not null").select(F.col("linked_operation_id").alias("operation_id"), "memory_id", (F.col("rating") > 0).alias("good"))
    return O.two_thresholds(rated.join(u, ["operation_id", "memory_id"]).join(asks.select("operation_id", "confidence"), "operation_id"), "confidence", "score", "good")


@query("la_43_source_scores", f"""{_with("fb", "uses", "src")} SELECT operation_id, count(*) AS expected, count(there) AS present FROM (SELECT DISTINCT linked_operation_id AS operation_id, source FROM fb JOIN src ON src.id = fb.memory_id WHERE rating > 0 AND source IS NOT NULL AND linked_operation_id IS NOT NULL)
LEFT JOIN (SELECT DISTINCT operation_id, source, true AS there FROM uses JOIN src ON src.id = memory_id WHERE source IS NOT NULL) USING (operation_id, source) GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """How many of the sources that an ask's good feedback names are among its results."""
    log = M.log(s, d)
    return O.source_scores(M.uses(M.asks(log)), M.feedback(log), M.sources(s, d))


_B = r"[\s\x1c-\x1f\x{85}\p{Z}]"


@query("tf_25_best_pieces", f"""{_with("uses", "mem")}, p AS (SELECT operation_id, memory_id, rank, query, unnest(l) AS piece, generate_subscripts(l, 1) AS pos FROM (SELECT operation_id, memory_id, rank, query, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?]){_B}+', '\\1' || chr(10), 'g'), '[\\r\\n]+'), lambda x: regexp_replace(x, '^{_B}+|{_B}+$', '', 'g')), lambda x: length(x) > 0) AS l FROM uses JOIN mem ON mem.id = memory_id WHERE query IS NOT NULL AND text IS NOT NULL)),
q AS (SELECT *, {_STEMS("query")} AS a, {_STEMS("piece")} AS b FROM p), r AS (SELECT *, round(len(list_intersect(a, b)) + CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END, 6) AS score FROM q)
SELECT operation_id, memory_id, piece, score FROM (SELECT *, row_number() OVER (PARTITION BY operation_id ORDER BY score DESC, rank NULLS LAST, memory_id, pos, piece) AS v FROM r) WHERE v = 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """The sentence of each ask's results that has most of the query's words."""
    return O.best_pieces(M.uses(_asks(s, d)), M.memories(s, d))
