"""Queries of the problems with an llm tag, over the tables of a directory, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import norm_key
from tessera.llm.clusters import mutual_clusters, typical_clusters
from tessera.llm.components import connected_components
from tessera.llm.containers import pack, report
from tessera.llm.format_duplicates import duplicate_members, unique_records
from tessera.llm.mixture import mix
from tessera.llm.neighbours import close_pairs, nearest, recall
from tessera.llm.pieces import split_oversized
from tessera.llm.survivors import FIELDS, best_records
from tessera.sources.tables import table
from tessera.storage import cut

LINKING = ("supersedes", "corrects", "updates")


def _best(spark: SparkSession, d: str) -> DataFrame:
    """The built records, written once, so that what is read of them is of whole records."""
    memories = table(spark, d, "memories")
    return cut(best_records(memories, duplicate_members(memories)), "records")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("group_id", "survivor_id")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """The record built field by field for each group of duplicates."""
    return _best(spark, d).select("group_id", "copies", "survivor_id", *FIELDS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_members(table(spark, d, "memories", "id", "text", "namespace")).select("memory_id", "group_id")


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per note, with its number of copies."""
    return unique_records(table(spark, d, "memories", "id", "text", "namespace"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "relations", "source_memory_id", "target_memory_id", "relation_type")
    ends = r.where(norm_key("relation_type").isin(*LINKING)).select(norm_key("source_memory_id").alias("a"), norm_key("target_memory_id").alias("b"))
    return ends.where("a <> b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(_links(spark, d)).select(F.col("id").alias("memory_id"), F.col("component").alias("group_id"))


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Members of each group."""
    return connected_components(_links(spark, d)).groupBy(F.col("component").alias("group_id")).agg(F.count("*").alias("members"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vectors", "memory_id", "embedding", "dim")


def _memory_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories", "id").select(norm_key("id").alias("id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mutual_clusters(_vectors(spark, d), _memory_ids(spark, d))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members of each density cluster."""
    return typical_clusters(_vectors(spark, d), _memory_ids(spark, d)).withColumn("typical", F.array_join("typical", ","))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return close_pairs(_vectors(spark, d))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of every usable vector."""
    return nearest(_vectors(spark, d))


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the index against brute force for every 50th vector, by how near the wanted neighbour is."""
    return recall(_vectors(spark, d))


def _limit(spark: SparkSession, d: str, purpose: str) -> tuple[int, int]:
    row = table(spark, d, "size_limits").where(norm_key("purpose") == purpose).first()
    return row["max_tokens"], row["overlap_tokens"] or 0


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    capacity, _ = _limit(spark, d, "container")
    return pack(table(spark, d, "documents", "doc_id", "text"), capacity), capacity


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document or part of one."""
    return _packed(spark, d)[0]


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return report(*_packed(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    return _mixed(spark, d)[1].withColumn("actual_share", F.round("actual_share", 9))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = _limit(spark, d, "piece")
    pieces = split_oversized(table(spark, d, "documents", "doc_id", "text"), limit, overlap, texts=False)
    return pieces.where("piece_no = 1").select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all documents."""
    limit, overlap = _limit(spark, d, "piece")
    return split_oversized(table(spark, d, "documents", "doc_id", "text"), limit, overlap)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_records, p2_found, p2_records, p3_found, p3_sizes, p4_found, p4_clusters, p6_found, p6_neighbours, p6_recall, p7_containers, p7_fill, p8_mixture, p8_shares, p9_found, p9_pieces)}

_KEY = r"nullif(lower(regexp_replace({0}, '^[\s\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')), '')".format
_NOTES = rf"""notes AS (
  SELECT DISTINCT {_KEY("id")} AS id, coalesce({_KEY("namespace")}, 'global') AS ns, lower(text) AS low,
    list_filter(regexp_split_to_array(lower(text), '[;|\r\n\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda p: regexp_matches(p, '[\p{{L}}\p{{N}}]')) AS pieces
  FROM memories WHERE text IS NOT NULL
), canon AS (
  SELECT DISTINCT id, ns, CASE WHEN len(pieces) >= 2 AND len(list_filter(pieces, lambda p: NOT regexp_matches(p, '(?s)^[^:=]*[\p{{L}}\p{{N}}][^:=]*[:=].*[\p{{L}}\p{{N}}]'))) = 0
    THEN array_to_string(list_sort(list_transform(pieces, lambda p: trim(regexp_replace(p, '[^\p{{L}}\p{{N}}]+', ' ', 'g')))), chr(10))
    ELSE trim(regexp_replace(low, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) END AS note
  FROM notes WHERE id IS NOT NULL
), groups AS (SELECT ns, note, min(id) AS group_id, count(DISTINCT id) AS copies FROM canon GROUP BY ns, note
), members AS (SELECT DISTINCT id AS memory_id, group_id FROM canon JOIN groups USING (ns, note) WHERE copies > 1)"""

_CURRENT = f"""current AS (
  SELECT *, epoch_us(updated_at) AS since, CASE WHEN deprecated = 0 THEN 1 ELSE 0 END AS live, round(coalesce(confidence, 0) * coalesce(importance, 0), 6) AS score
  FROM (SELECT * REPLACE ({_KEY("id")} AS id, coalesce(deprecated, 0) AS deprecated, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS confidence, CASE WHEN importance BETWEEN 0 AND 1 THEN importance END AS importance) FROM memories)
), latest AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, live DESC, score DESC) AS v FROM current
), survivors AS (
  SELECT group_id, id AS survivor_id, count(*) OVER (PARTITION BY group_id) AS copies, row_number() OVER (PARTITION BY group_id ORDER BY live DESC, score DESC, updated_at DESC NULLS LAST, id) AS r
  FROM members JOIN latest ON id = memory_id AND v = 1
)"""

_USABLE = f"""usable AS (
  SELECT {_KEY("memory_id")} AS id, min(embedding) AS e, min(dim) AS dim FROM vectors
  WHERE len(embedding) = dim AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY 1 HAVING id IS NOT NULL AND count(DISTINCT embedding) = 1
)"""

_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}]+"

_MIX = rf"""sized AS (
  SELECT doc_id, {_KEY("source")} AS source, len(regexp_extract_all(text, '{_TOKEN}')) AS n FROM documents
), recipe AS (
  SELECT {_KEY("source")} AS source, sum(target_share) AS share, max(coalesce(max_repeats, 1)) AS repeats FROM mix_targets WHERE target_share > 0 GROUP BY 1
), docs AS (SELECT * FROM sized WHERE n > 0 AND source IN (SELECT source FROM recipe)
), have AS (SELECT source, sum(n) AS tokens, count(*) AS docs FROM docs GROUP BY 1
), most AS (SELECT min(tokens * repeats / share) AS m FROM recipe JOIN have USING (source)
), budgets AS (
  SELECT source, share, repeats, coalesce(tokens, 0) AS tokens, coalesce(docs, 0) AS docs,
    CASE WHEN tokens > 0 THEN least(cast(floor(round(m * share, 6)) AS BIGINT), tokens * repeats) ELSE 0 END AS budget
  FROM recipe LEFT JOIN have USING (source), most
), ranked AS (
  SELECT doc_id, d.source, n, sum(n) OVER (PARTITION BY d.source ORDER BY substr(md5('0:' || doc_id), 1, 15), doc_id ROWS UNBOUNDED PRECEDING) AS upto, tokens, budget
  FROM docs d JOIN budgets b ON d.source = b.source
), mixture AS (
  SELECT doc_id, source, cast(n AS BIGINT) AS n_tokens, cast(budget // tokens + CASE WHEN upto <= budget - (budget // tokens) * tokens THEN 1 ELSE 0 END AS BIGINT) AS uses FROM ranked
), used AS (SELECT source, count(*) AS docs_used, sum(n_tokens * uses) AS tokens_used FROM mixture WHERE uses > 0 GROUP BY 1)"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_NOTES}, {_CURRENT} SELECT group_id, survivor_id FROM survivors WHERE r = 1",
    "p1_records": f"""WITH {_NOTES}, {_CURRENT}, fields AS (
  SELECT group_id, {", ".join(f"struct_extract(max(struct_pack(l := live, s := score, a := coalesce(since, -4611686018427387904), v := {f})) FILTER ({f} IS NOT NULL), 'v') AS {f}" for f in FIELDS)}
  FROM members JOIN current ON id = memory_id GROUP BY group_id
) SELECT group_id, copies, survivor_id, {", ".join(FIELDS)} FROM survivors JOIN fields USING (group_id) WHERE r = 1""",
    "p2_found": f"WITH {_NOTES} SELECT memory_id, group_id FROM members",
    "p2_records": f"WITH {_NOTES} SELECT group_id, copies FROM groups",
    "p3_found": f"""WITH RECURSIVE links AS (
  SELECT DISTINCT {_KEY("source_memory_id")} AS a, {_KEY("target_memory_id")} AS b FROM relations WHERE {_KEY("relation_type")} IN ('supersedes', 'corrects', 'updates')
), both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b
), reach AS (SELECT a AS id, a AS r FROM both_ways UNION SELECT b, r FROM reach JOIN both_ways ON a = id)
SELECT id AS memory_id, min(r) AS group_id FROM reach GROUP BY id""",
    "p3_sizes": f"""WITH RECURSIVE links AS (
  SELECT DISTINCT {_KEY("source_memory_id")} AS a, {_KEY("target_memory_id")} AS b FROM relations WHERE {_KEY("relation_type")} IN ('supersedes', 'corrects', 'updates')
), both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b
), reach AS (SELECT a AS id, a AS r FROM both_ways UNION SELECT b, r FROM reach JOIN both_ways ON a = id)
SELECT group_id, count(*) AS members FROM (SELECT id, min(r) AS group_id FROM reach GROUP BY id) GROUP BY group_id""",
    "p6_found": f"""WITH {_USABLE}, s AS (
  SELECT a.id AS i, b.id AS j, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM usable a JOIN usable b ON a.dim = b.dim AND a.id <> b.id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS r FROM s)
SELECT DISTINCT least(i, j) AS memory_id_a, greatest(i, j) AS memory_id_b FROM ranked WHERE r <= 5 AND c >= 0.97""",
    "p4_found": f"""WITH RECURSIVE {_USABLE}, u AS (SELECT * FROM usable WHERE id IN (SELECT {_KEY("id")} FROM memories)
), s AS (SELECT a.id AS i, b.id AS j FROM u a JOIN u b ON a.dim = b.dim AND a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.8
), sets AS (SELECT i, list_sort(list_append(list(j), i)) AS members FROM s GROUP BY i
), same AS (SELECT members, count(*) AS n FROM sets GROUP BY members HAVING count(*) >= 6 AND count(*) = len(members))
SELECT unnest(members) AS memory_id, members[1] AS cluster_id FROM same""",
    "p4_clusters": f"""WITH RECURSIVE {_USABLE}, u AS (SELECT * FROM usable WHERE id IN (SELECT {_KEY("id")} FROM memories)
), s AS (SELECT a.id AS i, b.id AS j FROM u a JOIN u b ON a.dim = b.dim AND a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.8
), core AS (SELECT i FROM s GROUP BY i HAVING count(*) + 1 >= 6
), link AS (SELECT i, j FROM s WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)
), reach AS (SELECT i AS id, i AS r FROM core UNION SELECT j, r FROM reach JOIN link ON i = id
), comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id
), member AS (SELECT id, c FROM comp UNION ALL SELECT j, min(c) FROM s JOIN comp ON id = i WHERE j NOT IN (SELECT i FROM core) GROUP BY j
), sized AS (SELECT id, c, count(*) OVER (PARTITION BY c) AS size, min(id) OVER (PARTITION BY c) AS cluster_id FROM member
), score AS (SELECT a.id, a.cluster_id, a.size, round(sum(list_cosine_similarity(x.e, y.e)) / a.size, 6) AS typical FROM sized a JOIN sized b ON a.c = b.c JOIN u x ON x.id = a.id JOIN u y ON y.id = b.id GROUP BY 1, 2, 3
), ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY typical DESC, id) AS r FROM score)
SELECT cluster_id, size, string_agg(id, ',' ORDER BY r) AS typical FROM ranked WHERE size >= 6 AND r <= 3 GROUP BY 1, 2""",
    "p8_mixture": f"WITH {_MIX} SELECT doc_id, source, n_tokens, uses FROM mixture WHERE uses > 0",
    "p8_shares": f"""WITH {_MIX} SELECT source, share AS target_share, cast(repeats AS BIGINT) AS max_repeats, cast(docs AS BIGINT) AS docs, cast(tokens AS BIGINT) AS tokens, cast(budget AS BIGINT) AS budget,
  cast(coalesce(docs_used, 0) AS BIGINT) AS docs_used, cast(coalesce(tokens_used, 0) AS BIGINT) AS tokens_used, round(coalesce(tokens_used, 0) / sum(tokens_used) OVER (), 9) AS actual_share
  FROM budgets LEFT JOIN used USING (source)""",
    "p9_found": f"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '{_TOKEN}')) > (SELECT max_tokens FROM size_limits WHERE purpose = 'piece')",
}
