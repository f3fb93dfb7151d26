"""Statute-first retrieval, key resolution and citation checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legal
from ..operators import containment
from .text_queries import _ALL_SQL, _CITES, _all_texts, _distinct

#: (topic, ord, target): the provisions of a topic, as rows.
TARGETS = (("credit", 1, "CGST_SEC_17"), ("credit", 2, "CGST_SEC_16"), ("credit", 3, "CGST_RULE_42"), ("refund", 1, "CGST_SEC_16"), ("refund", 2, "CGST_RULE_89"), ("rates", 1, "CGST_NOTIF_11"), ("rates", 2, "CGST_SCHED_II"), ("numbers", 1, "CGST_SEC_9"))
CITED = r"(?i)((?:Section|Sec|Rule)\s*\d+[A-Z]?(?:\(\d+\))?)"


def _keys(spark, sf):
    return _all_texts(spark, sf).select(F.col("id").alias("chunk_id"), legal.citation_keys(F.col("q")).alias("keys"))


def statute_first(spark, sf):
    """Each topic as a query, over the citation keys of all texts."""
    targets = spark.createDataFrame(list(TARGETS), "topic string, ord int, target string")
    queries = targets.select("topic").distinct().select(F.col("topic").alias("query_id"), "topic")
    return containment.statute_first(queries, targets, _keys(spark, sf))


def resolved_keys(spark, sf):
    """The keys that texts cite, held against those of the topics."""
    index = spark.createDataFrame([(t[2],) for t in TARGETS], "key string")
    asked = _keys(spark, sf).select(F.col("chunk_id").alias("id"), F.posexplode("keys").alias("ord", "key"))
    return containment.resolved(asked, index)


def citation_overlap(spark, sf):
    """Citations of each text, held against those of the five texts after it: contained either way."""
    s = _all_texts(spark, sf).select("id", F.explode(F.regexp_extract_all(F.col("q"), F.lit(CITED), 1)).alias("citation"))
    known = s.select(F.explode(F.sequence(F.col("id") - 5, F.col("id") - 1)).alias("id"), F.col("citation").alias("provision"))
    return containment.either_contains(s, known)


QUERIES = {f.__name__: f for f in (statute_first, resolved_keys, citation_overlap)}
_T = "t(topic, ord, target) AS (VALUES " + ", ".join(f"('{a}', {n}, '{k}')" for a, n, k in TARGETS) + ")"
_K = f"WITH {_ALL_SQL}, {_T}, l AS (SELECT id, {_CITES} AS c FROM s), k AS (SELECT id, {_distinct('c')} AS keys FROM l)"
ORACLES = {
    "statute_first": f"""{_K}, e AS (SELECT id, unnest(keys) AS key FROM k) SELECT topic AS query_id, id AS chunk_id, min_by(target, ord) AS target FROM e JOIN t ON key = target OR (starts_with(key, target) AND regexp_matches(substr(key, length(target) + 1, 1), '[_A-Za-z]')) GROUP BY 1, 2""",
    "resolved_keys": f"""{_K}, e AS (SELECT id, unnest(keys) AS key, unnest(range(len(keys))) AS ord FROM k), b AS (SELECT *, nullif(regexp_extract(key, '^((?:CGST|IGST|UTGST|SGST)_(?:SEC|RULE?)_\\d+[A-Z]?)', 1), '') AS base FROM e),
        r AS (SELECT id, ord, CASE WHEN key IN (SELECT target FROM t) THEN key WHEN base IN (SELECT target FROM t) THEN base END AS key FROM b) SELECT id, key, min(ord)::INTEGER AS ord FROM r WHERE key IS NOT NULL GROUP BY 1, 2""",
    "citation_overlap": f"""WITH {_ALL_SQL}, c AS (SELECT DISTINCT id, unnest(regexp_extract_all(q, '{CITED}', 1)) AS citation FROM s)
        SELECT a.id, a.citation, bool_or(b.id IS NOT NULL) AS verified FROM c a LEFT JOIN c b ON b.id BETWEEN a.id + 1 AND a.id + 5 AND (contains(lower(a.citation), lower(b.citation)) OR contains(lower(b.citation), lower(a.citation))) GROUP BY 1, 2""",
}
