"""Queries of index checks, cached contexts, message arrays, pages of documents and graph-expanded results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import graph, index_checks, nested
from ..sources import versions
from ..sources.readers import table
from .statute_queries import _K, TARGETS, _keys

#: Width of the vectors of the index, and the weights of a step over an edge of each relation.
WIDTH = 64
RELATIONS = {"RELATED_TO": 0.8, "PART_OF": 0.5}
#: Records a block of messages; small, so that conversations have several.
BLOCK = 3


def index_report(spark, sf):
    """Each vector against its width and its document, and its greatest component."""
    v = table(spark, sf, "embeddings")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"))
    most = v.groupBy("vec_id").agg(F.max(F.array_max(vectors.sanitised(F.col("embedding")))).alias("greatest"))
    return index_checks.index_faults(v, WIDTH, docs).join(most, "vec_id", "left")


def cached_contexts(spark, sf):
    """Documents with contexts: the label where one is cached, else the first sentence."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    label = F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(", toxic "), F.col("toxic").cast("string"))
    cache = table(spark, sf, "labels").select("doc_id", label.alias("context"))
    made = versions.work_list(docs, cache, "doc_id").select("doc_id", F.substring_index("text", ".", 1).alias("context"))
    out = versions.with_contexts(docs, cache.withColumn("cached", F.lit(True)).unionByName(made.withColumn("cached", F.lit(False))), "doc_id")
    return out.select("doc_id", "context", F.md5("embed_text").alias("embed_md5"))


def session_push(spark, sf):
    """The users' turns as sessions, into which all other turns are pushed."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").alias("ts"))
    own = c.where("role = 'user'")
    held = nested.blocks(nested.positions(own, "session_id", nested.ORDER), BLOCK)
    out = nested.pushed(held, own.select("session_id"), c.where("role <> 'user'"), BLOCK)
    joined = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "\n")
    return out.select("session_id", "block", F.size("messages").alias("n"), "updated_at", F.md5(joined).alias("messages_md5"))


def document_find(spark, sf):
    """The second page of English documents that speak of "the", longest first."""
    docs = table(spark, sf, "documents").withColumn("n", F.length("text"))
    return nested.find(docs, {"lang": "en", "source": None}, {"text": r"\bTHE\b"}, [F.desc("n"), "doc_id"], 20, 20, ("text", "source")).select("doc_id", "lang", "n")


def graph_expanded(spark, sf):
    """The provisions of each topic, what they are cited with or part of within two steps, and the texts that cite those."""
    own = _keys(spark, sf)
    cited = own.select("chunk_id", F.explode("keys").alias("key"))
    parts = cited.select(F.col("key").alias("src"), graph.base_key(F.col("key")).alias("dst")).where("dst IS NOT NULL").distinct()
    pairs = graph.co_citation(cited, "chunk_id", "key").select("src", "dst")
    weighted = lambda e, kind: e.withColumn("weight", F.lit(RELATIONS[kind]))
    seeds = spark.createDataFrame([(t[0], t[2]) for t in TARGETS], "query_id string, node string")
    found = graph.related(weighted(pairs, "RELATED_TO").unionByName(weighted(parts, "PART_OF")), seeds, 2)
    return graph.expanded(found, own).withColumn("weight", F.round("weight", 6))


QUERIES = {f.__name__: f for f in (index_report, cached_contexts, session_push, document_find, graph_expanded)}
_BASE = lambda c: f"CASE WHEN regexp_matches({c}, '_(SEC|RUL|RULE)_') AND len(string_split({c}, '_')) > 3 THEN array_to_string(string_split({c}, '_')[1:3], '_') END"
_BAD = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))"
ORACLES = {
    "index_report": f"""WITH v AS (SELECT vec_id, count(*) AS n, sum(coalesce({_BAD}, 0)) AS bad, count_if(embedding IS NULL) AS nul, count_if(len(embedding) <> {WIDTH}) AS wid, max(list_max(embedding))::DOUBLE AS greatest FROM embeddings GROUP BY 1), d AS (SELECT DISTINCT doc_id FROM documents)
        SELECT coalesce(vec_id, doc_id) AS vec_id, coalesce(n, 0) AS n_rows, coalesce(bad, 0)::BIGINT AS n_bad, greatest, concat_ws('|', CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN nul > 0 THEN 'null vector' END, CASE WHEN wid > 0 THEN 'width' END,
            CASE WHEN bad > 0 THEN 'not finite' END, CASE WHEN doc_id IS NULL THEN 'no document' END, CASE WHEN n IS NULL THEN 'no vector' END) AS faults FROM v FULL JOIN d ON vec_id = doc_id""",
    "cached_contexts": """WITH c AS (SELECT doc_id, max('quality ' || quality || ', toxic ' || toxic) AS label FROM labels GROUP BY 1), x AS (SELECT doc_id, text, nullif(coalesce(label, split_part(text, '.', 1)), '') AS context FROM documents LEFT JOIN c USING (doc_id))
        SELECT doc_id, context, md5(context || chr(10) || chr(10) || coalesce(text, '')) AS embed_md5 FROM x""",
    "session_push": f"""WITH c AS (SELECT conv_id, role, text, turn, role = 'user' AS own FROM conversations), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own DESC, turn, role, text) - 1 AS pos FROM c WHERE own OR (trim(text) <> '' AND conv_id IN (SELECT conv_id FROM c WHERE own)))
        SELECT conv_id AS session_id, pos // {BLOCK} AS block, count(*)::INTEGER AS n, max(turn) AS updated_at, md5(string_agg(concat_ws(':', role, text), chr(10) ORDER BY pos)) AS messages_md5 FROM p GROUP BY 1, 2""",
    "document_find": r"SELECT doc_id, lang, length(text) AS n FROM documents WHERE lang = 'en' AND regexp_matches(text, '(?i)\bTHE\b') ORDER BY n DESC, doc_id LIMIT 20 OFFSET 20",
    "graph_expanded": f"""{_K.replace("WITH", "WITH RECURSIVE", 1)}, i AS (SELECT id, unnest(keys) AS key FROM k), e AS (SELECT DISTINCT a.key AS src, b.key AS dst, 0.8::DOUBLE AS weight FROM i a JOIN i b ON a.id = b.id AND a.key <> b.key UNION ALL SELECT DISTINCT key, {_BASE("key")}, 0.5::DOUBLE FROM i WHERE {_BASE("key")} IS NOT NULL),
        w(query_id, node, hops, weight) AS (SELECT topic, target, 0, 1.0::DOUBLE FROM t UNION ALL SELECT query_id, e.dst, hops + 1, w.weight * e.weight FROM w JOIN e ON e.src = w.node OR e.src = {_BASE("w.node")} WHERE hops < 2),
        f AS (SELECT query_id, node, min(hops) AS hops, max(weight) AS weight FROM w WHERE NOT EXISTS (SELECT 1 FROM t WHERE topic = query_id AND target = node) GROUP BY 1, 2),
        m AS (SELECT DISTINCT query_id, id AS chunk_id, node, hops, weight FROM f JOIN i ON key = node OR (starts_with(key, node) AND regexp_matches(substr(key, length(node) + 1, 1), '[_A-Za-z]')))
        SELECT query_id, chunk_id, node, hops, round(weight, 6) AS weight FROM m QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY weight DESC, hops, node) = 1""",
}
