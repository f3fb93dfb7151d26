"""Queries of packing, template and library search, floors, verification, expansion, audits and confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legal, text
from ..functions.text import simple_tokens
from ..functions.vectors import inner
from ..operators import analytics as an, containment
from ..operators import assembly, dense, graph, lexical
from ..sources.readers import CHUNKS_SQL, chunks, table
from .analytics_queries import _RUNS, _runs
from .retrieval_queries import _BM25, _CORPUS, _DOT, _RANK, _bm25, _corpus
from .text_queries import _ALL_SQL, _all_texts, _cat_sql, simple_tokens_sql

#: (order, trigger, term): what a query that holds the trigger is widened by.
EXPANSIONS = ((1, "refund", "export"), (2, "refund", "zero rated"), (3, "section", "provision"), (4, "section", "clause"), (5, "credit", "input tax"), (6, "demand", "notice"), (7, "demand", "interest"), (8, "rule", "return"))


def packed_chunks(spark, sf):
    c = chunks(spark, sf).select("chunk_id", F.posexplode(assembly.pack_paragraphs(F.col("text"), 120)).alias("n", "t"))
    return c.select("chunk_id", "n", F.length("t").alias("chars"), F.md5("t").alias("text_md5"))


def template_hybrid(spark, sf):
    """0.4 of the vector and 0.6 of the title for every fiftieth benchmark item, whose vector is the one of its number;
    above 0.15, best fifteen of each. Every text is scored against that stated set of queries."""
    items = table(spark, sf, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"), F.slice(F.array_distinct(simple_tokens(F.col("text"))), 1, 5).alias("qw"))
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    items = items.join(vec.select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qv")), "query_id", "left")
    t = chunks(spark, sf).select("chunk_id", F.split_part("text", F.lit("."), F.lit(1)).alias("title")).join(vec, "chunk_id", "left").crossJoin(items)
    sim = F.round(inner(F.col("vec"), F.col("qv")), 6)
    score = F.round(0.4 * F.coalesce(sim, F.lit(0.0)) + 0.6 * assembly.lexical_match(F.col("title"), F.col("q"), F.col("qw")), 6)
    scored = t.select("query_id", "chunk_id", score.alias("score")).where("score > 0.15")
    return lexical.top_k(scored, 15, ["query_id"], [F.desc("score"), "chunk_id"])


def library_search(spark, sf):
    s = assembly.library_score(F.split_part("text", F.lit("."), F.lit(1)), "of the", ["of", "the", "and"])
    return chunks(spark, sf).select("chunk_id", F.round(s, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(60)


def _ranked(spark, sf):
    s = _bm25(spark, sf).join(_corpus(spark, sf).select("chunk_id", "category", "rel_path"), "chunk_id")
    return lexical.top_k(s, 50, ["query_id"], [F.desc("score"), "chunk_id"])


def circular_floor(spark, sf):
    out = assembly.category_floor(_ranked(spark, sf).drop("rel_path"), 8, ["circular", "notification"], 4, 0.1)
    return assembly.injection_cutoff(out, 6).select("query_id", "chunk_id", "category", "injected")


def composite_score(spark, sf):
    """0.5 relevance, 0.3 authority and 0.2 recency of the fifty best."""
    r = _ranked(spark, sf)
    from pyspark.sql import Window

    from ..operators import fusion

    w = Window.partitionBy("query_id")
    rel = F.col("score") / F.max("score").over(w)
    y = fusion.recency(text.path_year(F.col("rel_path")), 2023)
    return r.select("query_id", "chunk_id", F.round(0.5 * rel + 0.3 * text.authority_weight(F.col("rel_path")) + 0.2 * y, 6).alias("composite"))


def semantic_cache(spark, sf):
    """Of each cached query (every fiftieth vector) the nearest other one, where it is near enough to answer for it."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    near = dense.dense_topk(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec"), 2).where("id <> query_id")
    return near.groupBy("query_id").agg(F.max(F.struct("sim", (-F.col("id")).alias("m"))).alias("b")).select("query_id", (-F.col("b.m")).alias("chunk_id"), F.col("b.sim").alias("sim"), (F.col("b.sim") >= 0.3).alias("hit"))


def citation_verify(spark, sf):
    s = _all_texts(spark, sf)
    cites = s.select("id", F.explode(F.regexp_extract_all(F.col("q"), F.lit(r"((?:Section|Rule)\s+\d+(?:\(\d+\))?)"), 1)).alias("citation"))
    return containment.verify_citations(cites, s.select("id", F.lower("q").alias("text")), legal.citation_variants(F.col("citation")))


def query_expansion(spark, sf):
    rules = spark.createDataFrame(list(EXPANSIONS), "ord int, trigger string, term string")
    return assembly.expand(_all_texts(spark, sf), rules, 3)


def concept_paths(spark, sf):
    """Regions and nations as an ontology, their names as keywords: of each word of the documents of two letters or more, the first
    concept with a keyword that contains it, and the way there from the root."""
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    concepts = r.select(F.concat(F.lit("R_"), F.col("r_regionkey").cast("string")).alias("concept"), F.lower("r_name").alias("keyword")).unionByName(
        n.select(F.concat(F.lit("N_"), F.col("n_nationkey").cast("string")).alias("concept"), F.lower("n_name").alias("keyword"))
    )
    edges = n.select(F.concat(F.lit("N_"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("R_"), F.col("n_regionkey").cast("string")).alias("parent"))
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2,})"), 1)).alias("needle")).distinct()
    found = containment.containing(words, concepts.select(F.col("concept").alias("text_id"), F.col("keyword").alias("text")))
    first = found.groupBy(F.col("needle").alias("term")).agg(F.min("text_id").alias("node"))
    return first.join(graph.root_paths(concepts.select(F.col("concept").alias("node")), edges), "node").select("term", "node", F.array_join("path", ">").alias("path"))


def provenance(spark, sf):
    return assembly.provenance(_runs(spark, sf)[0], ["bm25", "tfidf", "final"])


def corpus_audit(spark, sf):
    c = chunks(spark, sf)
    n = F.length("text")
    return c.groupBy(F.substring_index("rel_path", "/", 1).alias("folder")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(n < 200).alias("short"),
        an.share(F.col("text").rlike("[0-9]")).alias("digits_pct"),
        (an.share(F.col("text").rlike("[0-9]")) < 30).alias("gap"),
        F.count_if(text.alpha_quality(F.col("text")) < 0.7).alias("garbage"),
    )


def confidence(spark, sf):
    """Mean of four banded signals of each query's ten best, held to [0.3, 0.98]."""
    r = _ranked(spark, sf).where("rank <= 10")
    g = r.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.countDistinct("category").alias("kinds"), F.max(text.authority_weight(F.col("rel_path"))).alias("auth"))
    s1 = F.when(F.col("n") >= 8, 0.9).when(F.col("n") >= 4, 0.7).otherwise(0.4)
    s2 = F.when(F.col("top") >= 40, 0.95).when(F.col("top") >= 15, 0.75).otherwise(0.5)
    s3 = F.when(F.col("kinds") >= 3, 0.9).otherwise(0.6)
    return g.select("query_id", F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.98), (s1 + s2 + s3 + F.col("auth")) / 4)), 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (packed_chunks, template_hybrid, library_search, circular_floor, composite_score, semantic_cache, citation_verify, query_expansion, concept_paths, provenance, corpus_audit, confidence)}

_R50 = f"{_BM25}, s0 AS (SELECT bm.*, category, rel_path FROM bm JOIN corpus USING (chunk_id)), r AS ({_RANK('s0', 50)})"
_PRI = "CASE WHEN rel_path LIKE 'cgst acts%' THEN 1 WHEN rel_path LIKE 'notifications%' THEN 3 WHEN rel_path LIKE 'circulars%' THEN 4 WHEN rel_path LIKE 'high court%' THEN 7 ELSE 10 END"
_W = f"((11 - {_PRI}) / 10.0::DOUBLE)"
_AGE = "2023 - split_part(rel_path, '/', 2)::INTEGER"
_REC = f"(CASE WHEN {_AGE} <= 0 THEN 1.0 WHEN {_AGE} <= 1 THEN 0.92 WHEN {_AGE} <= 2 THEN 0.84 WHEN {_AGE} <= 3 THEN 0.76 WHEN {_AGE} <= 5 THEN 0.65 WHEN {_AGE} <= 8 THEN 0.5 ELSE 0.35 END)::DOUBLE"
_TITLE = "lower(split_part(text, '.', 1))"
_HITS = " + ".join(f"contains({_TITLE}, '{w}')::INTEGER" for w in ("of", "the", "and"))
_RULES_SQL = "rules(ord, trig, term) AS (VALUES " + ", ".join(f"({o}, '{t}', '{x}')" for o, t, x in EXPANSIONS) + ")"

ORACLES = {
    "template_hybrid": f"""WITH {CHUNKS_SQL}, i AS (SELECT item_id AS query_id, text AS q, (list_filter({simple_tokens_sql("text")}, lambda v, k: list_position({simple_tokens_sql("text")}, v) = k))[1:5] AS qw FROM benchmark WHERE item_id % 50 = 0),
        v AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({_DOT}, 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), t AS (SELECT query_id, chunk_id, {_TITLE} AS t, lower(q) AS q, qw, len(list_filter(qw, lambda w: contains({_TITLE}, w))) / greatest(len(qw), 1) AS share FROM chunks, i)
        SELECT query_id, chunk_id, round(0.4::DOUBLE * coalesce(sim, 0) + 0.6::DOUBLE * CASE WHEN t = q THEN 1.0 WHEN contains(t, q) THEN 0.7 WHEN share > 0 THEN 0.2::DOUBLE + 0.3::DOUBLE * share ELSE 0 END, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM t LEFT JOIN v USING (query_id, chunk_id) WHERE score > 0.15 QUALIFY rank <= 15""",
    "library_search": f"WITH {CHUNKS_SQL} SELECT chunk_id, round(CASE WHEN contains({_TITLE}, 'of the') THEN 100 WHEN {_HITS} = 3 THEN 80 ELSE 50.0::DOUBLE * ({_HITS}) / 3 END, 6) AS score FROM chunks WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 60",
    "circular_floor": f"""{_R50}, have AS (SELECT query_id, count(*) AS have FROM r WHERE rank <= 8 AND category IN ('circular', 'notification') GROUP BY 1),
        more AS (SELECT query_id, chunk_id, category, rank, have FROM r LEFT JOIN have USING (query_id) WHERE rank > 8 AND category IN ('circular', 'notification') AND score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 4 - coalesce(have, 0))
        SELECT query_id, chunk_id, category, false AS injected FROM r WHERE rank <= 6 UNION ALL SELECT query_id, chunk_id, category, true FROM more""",
    "composite_score": f"{_R50} SELECT query_id, chunk_id, round(0.5::DOUBLE * (score / max(score) OVER (PARTITION BY query_id)) + 0.3::DOUBLE * {_W} + 0.2::DOUBLE * {_REC}, 6) AS composite FROM r",
    "semantic_cache": f"SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({_DOT}, 6) AS sim, round({_DOT}, 6) >= 0.3 AS hit FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 6) DESC, b.vec_id) = 1",
    "citation_verify": f"""WITH {_ALL_SQL}, c AS (SELECT id, unnest(regexp_extract_all(q, '((?:Section|Rule)\\s+\\d+(?:\\(\\d+\\))?)', 1)) AS citation FROM s), v AS (SELECT id, citation, unnest([0, 1, 2]) AS level, unnest([lower(citation), lower(regexp_replace(citation, '\\([^)]*\\)', '', 'g')), regexp_extract(citation, '(\\d+[A-Z]*)', 1)]) AS variant FROM c),
        f AS (SELECT DISTINCT v.* FROM v JOIN s ON s.id <> v.id AND contains(lower(s.q), variant)), b AS (SELECT id, citation, variant, level FROM f QUALIFY row_number() OVER (PARTITION BY id, citation ORDER BY level) = 1)
        SELECT c.id, c.citation, variant, CASE WHEN level = 2 AND NOT contains(c.citation, '(') THEN 1 ELSE level END::INTEGER AS level FROM c LEFT JOIN b ON b.id = c.id AND b.citation = c.citation""",
    "query_expansion": f"""WITH {_ALL_SQL}, {_RULES_SQL}, h AS (SELECT id, term, min(ord) AS ord FROM s JOIN rules ON contains(lower(q), trig) AND NOT contains(lower(q), term) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY min(ord), term) <= 3)
        SELECT s.id, string_agg(term, '|' ORDER BY ord, term) AS terms FROM s LEFT JOIN h USING (id) GROUP BY 1""",
    "concept_paths": """WITH RECURSIVE c AS (SELECT 'R_' || r_regionkey AS node, lower(r_name) AS kw, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'N_' || n_nationkey, lower(n_name), 'R_' || n_regionkey FROM nation),
        w(node, top, path) AS (SELECT node, parent, node FROM c UNION ALL SELECT w.node, c.parent, c.node || '>' || path FROM w JOIN c ON c.node = top), t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM documents),
        f AS (SELECT term, min(node) AS node FROM t JOIN c ON contains(kw, term) GROUP BY 1) SELECT term, node, path FROM f JOIN w USING (node) WHERE top IS NULL""",
    "provenance": f"{_RUNS} SELECT query_id, chunk_id, CASE WHEN bool_or(stage = 'bm25') THEN 'bm25' WHEN bool_or(stage = 'tfidf') THEN 'tfidf' ELSE 'final' END AS first_stage, string_agg(DISTINCT stage, '|' ORDER BY stage) AS signals, min(rank) AS best FROM runs GROUP BY 1, 2",
    "corpus_audit": f"WITH {CHUNKS_SQL} SELECT split_part(rel_path, '/', 1) AS folder, count(*) AS n, count_if(length(text) < 200) AS short, round(100.0 * count_if(regexp_matches(text, '[0-9]')) / count(*), 1) AS digits_pct, round(100.0 * count_if(regexp_matches(text, '[0-9]')) / count(*), 1) < 30 AS gap, count_if(coalesce(length(regexp_replace(text, '\\P{{L}}', '', 'g')) / nullif(length(text), 0), 0) < 0.7) AS garbage FROM chunks GROUP BY 1",
    "confidence": f"""{_R50}, g AS (SELECT query_id, count(*) AS n, max(score) AS top, count(DISTINCT category) AS kinds, max({_W}) AS auth FROM r WHERE rank <= 10 GROUP BY 1)
        SELECT query_id, round(greatest(0.3, least(0.98, (CASE WHEN n >= 8 THEN 0.9 WHEN n >= 4 THEN 0.7 ELSE 0.4 END::DOUBLE + CASE WHEN top >= 40 THEN 0.95 WHEN top >= 15 THEN 0.75 ELSE 0.5 END::DOUBLE + CASE WHEN kinds >= 3 THEN 0.9 ELSE 0.6 END::DOUBLE + auth) / 4)), 6) AS confidence FROM g""",
}
