"""Queries of hybrid retrieval: BM25, TF-IDF, dense search, fusion and the pool's rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import dense, fusion, lexical
from ..sources.readers import CHUNKS_SQL, chunks, table
from .text_queries import _cat_sql, simple_tokens_sql


def _corpus(spark, sf):
    return chunks(spark, sf).withColumn("category", text.category(F.col("rel_path")))


def _index(spark, sf):
    return lexical.index(_corpus(spark, sf), text.simple_tokens(F.col("text")), ["category"])


def _queries(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.explode(text.simple_tokens(F.col("text"))).alias("token"))


def _bm25(spark, sf, ix=None):
    ix = ix or _index(spark, sf)
    post, stats = lexical.postings(ix), lexical.length_stats(ix)
    return lexical.bm25(post, lexical.idf_okapi(post, stats.select("N")), stats.select("avgdl"), _queries(spark, sf))


def _best_bm25(spark, sf, k, ix=None, df=None):
    ix = ix or _index(spark, sf)
    stats = lexical.length_stats(ix)
    return lexical.best_bm25(ix, lexical.idf_okapi(lexical.postings(ix), stats.select("N"), df=df), stats.select("avgdl"), _queries(spark, sf), k)


def bm25_topk(spark, sf):
    return _best_bm25(spark, sf, 10)


def bm25_prf(spark, sf):
    """Second pass with the feedback terms of the top three added to the query."""
    ix, q = _index(spark, sf), _queries(spark, sf)
    post, stats = lexical.postings(ix), lexical.length_stats(ix)
    idf = lexical.idf_okapi(post, stats.select("N"))
    top = lexical.top_k(lexical.bm25(post, idf, stats.select("avgdl"), q), 3, ["query_id"], [F.desc("score"), "chunk_id"]).select("query_id", "chunk_id")
    more = lexical.feedback_terms(post, top, q)
    scores = lexical.bm25(post, idf, stats.select("avgdl"), q.unionByName(more), send=lexical.few(q, 9))
    return lexical.top_k(scores, 45, ["query_id"], [F.desc("score"), "chunk_id"])


def bm25_by_category(spark, sf):
    """Statistics within each category; top 8 of each with a positive score."""
    ix = _index(spark, sf)
    post, stats = lexical.postings(ix, ["category"]), lexical.length_stats(ix, ["category"])
    idf = lexical.idf_okapi(post, stats.select("category", "N"), ["category"])
    scores = lexical.bm25(post, idf, stats.select("category", "avgdl"), _queries(spark, sf), ["category"]).where("score > 0")
    return lexical.top_k(scores, 8, ["query_id", "category"], [F.desc("score"), "chunk_id"])


def tfidf_topk(spark, sf, ix=None, df=None):
    ix = ix or _index(spark, sf)
    idf = lexical.idf_smooth(lexical.postings(ix), lexical.length_stats(ix).select("N"), df or lexical.frequencies(ix))
    return lexical.best_tfidf(ix, idf, _queries(spark, sf), 50)


def _dense(spark, sf, k, **kw):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return dense.dense_topk(e, e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec"), k, **kw)


def dense_topk_q(spark, sf):
    return _dense(spark, sf, 50).select("query_id", F.col("id").alias("chunk_id"), "sim", "rank")


def dense_by_label(spark, sf):
    return _dense(spark, sf, 12, by="label", floor=0.2).select("query_id", F.col("grp").cast("int").alias("label"), F.col("id").alias("chunk_id"), "sim", "rank")


def _lists(spark, sf):
    ix = _index(spark, sf)
    df = lexical.frequencies(ix)
    return _best_bm25(spark, sf, 50, ix, df), tfidf_topk(spark, sf, ix, df)


def rrf_fusion(spark, sf):
    return fusion.rrf(list(_lists(spark, sf)))


def weighted_pool(spark, sf):
    """Fused rank weighted by source, boosted by document, at most two rows of a case-law document's folder."""
    pool = fusion.rrf(list(_lists(spark, sf))).join(_corpus(spark, sf).drop("text", "lang"), "chunk_id")
    pool = pool.withColumn("folder", F.substring_index("rel_path", "/", 2))
    pool = fusion.document_boost(fusion.weight_sources(pool, "rrf"), "folder").withColumn("score", F.round(F.col("weighted") + F.col("boost"), 6))
    pool = fusion.per_document_cap(pool, "folder", "score", 2, F.col("category") == "case_law")
    return pool.select("query_id", "chunk_id", "category", "score", F.round(fusion.recency(text.path_year(F.col("rel_path")), 2023), 2).alias("recency"))


def quota_fill(spark, sf):
    """What the BM25 order adds to a pool of the ten best so that each category has its quota."""
    scores = _bm25(spark, sf).join(_corpus(spark, sf).select("chunk_id", "category"), "chunk_id")
    pool = lexical.top_k(scores, 10, ["query_id"], [F.desc("score"), "chunk_id"])
    return fusion.fill_quotas(pool.select("query_id", "chunk_id", "category"), scores)


def priority_merge_q(spark, sf):
    a, b = _lists(spark, sf)
    return fusion.priority_merge([(a, 40), (b, 20)], 50)


def context_budget(spark, sf):
    """Whole texts in BM25 order up to 18,000 characters a query."""
    top = bm25_topk(spark, sf).join(_corpus(spark, sf).select("chunk_id", F.length("text").alias("n")), "chunk_id")
    return fusion.within_budget(top, F.col("n"), 18_000, ["rank"]).select("query_id", "chunk_id", "rank", "used")


def interleaved(spark, sf):
    top = bm25_topk(spark, sf).join(_corpus(spark, sf).select("chunk_id", "category"), "chunk_id")
    top = top.withColumn("cls", F.when(F.col("category").isin("statute", "notification"), "primary").otherwise("secondary"))
    return fusion.interleave(top, "cls", ["rank"], "secondary").select("query_id", "chunk_id", "cls", "pos")


def mmr_select(spark, sf):
    top = _best_bm25(spark, sf, 80)
    pool = top.join(_corpus(spark, sf).select("chunk_id", F.array_distinct(text.simple_tokens(F.col("text"))).alias("tokens")), "chunk_id")
    return fusion.mmr(pool.select("query_id", "chunk_id", "score", "tokens"), 10)


def hybrid_search(spark, sf):
    """The whole of it: BM25, TF-IDF and dense lists fused, weighted by source, boosted by document, best ten a query.
    A benchmark item's dense query is the vector of its number."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    near = dense.dense_topk(e, e.join(items, "id", "left_semi").select(F.col("id").alias("query_id"), "vec"), 50).select("query_id", F.col("id").alias("chunk_id"), "rank")
    pool = fusion.rrf([*_lists(spark, sf), near]).join(_corpus(spark, sf).drop("text", "lang"), "chunk_id")
    pool = fusion.document_boost(fusion.weight_sources(pool, "rrf"), "rel_path").withColumn("score", F.round(F.col("weighted") + F.col("boost"), 6))
    return lexical.top_k(pool, 10, ["query_id"], [F.desc("score"), "chunk_id"]).select("query_id", "chunk_id", "category", "score", "rank")


QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_prf": bm25_prf,
    "bm25_by_category": bm25_by_category,
    "tfidf_topk": tfidf_topk,
    "dense_topk": dense_topk_q,
    "dense_topk_by_label": dense_by_label,
    "rrf_fusion": rrf_fusion,
    "weighted_pool": weighted_pool,
    "quota_fill": quota_fill,
    "priority_merge": priority_merge_q,
    "context_budget": context_budget,
    "interleave": interleaved,
    "mmr_select": mmr_select,
    "hybrid_search": hybrid_search,
}

_TOK = simple_tokens_sql("text")
_CORPUS = f"{CHUNKS_SQL}, corpus AS (SELECT chunk_id, rel_path, text, {_cat_sql('lower(rel_path)')} AS category FROM chunks)"
_POST = f"""{_CORPUS}, tk AS (SELECT chunk_id, {_TOK} AS t FROM corpus), post AS (SELECT chunk_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS token FROM tk) GROUP BY 1, 2),
    qs AS (SELECT item_id AS query_id, unnest({_TOK}) AS token FROM benchmark)"""
_BM = lambda q, name: f"""{name} AS (SELECT query_id, chunk_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM (SELECT query_id, token, count(*) AS qf FROM {q} GROUP BY 1, 2) JOIN idf USING (token) JOIN post USING (token), st GROUP BY 1, 2)"""  # noqa: E731
_STATS = """st AS (SELECT count(*) AS N, avg(dl) AS avgdl FROM (SELECT DISTINCT chunk_id, dl FROM post)),
    raw AS (SELECT token, ln(N - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, st GROUP BY token, N), idf AS (SELECT token, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""
_BM25 = f"WITH {_POST}, {_STATS}, {_BM('qs', 'bm')}"
_RANK = lambda src, k, extra="": f"SELECT *, row_number() OVER (PARTITION BY query_id{extra} ORDER BY score DESC, chunk_id) AS rank FROM {src} QUALIFY rank <= {k}"
_TF = """ti AS (SELECT token, ln((1 + N) / (1 + count(*))) + 1 AS idf FROM post, st GROUP BY token, N), w AS (SELECT chunk_id, token, (1 + ln(tf)) * idf AS w FROM post JOIN ti USING (token)),
    wn AS (SELECT chunk_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS w FROM w), qw AS (SELECT query_id, token, (1 + ln(count(*))) * any_value(idf) AS w FROM qs JOIN ti USING (token) GROUP BY 1, 2),
    qn AS (SELECT query_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM qw), tfs AS (SELECT query_id, chunk_id, round(sum(wn.w * qn.w), 6) AS score FROM wn JOIN qn USING (token) GROUP BY 1, 2 HAVING round(sum(wn.w * qn.w), 6) > 0)"""
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_FUSED = f"""{_BM25}, {_TF}, la AS ({_RANK("bm", 50)}), lb AS ({_RANK("tfs", 50)}), fused AS (SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 6) AS rrf FROM (SELECT query_id, chunk_id, rank FROM la UNION ALL SELECT query_id, chunk_id, rank FROM lb) GROUP BY 1, 2)"""
_WEIGHT = "CASE category WHEN 'statute' THEN 1.5::DOUBLE WHEN 'notification' THEN 1.2::DOUBLE WHEN 'circular' THEN 1.1::DOUBLE WHEN 'case_law' THEN 0.75::DOUBLE WHEN 'other' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END"
_SCALED = "CASE WHEN max(rrf) OVER q > min(rrf) OVER q THEN (rrf - min(rrf) OVER q) / (max(rrf) OVER q - min(rrf) OVER q) ELSE 1.0 END"
_SCORED = lambda doc: f"""pool AS (SELECT query_id, chunk_id, category, rel_path, {doc} AS doc, round(round({_SCALED} * {_WEIGHT}, 6) + round(CASE WHEN count(*) OVER d > 1 THEN ln(count(*) OVER d) * 0.02 ELSE 0 END, 6), 6) AS score
    FROM fused JOIN corpus USING (chunk_id) WINDOW q AS (PARTITION BY query_id), d AS (PARTITION BY query_id, {doc}))"""  # noqa: E731
_FOLDER = "array_to_string(list_slice(string_split(rel_path, '/'), 1, 2), '/')"
_AGE = "2023 - split_part(rel_path, '/', 2)::INTEGER"
_QUOTA = "CASE category " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in fusion.QUOTAS.items()) + " ELSE 0 END"

ORACLES = {
    "bm25_topk": f"{_BM25} {_RANK('bm', 10)}",
    "bm25_prf": f"""{_BM25}, top AS ({_RANK("bm", 3)}), fb AS (SELECT query_id, token, count(DISTINCT chunk_id) AS df FROM top JOIN post USING (chunk_id) WHERE length(token) >= 4 AND token NOT IN ({", ".join(f"'{w}'" for w in text.STOP_WORDS)})
        AND (query_id, token) NOT IN (SELECT (query_id, token) FROM qs) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY df DESC, token) <= 8),
        q2 AS (SELECT query_id, token FROM qs UNION ALL SELECT query_id, token FROM fb), {_BM("q2", "bm2")} {_RANK("bm2", 45)}""",
    "bm25_by_category": f"""WITH {_POST}, pc AS (SELECT post.*, category FROM post JOIN corpus USING (chunk_id)), st AS (SELECT category, count(*) AS N, avg(dl) AS avgdl FROM (SELECT DISTINCT category, chunk_id, dl FROM pc) GROUP BY 1),
        raw AS (SELECT category, token, ln(N - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM pc JOIN st USING (category) GROUP BY category, token, N), mean AS (SELECT category, avg(r) AS m FROM raw GROUP BY 1),
        idf AS (SELECT category, token, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw JOIN mean USING (category)),
        bm AS (SELECT query_id, category, chunk_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM (SELECT query_id, token, count(*) AS qf FROM qs GROUP BY 1, 2) JOIN pc USING (token) JOIN idf USING (category, token) JOIN st USING (category) GROUP BY 1, 2, 3)
        SELECT *, row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, chunk_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 8""",
    "tfidf_topk": f"WITH {_POST}, {_STATS}, {_TF} {_RANK('tfs', 50)}",
    "dense_topk": f"SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({_DOT}, 6) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 50",
    "dense_topk_by_label": f"SELECT a.vec_id AS query_id, b.label, b.vec_id AS chunk_id, round({_DOT}, 6) AS sim, row_number() OVER (PARTITION BY a.vec_id, b.label ORDER BY round({_DOT}, 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND round({_DOT}, 6) >= 0.2 QUALIFY rank <= 12",
    "rrf_fusion": f"{_FUSED} SELECT * FROM fused",
    "weighted_pool": f"""{_FUSED}, {_SCORED(_FOLDER)} SELECT query_id, chunk_id, category, score, CASE WHEN {_AGE} <= 0 THEN 1.0 WHEN {_AGE} <= 1 THEN 0.92 WHEN {_AGE} <= 2 THEN 0.84 WHEN {_AGE} <= 3 THEN 0.76 WHEN {_AGE} <= 5 THEN 0.65 WHEN {_AGE} <= 8 THEN 0.5 ELSE 0.35 END::DOUBLE AS recency
        FROM pool QUALIFY category <> 'case_law' OR row_number() OVER (PARTITION BY query_id, doc ORDER BY score DESC, chunk_id) <= 2""",
    "quota_fill": f"""{_BM25}, sc AS (SELECT bm.*, category FROM bm JOIN corpus USING (chunk_id)), pool AS ({_RANK("sc", 10)}), have AS (SELECT query_id, category, count(*) AS have FROM pool GROUP BY 1, 2)
        SELECT query_id, chunk_id, category, score FROM sc LEFT JOIN have USING (query_id, category) WHERE score > 0 AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM pool)
        QUALIFY row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, chunk_id) <= {_QUOTA} - coalesce(have, 0)""",
    "priority_merge": f"""{_FUSED}, rows AS (SELECT query_id, chunk_id, 0 AS src, rank FROM la WHERE rank <= 40 UNION ALL SELECT query_id, chunk_id, 1, rank FROM lb WHERE rank <= 20), f AS (SELECT query_id, chunk_id, src, rank FROM rows QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY src, rank) = 1)
        SELECT query_id, chunk_id, src, row_number() OVER (PARTITION BY query_id ORDER BY src, rank, chunk_id) AS pos FROM f QUALIFY pos <= 50""",
    "context_budget": f"{_BM25}, t AS ({_RANK('bm', 10)}) SELECT query_id, chunk_id, rank, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used FROM t JOIN corpus USING (chunk_id) QUALIFY used <= 18000",
    "interleave": f"""{_BM25}, t AS ({_RANK("bm", 10)}), c AS (SELECT query_id, chunk_id, rank, CASE WHEN category IN ('statute', 'notification') THEN 'primary' ELSE 'secondary' END AS cls FROM t JOIN corpus USING (chunk_id)),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id, cls ORDER BY rank) AS n FROM c) SELECT query_id, chunk_id, cls, row_number() OVER (PARTITION BY query_id ORDER BY n, CASE WHEN cls = 'secondary' THEN 0 ELSE 1 END) AS pos FROM n""",
    "hybrid_search": f"""{_FUSED.replace("UNION ALL SELECT query_id, chunk_id, rank FROM lb", f"UNION ALL SELECT query_id, chunk_id, rank FROM lb UNION ALL SELECT a.vec_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark) QUALIFY rank <= 50")},
        {_SCORED("rel_path")}, best AS ({_RANK("pool", 10)}) SELECT query_id, chunk_id, category, score, rank FROM best""",
}
