"""Queries of topics, routes, injections and suite results."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import legal, text
from ..operators import routing
from ..sources.readers import CHUNKS_SQL, chunks, table
from .analytics_queries import _EDGES, _places
from .assembly_queries import _PRI, _R50, _ranked
from .retrieval_queries import _DOT
from .text_queries import _ALL_SQL, _all_texts, simple_tokens_sql

#: (topic, phrase, weight) and (topic, member) of a small taxonomy: words count 2, provisions 10.
TOPIC_RULES = (("credit", "credit", 2), ("credit", "section 17", 10), ("refund", "refund", 2), ("refund", "rule 89", 10), ("time", "days", 2), ("time", "late", 2), ("prose", " the ", 2), ("prose", " la ", 2))
TOPIC_MEMBERS = (("credit", "SEC_17"), ("credit", "RUL_42"), ("credit", "SEC_16"), ("refund", "SEC_54"), ("refund", "RUL_89"), ("time", "SEC_50"), ("prose", "SEC_17"), ("prose", "SEC_50"))
MULTIPLIERS = (("statute", 1.5), ("notification", 1.2), ("circular", 1.1), ("case_law", 0.75))


def _taxonomy(spark):
    return spark.createDataFrame(list(TOPIC_RULES), "topic string, phrase string, weight long"), spark.createDataFrame(list(TOPIC_MEMBERS), "topic string, member string")


def _texts(spark, sf):
    return _all_texts(spark, sf).withColumnRenamed("q", "text")


def topic_argmax(spark, sf):
    return routing.best_topic(_texts(spark, sf), _taxonomy(spark)[0])


def chunk_topics(spark, sf):
    """By phrases and citation keys. The keys are a column of their own: each use in a lambda would find them anew."""
    keyed = _texts(spark, sf).withColumn("keys", legal.citation_keys(F.col("text")))
    return keyed.select("id", routing.topic_of(F.col("text"), F.col("keys")).alias("topic"))


def topic_leaders(spark, sf):
    t = routing.leading_topics(_texts(spark, sf), *_taxonomy(spark))
    return t.select("id", F.array_join("topics", "|").alias("topics"), F.array_join("members", "|").alias("members"), "confidence")


def domain_routes(spark, sf):
    return _texts(spark, sf).select("id", F.array_join(routing.route_folders(F.col("text")), "|").alias("folders"))


def expected_categories(spark, sf):
    return _texts(spark, sf).select("id", F.array_join(routing.expected_categories(F.col("text")), "|").alias("categories"))


def complexity_bands(spark, sf):
    q = routing.complexity(F.col("q"))
    return _all_texts(spark, sf).select("id", q.alias("score"), routing.mode(q).alias("mode"))


def follow_ups(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("reply", F.last(F.when(F.col("role") == "assistant", F.col("text")), True).over(w))
    return c.where("role = 'user'").select("conv_id", "turn", F.md5(routing.with_last_reply(F.col("text"), F.col("reply"))).alias("query_md5"))


def authority_bonus(spark, sf):
    mult = F.coalesce(F.create_map(*[F.lit(x) for m in MULTIPLIERS for x in m])[F.col("category")], F.lit(1.0))
    r = _ranked(spark, sf)
    return r.select("query_id", "chunk_id", F.round(F.col("score") + routing.authority_bonus(text.source_priority(F.col("rel_path")), mult), 6).alias("score"))


def adaptive_domain(spark, sf):
    r = _ranked(spark, sf).where("rank <= 10")
    return routing.adaptive_filter(r, F.col("category").isin("circular", "notification"), 10).select("query_id", "chunk_id", "category")


def topic_clique(spark, sf):
    """Suppliers of one nation stand for the members of a topic."""
    m = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("topic"), F.col("s_suppkey").alias("member"))
    return routing.cliques(m)


def intra_topic_edges(spark, sf):
    """Edges between suppliers of a nation but for those of neighbouring numbers, which are there already."""
    m = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("topic"), F.col("s_suppkey").alias("member"))
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("src"), F.explode(F.array(*[F.col("s_suppkey") - k for k in (1, 2, 3)])).alias("dst"))
    return routing.ordered_pairs(m, known)


def trace_tests(spark, sf):
    """User turns against benchmark items and documents' beginnings."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("trace_id"), F.col("text").alias("query"))
    t = table(spark, sf, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("test_id"), F.col("text").alias("query"))
    return routing.trace_tests(d, t)


def suite_summary(spark, sf):
    n = F.size(F.array_distinct(F.split("text", " ")))
    v = table(spark, sf, "conversations").select(F.when(n > 20, "pass").otherwise("fail").alias("verdict"), (F.least(n, F.lit(40)) / 40).alias("coverage"), F.length("text").alias("ms"))
    return routing.suite_summary(v, 60.0)


def compressed_context(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(text.simple_tokens(F.col("text"))).alias("want"))
    have = chunks(spark, sf).select("chunk_id", F.array_distinct(text.simple_tokens(F.col("text"))).alias("have"))
    r = _ranked(spark, sf).select("query_id", "chunk_id", "score").join(items, "query_id").join(have, "chunk_id")
    overlap = F.size(F.array_intersect("want", "have")) / F.greatest(F.size("want"), F.lit(1))
    return routing.compressed(r, overlap, 20).select("query_id", "chunk_id", "value", "rank")


def _near(spark, sf):
    """(query_id, chunk_id, label, sim): every fiftieth vector against all rows, a stated set of queries."""
    from ..operators import dense

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return dense.dense_topk(e, e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec"), 20).select("query_id", F.col("id").alias("chunk_id"), "sim", "rank")


def mandatory_injection(spark, sf):
    """Keys SEC_n that a query (every fiftieth vector) needs and its twenty nearest rows lack."""
    near = _near(spark, sf)
    key = lambda c: F.concat(F.lit("SEC_"), (c % 37).cast("string"))
    wanted = near.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.lit(f"SEC_{n}") for n in (3, 17, 36, 40, 99)])).alias("key"))
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"))
    by_key = c.where("chunk_id % 37 < 20").select(key(F.col("chunk_id")).alias("key"), "chunk_id")
    by_number = c.where("chunk_id BETWEEN 30 AND 90").select(F.col("chunk_id").cast("string").alias("number"), "chunk_id")
    return routing.inject_missing(near.select("query_id", key(F.col("chunk_id")).alias("key")), wanted, by_key, by_number, near)


def notification_net(spark, sf):
    near = _near(spark, sf).withColumn("hits", F.col("chunk_id") % 3)
    have = near.where("rank <= 3 AND chunk_id % 5 = 1 AND chunk_id <> query_id")
    return routing.safety_net(near.where("chunk_id <> query_id"), have)


#: Categories of the labels of the vectors, and what each may add from which similarity on.
CATEGORY_OF = ("statute", "statute", "statute", "circular", "circular", "notification", "notification", "case_law", "case_law", "case_law")
FILL = (("case_law", 1, 0.20), ("circular", 2, 0.20), ("notification", 3, 0.18), ("statute", 1, 0.18))


def coverage_fill(spark, sf):
    """For every fiftieth vector: the categories that its four nearest rows lack, from the fifteen nearest of each category."""
    from ..operators import dense

    category = F.element_at(F.array(*map(F.lit, CATEGORY_OF)), F.col("label") + 1)
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), category.alias("category"))
    q = e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    near = dense.dense_topk(e, q, 15, by="category").select("query_id", F.col("id").alias("chunk_id"), F.col("grp").alias("category"), "sim")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "chunk_id")
    pool = near.withColumn("n", F.row_number().over(w)).where("n <= 4").select("query_id", "chunk_id", "category")
    expected = q.select("query_id").crossJoin(spark.createDataFrame(list(FILL), "category string, most int, least double"))  # four categories
    return routing.coverage_fill(pool, expected, near)


def token_estimates(spark, sf):
    a, b = routing.token_estimates(F.col("text"))
    return chunks(spark, sf).select("chunk_id", a.alias("by_chars"), b.alias("by_words"), F.md5(F.substring("text", 1, 150)).alias("snippet_md5"))


def live_sources(spark, sf):
    c = chunks(spark, sf).select("chunk_id", F.when(F.col("chunk_id") % 11 == 0, F.concat(F.lit("generated_reports/"), F.col("rel_path"))).otherwise(F.col("rel_path")).alias("rel_path"))
    return routing.live(c, c.where("chunk_id % 7 = 0").select("rel_path")).select("chunk_id", "rel_path")


def name_search(spark, sf):
    c = chunks(spark, sf).select("chunk_id", "rel_path", F.col("text").rlike("(?i)\\bthe the\\b").alias("twice"))
    return c.where(F.col("rel_path").ilike("%NOTIF%2018%") | F.col("twice")).select("chunk_id", "rel_path")


def source_list(spark, sf):
    """The pages of a text count by 1,000 characters from its start; a row's page is that of its last character."""
    page = F.ceil(F.length("text") / 1000).cast("int")
    r = _ranked(spark, sf).withColumn("source", F.substring_index("rel_path", "/", 2)).join(chunks(spark, sf).select("chunk_id", page.alias("page")), "chunk_id")
    return routing.source_list(r)


def graph_stats(spark, sf):
    return routing.graph_stats(_places(spark, sf))


_FUNCTIONS = (
    token_estimates, live_sources, name_search, source_list, graph_stats, topic_argmax, chunk_topics, topic_leaders, domain_routes, expected_categories, complexity_bands, follow_ups, authority_bonus, adaptive_domain, topic_clique, intra_topic_edges, trace_tests, suite_summary, compressed_context, mandatory_injection, notification_net, coverage_fill,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_TAX = "k(topic, phrase, weight) AS (VALUES " + ", ".join(f"('{t}', '{p}', {w})" for t, p, w in TOPIC_RULES) + "), mem(topic, member) AS (VALUES " + ", ".join(f"('{t}', '{m}')" for t, m in TOPIC_MEMBERS) + ")"
_HITS = f"WITH {_ALL_SQL}, {_TAX}, h AS (SELECT id, topic, sum(weight)::BIGINT AS score FROM s JOIN k ON contains(lower(q), phrase) GROUP BY 1, 2)"
_EDGE = r"[^\pL\pN_]"  # DuckDB's \b knows ASCII letters only
_BOUNDED = lambda p: re.sub(r"\\b(?=$|\|)", lambda _: f"(?:$|{_EDGE})", p).replace(r"\b", f"(?:^|{_EDGE})")
_ROUTES = ", ".join(f"CASE WHEN regexp_matches(lower(q), '{_BOUNDED(p)}') THEN {list(names)} ELSE [] END" for p, names in routing.ROUTES)
_MULT = "CASE category " + " ".join(f"WHEN '{c}' THEN {m}" for c, m in MULTIPLIERS) + " ELSE 1.0 END"
_NEAR = f"WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({_DOT}, 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM d QUALIFY rank <= 20)"
_HELD = lambda words: "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(lower(q), w)))"
_WEIGHT = f"CASE WHEN {_HELD(routing.CREDIT_WORDS)} + {_HELD(routing.DRAFT_WORDS)} > 0 THEN 0.35 WHEN {_HELD(routing.PLACE_WORDS)} > 0 THEN 0.28 ELSE 0.18 END::DOUBLE"
_COMPLEX = f"""round(greatest(0, least(1, least(1, {_HELD(routing.COMPLEX)} * {_WEIGHT}) - least(0.3::DOUBLE, {_HELD(routing.SIMPLE)} * 0.15::DOUBLE)
    + CASE WHEN n > 40 THEN 0.25 WHEN n > 20 THEN 0.15 WHEN n > 10 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN len(regexp_extract_all(lower(q), '\\bsec(?:tion)?\\s*\\d+')) > 1 THEN 0.3 ELSE 0 END::DOUBLE)), 6)"""
_NAMES = list(dict.fromkeys([n for n, _ in routing.TOPICS] + [n for _, n in routing.PROVISIONS]))
_WORTH = ", ".join(
    "(" + " + ".join(
        [f"contains(lower(q), '{w}')::INTEGER * 2" for n, words in routing.TOPICS if n == name for w in words]
        + [f"len(list_filter(c, lambda x: starts_with(x, '{p}'))) * 10" for p, n in routing.PROVISIONS if n == name]
    ) + ")" for name in _NAMES
)
_KEYS = "list_distinct(flatten([" + ", ".join(f"list_transform(regexp_extract_all(q, '{p}', 1), lambda v: 'CGST_{k}_' || upper(translate(trim(v), '/-()', '___')))" for k, p in legal.CITATIONS) + "]))"

ORACLES = {
    "token_estimates": f"WITH {CHUNKS_SQL} SELECT chunk_id, length(text) // 4 AS by_chars, floor(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 1.35)::BIGINT AS by_words, md5(substr(text, 1, 150)) AS snippet_md5 FROM chunks",
    "live_sources": f"WITH {CHUNKS_SQL}, c AS (SELECT chunk_id, CASE WHEN chunk_id % 11 = 0 THEN 'generated_reports/' || rel_path ELSE rel_path END AS rel_path FROM chunks) SELECT * FROM c WHERE NOT starts_with(rel_path, 'generated_reports') AND rel_path NOT IN (SELECT rel_path FROM c WHERE chunk_id % 7 = 0)",
    "name_search": f"WITH {CHUNKS_SQL} SELECT chunk_id, rel_path FROM chunks WHERE rel_path ILIKE '%NOTIF%2018%' OR regexp_matches(text, '(?i)\\bthe the\\b')",
    "source_list": f"""{_R50}, p AS (SELECT r.*, array_to_string(string_split(r.rel_path, '/')[1:2], '/') AS source, ceil(length(c.text) / 1000.0)::INTEGER AS page FROM r JOIN corpus c USING (chunk_id)),
        o AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, source, page ORDER BY rank) = 1), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 20)
        SELECT query_id, source, page, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM f QUALIFY place <= 8""",
    "graph_stats": f"WITH {_EDGES} SELECT (SELECT count(DISTINCT n) FROM (SELECT src AS n FROM e UNION ALL SELECT dst FROM e)) AS nodes, count(*) AS edges, 1::BIGINT AS relations FROM e",
    "topic_argmax": f"{_HITS} SELECT s.id, coalesce(topic, 'General') AS topic FROM s LEFT JOIN (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) = 1) b ON b.id = s.id",
    "chunk_topics": f"WITH {_ALL_SQL}, k AS (SELECT id, q, {_KEYS} AS c FROM s), w AS (SELECT id, [{_WORTH}] AS l FROM k) SELECT id, CASE WHEN list_max(l) > 0 THEN {_NAMES}[list_position(l, list_max(l))] ELSE 'General' END AS topic FROM w",
    "topic_leaders": f"""{_HITS}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) AS n FROM h QUALIFY n <= 2), m AS (SELECT id, string_agg(DISTINCT member, '|' ORDER BY member) AS members FROM t JOIN mem USING (topic) GROUP BY 1)
        SELECT id, string_agg(topic, '|' ORDER BY n) AS topics, any_value(members) AS members, max(score) AS confidence FROM t JOIN m USING (id) GROUP BY 1""",
    "domain_routes": f"WITH {_ALL_SQL}, f AS (SELECT id, flatten([{_ROUTES}]) AS l FROM s) SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(list_sort(list_distinct(l || {list(routing.COURTS)})), '|') ELSE '' END AS folders FROM f",
    "expected_categories": f"WITH {_ALL_SQL} SELECT id, CASE WHEN {_HELD(routing.ADVISORY_WORDS)} > 0 THEN 'circular|' ELSE '' END || CASE WHEN {_HELD(routing.RATE_WORDS)} > 0 THEN 'notification|' ELSE '' END || 'statute' AS categories FROM s",
    "complexity_bands": f"WITH {_ALL_SQL}, t AS (SELECT id, q, len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) AS n FROM s), c AS (SELECT id, {_COMPLEX} AS score FROM t) SELECT id, score, CASE WHEN score < 0.25 THEN 'brief' WHEN score < 0.6 THEN 'standard' ELSE 'detailed' END AS mode FROM c",
    "follow_ups": """WITH c AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS reply FROM conversations)
        SELECT conv_id, turn, md5(CASE WHEN len(string_split_regex(trim(text), '\\s+')) < 8 AND reply IS NOT NULL THEN text || ' ' || substr(reply, 1, 100) ELSE text END) AS query_md5 FROM c WHERE role = 'user'""",
    "authority_bonus": f"{_R50} SELECT query_id, chunk_id, round(score + (11 - {_PRI}) * 0.03::DOUBLE * ({_MULT})::DOUBLE, 6) AS score FROM r",
    "adaptive_domain": f"{_R50} SELECT query_id, chunk_id, category FROM (SELECT *, count_if(category IN ('circular', 'notification')) OVER (PARTITION BY query_id) AS n FROM r WHERE rank <= 10) WHERE category IN ('circular', 'notification') OR n < 3",
    "topic_clique": "SELECT DISTINCT a.s_suppkey AS src, b.s_suppkey AS dst FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey",
    "intra_topic_edges": "SELECT DISTINCT a.s_suppkey AS src, b.s_suppkey AS dst, 5 AS weight FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE b.s_suppkey - a.s_suppkey > 3",
    "trace_tests": """WITH t AS (SELECT min(doc_id) AS t, text FROM documents WHERE doc_id % 2 = 0 GROUP BY text), p AS (SELECT min(doc_id) AS t, substr(text, 1, 50) AS k FROM documents WHERE doc_id % 2 = 0 GROUP BY 2)
        SELECT d.doc_id AS trace_id, coalesce(t.t, p.t) AS test_id FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN p ON p.k = substr(d.text, 1, 50)""",
    "suite_summary": """WITH c AS (SELECT len(list_distinct(string_split(text, ' '))) AS n, length(text) AS ms FROM conversations)
        SELECT *, pass_pct >= 60 AS ok FROM (SELECT count(*) AS n, round(100.0::DOUBLE * count_if(c.n > 20) / count(*), 1) AS pass_pct, round(avg(least(c.n, 40) / 40), 4) AS coverage, round(avg(ms), 1) AS ms FROM c)""",
    "compressed_context": f"""{_R50}, i AS (SELECT item_id AS query_id, list_distinct({simple_tokens_sql('text')}) AS want FROM benchmark), hv AS (SELECT doc_id AS chunk_id, list_distinct({simple_tokens_sql('text')}) AS have FROM documents),
        v AS (SELECT query_id, chunk_id, round(0.6::DOUBLE * score + 0.4::DOUBLE * (len(list_intersect(want, have)) / greatest(len(want), 1)), 6) AS value FROM r JOIN i USING (query_id) JOIN hv USING (chunk_id))
        SELECT query_id, chunk_id, value, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, chunk_id) AS rank FROM v QUALIFY rank <= 20""",
    "mandatory_injection": f"""{_NEAR}, w AS (SELECT DISTINCT query_id, 'SEC_' || n AS key, n FROM near, (VALUES (3), (17), (36), (40), (99)) v(n)), g AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.query_id = w.query_id AND 'SEC_' || (near.chunk_id % 37) = w.key)),
        k AS (SELECT 'SEC_' || (doc_id % 37) AS key, min(doc_id) AS c FROM documents WHERE doc_id % 37 < 20 GROUP BY 1), m AS (SELECT doc_id AS n, doc_id AS c FROM documents WHERE doc_id BETWEEN 30 AND 90)
        SELECT g.query_id, g.key, coalesce(k.c, m.c, f.chunk_id) AS chunk_id, CASE WHEN k.c IS NOT NULL THEN 1.5 WHEN m.c IS NOT NULL THEN 1.2 ELSE 1.35 END::DOUBLE AS score FROM g LEFT JOIN k ON k.key = g.key LEFT JOIN m ON m.n = g.n LEFT JOIN near f ON f.query_id = g.query_id AND f.rank = 1""",
    "notification_net": f"""{_NEAR}, c AS (SELECT * FROM near WHERE chunk_id <> query_id), h AS (SELECT DISTINCT query_id FROM c WHERE rank <= 3 AND chunk_id % 5 = 1)
        SELECT query_id, chunk_id, round(10 * (chunk_id % 3) + sim, 6) AS value FROM c WHERE sim >= 0.15 AND query_id NOT IN (SELECT query_id FROM h) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, chunk_id) = 1""",
    "coverage_fill": f"""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {list(CATEGORY_OF)}[b.label + 1] AS category, round({_DOT}, 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
        pool AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) <= 4), wide AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, category ORDER BY sim DESC, chunk_id) <= 15),
        m(category, most, least) AS (VALUES {", ".join(f"('{c}', {n}, {x}::DOUBLE)" for c, n, x in FILL)}),
        w AS (SELECT wide.*, most FROM wide JOIN m USING (category) WHERE sim >= least AND (query_id, category) NOT IN (SELECT (query_id, category) FROM pool) AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM pool))
        SELECT query_id, category, chunk_id, sim FROM w QUALIFY row_number() OVER (PARTITION BY query_id, category ORDER BY sim DESC, chunk_id) <= most""",
}
