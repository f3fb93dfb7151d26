"""Queries of joins, graphs, usage, inventory, evaluation and time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import simple_tokens
from ..operators import analytics as an
from ..operators import graph, lexical
from ..sources import sinks
from ..sources.readers import CHUNKS_SQL, chunks, table
from .retrieval_queries import _BM25, _RANK, _TF, _lists
from .text_queries import _cat_sql, simple_tokens_sql


def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# joins


def key_lookup_capped(spark, sf):
    """Of each part the three line items that come first by supplier and order."""
    p = table(spark, sf, "part").select("p_partkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    w = Window.partitionBy("p_partkey").orderBy("l_suppkey", "l_orderkey", "l_linenumber")
    return li.join(p, "p_partkey").withColumn("n", F.row_number().over(w).cast("long")).where("n <= 3")


def alias_fallback(spark, sf):
    """A page's document by its own number, else by the number modulo a hundred."""
    p = table(spark, sf, "pages").select("page_id", (F.col("page_id") * 7 + 3).alias("a"), (F.col("page_id") % 100).alias("b"))
    d = table(spark, sf, "documents").select("doc_id", "source")
    own = p.join(d, F.col("a") == F.col("doc_id"), "left").select("page_id", "b", F.col("doc_id").alias("x"))
    other = own.where("x IS NULL").join(d, F.col("b") == F.col("doc_id")).select("page_id", F.col("doc_id").alias("target"), F.lit("alias").alias("via"))
    return own.where("x IS NOT NULL").select("page_id", F.col("x").alias("target"), F.lit("own").alias("via")).unionByName(other)


def prefix_join(spark, sf):
    """Keys that match a target as F01 has it: the key itself, or the key with a letter or underscore after it."""
    keys = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("SEC_"), (F.col("p_partkey") % 400).cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit("_5")).when(F.col("p_partkey") % 3 == 1, F.lit("A")).otherwise(F.lit(""))).alias("key"))
    targets = table(spark, sf, "nation").select((F.col("n_nationkey") + 10).alias("t")).select(F.concat(F.lit("SEC_"), F.col("t").cast("string")).alias("target"))
    stem = F.concat(F.lit("SEC_"), F.regexp_extract("key", r"^SEC_(\d+)", 1))  # what any match must equal
    return keys.withColumn("target", stem).join(F.broadcast(targets), "target").where(text.key_matches(F.col("key"), F.col("target"))).select("p_partkey", "key", "target")


def anti_missing(spark, sf):
    """Customers without an urgent order, by segment."""
    c = table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def range_neighbours(spark, sf):
    """The next line items of the same order, within two line numbers."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    b = li.select("l_orderkey", F.col("l_linenumber").alias("m"), F.col("l_partkey").alias("near_part"))
    j = li.join(b, "l_orderkey").where((F.abs(F.col("m") - F.col("l_linenumber")) <= 2) & (F.col("m") != F.col("l_linenumber")))
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("m", "near_part")
    return j.withColumn("n", F.row_number().over(w).cast("long")).where("n <= 2").select("l_orderkey", "l_linenumber", "m", "near_part", "n")


def exact_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    g = d.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    return d.join(g.where("n > 1"), "sha").where("doc_id <> first_id").select("doc_id", "first_id", "n")


def merge_new_wins(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    new = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("new"), F.col("quality").cast("string")).alias("source"), F.lit(0).cast("long").alias("n_chars"))
    return sinks.merge_new_wins(d, new, "doc_id")


def prev_turn(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("before", F.lag("text").over(w)).withColumn("role_before", F.lag("role").over(w))
    return c.where("role = 'assistant' AND role_before = 'user'").select("conv_id", "turn", F.md5("before").alias("before_md5"))


def session_memory(spark, sf):
    """For every fiftieth benchmark item the newest three conversations with a word of it, and the first turn that has one."""
    words = table(spark, sf, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.explode(simple_tokens(F.col("text"))).alias("w")).where("length(w) >= 6").distinct()
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(simple_tokens(F.col("text")))).alias("w"))
    hits = t.join(words, "w").groupBy("query_id", "conv_id").agg(F.min("turn").alias("first_turn"))
    return lexical.top_k(hits, 3, ["query_id"], [F.desc("conv_id")])


# graph


def co_citation(spark, sf):
    li = table(spark, sf, "lineitem")
    return graph.co_citation(li.select("l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey")


def _places(spark, sf):
    r = table(spark, sf, "nation").select(F.concat(F.lit("N_"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("R_"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("part_of").alias("relation"))
    c = table(spark, sf, "supplier").select(F.concat(F.lit("S_"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("N_"), F.col("s_nationkey").cast("string")).alias("dst"), F.lit("part_of").alias("relation"))
    return r.unionByName(c)


def bfs_depth2(spark, sf):
    e = graph.symmetric(_places(spark, sf), ["part_of"])
    seeds = table(spark, sf, "supplier").select(F.concat(F.lit("S_"), F.col("s_suppkey").cast("string")).alias("node"))
    return graph.walk(e, seeds, 2)


def graph_levels(spark, sf):
    e = _places(spark, sf)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    return graph.levels(e, nodes)


def parent_edges(spark, sf):
    """Edges from a key with a sub-clause to its parent, where the parent is there."""
    k = table(spark, sf, "orders").select(F.concat(F.lit("ACT_SEC_"), (F.col("o_orderkey") % 97).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("_"), (F.col("o_orderkey") % 5).cast("string"))).otherwise(F.lit(""))).alias("key")).distinct()
    parents = k.where(~F.col("key").rlike(r"^ACT_SEC_\d+_")).select(F.col("key").alias("parent"))
    return k.where(F.col("key").rlike(r"^ACT_SEC_\d+_")).withColumn("parent", F.substring_index("key", "_", 3)).join(parents, "parent", "left_semi").select("key", "parent", F.lit(15).alias("weight"))


def coverage_verify(spark, sf):
    """Of each benchmark item the share of its words in the best BM25 text, and the verdict."""
    best = _lists(spark, sf)[0].where("rank = 1").select(F.col("query_id").alias("item_id"), "chunk_id")
    items = table(spark, sf, "benchmark").select("item_id", F.array_distinct(simple_tokens(F.col("text"))).alias("want"))
    have = chunks(spark, sf).select("chunk_id", F.array_distinct(simple_tokens(F.col("text"))).alias("have"))
    j = items.join(best, "item_id").join(have, "chunk_id")
    found, total = F.size(F.array_intersect("want", "have")), F.size("want")
    return j.select("item_id", "chunk_id", found.cast("long").alias("found"), total.cast("long").alias("total"), an.verdict(found, total).alias("verdict"))


# usage


def usage_ratios(spark, sf):
    e = _events(spark, sf)
    return e.agg(
        F.count(F.lit(1)).alias("n"),
        an.share(F.col("event_type") != "error").alias("success_pct"),
        an.share(F.col("event_type") == "click").alias("click_pct"),
        F.round(F.avg(F.when(F.col("value") > 0, F.col("value"))), 4).alias("mean_positive"),
        F.countDistinct("user_id").alias("users"),
    )


def daily_counts(spark, sf):
    return an.daily_counts(_events(spark, sf), "ts", 7).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def active_users(spark, sf):
    e = _events(spark, sf)
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).where("ts > last - INTERVAL 24 HOURS").agg(F.greatest(F.countDistinct("user_id"), F.lit(1)).alias("users"))


def health_bands(spark, sf):
    e = _events(spark, sf).groupBy("user_id").agg(an.share(F.col("event_type") != "error").alias("ok_pct"))
    return e.withColumn("band", an.bands(F.col("ok_pct"), [(50, "critical"), (80, "degraded")], "healthy")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


def miss_rates(spark, sf):
    """Of each category the event kinds missing on 30 % or more of its users' days, of which there are five at least."""
    e = _events(spark, sf).select("user_id", F.to_date("ts").alias("day"), "event_type").distinct()
    users = e.select("user_id", "day").distinct().withColumn("grp", F.col("user_id") % 7)
    kinds = e.select("event_type").distinct()
    all_ = users.crossJoin(F.broadcast(kinds))  # five kinds
    m = all_.join(e.withColumn("hit", F.lit(1)), ["user_id", "day", "event_type"], "left").groupBy("grp", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("hit").isNull(), 1.0).otherwise(0.0)), 6).alias("miss_rate"))
    return m.where("n >= 5 AND miss_rate >= 0.3")


def category_inventory(spark, sf):
    c = chunks(spark, sf).withColumn("category", text.category(F.col("rel_path")))
    return c.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.length("text") < 500).alias("short"), an.share(F.col("lang") == "en").alias("en_pct"))


def year_groups(spark, sf):
    y = F.coalesce(text.path_year(F.col("rel_path")).cast("string"), F.lit("other"))
    n = chunks(spark, sf).select(y.alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("year") == "other", F.desc("year"))
    return n.withColumn("pos", F.row_number().over(w).cast("long"))  # a row a year


def retention(spark, sf):
    return sinks.newest(_events(spark, sf), 10, [F.desc("ts"), F.desc("event_id")], ["user_id"]).select("user_id", "event_id")


def ttl_filter(spark, sf):
    e = _events(spark, sf)
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).where("ts > last - INTERVAL 48 HOURS").select("event_id", "user_id")


def version_history(spark, sf):
    return an.versions(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "version", "status")


def latest_status(spark, sf):
    return an.latest(_events(spark, sf), "user_id", "event_type", F.struct("ts", "event_id"))


def pagination(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice")


def shelves(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return sinks.newest(d, 100, [F.desc("doc_id")], ["source"])


def word_frequencies(spark, sf):
    t = chunks(spark, sf).select(F.explode(simple_tokens(F.col("text"))).alias("w")).where("length(w) > 3")
    return t.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(50)


def registry_overlay(spark, sf):
    e = _events(spark, sf)
    pick = lambda kind: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.array_sort(F.collect_set(F.date_format("ts", "yyyy-MM"))).alias("months"), F.round(F.max("value"), 6).alias("weight"))
    m = an.merge_overlay(pick("click"), pick("purchase"), "user_id", ["months"], "weight")
    return m.select("user_id", F.array_join(F.array_sort("months"), "|").alias("months"), "weight")


def set_operations(spark, sf):
    a = table(spark, sf, "documents").select("doc_id")
    b = table(spark, sf, "labels").select("doc_id")
    tag = lambda df, s: df.select("doc_id", F.lit(s).alias("part"))
    return tag(a.exceptAll(b), "difference").unionByName(tag(a.intersect(b), "intersection"))


def usage_cube(spark, sf):
    e = _events(spark, sf).withColumn("day", F.to_date("ts"))
    return e.cube("event_type", F.expr("user_id % 3").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("gid"))


def usage_rollup(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"), F.count(F.lit(1)).alias("n"))


def pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    d = lambda c: F.col(c).cast("decimal(18,4)")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(d("l_quantity")).alias("sum_qty"), F.sum(d("l_extendedprice")).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def asof_latest(spark, sf):
    """Each purchase with the same user's last click before it: a union sorted by time instead of a range join."""
    e = _events(spark, sf).where("event_type IN ('click', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("click_id", click).where("event_type = 'purchase'").select("event_id", "user_id", "click_id")


# evaluation: a text that holds the item is gold


def _runs(spark, sf):
    a, b = (lexical.written(x.select("query_id", "chunk_id", "rank"), "runs") for x in _lists(spark, sf))  # read for each stage, and for gold
    runs = a.select("query_id", "chunk_id", "rank", F.lit("bm25").alias("stage")).unionByName(b.select("query_id", "chunk_id", "rank", F.lit("tfidf").alias("stage")))
    runs = runs.unionByName(a.where("rank <= 3").select("query_id", "chunk_id", "rank", F.lit("final").alias("stage")))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    held = runs.select("query_id", "chunk_id").distinct().join(items, "query_id").join(chunks(spark, sf).select("chunk_id", "text"), "chunk_id")
    return runs, held.where(F.contains("text", "item")).select("query_id", "chunk_id"), items


def recall_mrr(spark, sf):
    runs, gold, items = _runs(spark, sf)
    return an.recall_and_mrr(an.best_ranks(runs, gold), items.agg(F.count(F.lit(1)).alias("n")))


def first_failures(spark, sf):
    runs, gold, items = _runs(spark, sf)
    return an.first_failure(an.best_ranks(runs, gold), items, ["bm25", "tfidf", "final"])


def rank_pivot(spark, sf):
    runs, gold, _ = _runs(spark, sf)
    return an.best_ranks(runs, gold).groupBy("query_id").pivot("stage", ["bm25", "tfidf", "final"]).agg(F.min("best"))


def hard_negatives(spark, sf):
    runs, gold, _ = _runs(spark, sf)
    final = runs.where("stage = 'final'")
    lost = final.join(gold.select("query_id").distinct(), "query_id", "left_anti")
    return lost.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "chunk_id").limit(10)


# time windows


def tumbling(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n")


def sliding(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("start_s"), "n")


def sessions(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def anchored(spark, sf):
    a = an.anchored_windows(_events(spark, sf), "user_id", "ts", 86_400 * 7)
    return a.groupBy("user_id", "started").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        key_lookup_capped, alias_fallback, prefix_join, anti_missing, range_neighbours, exact_duplicates, merge_new_wins, prev_turn, session_memory, co_citation, bfs_depth2, graph_levels, parent_edges,
        coverage_verify, usage_ratios, daily_counts, active_users, health_bands, miss_rates, category_inventory, year_groups, retention, ttl_filter, version_history, latest_status, pagination, shelves,
        word_frequencies, registry_overlay, set_operations, usage_cube, usage_rollup, pricing_summary, asof_latest, recall_mrr, first_failures, rank_pivot, hard_negatives, tumbling, sliding, sessions, anchored,
    )
}

_EDGES = "e AS (SELECT 'N_' || n_nationkey AS src, 'R_' || n_regionkey AS dst FROM nation UNION ALL SELECT 'S_' || s_suppkey, 'N_' || s_nationkey FROM supplier)"
_KEY = "'SEC_' || (p_partkey % 400) || CASE p_partkey % 3 WHEN 0 THEN '_5' WHEN 1 THEN 'A' ELSE '' END"
_OKEY = "'ACT_SEC_' || (o_orderkey % 97) || CASE WHEN o_orderkey % 2 = 0 THEN '_' || (o_orderkey % 5) ELSE '' END"
_RUNS = f"""{_BM25}, {_TF}, la AS ({_RANK("bm", 50)}), lb AS ({_RANK("tfs", 50)}), runs AS (SELECT query_id, chunk_id, rank, 'bm25' AS stage FROM la UNION ALL SELECT query_id, chunk_id, rank, 'tfidf' FROM lb UNION ALL SELECT query_id, chunk_id, rank, 'final' FROM la WHERE rank <= 3),
    gold AS (SELECT DISTINCT query_id, chunk_id FROM runs JOIN benchmark b ON b.item_id = query_id JOIN chunks USING (chunk_id) WHERE contains(chunks.text, b.text)), best AS (SELECT query_id, stage, min(rank) AS best FROM runs JOIN gold USING (query_id, chunk_id) GROUP BY 1, 2)"""
_PICK = lambda kind: f"(SELECT user_id, list_sort(list_distinct(list(strftime(ts, '%Y-%m')))) AS months, round(max(value), 6) AS weight FROM events WHERE event_type = '{kind}' GROUP BY 1)"
_OK = "round(100.0 * count_if(event_type <> 'error') / count(*), 1)"

ORACLES = {
    "key_lookup_capped": "SELECT l_orderkey, l_linenumber, p_partkey, l_suppkey, row_number() OVER (PARTITION BY p_partkey ORDER BY l_suppkey, l_orderkey, l_linenumber) AS n FROM lineitem JOIN part ON p_partkey = l_partkey QUALIFY n <= 3",
    "alias_fallback": "SELECT page_id, coalesce(d.doc_id, f.doc_id) AS target, CASE WHEN d.doc_id IS NULL THEN 'alias' ELSE 'own' END AS via FROM pages LEFT JOIN documents d ON d.doc_id = page_id * 7 + 3 LEFT JOIN documents f ON f.doc_id = page_id % 100",
    "prefix_join": f"SELECT p_partkey, key, target FROM (SELECT p_partkey, {_KEY} AS key FROM part), (SELECT 'SEC_' || (n_nationkey + 10) AS target FROM nation) WHERE key = target OR (starts_with(key, target) AND regexp_matches(substr(key, length(target) + 1, 1), '[_A-Za-z]'))",
    "anti_missing": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1",
    "range_neighbours": "SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS m, b.l_partkey AS near_part, row_number() OVER (PARTITION BY a.l_orderkey, a.l_linenumber ORDER BY b.l_linenumber, b.l_partkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(b.l_linenumber - a.l_linenumber) <= 2 AND a.l_linenumber <> b.l_linenumber QUALIFY n <= 2",
    "exact_duplicates": "SELECT doc_id, first_id, n FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE doc_id <> first_id",
    "merge_new_wins": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'new' || quality, 0 FROM labels",
    "prev_turn": "SELECT conv_id, turn, md5(b) AS before_md5 FROM (SELECT *, lag(text) OVER w AS b, lag(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND r = 'user'",
    "session_memory": f"WITH w AS (SELECT DISTINCT query_id, w FROM (SELECT item_id AS query_id, unnest({simple_tokens_sql('text')}) AS w FROM benchmark WHERE item_id % 50 = 0) WHERE length(w) >= 6) SELECT query_id, conv_id, min(turn) AS first_turn, row_number() OVER (PARTITION BY query_id ORDER BY conv_id DESC) AS rank FROM (SELECT conv_id, turn, unnest({simple_tokens_sql('text')}) AS t FROM conversations) JOIN w ON t = w GROUP BY 1, 2 QUALIFY rank <= 3",
    "co_citation": "WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*) AS n FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2",
    "bfs_depth2": f"WITH {_EDGES}, s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), h0 AS (SELECT 'S_' || s_suppkey AS seed, 'S_' || s_suppkey AS node, 0 AS hops FROM supplier), h1 AS (SELECT seed, dst AS node, 1 AS hops FROM h0 JOIN s ON src = node), h2 AS (SELECT seed, dst AS node, 2 AS hops FROM h1 JOIN s ON src = node) SELECT seed, node, min(hops) AS hops FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2",
    "graph_levels": f"WITH {_EDGES}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), d1 AS (SELECT node, CASE WHEN node LIKE 'S%' THEN 0 WHEN node LIKE 'N%' AND node IN (SELECT dst FROM e) THEN 1 WHEN node LIKE 'N%' THEN 0 END AS level FROM n) SELECT node, coalesce(level, (SELECT max(d.level) + 1 FROM e JOIN d1 d ON d.node = e.src WHERE e.dst = d1.node))::INTEGER AS level FROM d1",
    "parent_edges": f"WITH k AS (SELECT DISTINCT {_OKEY} AS key FROM orders) SELECT key, parent, 15 AS weight FROM (SELECT key, array_to_string(list_slice(string_split(key, '_'), 1, 3), '_') AS parent FROM k WHERE len(string_split(key, '_')) > 3) WHERE parent IN (SELECT key FROM k)",
    "coverage_verify": f"""{_BM25}, b AS ({_RANK("bm", 1)}), c AS (SELECT item_id, b.chunk_id, len(list_intersect(list_distinct({simple_tokens_sql("benchmark.text")}), list_distinct({simple_tokens_sql("chunks.text")}))) AS found, len(list_distinct({simple_tokens_sql("benchmark.text")})) AS total FROM benchmark JOIN b ON query_id = item_id JOIN chunks USING (chunk_id))
        SELECT item_id, chunk_id, found, total, CASE WHEN round(100.0 * found / total) >= 80 THEN 'pass' WHEN round(100.0 * found / total) >= 50 THEN 'partial' ELSE 'fail' END AS verdict FROM c""",
    "usage_ratios": f"SELECT count(*) AS n, {_OK} AS success_pct, round(100.0 * count_if(event_type = 'click') / count(*), 1) AS click_pct, round(avg(CASE WHEN value > 0 THEN value END), 4) AS mean_positive, count(DISTINCT user_id) AS users FROM events",
    "daily_counts": "WITH d AS (SELECT unnest(generate_series(max(ts)::DATE - INTERVAL 6 DAYS, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events) SELECT strftime(day, '%Y-%m-%d') AS day, count(event_id) AS n FROM d LEFT JOIN events ON ts::DATE = day GROUP BY 1",
    "active_users": "SELECT greatest(count(DISTINCT user_id), 1) AS users FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS",
    "health_bands": f"SELECT band, count(*) AS n FROM (SELECT CASE WHEN {_OK} < 50 THEN 'critical' WHEN {_OK} < 80 THEN 'degraded' ELSE 'healthy' END AS band FROM events GROUP BY user_id) GROUP BY 1",
    "miss_rates": "WITH p AS (SELECT DISTINCT user_id, ts::DATE AS day, event_type FROM events), u AS (SELECT DISTINCT user_id, ts::DATE AS day, user_id % 7 AS grp FROM events), k AS (SELECT DISTINCT event_type FROM events) SELECT grp, k.event_type, count(*) AS n, round(avg(CASE WHEN p.user_id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS miss_rate FROM u CROSS JOIN k LEFT JOIN p ON p.user_id = u.user_id AND p.day = u.day AND p.event_type = k.event_type GROUP BY 1, 2 HAVING count(*) >= 5 AND round(avg(CASE WHEN p.user_id IS NULL THEN 1.0 ELSE 0.0 END), 6) >= 0.3",
    "category_inventory": f"WITH {CHUNKS_SQL} SELECT {_cat_sql('lower(rel_path)')} AS category, count(*) AS n, sum(length(text))::BIGINT AS chars, count_if(length(text) < 500) AS short, round(100.0 * count_if(lang = 'en') / count(*), 1) AS en_pct FROM chunks GROUP BY 1",
    "year_groups": f"WITH {CHUNKS_SQL}, y AS (SELECT split_part(rel_path, '/', 2) AS year, count(*) AS n FROM chunks GROUP BY 1) SELECT *, row_number() OVER (ORDER BY year DESC) AS pos FROM y",
    "retention": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10",
    "ttl_filter": "SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 48 HOURS",
    "version_history": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = count(*) OVER (PARTITION BY o_custkey) THEN 'active' ELSE 'archived' END AS status FROM orders",
    "latest_status": "SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "pagination": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100",
    "shelves": "SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 100",
    "word_frequencies": f"WITH {CHUNKS_SQL} SELECT w, count(*) AS n FROM (SELECT unnest({simple_tokens_sql('text')}) AS w FROM chunks) WHERE length(w) > 3 GROUP BY 1 ORDER BY n DESC, w LIMIT 50",
    "registry_overlay": f"SELECT coalesce(a.user_id, b.user_id) AS user_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.months, []), coalesce(b.months, [])))), '|') AS months, greatest(a.weight, b.weight) AS weight FROM {_PICK('click')} a FULL JOIN {_PICK('purchase')} b ON a.user_id = b.user_id",
    "set_operations": "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'intersection' ELSE 'difference' END AS part FROM documents",
    "usage_cube": "SELECT event_type, grp, count(*) AS n, grouping_id(event_type, grp)::INTEGER AS gid FROM (SELECT event_type, user_id % 3 AS grp FROM events) GROUP BY CUBE (event_type, grp)",
    "usage_rollup": "SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2)) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,4)) AS sum_qty, sum(l_extendedprice::DECIMAL(18,4)) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "asof_latest": "SELECT event_id, user_id, click_id FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events WHERE event_type IN ('click', 'purchase')) WHERE event_type = 'purchase'",
    "recall_mrr": f"{_RUNS} SELECT stage, " + ", ".join(f"round(count_if(best <= {k}) / (SELECT count(*) FROM benchmark), 6) AS recall_{k}" for k in (1, 5, 10)) + ", round(avg(1.0 / best), 6) AS mrr FROM best GROUP BY 1",
    "first_failures": f"{_RUNS}, s AS (SELECT item_id, list(stage) AS s FROM benchmark LEFT JOIN best ON query_id = item_id GROUP BY 1) SELECT CASE WHEN NOT list_contains(s, 'bm25') THEN 'bm25' WHEN NOT list_contains(s, 'tfidf') THEN 'tfidf' WHEN NOT list_contains(s, 'final') THEN 'final' ELSE 'generation' END AS stage, count(*) AS n FROM s GROUP BY 1",
    "rank_pivot": f"{_RUNS} SELECT query_id, min(best) FILTER (stage = 'bm25') AS bm25, min(best) FILTER (stage = 'tfidf') AS tfidf, min(best) FILTER (stage = 'final') AS final FROM best GROUP BY 1",
    "hard_negatives": f"{_RUNS} SELECT chunk_id, count(*) AS n FROM runs WHERE stage = 'final' AND query_id NOT IN (SELECT query_id FROM gold) GROUP BY 1 ORDER BY n DESC, chunk_id LIMIT 10",
    "tumbling": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding": "SELECT epoch(s)::BIGINT AS start_s, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1",
    "sessions": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, min(epoch_us(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, sid",
}
