"""Topics, routes and injections: what a text or query is about, where to look for it, and what must be in its pool.

Taxonomies come as small dimensions of rows (topic, kind, value, weight) or (topic, member), never as code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled, spread_join
from .lexical import few


def topic_hits(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, topic, score): the weights of a topic's phrases that a text (id, text) holds, whatever the case. `rules` is a
    dimension (topic, phrase, weight) that Spark broadcasts as long as it is small."""
    held = texts.join(rules, F.contains(F.lower(F.col("text")), F.col("phrase")))
    return held.groupBy("id", "topic").agg(F.sum("weight").alias("score"))


def best_topic(texts: DataFrame, rules: DataFrame, default: str = "General") -> DataFrame:
    """(id, topic): the topic of the highest score, the first by name on ties; `default` without a hit."""
    best = topic_hits(texts, rules).groupBy("id").agg(F.min_by("topic", F.struct(-F.col("score"), "topic")).alias("topic"))
    return texts.select("id").join(best, "id", "left").select("id", F.coalesce("topic", F.lit(default)).alias("topic"))


def leading_topics(texts: DataFrame, rules: DataFrame, members: DataFrame, most: int = 2) -> DataFrame:
    """(id, topics, members, confidence): the `most` topics of highest score, their distinct members (topic, member) in
    order, and the highest score."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "topic")
    top = topic_hits(texts, rules).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    own = top.join(members, "topic", "left").groupBy("id").agg(F.sort_array(F.collect_set("member")).alias("members"))
    named = top.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "topic"))), lambda x: x["topic"]).alias("topics"), F.max("score").alias("confidence"))
    return named.join(own, "id").select("id", "topics", "members", "confidence")


#: Topics with the phrases that count 2, and the provisions that count 10 with all keys that start like them (fixed values).
TOPICS = (
    ("ITC", ("input tax credit", "itc", "blocked credit")),
    ("RCM", ("reverse charge", "rcm", "9(3)", "9(4)", "reverse charge mechanism")),
    ("Works_Contract", ("works contract", "immovable property", "construction", "erection", "commissioning")),
    ("Place_of_Supply", ("place of supply", "inter-state", "intra-state")),
    ("Exemption", ("exemption", "exempt", "not taxable", "nil rated")),
    ("Refund", ("refund", "zero rated", "inverted duty")),
    ("Export", ("export", "sez", "lut", "zero rated", "high seas sale", "bill of lading", "shipping bill")),
    ("Penalty", ("penalty", "confiscation", "fine", "detention")),
    ("Registration", ("registration", "gstin", "cancellation")),
    ("Valuation", ("valuation", "transaction value", "open market value")),
    ("Composite_Supply", ("composite supply", "mixed supply", "natural bundle")),
)
PROVISIONS = (
    ("CGST_SEC_16", "ITC"), ("CGST_SEC_17", "ITC"), ("CGST_RULE_42", "ITC"), ("CGST_RULE_43", "ITC"),
    ("CGST_SEC_15", "Valuation"), ("CGST_SEC_9", "RCM"), ("CGST_SEC_8", "Composite_Supply"),
    ("CGST_SEC_10", "Place_of_Supply"), ("CGST_SEC_12", "Place_of_Supply"), ("CGST_SEC_13", "Place_of_Supply"),
    ("CGST_SEC_54", "Refund"), ("CGST_SEC_122", "Penalty"), ("CGST_SEC_129", "Penalty"),
    ("CGST_SEC_22", "Registration"), ("CGST_SEC_24", "Registration"),
    ("CGST_SCHED_I", "Supply"), ("CGST_SCHED_II", "Supply"),
)


def topic_of(text: Column, keys: Column, topics=TOPICS, provisions=PROVISIONS, default: str = "General") -> Column:
    """The topic of the highest score, of equal ones the first listed; `default` where nothing of it is in the text or its
    citation keys. A row's topics are scored in one projection."""
    t, k = F.coalesce(F.lower(text), F.lit("")), F.coalesce(keys, F.array().cast("array<string>"))
    names = list(dict.fromkeys([n for n, _ in topics] + [n for _, n in provisions]))

    below = lambda p: F.size(F.filter(k, lambda x: F.startswith(x, F.lit(p))))

    def score(name):
        parts = [F.contains(t, F.lit(w)).cast("int") * 2 for n, words in topics if n == name for w in words]
        parts += [below(p) * 10 for p, n in provisions if n == name]
        return reduce(lambda a, b: a + b, parts)

    best = F.array_max(F.array(*[F.struct(score(n).alias("score"), F.lit(-i).alias("place"), F.lit(n).alias("topic")) for i, n in enumerate(names)]))
    return F.when(best["score"] > 0, best["topic"]).otherwise(default)


#: Folders that go with every route, and the routes: what a question must match, in lower case, and where to look (fixed values).
COURTS = ("High Court Case Laws", "Supreme Court Case Laws", "AAR")
ROUTES = (
    (r"rule\s*4[23]|common\s+input|revers.*itc|itc.*revers", ("Rules", "Act", "Circulars")),
    (r"\bitc\b|input\s+tax\s+credit|sec(?:tion)?\.?\s*1[67]", ("Rules", "Act", "Circulars", "CGST", "IGST", "Notification")),
    (r"refund|igst\s+refund|export.*refund|unutilised\s+credit", ("Act", "Rules", "Circulars", "Notification", "Forms")),
    (r"hsn|sac|\bgst\s+rate\b|percent|gst\s+on\s+\w", ("Act", "Notification", "IGST", "Forms")),
    (r"export|zero.?rated|\blut\b|letter\s+of\s+undertaking|sez\b", ("Export", "Act", "Notification", "Circulars")),
    (r"e.?way\s*bill|eway", ("Rules", "Circulars", "Notification")),
    (r"appeal|tribunal|gstat|high\s+court|supreme\s+court", ("Act", "Rules")),
    (r"annual\s+return|gstr.?9\b", ("Rules", "Forms", "Circulars")),
    (r"registr(?:ation|ed|ing)", ("Act", "Rules", "Circulars")),
    (r"\baudit\b|gst\s+audit|gstr.?9c", ("Act", "Rules", "Circulars")),
    (r"penalty|penalt|section\s*12[2-9]|sec\s*12[2-9]", ("Act", "Rules", "Circulars", "Notification")),
    (r"scn|show\s*cause|notice|drc.?0?1|section\s*7[34]|sec\s*7[34]", ("Act", "Rules", "Circulars", "Notification")),
    (r"draft|reply|response|representation|appeal\s+letter|submission", ("Act", "Rules", "Circulars", "Notification")),
    (r"intermediary|commission\s+agent|broker\s+service|facilitator|agent\s+service", ("Act", "IGST", "Circulars", "Notification")),
    (r"place\s+of\s+supply|pos\b|section\s*1[23]\s*igst|cross.?border\s+service", ("Act", "IGST", "Circulars", "Notification")),
)


#: Of each route words of which every match holds one: they are sought first, as the patterns take much longer.
ROUTE_WORDS = (
    ("rule", "common", "revers"),
    ("itc", "input", "sec"),
    ("refund", "unutilised"),
    ("hsn", "sac", "gst", "percent"),
    ("export", "zero", "lut", "letter", "sez"),
    ("way",),
    ("appeal", "tribunal", "gstat", "court"),
    ("annual", "gstr"),
    ("registr",),
    ("audit", "gstr"),
    ("penalt", "sec"),
    ("scn", "show", "notice", "drc", "sec"),
    ("draft", "reply", "response", "representation", "appeal", "submission"),
    ("intermediary", "commission", "broker", "facilitator", "agent"),
    ("place", "pos", "section", "cross"),
)


def route_folders(q: Column, routes=ROUTES, always=COURTS, words=ROUTE_WORDS) -> Column:
    """The distinct folders, in order, of all routes that a text matches, and those that go with every route; empty, which
    means no restriction, without a match or a text. `words` has for each route what its matches can't be without."""
    t, none = F.lower(q), F.array().cast("array<string>")
    of = lambda names: F.array(*map(F.lit, names))
    held = lambda own: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in own])
    found = F.concat(*[F.when(held(own) & F.coalesce(F.rlike(t, F.lit(f"(?dU){p}")), F.lit(False)), of(names)).otherwise(none) for (p, names), own in zip(routes, words, strict=True)])
    return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(F.concat(found, of(always))))).otherwise(none)


#: Words of a question that needs circulars, and of one that needs notifications (fixed values).
ADVISORY_WORDS = (
    "what", "whether", "how", "explain", "clarif", "position", "treatment",
    "applicab", "eligible", "liable", "charge", "implication", "cross",
    "isd", "reverse", "works", "import", "export", "exempt", "place",
    "valuat", "time", "registr", "refund", "distinct", "common", "shared",
    "branch", "headquarter", "head office", "proviso",
)
RATE_WORDS = (
    "rate", "nil", "hsn", "sac", "12%", "18%", "28%", "5%", "classif",
    "exemption", "exempt supply",
)


def expected_categories(q: Column) -> Column:
    """Categories that an answer must draw on: statute always, circular and notification where a word asks for them."""
    t = F.coalesce(F.lower(q), F.lit(""))
    held = lambda words: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
    return F.array_compact(F.array(F.when(held(ADVISORY_WORDS), F.lit("circular")), F.when(held(RATE_WORDS), F.lit("notification")), F.lit("statute")))


#: Words of a question that asks for an analysis, and of one that doesn't (fixed values).
COMPLEX = (
    "section", "rule", "notification", "circular", "itc", "input tax credit",
    "appeal", "penalty", "prosecution", "tribunal", "high court", "supreme court",
    "composite", "mixed supply", "place of supply", "time of supply", "reverse charge",
    "gstr", "annual return", "audit", "assessment", "demand", "adjudication",
    "fema", "company law", "income tax", "tds", "tcs", "capital gains",
    "export", "import", "customs", "sez", "e-way bill", "refund",
    "draft", "notice", "reply", "advisory", "legal draft", "observation", "written submission",
    "igst", "cgst", "sgst", "utgst", "intermediary", "zero rated", "export of service",
    "import of service", "cross border", "inter-state", "intra-state",
    "our understanding", "gst implications", "gst treatment", "tax position", "advise",
    "qualifying", "characterisation", "characterization", "section 2", "section 7", "section 9",
    "section 12", "section 13", "section 16", "section 17", "section 24", "section 74",
    "schedule ii", "schedule iii", "schedule i",
)
SIMPLE = (
    "what is", "define", "meaning of", "full form", "abbreviation",
    "rate of", "gst rate", "hsn", "sac", "due date", "last date",
    "deadline", "turnover limit", "threshold", "registration limit",
)
#: What raises the weight of each word of an analysis (fixed values).
CREDIT_WORDS = ("itc", "input tax credit")
DRAFT_WORDS = ("draft", "notice", "reply", "scn", "show cause", "drc-01", "drc 01", "asmt-10", "appeal letter", "representation")
PLACE_WORDS = ("igst", "cgst", "intermediary", "place of supply", "zero rated", "export of service", "our understanding", "gst implications", "characteris")


def complexity(q: Column) -> Column:
    """0 to 1: words of an analysis by their weight, less those of a plain question, more for a long one and for several
    sections."""
    t = F.lower(q)
    held = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)))
    weight = F.when((held(CREDIT_WORDS) > 0) | (held(DRAFT_WORDS) > 0), 0.35).when(held(PLACE_WORDS) > 0, 0.28).otherwise(0.18)
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    long = F.when(words > 40, 0.25).when(words > 20, 0.15).when(words > 10, 0.05).otherwise(0.0)
    several = F.when(F.regexp_count(t, F.lit(r"\bsec(?:tion)?\s*\d+")) > 1, 0.3).otherwise(0.0)
    score = F.least(F.lit(1.0), held(COMPLEX) * weight) - F.least(F.lit(0.3), held(SIMPLE) * F.lit(0.15)) + long + several
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def mode(score: Column) -> Column:
    return F.when(score < 0.25, "brief").when(score < 0.6, "standard").otherwise("detailed")


def authority_bonus(priority: Column, multiplier: Column) -> Column:
    """0.03 for each step above the lowest of ten priorities, times the category's multiplier."""
    return (11 - priority) * 0.03 * multiplier


def adaptive_filter(pool: DataFrame, inside: Column, k: int) -> DataFrame:
    """Of each query the rows where `inside` holds, if there are max(3, k // 3) of them; else all its rows."""
    n = F.count_if(inside).over(Window.partitionBy("query_id"))
    return pool.withColumn("_n", n).where(inside | (F.col("_n") < max(3, k // 3))).drop("_n")


def cliques(members: DataFrame) -> DataFrame:
    """(src, dst): all pairs of members (topic, member) that share a topic, both ways. A pair is made once, at the least topic that
    both have, so pairs aren't shuffled; topics of any size are dealt over many tasks. A member has few topics."""
    m = members.select("topic", "member").where("topic IS NOT NULL AND member IS NOT NULL").distinct()
    own = m.groupBy("member").agg(F.collect_list("topic").alias("topics"))
    m = settled(own.select(F.explode("topics").alias("topic"), "member", "topics"))
    pairs = spread_join(m.withColumnRenamed("member", "src"), m.select("topic", F.col("member").alias("dst"), F.col("topics").alias("_topics")), "topic")
    least = (F.size("topics") == 1) | (F.col("topic") == F.array_min(F.array_intersect("topics", "_topics")))
    return pairs.where((F.col("src") != F.col("dst")) & least).select("src", "dst")


def ordered_pairs(members: DataFrame, existing: DataFrame, weight: int = 5) -> DataFrame:
    """(src, dst, weight): pairs of a topic's members, the lesser first, without those that `existing` (src, dst) has either way. Of
    `existing` only what joins members of one topic counts, which is sent to all tasks where it is small."""
    known = existing.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src < dst")
    m = members.select("topic", "member").distinct()
    known = known.join(m.withColumnRenamed("member", "src"), "src").join(m.withColumnRenamed("member", "dst"), ["topic", "dst"]).select("src", "dst").distinct()
    known = settled(known)
    pairs = cliques(members).where("src < dst").join(few(known)(known), ["src", "dst"], "left_anti")
    return pairs.withColumn("weight", F.lit(weight))


def trace_tests(traces: DataFrame, tests: DataFrame, chars: int = 50) -> DataFrame:
    """(trace_id, test_id): the test (test_id, query) of a trace (trace_id, query): the same text, else the same first
    characters; the least test_id where there are several."""
    by = lambda key: tests.groupBy(key.alias("k")).agg(F.min("test_id").alias("t"))
    whole, part = by(F.col("query")), by(F.substring("query", 1, chars))
    own = traces.join(whole.withColumnRenamed("t", "exact"), F.col("query") == F.col("k"), "left").drop("k")
    own = own.join(part, F.substring("query", 1, chars) == F.col("k"), "left")
    return own.select("trace_id", F.coalesce("exact", "t").alias("test_id"))


def suite_summary(results: DataFrame, gate: float) -> DataFrame:
    """One row (n, pass_pct, coverage, ms, ok) of results (verdict, coverage, ms)."""
    pct = F.round(100.0 * F.count_if(F.col("verdict") == "pass") / F.count(F.lit(1)), 1)
    return results.agg(F.count(F.lit(1)).alias("n"), pct.alias("pass_pct"), F.round(F.avg("coverage"), 4).alias("coverage"), F.round(F.avg("ms"), 1).alias("ms")).withColumn("ok", F.col("pass_pct") >= gate)


def compressed(pool: DataFrame, overlap: Column, k: int) -> DataFrame:
    """The k best rows of each query by 0.6 of the score and 0.4 of the overlap, with their rank."""
    scored = pool.withColumn("value", F.round(0.6 * F.col("score") + 0.4 * overlap, 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "chunk_id")).cast("long")).where(F.col("rank") <= k)


def inject_missing(pool: DataFrame, wanted: DataFrame, by_key: DataFrame, by_number: DataFrame, similar: DataFrame) -> DataFrame:
    """(query_id, key, chunk_id, score): for each key (query_id, key) that no row of `pool` (query_id, key) has, the first
    of: a chunk of the key (key, chunk_id) at 1.50, a chunk of its number (number, chunk_id) at 1.20, the query's most
    similar chunk (query_id, chunk_id, sim) at 1.35."""
    gone = wanted.join(pool.select("query_id", "key").distinct(), ["query_id", "key"], "left_anti")
    one = lambda df, by: df.groupBy(by).agg(F.min("chunk_id").alias(f"{by}_chunk"))
    best = similar.groupBy("query_id").agg(F.min_by("chunk_id", F.struct(-F.col("sim"), "chunk_id")).alias("near"))
    out = gone.withColumn("number", F.regexp_extract("key", "([0-9]+)", 1))
    out = out.join(one(by_key, "key"), "key", "left").join(one(by_number, "number"), "number", "left").join(best, "query_id", "left")
    score = F.when(F.col("key_chunk").isNotNull(), 1.50).when(F.col("number_chunk").isNotNull(), 1.20).otherwise(1.35)
    out = out.select("query_id", "key", F.coalesce("key_chunk", "number_chunk", "near").alias("chunk_id"), score.alias("score"))
    return out.where("chunk_id IS NOT NULL")


def safety_net(candidates: DataFrame, have: DataFrame, least: float = 0.15) -> DataFrame:
    """(query_id, chunk_id, value): for each query that isn't in `have` the best of its candidates (query_id, chunk_id,
    hits, sim) of `least` similarity, by ten times the hits and the similarity."""
    open_ = candidates.where(F.col("sim") >= least).join(have.select("query_id").distinct(), "query_id", "left_anti")
    value = F.round(10 * F.col("hits") + F.col("sim"), 6)
    best = open_.groupBy("query_id").agg(F.min_by(F.struct("chunk_id", value.alias("value")), F.struct(-value, "chunk_id")).alias("b"))
    return best.select("query_id", "b.chunk_id", "b.value")


def coverage_fill(pool: DataFrame, expected: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, category, chunk_id, sim): for each expected category (query_id, category, most, least) that `pool` (query_id,
    category, chunk_id) lacks, its `most` best candidates (query_id, category, chunk_id, sim) of similarity `least` or more that aren't in the pool."""
    gone = expected.join(pool.select("query_id", "category").distinct(), ["query_id", "category"], "left_anti")
    w = Window.partitionBy("query_id", "category").orderBy(F.desc("sim"), "chunk_id")
    new = candidates.join(gone, ["query_id", "category"]).where(F.col("sim") >= F.col("least")).join(pool.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return new.withColumn("n", F.row_number().over(w)).where("n <= most").select("query_id", "category", "chunk_id", "sim")


def with_last_reply(q: Column, reply: Column, least: int = 8, chars: int = 100) -> Column:
    """A query of fewer than `least` words with the start of the last reply after it."""
    short = F.size(F.split(F.trim(q), r"\s+")) < least
    return F.when(short & reply.isNotNull(), F.concat(q, F.lit(" "), F.substring(reply, 1, chars))).otherwise(q)


def token_estimates(c: Column) -> tuple[Column, Column]:
    """A quarter of the characters, and 1.35 for each word, rounded down."""
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.floor(F.length(c) / 4).cast("long"), F.floor(words * 1.35).cast("long")


def live(chunks: DataFrame, archived: DataFrame, generated: str = "generated_reports") -> DataFrame:
    """Rows whose path (rel_path) isn't archived (rel_path) and doesn't start like generated content."""
    return chunks.where(~F.startswith("rel_path", F.lit(generated))).join(archived.select("rel_path").distinct(), "rel_path", "left_anti")


def source_list(pool: DataFrame, first: int = 20, most: int = 8) -> DataFrame:
    """(query_id, source, page, score, place): each query's first `first` distinct (source, page) by rank, each as it comes
    first, of which the `most` of greatest score stay; equal scores by rank."""
    own = pool.groupBy("query_id", "source", "page").agg(F.min(F.struct("rank", "score")).alias("b"))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("b.rank"))).where(F.col("n") <= first)
    w = Window.partitionBy("query_id").orderBy(F.desc("b.score"), "b.rank")
    return own.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).select("query_id", "source", "page", F.col("b.score").alias("score"), "place")


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row (nodes, edges, relations)."""
    n = edges.select(F.col("src").alias("node")).union(edges.select("dst")).agg(F.countDistinct("node").alias("nodes"))
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("relation").alias("relations")).crossJoin(n)  # one row each
