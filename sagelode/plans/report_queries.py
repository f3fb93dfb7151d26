"""Queries of answer coverage, mined misses and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, segments
from ..sources.readers import CHUNKS_SQL, chunks, table
from .assembly_queries import ORACLES as _ASSEMBLY, citation_verify
from .text_queries import _ALL_SQL, _SENTENCES_SQL, _all_texts, _sentences

#: (name, triggers, concepts): a text that holds a trigger should hold the concepts.
TRUTH_RULES = (("export", ["zero rated", "export"], ["refund", "bond"]), ("interest", ["late by", "interest"], ["days", "per cent"]), ("article", ["of the"], ["and", "in", "to"]))
MANDATORY = ("CGST_SEC_16", "CGST_SEC_17", "CGST_RUL_42", "CGST_RUL_89", "CIRCULAR_183")
LIMITS = {"documents": 100_000, "queries": 50_000, "text_bytes": 1 << 30}


KEYWORDS = ("18%", "24%", "section 17(5)", "circular 183", "gstr-3b", "1.2 crore", "reverse charge", "blocked credit", "export")
SYNONYMS = {"reverse charge": ["payable by the recipient", "demand"], "export": ["zero rated"]}
#: Texts with headers and entries, for what invented prose doesn't hold.
JUDGMENT = "Heard both sides at length on the appeal that is before this authority.\nBrief facts of the case: the applicant sells goods of many kinds in three states.\nQuestions presented\nshort\n  Analysis \nthe goods fall under the heading that the applicant names, as was found before. HELD so.\nOrder\nallowed"
SCHEDULE = "\n".join(f"{n}. goods of heading {n:04d} and what is sold with them at {n} per cent of their value\n  note {n}" for n in range(1, 9)) + "\nChapter 12 and all that follows it\n9) x\n" + "\n".join(["a line without a number that goes on for a while"] * 30)


def _texts(spark, sf):
    given = spark.createDataFrame([(-1, JUDGMENT), (-2, SCHEDULE)], "chunk_id long, text string")
    return chunks(spark, sf).select("chunk_id", "text").unionByName(given)


def structural_split(spark, sf):
    s = _texts(spark, sf).select("chunk_id", F.posexplode(segments.structural_segments(F.col("text"))).alias("segment", "s"))
    s = s.select("chunk_id", "segment", "s.structure", F.posexplode(segments.pack_sentences(F.col("s.text"))).alias("n", "t"))
    return s.select("chunk_id", "segment", "structure", "n", F.length("t").alias("chars"), F.md5("t").alias("text_md5"))


def rate_schedule(spark, sf):
    s = _texts(spark, sf).select("chunk_id", F.posexplode(segments.schedule_entries(F.col("text"))).alias("n", "t"))
    return s.select("chunk_id", "n", F.length("t").alias("chars"), F.md5("t").alias("text_md5"))


def truth_rules(spark, sf):
    both = chunks(spark, sf).select(F.col("chunk_id").alias("id"), "text").unionByName(_sentences(spark).select((-F.col("id")).cast("long").alias("id"), F.col("q").alias("text")))
    return reports.missing_concepts(both, list(TRUTH_RULES))


def keyword_coverage(spark, sf):
    both = chunks(spark, sf).select(F.col("chunk_id").alias("id"), "text").unionByName(_sentences(spark).select((-F.col("id")).cast("long").alias("id"), F.col("q").alias("text")))
    return reports.keyword_coverage(both, list(KEYWORDS), SYNONYMS)


def answer_coverage(spark, sf):
    return reports.answer_coverage(_all_texts(spark, sf).select("id", F.col("q").alias("text")), list(MANDATORY))


def mined_misses(spark, sf):
    """Return flags that the first lines of a priority's orders lack, as queries of a topic lack authorities."""
    flags = F.array(*map(F.lit, ("A", "N", "R")))
    seen = table(spark, sf, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("have"))
    log = table(spark, sf, "orders").join(seen, F.col("o_orderkey") == F.col("l_orderkey"))
    missing = F.array_except(flags, "have")
    return reports.miss_rates(log.select(F.col("o_orderpriority").alias("topic"), missing.alias("missing"), ((3 - F.size(missing)) / 3).alias("coverage")), 5, 0.3)


def enrichment_audit(spark, sf):
    c = chunks(spark, sf).select(F.substring_index("rel_path", "/", 1).alias("folder"), F.coalesce(F.length("text"), F.lit(0)).alias("n_text"))
    band = F.when(F.col("n_text") < 100, "none").when(F.col("n_text") < 500, "thin").otherwise("rich")
    return reports.band_counts(c, "folder", band, ["none", "thin", "rich"])


def retag_report(spark, sf):
    words = lambda c: F.split(F.lower(c), " ")
    return reports.tag_changes(table(spark, sf, "part").select("p_brand", words("p_type").alias("old"), words("p_name").alias("new")), "p_brand", "old", "new")


def reference_registry(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_type").alias("ref"), F.col("p_brand").alias("source"))
    return reports.reference_registry(p, F.when(F.col("ref") < "M", "statutory").otherwise("circular"))


def verification_score(spark, sf):
    """Verified citations of each text against all of them."""
    v = citation_verify(spark, sf)
    g = v.groupBy("id").agg(F.count(F.lit(1)).alias("total"), F.count("variant").alias("verified"), F.collect_list(F.when(F.col("variant").isNotNull(), F.col("citation"))).alias("y"), F.collect_list(F.when(F.col("variant").isNull(), F.col("citation"))).alias("n"))
    return g.select("id", "total", "verified", F.round(100.0 * F.col("verified") / F.col("total"), 1).alias("pct"), F.array_join(F.array_sort("y"), "|").alias("found"), F.array_join(F.array_sort("n"), "|").alias("lacking"))


def quotas_used(spark, sf):
    docs = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("text")).alias("text_bytes"))
    asked = table(spark, sf, "events").where("event_type = 'view'").agg(F.count(F.lit(1)).alias("queries"))
    return reports.quota_use(docs.join(F.broadcast(asked)), LIMITS)  # one row each


def index_alignment(spark, sf):
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n_chunks"))
    m = table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n_vectors"))
    return n.join(F.broadcast(m)).withColumn("aligned", F.col("n_chunks") == F.col("n_vectors"))  # one row each


QUERIES = {f.__name__: f for f in (structural_split, rate_schedule, keyword_coverage, truth_rules, answer_coverage, mined_misses, enrichment_audit, retag_report, reference_registry, verification_score, quotas_used, index_alignment)}


def _rule_sql(name, triggers, concepts):
    trig = "CASE " + " ".join(f"WHEN contains(lower(text), '{x}') THEN '{x}'" for x in triggers) + " END"
    miss = "concat_ws('|', " + ", ".join(f"CASE WHEN NOT contains(lower(text), '{c}') THEN '{c}' END" for c in concepts) + ")"
    return f"SELECT id, '{name}' AS rule, {trig} AS trigger, {miss} AS missing FROM t"


_HITS = ", ".join(f"('{k}', '{reports.keyword_pattern(k, SYNONYMS)}')" for k in KEYWORDS)
_KEYS = "k(key) AS (VALUES " + ", ".join(f"('{k}')" for k in MANDATORY) + ")"
_NUM = "split_part(key, '_', -1)"

ORACLES = {
    "truth_rules": f"WITH {CHUNKS_SQL}, {_SENTENCES_SQL}, t AS (SELECT chunk_id AS id, text FROM chunks UNION ALL SELECT -id, q FROM s) SELECT * FROM ({' UNION ALL '.join(_rule_sql(*r) for r in TRUTH_RULES)}) WHERE trigger IS NOT NULL AND missing <> ''",
    "keyword_coverage": f"""WITH {CHUNKS_SQL}, {_SENTENCES_SQL}, t AS (SELECT chunk_id AS id, text FROM chunks UNION ALL SELECT -id, q FROM s), k(key, pattern) AS (VALUES {_HITS}), h AS (SELECT id, key, regexp_matches(lower(coalesce(text, '')), pattern) AS hit FROM t, k)
        SELECT id, coalesce(string_agg(key, '|' ORDER BY key) FILTER (hit), '') AS found, coalesce(string_agg(key, '|' ORDER BY key) FILTER (NOT hit), '') AS missing, round(100.0::DOUBLE * count_if(hit) / count(*), 1) AS pct FROM h GROUP BY 1""",
    "answer_coverage": f"""WITH {_ALL_SQL}, {_KEYS}, h AS (SELECT id, key, CASE WHEN key LIKE '%\\_SEC\\_%' ESCAPE '\\' THEN regexp_matches(lower(q), '(section |sec |sec\\. |sec\\.)' || {_NUM}) WHEN key LIKE '%\\_RUL\\_%' ESCAPE '\\' THEN contains(lower(q), 'rule ' || {_NUM}) ELSE regexp_matches(lower(q), '(circular |circular no\\. |circular no )' || {_NUM} || '|/' || {_NUM} || '/') END AS hit FROM s, k)
        SELECT id, coalesce(string_agg(key, '|' ORDER BY key) FILTER (hit), '') AS cited, coalesce(string_agg(key, '|' ORDER BY key) FILTER (NOT hit), '') AS missing, CASE WHEN count_if(NOT hit) = 0 THEN 'pass' WHEN count_if(NOT hit) <= count(*) // 2 THEN 'partial' ELSE 'fail' END AS verdict FROM h GROUP BY 1""",
    "mined_misses": """WITH f(flag) AS (VALUES ('A'), ('N'), ('R')), o AS (SELECT o_orderkey AS k, o_orderpriority AS topic FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)), seen AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS flag FROM lineitem WHERE l_linenumber = 1),
        c AS (SELECT topic, count(*) AS n, round(avg(have / 3.0::DOUBLE), 4) AS coverage FROM (SELECT k, topic, count(*) AS have FROM o JOIN seen USING (k) GROUP BY 1, 2) GROUP BY 1),
        m AS (SELECT topic, flag AS missing, count(*) AS misses FROM o, f WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.k = o.k AND seen.flag = f.flag) GROUP BY 1, 2)
        SELECT topic, missing, misses, n, coverage, round(misses / n, 4) AS rate FROM m JOIN c USING (topic) WHERE n >= 5 AND misses / n >= 0.3""",
    "enrichment_audit": f'WITH {CHUNKS_SQL} SELECT split_part(rel_path, \'/\', 1) AS folder, count(*) AS n, count_if(coalesce(length(text), 0) < 100) AS "none", count_if(length(text) >= 100 AND length(text) < 500) AS thin, count_if(length(text) >= 500) AS rich FROM chunks GROUP BY 1',
    "retag_report": """WITH p AS (SELECT p_brand, list_distinct(string_split(lower(p_type), ' ')) AS o, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), d AS (SELECT p_brand, len(list_filter(w, lambda x: NOT list_contains(o, x))) AS added, len(list_filter(o, lambda x: NOT list_contains(w, x))) AS gone FROM p)
        SELECT p_brand, count(*) AS n, count_if(added > 0 OR gone > 0) AS changed, sum(added)::BIGINT AS added FROM d GROUP BY 1""",
    "reference_registry": "WITH d AS (SELECT DISTINCT p_type AS ref, p_brand AS source FROM part) SELECT ref, CASE WHEN ref < 'M' THEN 'statutory' ELSE 'circular' END AS kind, count(*) AS n_sources, array_to_string((list(source ORDER BY source))[1:2], '|') AS sources FROM d GROUP BY 1",
    "verification_score": f"WITH v AS ({_ASSEMBLY['citation_verify']}) SELECT id, count(*) AS total, count(variant) AS verified, round(100.0::DOUBLE * count(variant) / count(*), 1) AS pct, coalesce(string_agg(citation, '|' ORDER BY citation) FILTER (variant IS NOT NULL), '') AS found, coalesce(string_agg(citation, '|' ORDER BY citation) FILTER (variant IS NULL), '') AS lacking FROM v GROUP BY 1",
    "quotas_used": f"WITH q(name, used, allowed) AS (SELECT 'documents', count(*), {LIMITS['documents']} FROM documents UNION ALL SELECT 'queries', count(*), {LIMITS['queries']} FROM events WHERE event_type = 'view' UNION ALL SELECT 'text_bytes', sum(strlen(text))::BIGINT, {LIMITS['text_bytes']} FROM documents) SELECT name, used, allowed::BIGINT AS allowed, round(100.0::DOUBLE * used / allowed, 2) AS pct FROM q",
    "index_alignment": "SELECT *, n_chunks = n_vectors AS aligned FROM (SELECT count(*) AS n_chunks FROM documents), (SELECT count(*) AS n_vectors FROM embeddings)",
}
