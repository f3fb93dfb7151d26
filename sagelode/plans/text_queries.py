"""Queries over text, paths, citations and amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legal, text, vectors
from ..sources.readers import CHUNKS_SQL, chunks, row_sentence, table

#: Sentences with references and amounts, for what invented prose doesn't hold.
SENTENCES = (
    (1, "What does Section 17(5) of the CGST Act say on blocked credit? See Rule 42 and Circular No. 183/15/2022."),
    (2, "igst refund under section 16 and rule 89 for exports; Schedule II applies."),
    (3, "Pay Rs. 1,50,000 with 18% tax within 30 days; interest is 24 per cent."),
    (4, "Credit of 2.5 lakh with 40% exempt turnover, late by 45 days"),
    (5, "A demand of 1.2 crore at 12% under Notification No. 11/2017, late by 365 days"),
    (6, "form drc-01 and gstr-3b replies, cir 183"),
    (7, "nothing of note"),
    (8, "SECTION 17(5), RULE 42 and NOTIFICATION NO. 11/2017 under the IGST ACT; cf. S. 16, s.9(3)(b) and u/s 73."),
)
_VALUES = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in SENTENCES) + ")"
_SENTENCES_SQL = f"s(id, q) AS {_VALUES}"
#: The sentences and all documents.
_ALL_SQL = f"s AS (SELECT id::BIGINT AS id, q FROM {_VALUES} v(id, q) UNION ALL SELECT 100 + doc_id, text FROM documents)"


def _sentences(spark):
    return spark.createDataFrame(list(SENTENCES), "id long, q string")


def _all_texts(spark, sf):
    """(id, q): the sentences, and each document under 100 more than its number."""
    return _sentences(spark).unionByName(table(spark, sf, "documents").select((F.col("doc_id") + 100).alias("id"), F.col("text").alias("q")))


def _joined(c):
    return F.array_join(c, "|")


def clean_text_q(spark, sf):
    c = text.clean_text(text.fold_marks(F.col("text")))
    return chunks(spark, sf).select("chunk_id", F.md5(c).alias("clean_md5"), F.length(c).alias("n"))


def quality_q(spark, sf):
    c = F.col("text")
    q = text.alpha_quality(c)
    return chunks(spark, sf).select("chunk_id", F.round(q, 6).alias("quality"), (q < 0.7).alias("garbage"), F.round(text.meaningful_ratio(c), 6).alias("meaningful"))


def html_strip_q(spark, sf):
    c = text.html_strip(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.length(c).alias("n"), F.md5(c).alias("text_md5")).where("n >= 100")


def path_ladders_q(spark, sf):
    p = F.col("rel_path")
    return chunks(spark, sf).select(
        "chunk_id",
        text.document_type(p).alias("document_type"),
        text.category(p).alias("category"),
        text.source_priority(p).alias("priority"),
        F.round(text.authority_weight(p), 6).alias("weight"),
        text.path_year(p).alias("year"),
        text.act_prefix(p).alias("act"),
        text.case_name(F.substring_index(p, "/", -1)).alias("case_name"),
        text.path_url("/view?path=", p).alias("url"),
    )


def circular_keys_q(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.circular_key(F.concat(F.lit("circulars/cir_no_"), F.col("page_id") % 250, F.lit(".pdf"))).alias("circular"))


def window_chunks_q(spark, sf):
    w = chunks(spark, sf).select("chunk_id", F.posexplode(text.char_windows(F.col("text"))).alias("n", "w"))
    return w.where(F.length("w.text") >= 80).select("chunk_id", "n", F.col("w.at").alias("pos"), F.md5("w.text").alias("text_md5"))


def word_windows_q(spark, sf):
    w = chunks(spark, sf).select("chunk_id", F.posexplode(text.word_windows(F.col("text"))).alias("n", "w"))
    return w.select("chunk_id", "n", F.md5("w.text").alias("text_md5"))


def chunk_ids_q(spark, sf):
    p = F.col("rel_path")
    out = text.chunk_id(text.document_type(p), F.substring_index(p, "/", -1), F.lit("P1"), F.col("text"), F.lit(0))
    return chunks(spark, sf).select("chunk_id", out.alias("key"))


def token_counts_q(spark, sf):
    t = chunks(spark, sf).select("chunk_id", F.explode(text.simple_tokens(F.col("text"))).alias("token"))
    return t.groupBy("chunk_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def reference_tokens_q(spark, sf):
    return _all_texts(spark, sf).select("id", _joined(text.reference_tokens(F.col("q"))).alias("tokens"))


def citations_q(spark, sf):
    keys = legal.citation_keys(F.col("q"))
    return _all_texts(spark, sf).select("id", _joined(keys).alias("citations"), _joined(F.array_distinct(F.transform(keys, legal.canonical_key))).alias("canonical"), _joined(legal.query_refs(F.col("q"))).alias("refs"))


def amounts_q(spark, sf):
    q = F.col("q")
    a, p, d = legal.amount(q), legal.percentage(q), legal.days(q)
    return _all_texts(spark, sf).select(
        "id",
        a.alias("amount"),
        p.alias("pct"),
        d.alias("days"),
        legal.credit_reversal(a, p).alias("reversal"),
        legal.capital_goods_reversal(a, p).alias("capital_reversal"),
        legal.delay_interest(a, d).alias("interest"),
        legal.tax_parts(a, p)["total"].alias("total"),
    )


def number_claims_q(spark, sf):
    q = F.col("q")
    context = F.lit("The rate is 18% and 30 days are allowed; 150000 is the limit.")
    return _all_texts(spark, sf).select("id", _joined(legal.numeric_claims(q)).alias("claims"), _joined(legal.ungrounded(q, context)).alias("ungrounded"))


def row_sentences_q(spark, sf):
    c = ["c_custkey", "c_name", "c_mktsegment"]
    return table(spark, sf, "customer").select("c_custkey", row_sentence(c).alias("sentence"))


def cache_keys_q(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", text.cache_key(F.col("text")).alias("key"))


def best_sentence_q(spark, sf):
    """For every fiftieth benchmark item and each document that shares a word with it, the sentence that shares most; the
    first on ties."""
    items = table(spark, sf, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(text.simple_tokens(F.col("text")))).alias("token"))
    s = chunks(spark, sf).select("chunk_id", F.posexplode(F.split("text", "[.]")).alias("n", "s")).select("chunk_id", "n", F.explode(F.array_distinct(text.simple_tokens(F.col("s")))).alias("token"))
    score = s.join(items, "token").groupBy("query_id", "chunk_id", "n").agg(F.count(F.lit(1)).alias("score"))
    best = score.groupBy("query_id", "chunk_id").agg(F.max(F.struct("score", (-F.col("n")).alias("m"))).alias("b"))
    return best.select("query_id", "chunk_id", F.col("b.score").alias("score"), (-F.col("b.m")).alias("n"))


#: (name, words that set it off), asked in order (fixed values).
INTENTS = (("definition", ("what is", "define", "meaning of")), ("comparison", ("difference", "compare", " vs ")), ("rate_classification", ("rate", "hsn", "percent")), ("section_advisory", ("section", "rule", "under")))


def intent_q(spark, sf):
    q = F.lower("q")
    return _all_texts(spark, sf).select("id", text.ladder([(text.has(q, *w), n) for n, w in INTENTS], "general").alias("intent"), legal.safety_band(F.col("id") / 7.0).alias("band"))


def similarity_q(spark, sf):
    """Each vector against the next one by number."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    pair = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("q")), "vec_id")
    return pair.select("vec_id", F.round(vectors.cosine("embedding", "q"), 6).alias("cosine"), F.round(vectors.sigmoid(vectors.inner("embedding", "q")), 6).alias("sigmoid"))


QUERIES = {
    "clean_text": clean_text_q,
    "text_quality": quality_q,
    "html_strip": html_strip_q,
    "path_ladders": path_ladders_q,
    "circular_keys": circular_keys_q,
    "window_chunks": window_chunks_q,
    "word_windows": word_windows_q,
    "chunk_ids": chunk_ids_q,
    "tokenize_counts": token_counts_q,
    "reference_tokens": reference_tokens_q,
    "citation_extract": citations_q,
    "amount_formulas": amounts_q,
    "number_claims": number_claims_q,
    "row_sentences": row_sentences_q,
    "cache_keys": cache_keys_q,
    "best_sentence": best_sentence_q,
    "intent_bands": intent_q,
    "vector_similarity": similarity_q,
}

_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def simple_tokens_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '([a-z0-9]+)', 1), lambda w: length(w) > 1 AND w NOT IN ({_STOPS}))"


def _cat_sql(p: str) -> str:
    out = []
    for name, folders in text.CATEGORY_FOLDERS:
        tests = [f"contains('/' || {p}, '/{f}/')" for f in folders] + [f"contains('/' || {p}, '/{f}')" for f in folders if len(f) >= 4]
        out.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return "CASE " + " ".join(out) + " ELSE 'other' END"


_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"
_RE = {k: p.replace("'", "''") for k, p in legal.CITATIONS}
_NORM = "upper(translate(trim(v), '/-()', '___'))"
_CITES = (
    "list_concat("
    + ", ".join(f"list_transform(regexp_extract_all(q, '{p}', 1), lambda v: 'CGST_{k}_' || {_NORM})" for k, p in _RE.items())
    + f", CASE WHEN regexp_matches(q, '{legal.ACT}') THEN ['ACT'] ELSE [] END)"
)


def _distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _unless_empty(pattern: str, of: str = "lower(q)") -> str:
    return f"try_cast(replace(nullif(regexp_extract({of}, '{pattern}', 1), ''), ',', '') AS DECIMAL(18,2))"


_AMOUNT = (
    f"CAST(coalesce({_unless_empty('([0-9,]+(?:[.][0-9]+)?)\\s*crore')} * 10000000, {_unless_empty('([0-9,]+(?:[.][0-9]+)?)\\s*lakh')} * 100000, "
    f"{_unless_empty('(?:₹|rs[.]?|inr)\\s*([0-9,]+(?:[.][0-9]+)?)')}) AS DECIMAL(18,2))"
)
_CLAIMS = (
    lambda c: f"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all({c}, '{legal.RATE}', 1), lambda x: x || '%'), list_transform(regexp_extract_all({c}, '{legal.RUPEES}', 1), lambda x: replace(x, ',', '')), regexp_extract_all({c}, '{legal.DAYS}', 1))))"
)
_CONTEXT = "'The rate is 18% and 30 days are allowed; 150000 is the limit.'"
_SAFE = ", ".join(f"'{n}'" for n in legal.SAFE_NUMBERS)
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_ACTS = "list_filter([CASE WHEN contains(lower(q), 'cgst') THEN 'CGST' END, CASE WHEN contains(lower(q), 'igst') THEN 'IGST' END, CASE WHEN contains(lower(q), 'sgst') THEN 'SGST' END, CASE WHEN contains(lower(q), 'utgst') THEN 'UTGST' END], lambda a: a IS NOT NULL)"

ORACLES = {
    "clean_text": f"""WITH {CHUNKS_SQL}, c AS (SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        translate(text, '‘’“”–—', '''''""--'), chr(12), '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'),
        '[\\x00-\\x09\\x0B-\\x1F\\x7F]', '', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS t FROM chunks)
        SELECT chunk_id, md5(t) AS clean_md5, length(t)::INTEGER AS n FROM c""",
    "text_quality": f"""WITH {CHUNKS_SQL}, c AS (SELECT chunk_id, text, {_WORDS} AS w, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '\\P{{L}}', '', 'g')) / length(text) ELSE 0 END AS q FROM chunks)
        SELECT chunk_id, round(q, 6) AS quality, q < 0.7 AS garbage, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_full_match(x, '\\p{{L}}{{3,}}'))) / len(w) ELSE 0 END, 6) AS meaningful FROM c""",
    "html_strip": "SELECT page_id, length(t)::INTEGER AS n, md5(t) AS text_md5 FROM (SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS t FROM pages) WHERE length(t) >= 100",
    "path_ladders": f"""WITH {CHUNKS_SQL}, c AS (SELECT *, lower(rel_path) AS p, split_part(rel_path, '/', -1) AS f FROM chunks), d AS (SELECT *,
        CASE WHEN contains(p, 'cgst acts') OR contains(p, 'igst acts') OR contains(p, 'utgst') OR contains(p, '/act/') OR starts_with(p, 'act/') OR ((contains(p, 'cgst') OR contains(p, 'igst')) AND contains(p, 'act') AND NOT contains(p, 'rules')) THEN 1
             WHEN contains(p, 'rules') THEN 2 WHEN contains(p, 'notification') THEN 3 WHEN contains(p, 'circular') THEN 4 WHEN contains(p, 'icai') THEN 5 WHEN contains(p, 'aar') OR contains(p, 'advance') THEN 6
             WHEN contains(p, 'high court') OR contains(p, 'supreme court') THEN 7 WHEN contains(p, 'form') OR contains(p, 'apl') THEN 8 WHEN contains(p, 'excel') OR contains(p, '.xlsx') THEN 9 ELSE 10 END AS priority FROM c)
        SELECT chunk_id, CASE WHEN contains(p, 'act') OR contains(p, 'cgst') OR contains(p, 'igst') THEN 'Statute' WHEN contains(p, 'rule') THEN 'Rules' WHEN contains(p, 'notification') THEN 'Notification'
            WHEN contains(p, 'circular') THEN 'Circular' WHEN contains(p, 'case laws') OR contains(p, 'aar') THEN 'Case Law' WHEN contains(p, 'faq') THEN 'FAQ' ELSE 'Other' END AS document_type,
            {_cat_sql("p")} AS category, priority, round((11 - priority) / 10.0::DOUBLE, 6) AS weight, split_part(rel_path, '/', 2)::INTEGER AS year,
            CASE WHEN contains(p, 'utgst') THEN 'UTGST' WHEN contains(p, 'igst') THEN 'IGST' ELSE 'CGST' END AS act,
            trim(replace(regexp_replace(f, '[.][A-Za-z0-9]+$', ''), '_', ' ')) AS case_name, '/view?path=' || replace(replace(rel_path, ' ', '%20'), '/', '%2F') AS url FROM d""",
    "circular_keys": "SELECT page_id, 'CIRCULAR_' || (page_id % 250) AS circular FROM pages",
    "window_chunks": f"""WITH {CHUNKS_SQL}, w AS (SELECT chunk_id, text, unnest(range(0, greatest(1, length(text) - 200), 1300)) AS pos FROM chunks), x AS (SELECT chunk_id, pos, substr(text, (pos + 1)::BIGINT, 1500) AS t FROM w)
        SELECT chunk_id, (pos // 1300)::INTEGER AS n, pos::INTEGER AS pos, md5(t) AS text_md5 FROM x WHERE length(t) >= 80""",
    "word_windows": f"""WITH {CHUNKS_SQL}, a AS (SELECT chunk_id, {_WORDS} AS w FROM chunks), b AS (SELECT chunk_id, w, unnest(range(0, greatest(len(w) - 1, 0) + 1, 700)) AS pos FROM a)
        SELECT chunk_id, (pos // 700)::INTEGER AS n, md5(coalesce(array_to_string(list_slice(w, pos + 1, pos + 800), ' '), '')) AS text_md5 FROM b""",
    "chunk_ids": f"""WITH {CHUNKS_SQL}, c AS (SELECT *, lower(rel_path) AS p, split_part(rel_path, '/', -1) AS f FROM chunks)
        SELECT chunk_id, concat_ws('_', CASE WHEN contains(p, 'act') OR contains(p, 'cgst') OR contains(p, 'igst') THEN 'STA' WHEN contains(p, 'rule') THEN 'RUL' WHEN contains(p, 'notification') THEN 'NOT' WHEN contains(p, 'circular') THEN 'CIR'
            WHEN contains(p, 'case laws') OR contains(p, 'aar') THEN 'CAS' WHEN contains(p, 'faq') THEN 'FAQ' ELSE 'OTH' END, upper(substr(regexp_replace(f, '[^A-Za-z0-9]', '', 'g'), 1, 20)), 'P1', substr(md5(concat_ws('|', f, '0', text)), 1, 6)) AS key FROM c""",
    "tokenize_counts": f"WITH {CHUNKS_SQL}, t AS (SELECT chunk_id, unnest({simple_tokens_sql('text')}) AS token FROM chunks) SELECT chunk_id, token, count(*) AS tf FROM t GROUP BY ALL",
    "reference_tokens": f"""WITH {_ALL_SQL} SELECT id, array_to_string(list_concat(regexp_extract_all(lower(q), '({text.WORD})', 1),
        list_transform(regexp_extract_all(lower(q), '\\b((?:section|rule|schedule|article|clause)\\s+\\d+(?:[(\\w)]+)*)', 1), lambda x: regexp_replace(x, '[^a-z0-9]', '_', 'g')),
        regexp_extract_all(lower(q), '\\b([a-z]{{2,5}}-[0-9a-z_]+)\\b', 1), list_transform(regexp_extract_all(lower(q), '\\b(?:circular|cir)[-_.\\s]*(?:no\\.?[-_.\\s]*)?(\\d{{2,3}})\\b', 1), lambda x: 'circular_' || x)), '|') AS tokens FROM s""",
    "citation_extract": f"""WITH {_ALL_SQL}, a AS (SELECT id, q, {_CITES} AS c, CASE WHEN len({_ACTS}) > 0 THEN {_ACTS} ELSE ['CGST', 'IGST'] END AS acts FROM s),
        b AS (SELECT *, {_distinct("c")} AS d, list_concat(flatten(list_transform(regexp_extract_all(lower(q), '\\bsec(?:tion)?\\s*\\.?\\s*(\\d+)', 1), lambda n: list_transform(acts, lambda a: a || '_SEC_' || n))),
            flatten(list_transform(regexp_extract_all(lower(q), '\\brule\\s+(\\d+)', 1), lambda n: list_transform(acts, lambda a: a || '_RULE_' || n))),
            list_transform(regexp_extract_all(lower(q), '\\bschedule\\s+([ivxlcdm]+|\\d+)\\b', 1), lambda n: 'CGST_SCHED_' || upper(n)),
            list_transform(regexp_extract_all(lower(q), '\\bcircular\\s+(?:no\\.?\\s*)?(\\d{{2,3}})\\b', 1), lambda n: 'CIRCULAR_' || n)) AS r FROM a)
        SELECT id, array_to_string(d, '|') AS citations, array_to_string(list_transform(d, lambda k: regexp_replace(k, '^(?:[A-Z]+_)?CIRC_(\\d+)(?:_.*)?$', 'CIRCULAR_\\1')), '|') AS canonical, array_to_string({_distinct("r")}, '|') AS refs FROM b""",
    "amount_formulas": f"""WITH {_ALL_SQL}, a AS (SELECT id, {_AMOUNT} AS amount, {_unless_empty("(\\d+(?:\\.\\d+)?)\\s*(?:%|per\\s*cent)")} AS pct, nullif(regexp_extract(lower(q), '(\\d+)\\s*days?', 1), '')::INTEGER AS days FROM s)
        SELECT id, amount, pct, days, round(amount::DECIMAL(20,4) * pct / 100, 2)::DECIMAL(18,2) AS reversal, round(round(amount / 60, 2)::DECIMAL(18,2) * pct / 100, 2)::DECIMAL(18,2) AS capital_reversal,
            round(amount * 18 * days / 36500, 2)::DECIMAL(18,2) AS interest, (amount + round(amount * pct / 100, 2)::DECIMAL(18,2))::DECIMAL(18,2) AS total FROM a""",
    "number_claims": f"""WITH {_ALL_SQL} SELECT id, array_to_string({_CLAIMS("q")}, '|') AS claims, array_to_string(list_filter({_CLAIMS("q")}, lambda x: replace(x, '%', '') NOT IN ({_SAFE})
        AND NOT list_contains({_CLAIMS(_CONTEXT)}, x) AND NOT contains({_CONTEXT}, replace(x, '%', ''))), '|') AS ungrounded FROM s""",
    "row_sentences": "SELECT c_custkey, concat_ws('. ', 'c_custkey: ' || c_custkey, 'c_name: ' || c_name, 'c_mktsegment: ' || c_mktsegment) AS sentence FROM customer",
    "cache_keys": "SELECT conv_id, turn, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS key FROM conversations WHERE role = 'user'",
    "best_sentence": f"""WITH {CHUNKS_SQL}, i AS (SELECT item_id AS query_id, unnest(list_distinct({simple_tokens_sql("text")})) AS token FROM benchmark WHERE item_id % 50 = 0), s AS (SELECT chunk_id, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) - 1 AS n FROM chunks),
        c AS (SELECT query_id, chunk_id, n, count(*) AS score FROM (SELECT chunk_id, n, unnest(list_distinct({simple_tokens_sql("s")})) AS token FROM s) JOIN i USING (token) GROUP BY ALL) SELECT query_id, chunk_id, score, n::INTEGER AS n FROM c QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, n) = 1""",
    "intent_bands": f"WITH {_ALL_SQL} SELECT id, CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(lower(q), '{x}')" for x in w) + f" THEN '{n}'" for n, w in INTENTS)
    + " ELSE 'general' END AS intent, CASE WHEN id / 7.0 < 0.4 THEN 'refuse' WHEN id / 7.0 < 0.65 THEN 'caution' WHEN id / 7.0 < 0.8 THEN 'review' ELSE 'ok' END AS band FROM s",
    "vector_similarity": f"""WITH d AS (SELECT a.vec_id, {_DOT.format(a="a.embedding", b="b.embedding")} AS ab, {_DOT.format(a="a.embedding", b="a.embedding")} AS aa, {_DOT.format(a="b.embedding", b="b.embedding")} AS bb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
        SELECT vec_id, round(CASE WHEN sqrt(aa) * sqrt(bb) > 0 THEN ab / (sqrt(aa) * sqrt(bb)) ELSE 0 END, 6) AS cosine, round(1 / (1 + exp(-5 * ab)), 6) AS sigmoid FROM d""",
}
