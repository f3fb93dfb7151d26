"""Topics, routes and expected categories of hand-made questions; counts of tokens within a row."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sagelode.functions import legal
from sagelode.operators import lexical, routing
from sagelode.plans import catalogue


def test_topics_routes_and_categories(spark):
    rows = [
        (1, "Section 17(5) and rule 42"),
        (2, "refund of zero rated supplies"),
        (3, "Schedule II applies"),
        (4, None),
        (5, ""),
        (6, "e-way bill and HSN rate, posé"),
        (7, "Is a pos needed?"),
        (8, "refund or penalty"),
    ]
    q = F.col("q")
    df = spark.createDataFrame(rows, "id long, q string").select(
        "id", routing.topic_of(q, legal.citation_keys(q)).alias("t"), routing.route_folders(q).alias("f"), routing.expected_categories(q).alias("c")
    )
    got = {r.id: r for r in df.collect()}
    # equal scores go to the topic listed first
    assert {k: r.t for k, r in got.items()} == {1: "ITC", 2: "Refund", 3: "Supply", 4: "General", 5: "General", 6: "General", 7: "General", 8: "Refund"}
    assert got[4].f == got[5].f == got[3].f == []
    assert "Rules" in got[1].f and set(routing.COURTS) < set(got[1].f) and got[1].f == sorted(set(got[1].f))
    assert "Forms" in got[6].f  # a letter with a mark is no end of a word: 'posé' isn't 'pos'
    assert "CGST" not in got[6].f and got[7].f == sorted({"Act", "IGST", "Circulars", "Notification", *routing.COURTS})
    # words count by substring: "rated" has "rate"
    assert got[4].c == got[1].c == ["statute"] and got[2].c == ["circular", "notification", "statute"] and got[6].c == ["notification", "statute"]


def test_topics_seek_each_citation_pattern_once(spark):
    plan = catalogue.QUERIES["chunk_topics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 * len(legal.CITATIONS)  # of the sentences and of the documents


def test_citation_keys_are_those_of_the_patterns(spark):
    """Words are sought before the patterns; that drops no match, whatever its case."""
    texts = ["SECTION 9(3)(b) Sec.7 U/S 12 cf. S.16 s. 4", "cgst ACT", "RULE 42 U/R 3", "NOTIFICATION NO. 11/2017", "Circular no 1-2-3", "SCHEDULE iv", "sched 3", "ſection 5 İs.8", "", None, "s5 rules act"]
    q = F.col("q")
    each = lambda k: lambda v: legal.normal_citation(k, v)
    plain = [F.transform(F.regexp_extract_all(q, F.lit(p), 1), each(k)) for k, p in legal.CITATIONS]
    named = F.when(q.rlike(legal.ACT), F.array(F.lit("ACT"))).otherwise(F.array().cast("array<string>"))
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    got = df.select("q", legal.citation_keys(q).alias("got"), F.array_distinct(F.concat(*plain, named)).alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got] and sum(bool(r.got) for r in got) >= 6


def test_counts_within_a_row(spark):
    lists = [[], ["b", "a", "b"], ["x"], None, ["a"] * 5 + ["é", "z", "é"]]
    df = spark.createDataFrame(list(enumerate(lists)), "id long, t array<string>").select("id", lexical.counted(F.col("t")).alias("c"))
    for r in df.collect():
        assert [tuple(x) for x in r.c] == sorted(Counter(lists[r.id] or []).items())


def test_index_leaves_out_chunks_without_tokens(spark):
    df = spark.createDataFrame([(1, "a b a", "x"), (2, None, "x"), (3, "", "y"), (4, "b", "y")], "chunk_id long, text string, category string")
    ix = lexical.index(df, F.filter(F.split("text", " "), lambda w: w != ""), ["category"])
    assert sorted(map(tuple, lexical.postings(ix).select("chunk_id", "token", "tf", "dl").collect())) == [(1, "a", 2, 3), (1, "b", 1, 3), (4, "b", 1, 1)]
    assert sorted((r.category, r.N, r.avgdl) for r in lexical.length_stats(ix, ["category"]).collect()) == [("x", 1, 3.0), ("y", 1, 1.0)]


@pytest.mark.parametrize(("cells", "block"), [(1_000_000, 1024), (40, 3), (1, 1)])
def test_best_scores_within_rows_are_those_of_joins(spark, monkeypatch, cells, block):
    """By whatever stretches and blocks, the best are those of the joined postings; before, each pair of query and chunk was shuffled."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghé")
    texts = [(i, " ".join(rng.choice(letters, rng.integers(0, 9)))) for i in range(150)] + [(150, None), (151, "a b"), (152, "a b")]
    df = spark.createDataFrame(texts, "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame([(q, t) for q in range(7) for t in rng.choice([*letters, "none"], 3)], "query_id long, token string")
    ix = lexical.index(df, F.filter(F.split("text", " "), lambda w: w != ""))
    post, stats = lexical.postings(ix), lexical.length_stats(ix)
    plain = lexical.best_scores
    monkeypatch.setattr(lexical, "best_scores", lambda *a: plain(*a, block=block, cells=cells))
    order = [F.desc("score"), "chunk_id"]
    rows = lambda x: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 5)) for r in x.collect())
    freq = lexical.frequencies(ix)
    best = lexical.best_bm25(ix, lexical.idf_okapi(post, stats.select("N"), df=freq), stats.select("avgdl"), queries, 5)
    assert rows(best) == rows(lexical.top_k(lexical.bm25(post, lexical.idf_okapi(post, stats.select("N")), stats.select("avgdl"), queries), 5, ["query_id"], order))
    found = lexical.best_tfidf(ix, lexical.idf_smooth(post, stats.select("N"), freq), queries, 5)
    assert rows(found) == rows(lexical.top_k(lexical.tfidf(post, lexical.idf_smooth(post, stats.select("N")), queries).where("score > 0"), 5, ["query_id"], order))
    assert "Aggregate" not in best._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    none = spark.createDataFrame([], "query_id long, token string")
    assert lexical.best_bm25(ix, lexical.idf_okapi(post, stats.select("N")), stats.select("avgdl"), none, 5).count() == 0


def test_evaluation_reads_the_ranked_lists_not_the_postings(spark):
    for name in ("recall_mrr", "first_failures", "rank_pivot", "hard_negatives", "provenance"):
        assert not any("/postings-" in f for f in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()), name


def test_dense_tiles_hold_few_products(spark, monkeypatch):
    """By whatever tiles the products are made, forgotten or not, the rows are those of a plain search; ties stay."""
    import numpy as np

    from sagelode.operators import dense

    rng = np.random.default_rng(3)
    vecs = rng.integers(-2, 3, (700, 4)).astype(float)
    rows = [(i, v.tolist(), f"g{i % 3}" if i % 7 else None) for i, v in enumerate(vecs)]
    v = spark.createDataFrame(rows, "id long, vec array<float>, g string").repartition(3)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec")
    for by, k, floor in ((None, 5, None), ("g", 4, 1.0)):
        want = set()
        for a in range(0, 700, 50):
            sims = [(-float(vecs[a] @ vecs[i]), i, g if by else "") for i, _, g in rows]
            for g in {x[2] for x in sims}:
                best = sorted(x for x in sims if x[2] == g and (floor is None or -x[0] >= floor))[:k]
                want |= {(a, i, g, -s, n) for n, (s, i, _) in enumerate(best, 1)}
        for cells in (64, 2000, 1_000_000):
            # the tasks get the bound with the function, as they import the module by themselves
            tiles = lambda batches, names, m, n, least, schema, f=dense._candidates, cells=cells: f(batches, names, m, n, least, schema, cells)
            monkeypatch.setattr(dense, "_candidates", tiles)
            out = dense.dense_topk(v, q, k, by=by, floor=floor).select("query_id", "id", "grp", "sim", "rank")
            assert {tuple(r) for r in out.collect()} == want
            monkeypatch.undo()
    batch = [dense.pa.RecordBatch.from_pydict({"id": list(range(5000)), "vec": [[float(i % 9), 1.0] for i in range(5000)], "grp": [""] * 5000})]
    import tracemalloc

    tracemalloc.start()
    schema = dense.pa.schema([("query_id", dense.pa.int64()), ("id", dense.pa.int64()), ("grp", dense.pa.string()), ("sim", dense.pa.float64())])
    n = sum(b.num_rows for b in dense._candidates(batch, np.arange(4000), np.ones((4000, 2)) * np.arange(4000)[:, None], 3, None, schema, 100_000))
    assert n >= 12_000 and tracemalloc.get_traced_memory()[1] < 40_000_000  # all products at once are 160 MB
    tracemalloc.stop()


def test_words_sought_first_lose_no_route(spark):
    """Every alternative of every route, in a match of its own: the words before the patterns leave it as it is."""
    matches = """rule 42|rule43|common  input|reversal of itc|itc is reversed;an itc x|input tax credit|section 17|sec. 16|sec.17;refund|igst refund|export with refund|unutilised credit;
        hsn|sac|gst rate|ten percent|gst on goods;export|zero rated|zero-rated|zerorated|a lut b|letter of undertaking|sez unit;e-way bill|eway|e way  bill;
        appeal|tribunal|gstat|high court|supreme  court;annual return|gstr-9|gstr9;registration|registred|registring;audit|gst audit|gstr-9c|gstr9c;
        penalty|penalties|section 122|sec 129;scn|show cause|showcause|notice|drc-01|drc1|section 73|sec 74;draft|reply|response|representation|appeal letter|submission;
        intermediary|commission agent|broker service|facilitator|agent service;place of supply|pos|section 13 igst|cross-border service|crossborder service"""
    texts = [[x.strip() for x in group.split("|")] for group in matches.split(";")]
    assert len(texts) == len(routing.ROUTES) == len(routing.ROUTE_WORDS)
    rows = [(k, x) for k, group in enumerate(texts) for x in group]
    q = F.col("q")
    own = [F.rlike(F.lower(q), F.lit(f"(?dU){p}")) for p, _ in routing.ROUTES]
    all_ = [("",)] * len(routing.ROUTES)  # every text holds the empty word
    df = spark.createDataFrame(rows + [(99, None), (99, "nothing of it")], "k long, q string")
    for r in df.select("k", "q", F.array(*own).alias("m"), routing.route_folders(q).alias("a"), routing.route_folders(q, words=all_).alias("b")).collect():
        assert r.a == r.b
        if r.k == 99:
            assert r.a == []
            continue
        assert r.m[r.k], r.q
        for k, hit in enumerate(r.m):
            assert not hit or any(w in r.q for w in routing.ROUTE_WORDS[k]), (r.q, k)
