"""Quality rules, URL filters, decontamination and the pipeline."""

import itertools
import random

import duckdb
import numpy as np
import pytest

from fixtures import documents, empty, frame
from oracle import same
from sagelode.llm import decontaminate as dc
from sagelode.llm import quality_rules as qr
from sagelode.llm import registry, url_filters as uf

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_quality_counts(spark):
    import re

    def want(t):
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        lines = [x for x in t.split("\n") if re.sub("[\x20\x09-\x0d]+", "", x)]
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        hit = set()
        for i, g in enumerate(wins):
            if wins.count(g) > 1:
                hit |= set(range(i, i + 8))
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))

    extra = [(300, "a b c d e f g h a b c d e f g h", None, 0, 0), (301, "x " * 40, None, 0, 0)]
    docs = spark.createDataFrame(documents() + extra, frame(spark).schema)
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.quality_rules(docs).collect())
    assert got == sorted((str(d), *want(t)) for d, t, *_ in documents() + extra)
    assert qr.quality_rules(empty(spark)).count() == 0


def test_quality_stage_returns_rows_as_they_are(spark):
    kept = qr.quality_stage(spark, frame(spark), SF)
    assert kept.columns == frame(spark).columns
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in documents()}


def test_url_rules(spark):
    urls = [(0, None), (1, "no scheme"), (2, "http://A.Example.ORG/es/x?q"), (3, "http://example.org"), (4, "https://x.com/de/1#a"), (5, "https://x.com/fr/"), (6, "http://notexample.org/en/1"), (7, "http://example.org/en/12"), (8, "://h.net?x/y"), (9, "a://b.c/p://q")]
    pages = spark.createDataFrame([(*u, None) for u in urls], "page_id long, url string, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.url_filter(pages).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("a.example.org", "/es/x", "example.org/es/", "block"), 3: ("example.org", "", None, "allow"),
        4: ("x.com", "/de/1", "com/de/", "block"), 5: ("x.com", "/fr/", "com/fr/", "allow"), 6: ("notexample.org", "/en/1", "org/", "allow"), 7: ("example.org", "/en/12", "example.org/en/1", "block"),
        8: ("h.net", "", None, "allow"), 9: ("b.c", "/p://q", None, "allow"),
    }
    assert uf.url_filter(pages.limit(0)).count() == 0


def test_reputation_blocks_a_bad_host_only(spark):
    rows = [(i, f"http://h{i % 10}.example.net/p", int(i % 10 != 3)) for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good int")
    out = uf.url_filter(pages).where("verdict = 'block'").select("host").distinct().collect()
    assert [r.host for r in out] == ["h3.example.net"]


def test_url_filter_counts_rows_and_keeps_columns(spark, tmp_path):
    """Repeated and missing page ids count once a row; columns of any name pass through."""
    rows = [(7 if i % 2 else None, f"http://h{i % 4}.example.co.uk/en/{i % 4}", i, i, i, i) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, domain int, _rest int, `a.b` int, bad int")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, None), (2, 0, 0), (3, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    shown = uf.page_outcomes(pages, labels)
    assert shown.count() == 400 and {(r.domain % 4, r.good) for r in shown.collect()} == {(0, 1), (1, 0), (2, 0), (3, 0)}
    out = uf.url_filter(shown)
    assert set(out.columns) == {*pages.columns, "good", "host", "path", "rule", "verdict"}
    got = out.collect()
    assert len(got) == 400 and {(r["_rest"], r["a.b"], r["bad"], r["domain"]) for r in got} == {(i, i, i, i) for i in range(400)}
    assert {(r.host, r.verdict) for r in got} == {("h0.example.co.uk", "allow")} | {(f"h{k}.example.co.uk", "block") for k in (1, 2, 3)}
    for name, t in (("pages", pages), ("labels", labels)):
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(registry.ORACLES["op9_url_filters"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in uf.op9_url_filters(spark, str(tmp_path)).collect())
    names = uf.url_parts(spark.createDataFrame([("http://a.b.co.uk",), ("http://a.b.com",), ("http://co.uk",), ("x",)], "url string")).select("domain", "suffix").collect()
    assert [tuple(r) for r in names] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("co.uk", "co.uk"), ("", "")]


def test_quality_takes_columns_of_any_name(spark):
    docs = spark.createDataFrame([("t " * 30, 1, 2, 3, 4), (None, 5, 6, 7, None)], "text string, _text int, _seq int, `a.b` int, _WORDS int")
    got = qr.quality_rules(docs)
    assert {"_text", "_seq", "a.b", "_WORDS"} <= set(got.columns) and not {"__text", "__seq", "__words", "_lines"} & set(got.columns)
    assert sorted((r["_text"], r["_seq"], r["a.b"], r["n_words"]) for r in got.collect()) == [(1, 2, 3, 30), (5, 6, 7, 0)]
    assert qr.quality_stage(spark, docs, "").columns == docs.columns


def test_decontamination(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items = [[word() for _ in range(n)] for n in (30, 40, 5, 16)]
    noise = lambda n: [word() for _ in range(n)]
    swapped = list(items[1])
    for i in range(0, 40, 7):
        swapped[i] = word()
    broken = [w if i % 2 else word() for i, w in enumerate(items[0])]
    docs = [(0, noise(50) + items[0] + noise(9)), (1, swapped + noise(80)), (2, noise(100)), (3, noise(7) + items[2] + noise(3)), (4, broken + noise(30)), (5, items[0][:10] + noise(40)), (6, [w.upper() + "," for w in items[3]])]
    frame_ = spark.createDataFrame([(d, " ".join(w)) for d, w in docs] + [(7, None), (8, ""), (0, " ".join(docs[0][1]))], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    want = {0: [0], 1: [1], 2: [], 3: [2], 4: [], 5: [], 6: [3], 7: [], 8: []}
    for seeds in (dc.Seeds(), dc.Seeds(chunk=1, most_bits=1 << 10)):
        assert {r.doc_id: r.item_ids for r in dc.contamination(frame_, bench, seeds).collect()} == want
    assert dc.contamination(frame_.limit(0), bench).count() == 0
    assert dc.contamination(frame_, bench.limit(0)).where("contaminated").count() == 0


def test_masks_hit_every_overlap():
    """Each way to place the differences that the verdict allows leaves all positions of some mask alone."""
    seeds = dc.Seeds()
    masks = [(len(m), sum(1 << i for i, c in enumerate(m) if c == "1")) for m in seeds.masks]
    for n in range(seeds.span(), seeds.window + 1):
        for gone in itertools.combinations(range(n), n * (100 - seeds.percent) // 100):
            left = (1 << n) - 1 & ~sum(1 << i for i in gone)
            assert any(left >> at & m == m for size, m in masks for at in range(n - size + 1))


def _overlap(doc, item):
    """Most agreeing tokens of an aligned window, without seeds: every diagonal, every window."""
    if not item or not doc:
        return 0
    w, m = min(20, len(item)), len(item)
    if m < 11:
        return m if any(doc[i : i + m] == item for i in range(len(doc) - m + 1)) else 0
    best = 0
    for d in range(-m, len(doc)):
        same = [0 <= d + j < len(doc) and doc[d + j] == item[j] for j in range(m)]
        same = [False] * w + same + [False] * w
        best = max(best, *(sum(same[i : i + w]) for i in range(len(same) - w)))
    return best if 100 * best >= 75 * w else 0


def test_decontamination_against_all_diagonals(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "a", "in"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (*range(11, 31), 4, 7, 10, 45, 60)] + [["the"] * 30]
    docs = [[word() for _ in range(60)] for _ in range(20)] + [["the"] * 14, ["the"] * 400]
    for i, item in enumerate(items * 3):
        own = list(item)
        for k in rng.sample(range(len(own)), min(len(own), rng.randrange(0, len(own) // 3 + 1))):
            own[k] = word()
        cut = rng.randrange(0, len(own) // 3 + 1) if i % 2 else 0  # parts of items too
        docs.append([word() for _ in range(rng.randrange(9))] + own[cut:] + [word() for _ in range(rng.randrange(9))])
    want = {(d, i): n for d, doc in enumerate(docs) for i, item in enumerate(items) if (n := _overlap(doc, item))}
    assert 30 < len(want) < len(docs) * 3
    frame_ = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_same for r in dc.benchmark_overlaps(frame_, bench).collect()}
    assert got == want


def test_decontamination_of_long_repetitive_texts(spark):
    docs = spark.createDataFrame([(1, "the " * 200_000), (2, "x " * 300)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the " * 3000), (2, "the a " * 40)], "item_id long, text string")
    assert {r.doc_id: r.item_ids for r in dc.contamination(docs, bench).collect()} == {1: [1], 2: []}


def test_decontamination_stage_takes_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([(1, "some words of a benchmark item that are long enough to count")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "clean", 77, 5), (2, "x some words of a benchmark item that are long enough to count", 78, 6), (None, None, 79, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, row_key int, `a.b` int")
    got = dc.decontamination_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[0], rows[2]], key=repr)


def test_pipeline(spark):
    import corpus_pipeline
    from sagelode.llm.minhash_dedup import near_duplicates

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/stage-{name}"
        after.write.mode("overwrite").parquet(path)
        before = spark.read.parquet(path)
    assert near_duplicates(before).where("NOT kept").count() == 0
    assert not dc.contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in before.collect()}
