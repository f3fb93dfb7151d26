"""The chunkers against step-by-step versions."""

import re

import pytest

from oracle import same
from sagelode.functions import legal
from sagelode.operators import chunking
from sagelode.plans import catalogue

TINY = "/root/testdata/sf0.001"


def merged(parts, size, overlap):
    out, own = [], []
    for s in parts:
        if own and sum(map(len, own)) + len(s) > size:
            out.append("".join(own))
            while own and (sum(map(len, own)) > overlap or sum(map(len, own)) + len(s) > size):
                own.pop(0)
        own.append(s)
    return out + ["".join(own)] * bool(own)


def recursive(text, seps, size, overlap):
    for k, sep in enumerate(seps):
        if sep in text:
            break
    bits = text.split(sep) if sep else list(text)
    parts = [p for p in ([bits[0]] + [sep + b for b in bits[1:]] if sep else bits) if p]
    out, run = [], []
    for p in parts:
        if len(p) < size:
            run.append(p)
            continue
        out += merged(run, size, overlap)
        run = []
        out += recursive(p, seps[k + 1 :], size, overlap) if seps[k + 1 :] else [p]
    return out + merged(run, size, overlap)


def texts():
    long = "One two. Three? Four! five; six " * 40
    return [(1, long), (2, "x" * 500), (3, long.replace(" ", "") + "\n\n" + long), (4, None), (5, ""), (6, " \n "), (7, "a\n\n\nb\n\nc\n" * 30), (8, ("y" * 90 + " ") * 9), (9, "\n\n\n".join(["ab " * 20] * 4) + "\\E.x")]


def split_by_hand(text, size, overlap, least):
    strip = lambda t: re.sub(r"\A[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", t)
    found = [c for c in map(strip, recursive(text or "", chunking.SEPARATORS, size, overlap)) if c]
    return [(i, c) for i, c in enumerate(found) if len(c) >= least]


@pytest.mark.parametrize(("size", "overlap", "least"), [(100, 30, 0), (40, 39, 5), (1200, 150, 80), (3, 1, 1)])
def test_recursive_chunks_by_hand(spark, size, overlap, least):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_no, r.chunk) for r in chunking.recursive_chunks(df, size, overlap, least).collect())
    assert got == sorted((d, *c) for d, t in texts() for c in split_by_hand(t, size, overlap, least))


def test_recursive_chunks_of_documents(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text")
    got = sorted((r.doc_id, r.chunk_no, r.chunk) for r in chunking.recursive_chunks(docs).collect())
    assert got == sorted((r.doc_id, *c) for r in docs.collect() for c in split_by_hand(r.text, 1200, 150, 80))


def sections(paras, most, overlap):
    est = lambda s: int(len(s.split()) * 1.35)
    starts = re.compile("|".join(chunking.SECTION_STARTS), re.M)
    out, own, n, labels, active = [], [], 0, [], None

    def cut(p):
        if est(p) <= most:
            return [p]
        bits, cur = [], []
        for s in re.split(r"(?<=[.;])\s+", p):
            if cur and sum(map(est, cur)) + est(s) > most:
                bits.append(" ".join(cur))
                cur = []
            cur.append(s)
        return bits + [" ".join(cur)]

    def flush():
        nonlocal own, n, labels
        if " ".join(own).strip():
            out.append((" ".join(own).strip(), list(labels)))
        own = [w] if (w := " ".join(" ".join(own).split()[-overlap:])) else []
        n, labels = est(own[0]) if own else 0, [active] if active else []

    for p in (s for q in paras if q.strip() for s in cut(q.strip())):
        first = bool(starts.match(p))
        if first:
            active = next((f"{k} {m[1]}" for k, x in chunking.LABELS if (m := re.search(x, p))), active)
            if own:
                flush()
        if n + est(p) > most and own:
            flush()
        own.append(p)
        n += est(p)
        if first and active and active not in labels:
            labels.append(active)
    flush()
    return out


LAW = [
    "Section 17(5) Blocked credits. " + "word " * 30,
    "(1) Where a person; claims " + "credit of tax. " * 20,
    "Provided that nothing here",
    "Rule 36(4) sets " + "limits " * 50,
    "plain paragraph " * 15,
    "CHAPTER V",
    "  ",
    "Article 246A says; " + "so it is. " * 60,
    "1. Short title",
    "see Section 9",
]


@pytest.mark.parametrize(("most", "overlap"), [(60, 8), (500, 80), (20, 3)])
def test_section_chunks_by_hand(spark, most, overlap):
    cases = [(1, "\n\n".join(LAW)), (2, None), (3, ""), (4, "\n\n".join(LAW[4:] * 3)), (5, "one")]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_no, r.chunk, r.section_labels, r.section_label) for r in chunking.section_chunks(df, most, overlap).collect())
    want = [(d, i, c, ls, ls[0] if ls else None) for d, t in cases if t for i, (c, ls) in enumerate(sections(t.split("\n\n"), most, overlap))]
    assert got == sorted(want)


def test_section_chunks_of_documents(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text")
    got = sorted((r.doc_id, r.chunk_no, r.chunk) for r in chunking.section_chunks(docs, paragraph="\n").collect())
    assert got == sorted((r.doc_id, i, c) for r in docs.collect() for i, (c, _) in enumerate(sections((r.text or "").split("\n"), 500, 80)))


def test_section_chunks_fold_outside_expressions_and_by_ascii_space(spark):
    text = "Section 1 a\u00a0b\n\x0b one\u2003two \u2028\nRule 7 c\u0130d\n\x1c x"
    df = spark.createDataFrame([(1, text, 5), (2, None, 6)], "doc_id long, text string, more int")
    out = chunking.section_chunks(df, paragraph="\n", overlap=2)
    assert [(r.doc_id, r.more, r.chunk_no, r.chunk, r.section_labels) for r in out.orderBy("chunk_no").collect()] == [
        (1, 5, 0, "Section 1 a\u00a0b one\u2003two\u2028", ["Section 1"]),
        (1, 5, 1, "a\u00a0b one\u2003two\u2028 Rule 7 c\u0130d \x1c x", ["Rule 7"]),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and plan.count("ArrowEvalPython") == 1  # interpreted, the fold took most of the time


def test_provisions_keep_the_text_that_follows(spark):
    df = spark.createDataFrame([(1, "Preamble Section 7(1) scope of supply. SEC. 9 levy u/s 73 end"), (2, "no marker"), (3, None), (4, "Section 5")], "id long, text string")
    got = sorted((r.id, r.part_no, r.provision, r.part) for r in chunking.provisions(df).collect())
    assert got == [(1, 0, "Section 7(1)", "Section 7(1)  scope of supply. "), (1, 1, "SEC. 9", "SEC. 9  levy "), (1, 2, "u/s 73", "u/s 73  end"), (2, 0, None, "no marker"), (4, 0, "Section 5", "Section 5 ")]


def test_citations_in_any_case(spark):
    given = ["SECTION 17(5)", "RULE 42", "NOTIFICATION NO. 11/2017", "S. 16", "s.9(3)", "under the cgst act", "classes. 12", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "id int, t string")
    got = [r.k for r in df.select("id", legal.citation_keys(df.t).alias("k")).orderBy("id").collect()]
    assert got == [["CGST_SEC_17_5"], ["CGST_RULE_42"], ["CGST_NOTIF_11_2017"], ["CGST_SEC_16"], ["CGST_SEC_9_3"], ["ACT"], [], None]


@pytest.mark.parametrize("name", ["provision_split", "citation_extract"])
def test_query_equals_sql(spark, name):
    same(catalogue.QUERIES[name](spark, "/root/testdata/sf0.01"), catalogue.ORACLES[name], "/root/testdata/sf0.01")
