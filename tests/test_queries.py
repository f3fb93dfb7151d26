"""Every query of the engine against its SQL on the smallest tables; those without SQL against what must hold."""

import hashlib
import re

import pytest

from oracle import same
from sagelode.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_mmr_keeps_distinct_rows_in_order(spark):
    out = catalogue.QUERIES["mmr_select"](spark, SF).toPandas()
    assert not out.duplicated(["query_id", "chunk_id"]).any()
    assert (out.groupby("query_id").pos.max() == out.groupby("query_id").size()).all()
    assert out.pos.max() <= 10


def _anchored(events, seconds):
    out, start = {}, {}
    for e in sorted(events, key=lambda e: (e.ts, e.event_id)):
        t = int(e.ts.timestamp() * 1e6)
        if e.user_id not in start or t >= start[e.user_id] + seconds * 1_000_000:
            start[e.user_id] = t
        out.setdefault((e.user_id, start[e.user_id]), []).append(e.event_id)
    return out


def test_anchored_windows_and_budgets(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "user_id", "cast(ts AS timestamp) AS ts").collect()
    want = _anchored(events, 7 * 86_400)
    got = {(r.user_id, r.started): r.n for r in catalogue.QUERIES["anchored"](spark, SF).collect()}
    assert sorted(got.values()) == sorted(map(len, want.values()))
    allowed = {}
    for (u, _), e in want.items():
        allowed[u] = allowed.get(u, 0) + min(20, len(e))
    assert {r.user_id: r.allowed for r in catalogue.QUERIES["stream_budgets"](spark, SF).collect()} == allowed


def test_packed_chunks(spark):
    def pack(text, most):
        out, held, n = [], "", 0
        for p in text.split("\n"):
            k = len([w for w in re.split(r"\s+", p) if w])
            if not k:
                continue
            if n and n + k > most:
                out, held, n = [*out, held], "", 0
            held, n = (p if not n else f"{held}\n{p}"), n + k
        return [*out, held] if n else out

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(d.doc_id, i, hashlib.md5(t.encode()).hexdigest()) for d in docs for i, t in enumerate(pack(d.text, 120))}
    assert {(r.chunk_id, r.n, r.text_md5) for r in catalogue.QUERIES["packed_chunks"](spark, SF).collect()} == want


def _texts(spark):
    from sagelode.plans.report_queries import JUDGMENT, SCHEDULE

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(d.doc_id, d.text) for d in docs] + [(-1, JUDGMENT), (-2, SCHEDULE)]


def _md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def test_structural_split(spark):
    from sagelode.operators.segments import HEADERS

    space = " \t\n\x0b\f\r"
    head = re.compile(r"(?:^|\n)\s*(" + "|".join(p for _, p in HEADERS) + ")", re.IGNORECASE | re.ASCII)
    want = set()
    for d, text in _texts(spark):
        cuts = [("BACKGROUND", 0, 0)]
        for m in head.finditer(text):
            cuts.append((next(n for n, p in HEADERS if re.fullmatch(p, m[1], re.IGNORECASE | re.ASCII)), m.start(), m.end()))
        k = 0
        for i, (name, _, begin) in enumerate(cuts):
            body = text[begin : cuts[i + 1][1] if i + 1 < len(cuts) else None].strip(space)
            if not body or (len(body) <= 50 and i + 1 < len(cuts)):
                continue
            pieces = [body]
            if len(body) > 2000:
                pieces = [""]
                for p in filter(None, re.split(r"\n\n|\.\s+(?=[A-Z])", body, flags=re.ASCII)):
                    if len(pieces[-1]) + len(p) < 1500:
                        pieces[-1] += (" " if pieces[-1] else "") + p
                    elif pieces[-1]:
                        pieces.append(p)
                    else:
                        pieces[-1] = p
            want |= {(d, k, name, n, _md5(t)) for n, t in enumerate(pieces)}
            k += 1
    got = catalogue.QUERIES["structural_split"](spark, SF).collect()
    assert {(r.chunk_id, r.segment, r.structure, r.n, r.text_md5) for r in got} == want
    assert {r.structure for r in got if r.chunk_id == -1} == {"BACKGROUND", "FACTS", "ANALYSIS", "RULING"}


def test_rate_schedule(spark):
    starts = re.compile(r"\d{1,3}[a-z]?[\s.)\]]", re.ASCII)
    heading = re.compile(r"(?:Chapter|Section|Heading)\s+\d", re.IGNORECASE | re.ASCII)
    want = set()
    for d, text in _texts(spark):
        out, held = [], []
        for line in filter(None, (x.strip(" \t\n\x0b\f\r") for x in text.split("\n"))):
            if ((starts.match(line) and len(line) > 10) or heading.match(line)) and sum(map(len, held)) >= 80:
                out, held = [*out, held], [line]
                continue
            held = [*held, line]
            if sum(map(len, held)) > 800:
                out, held = [*out, held], []
        out += [held] if sum(map(len, held)) >= 80 else []
        want |= {(d, n, _md5("\n".join(t))) for n, t in enumerate(out)}
    got = catalogue.QUERIES["rate_schedule"](spark, SF).collect()
    assert {(r.chunk_id, r.n, r.text_md5) for r in got} == want
    assert sum(r.chunk_id == -2 for r in got) > 5
