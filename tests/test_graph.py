"""Walks, cliques and co-citations where few keys hold nearly all rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from sagelode.operators import graph, routing


def _counts(df):
    """Rows of each task."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def _distances(edges, seeds, depth):
    step = defaultdict(set)
    for a, b in edges:
        step[a].add(b)
    out = set()
    for s in seeds:
        seen, front = {s: 0}, {s}
        for d in range(1, depth + 1):
            front = {b for a in front for b in step[a]} - set(seen)
            seen |= dict.fromkeys(front, d)
        out |= {(s, n, d) for n, d in seen.items()}
    return out


def test_walks_of_hubs_and_of_several_ways(spark, monkeypatch):
    rng = random.Random(4)
    hubs = [(f"s{i}", f"h{i % 2}") for i in range(60)] + [("h0", "r"), ("h1", "r"), ("s7", "h0")]
    edges = hubs + [(b, a) for a, b in hubs] + [(f"x{rng.randrange(12)}", f"x{rng.randrange(12)}") for _ in range(30)] + [(f"c{i}", f"c{i + 1}") for i in range(5)]
    seeds = [f"s{i}" for i in range(60)] + [f"x{i}" for i in range(12)] + ["c0", "lone"]
    df = spark.createDataFrame(edges + edges[:5], "src string, dst string").repartition(3)
    for listed in (16, 2):  # the second is less than what the chain's seed reaches
        depth = 3
        monkeypatch.setattr(graph, "LISTED", listed)
        got = [tuple(r) for r in graph.walk(df, spark.createDataFrame([(s,) for s in seeds], "node string"), depth).select("seed", "node", "hops").collect()]
        assert len(got) == len(set(got)) and set(got) == _distances(edges, seeds, depth)


def test_pairs_of_few_topics_go_to_all_tasks(spark):
    m = spark.range(4000).select((F.col("id") % 2).alias("topic"), F.col("id").alias("member"))
    rows = _counts(routing.cliques(m))
    assert sum(rows) == 2 * 2000 * 1999
    assert max(rows) < sum(rows) / 3  # by topic alone two tasks would make them all


def test_pairs_of_members_of_several_topics(spark):
    rows = [(t, n) for n in range(40) for t in {n % 3, n % 5, 7 * (n % 2)}] + [(None, 1), (2, None), (1, 1)]
    m = spark.createDataFrame(rows, "topic long, member long")
    want = {(a, b) for t, a in rows for u, b in rows if None not in (t, a, b) and t == u and a != b}
    got = [tuple(r) for r in routing.cliques(m).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    known = spark.createDataFrame([(5, 0), (1, 2), (1, 4), (90, 1), (3, 3)], "src long, dst long")
    got = [(r.src, r.dst) for r in routing.ordered_pairs(m, known).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if a < b} - {(0, 5), (1, 2), (1, 4)}


def test_co_citations_of_many_pairs_get_more_tasks(spark, monkeypatch):
    rows = [(d, k) for d in range(50) for k in range(d % 7)] + [(3, 0), (3, None)]
    want = defaultdict(set)
    for d, a in rows:
        for e, b in rows:
            if d == e and a != b and None not in (a, b):
                want[a, b].add(d)
    width = graph.width
    monkeypatch.setattr(graph, "width", lambda s, n: width(s, n, 20))
    out = graph.co_citation(spark.createDataFrame(rows, "d long, k long"), "d", "k")
    pairs = sum(map(len, want.values()))
    assert {tuple(r) for r in out.collect()} == {(*k, len(v)) for k, v in want.items()}
    assert f"{-(-pairs // 20)}" in out._jdf.queryExecution().executedPlan().toString() and -(-pairs // 20) > 8
