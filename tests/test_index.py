"""Versions, sidecars and caches that break off halfway; index checks; message arrays; weighted walks and ways to the root."""

import random

import pytest
from pyspark.sql import functions as F

from sagelode.functions.vectors import sanitised
from sagelode.operators import graph, index_checks, nested
from sagelode.sources import versions

VECTORS = "vec_id long, embedding array<float>"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def clean(df):
    index_checks.require_clean(index_checks.index_faults(df, 2))


def test_faults_are_named(spark):
    v = frame(spark, [(1, [1.0, 2.0]), (2, [1.0]), (3, [NAN, None]), (4, None), (5, [0.0, INF]), (5, [0.0, 1.0]), (None, [1.0, 1.0])], VECTORS)
    docs = frame(spark, [(1,), (2,), (3,), (4,), (9,), (9,), (None,)], "vec_id long")
    got = {r.vec_id: (r.n_rows, r.n_bad, r.faults) for r in index_checks.index_faults(v, 2).collect()}
    assert got == {1: (1, 0, ""), 2: (1, 0, "width"), 3: (1, 2, "not finite"), 4: (1, 0, "null vector"), 5: (2, 1, "repeated|not finite"), None: (1, 0, "no key")}
    both = {(r.vec_id, r.n_rows): r.faults for r in index_checks.index_faults(v, 2, docs).collect()}
    assert both[1, 1] == "" and both[5, 2] == "repeated|not finite|no document" and both[9, 0] == "no vector"
    with pytest.raises(ValueError, match=r"1 x not finite, first 3; 1 x null vector, first 4"):
        clean(v.where("vec_id < 5"))
    clean(v.where("vec_id = 1"))
    clean(v.where("vec_id = 77"))
    assert v.where("vec_id = 3").select(sanitised(F.col("embedding")).alias("s")).first().s == [0.0, 0.0]


def test_sidecar_merges_once_whatever_breaks(spark, tmp_path, monkeypatch):
    main, side = f"{tmp_path}/main", f"{tmp_path}/side"
    assert versions.current(spark, main) is None and versions.merge_sidecar(spark, main, side, "vec_id", clean) is None
    versions.publish(frame(spark, [(1, [1.0, 1.0]), (2, [2.0, 2.0])], VECTORS), main, clean)
    frame(spark, [(2, [9.0, 9.0]), (3, [3.0, 3.0])], VECTORS).write.parquet(f"{side}/batch=1")
    frame(spark, [(3, [8.0, 8.0])], VECTORS).write.parquet(f"{side}/batch=2")
    (tmp_path / "side" / "batch=3").mkdir()  # still being written
    want = [(1, [1.0, 1.0]), (2, [9.0, 9.0]), (3, [8.0, 8.0])]
    with monkeypatch.context() as m:
        m.setattr(versions, "remove", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):  # after the merge, before the sidecar goes
            versions.merge_sidecar(spark, main, side, "vec_id", clean)
    assert rows(versions.current(spark, main)) == want and versions.finished(spark, side, "batch") == [1, 2]
    assert versions.merge_sidecar(spark, main, side, "vec_id", clean) == 3
    assert rows(versions.current(spark, main)) == want and versions.finished(spark, side, "batch") == []
    assert versions.finished(spark, f"{main}/mark", "version") == [2, 3]


def test_failing_check_leaves_table_and_sidecar(spark, tmp_path):
    main, side = f"{tmp_path}/main", f"{tmp_path}/side"
    versions.publish(frame(spark, [(1, [1.0, 1.0])], VECTORS), main, clean)
    frame(spark, [(2, [1.0, 2.0, 3.0])], VECTORS).write.parquet(f"{side}/batch=1")
    with pytest.raises(ValueError, match="1 x width, first 2"):
        versions.merge_sidecar(spark, main, side, "vec_id", clean)
    assert rows(versions.current(spark, main)) == [(1, [1.0, 1.0])] and versions.finished(spark, side, "batch") == [1]


def test_enrichment_makes_each_context_once(spark, tmp_path):
    folder = f"{tmp_path}/cache"
    schema = "chunk_id long, text string"
    first = [(1, "alpha. one"), (1, "alpha. one"), (2, None), (None, "lost"), (3, ". starts blank")]
    asked = []

    def context(todo):
        asked.append(sorted(r.chunk_id for r in todo.collect()))
        return todo.select("chunk_id", F.substring_index("text", ".", 1).alias("context"))

    want = [(1, "alpha", "alpha\n\nalpha. one")] * 2 + [(2, None, None), (3, None, None), (None, None, None)]
    got = [(r.chunk_id, r.context, r.embed_text) for r in versions.enrich(frame(spark, first, schema), folder, context).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    (tmp_path / "cache" / "batch=2").mkdir()  # died halfway
    out = versions.enrich(frame(spark, [*first, (4, "delta. four")], schema), folder, context)
    assert {r.chunk_id: r.context for r in out.collect()} == {1: "alpha", 2: None, 3: None, 4: "delta", None: None}
    versions.enrich(frame(spark, first, schema), folder, F.lit("never asked")).collect()
    assert asked == [[1, 2, 3], [4]]
    assert rows(versions.cached_contexts(spark, folder)) == [(1, "alpha"), (2, ""), (3, ""), (4, "delta")]


def test_positions_of_a_hot_key_use_several_tasks(spark):
    data = [(1 if i % 3 else i, i * 7919 % 1000, i) for i in range(3000)]
    df = frame(spark, data, "k long, a long, b long").repartition(7)
    want, seen = set(), {}
    for k, a, b in sorted(data):
        want.add((k, a, b, seen.setdefault(k, 0)))
        seen[k] += 1
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # small ranges would be put together
    try:
        assert df.repartitionByRange("k", "a", "b").where("k = 1").select(F.spark_partition_id()).distinct().count() > 1
        got = nested.positions(df, "k", ("a", "b"))
        assert {tuple(r) for r in got.select("k", "a", "b", "position").collect()} == want
    finally:
        spark.conf.unset(setting)
    assert nested.positions(df.limit(0), "k", ("a", "b")).count() == 0


def test_pushes_equal_appending(spark):
    rng, size = random.Random(5), 4
    schema = "session_id long, role string, content string, ts long"
    known = {1: [], 2: [], 3: []}
    sessions = frame(spark, [(k,) for k in known], "session_id long")
    held = nested.blocks(frame(spark, [], "session_id long, position long, role string, content string, ts long"), size)
    for n in (5, 1, 0, 9):
        new = [(rng.choice([1, 1, 2, 3, 8, None]), rng.choice("ab"), rng.choice(["x", "y", "", " ", None]), rng.randrange(50)) for _ in range(n * 3)]
        for k, role, text, ts in sorted((r for r in new if r[0] in known and (r[2] or "").strip()), key=lambda r: (r[0], r[3], r[1], r[2])):
            known[k].append((role, text, ts))
        held = graph.settled(nested.pushed(held, sessions, frame(spark, new, schema), size))
    got = {}
    for r in sorted(held.collect(), key=lambda r: (r.session_id, r.block)):
        assert [m.position // size for m in r.messages] == [r.block] * len(r.messages) and len(r.messages) <= size
        assert r.updated_at == max(m.ts for m in r.messages)
        got.setdefault(r.session_id, []).extend((m.role, m.content, m.ts) for m in r.messages)
    assert got == {k: v for k, v in known.items() if v}


def test_find(spark):
    df = frame(spark, [(1, "en", "Alpha"), (2, "en", "alphabet"), (3, "de", "alpha"), (4, "en", None), (5, "en", "beta")], "id long, lang string, name string")
    page = lambda *a, **k: [r.id for r in nested.find(df, *a, sort=["id"], **k).collect()]
    assert page({"lang": "en"}, {"name": "^ALPHA"}) == [1, 2]
    assert page({"lang": None}, {"name": ""}) == [1, 2, 3, 4, 5]
    assert page({"lang": "en"}, skip=1, limit=2) == [2, 4]
    assert nested.find(df, without=("name",)).columns == ["id", "lang"]


def walks(edges, seeds, depth):
    out = {}
    for q, s in seeds:
        level = {s: [1.0]}
        for d in range(1, depth + 1):
            after = {}
            for node, weights in level.items():
                parts = node.split("_")
                base = "_".join(parts[:3]) if len(parts) > 3 and parts[1] in ("SEC", "RUL", "RULE") else None
                for a, b, w in edges:
                    if a in (node, base):
                        after.setdefault(b, []).append(max(weights) * w)
            for node, weights in after.items():
                if (q, node) not in seeds:
                    hops, best = out.get((q, node), (d, 0.0))
                    out[q, node] = (min(hops, d), max(best, *weights))
            level = after
    return out


@pytest.mark.parametrize("seed", range(4))
def test_related_equals_all_walks(spark, seed):
    rng = random.Random(seed)
    names = [f"CGST_SEC_{i}" for i in range(4)] + [f"CGST_SEC_{i}_{j}" for i in range(4) for j in "5A"] + ["CGST_NOTIF_1_2", "CGST_NOTIF_1"]
    edges = [(rng.choice(names), rng.choice(names), rng.choice([0.25, 0.5, 0.75, 1.0])) for _ in range(30)]
    seeds = {(q, rng.choice(names)) for q in range(3) for _ in range(2)}
    found = graph.related(frame(spark, edges, "src string, dst string, weight double"), frame(spark, sorted(seeds), "query_id long, node string"), 3)
    got = {(r.query_id, r.node): (r.hops, r.weight) for r in found.collect()}
    assert got == walks(edges, seeds, 3)


def test_expanded_names_the_best_node_and_keeps_bounds(spark):
    found = frame(spark, [(1, "CGST_SEC_17", 1, 0.5), (1, "CGST_RULE_4", 2, 0.9)], "query_id long, node string, hops int, weight double")
    pool = frame(spark, [(1, ["CGST_SEC_17_5", "CGST_RULE_4"]), (2, ["CGST_SEC_17A"]), (3, ["CGST_SEC_170"]), (4, []), (5, None)], "chunk_id long, keys array<string>")
    assert rows(graph.expanded(found, pool)) == [(1, 1, "CGST_RULE_4", 2, 0.9), (1, 2, "CGST_SEC_17", 1, 0.5)]


def test_root_paths_end_at_roots_and_cycles(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s"), ("a", "z")], "child string, parent string")
    got = dict(rows(graph.root_paths(frame(spark, [(n,) for n in "abcxsq"], "node string"), edges)))
    assert got == {"a": ["c", "b", "a"], "b": ["c", "b"], "c": ["c"], "x": ["y", "x"], "s": ["s"], "q": ["q"]}


def test_levels_have_no_greatest_depth(spark):
    edges = frame(spark, [(i, i + 1) for i in range(60)], "src long, dst long")
    got = graph.levels(edges, spark.range(61).select(F.col("id").alias("node")))
    assert dict(rows(got)) == {i: i for i in range(61)}
