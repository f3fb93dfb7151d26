"""Line dedup, suffix-array dedup and MinHash dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import documents, empty, frame
from sagelode.llm import common
from sagelode.llm import line_dedup as ld
from sagelode.llm import links
from sagelode.llm import minhash_dedup as mh
from sagelode.llm import suffix_dedup as sd
from sagelode.llm.common import U64, connected_components, mix64
from sagelode.llm.edits import within


def _groups(n, linked):
    top = list(range(n))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in linked:
        x, y = root(i), root(j)
        top[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_size_join_counts_what_lists_hold(spark, monkeypatch):
    big = spark.createDataFrame([(1, "x"), (2, "y")], "k long, t string")
    side = spark.createDataFrame([(1, [1, 2, 3]), (2, [4])], "k long, v array<long>")
    want = sorted(big.join(side, "k").collect())
    for numbers, broadcast in ((4, True), (3, False)):
        monkeypatch.setattr(common, "BROADCAST_NUMBERS", numbers)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = common.shared_size_join(big, side, "k", listed="v")
        plan = got._jdf.queryExecution().sparkPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert ("BroadcastHashJoin" in plan) is broadcast
        assert sorted(got.collect()) == want
    empty_side = spark.createDataFrame([], side.schema)
    assert common.shared_size_join(big, empty_side, "k", "left", listed="v").count() == 2


def test_bucket_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), i) for i, k in enumerate(rng.choice([1, 1, 1, 1, 2, 3, 4, 5, *range(6, 60)], 200))]
    by = defaultdict(set)
    for k, i in rows:
        by[k].add(i)
    for size in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = links.bucket_rows(spark.createDataFrame(rows, "bucket long, id long")).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r.bucket, r.id) for r in got) == sorted((k, i) for k, i in rows if len(by[k]) > 1)
        leaders = {(r.bucket, r.leader) for r in got}
        assert len(leaders) == len({k for k, _ in leaders}) and all(x in by[k] for k, x in leaders)


@pytest.mark.parametrize("block", [1024, 8])
def test_linked_components_lose_no_link_of_a_bucket(spark, block):
    rng = np.random.default_rng(4)
    value = rng.integers(0, 4000, 700)
    buckets = [(int(b), i) for i in range(700) for b in {1000, *rng.integers(0, 30, 2).tolist()}]  # all share bucket 1000
    linked = [(i, j) for i in range(700) for j in range(i) if abs(value[i] - value[j]) <= 3]
    root = _groups(700, linked)
    members = spark.createDataFrame(buckets, "bucket long, id long")
    marks = spark.createDataFrame([(i, int(v)) for i, v in enumerate(value)], "id long, mark long")
    confirm = lambda pairs: pairs.join(marks.toDF("a", "x"), "a").join(marks.toDF("b", "y"), "b").where("abs(x - y) <= 3").select("a", "b")
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 5
    got = {r.node: r.component for r in links.linked_components(members, marks, near, confirm, "t", block).collect()}
    alone = {i for i in range(700) if root.count(root[i]) == 1}
    assert got == {i: root[i] for i in range(700) if i not in alone}


def test_pairs_are_held_once(spark, monkeypatch):
    """Ids that share five buckets, and pairs alone in theirs: the join of what is apart makes a pair once, those of two ids never."""
    crossed = []
    plain = links.materialize

    def spied(df, label):
        if label == "t-cross":
            assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
            crossed.extend((r.a, r.b) for r in df.collect())
        return plain(df, label)

    monkeypatch.setattr(links, "materialize", spied)
    rows = [(b, i) for b in range(5) for i in range(20)] + [(100 + k, 1000 + 2 * k + i) for k in range(30) for i in range(2)]
    members = spark.createDataFrame(rows, "bucket long, id long")
    marks = members.select("id", F.col("id").alias("mark")).distinct()
    got = links.linked_components(members, marks, lambda x, y: F.lit(True), lambda pairs: pairs.where("b - a = 19 AND b = 19"), "t", rounds=())
    assert sorted((r.node, r.component) for r in got.collect()) == [(0, 0), (19, 0)]
    assert len(crossed) == len(set(crossed)) and set(crossed) >= {(a, b) for b in range(19) for a in range(1, b)} - {(0, 19)} and all(b < 20 for _, b in crossed)


def test_merged_components_walk_components_not_ids(spark, monkeypatch):
    """Further edges merge components: only those that they connect are walked again, with the groups of a walk over all edges."""
    rng = np.random.default_rng(9)
    first = [(int(a), int(a) + 1) for a in rng.choice(400, 250, replace=False)]
    more = [(int(a), int(b)) for a, b in rng.integers(0, 500, (40, 2)) if a != b]
    known = common.connected_components(spark.createDataFrame(first, "a long, b long"), "t")
    edges = common.materialize(spark.createDataFrame(more, "a long, b long"), "t-edges")
    walked = []
    plain = links.connected_components
    monkeypatch.setattr(links, "connected_components", lambda e, label: walked.append(e.count()) or plain(e, label))
    got = {r.node: r.component for r in links.merged_components(known, edges, "t").collect()}
    assert got == {r.node: r.component for r in plain(spark.createDataFrame(first + more, "a long, b long")).collect()}
    assert walked == [len(more)]
    none = common.materialize(spark.createDataFrame([], "a long, b long"), "t-none")
    assert sorted(links.merged_components(known, none, "t").collect()) == sorted(known.select("node", "component").collect())
    assert {(r.node, r.component) for r in links.merged_components(none.toDF("node", "component"), edges, "t").collect()} == {(r.node, r.component) for r in plain(edges).collect()}


def test_rounds_are_for_large_buckets(spark, monkeypatch):
    """Buckets of up to `few` ids go to the join of what is apart at once."""
    seen = []
    plain = links._outsiders
    monkeypatch.setattr(links, "_outsiders", lambda own, *a: seen.extend(r.bucket for r in own.collect()) or plain(own, *a))
    rows = [(1, i) for i in range(5)] + [(2, i) for i in range(100, 120)]
    members = spark.createDataFrame(rows, "bucket long, id long")
    marks = members.select("id", (F.col("id") % 2).alias("mark"))
    got = links.linked_components(members, marks, lambda x, y: F.col(x) == F.col(y), lambda pairs: pairs, "t")
    assert {(r.node, r.component) for r in got.collect()} == {(i, i % 2) for i in range(5)} | {(i, 100 + i % 2) for i in range(100, 120)}
    assert set(seen) == {2}


def test_word_counts_travel_as_few_rows(spark):
    word = lambda i: str(i).translate(str.maketrans("0123456789", "abcdefghij"))
    docs = spark.createDataFrame([(f"w{word(i)} x{word(i)}",) for i in range(2000)], "text string").repartition(3)
    p = ld.LineDedup(buckets=4096)
    rows = {r.part: np.frombuffer(r.n, np.int64) for r in ld.word_counts(docs, p).collect()}
    assert sorted(rows) == [-1, 0, 1, 2, 3] and rows.pop(-1).tolist() == [2000]
    assert sum(int(n.sum()) for n in rows.values()) == 4000


def test_a_bucket_of_many_unlike_ids(spark):
    n = 20_000
    ids = spark.range(n)
    members = ids.select(F.lit(7).cast("long").alias("bucket"), "id")
    marks = ids.select("id", F.when(F.col("id") < 3, F.lit(0)).otherwise(F.xxhash64("id")).cast("long").alias("mark"))
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= 5
    got = links.linked_components(members, marks, near, lambda pairs: pairs, "t").collect()
    assert sorted((r.node, r.component) for r in got) == [(0, 0), (1, 0), (2, 0)]


def _sets(rows):
    out = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    return out


@pytest.mark.parametrize("block", [1024, 2])
def test_minhash_components(spark, block):
    rows = documents()
    sets = _sets(rows)
    ids = [r[0] for r in rows]
    ok = [i for i in range(len(rows)) if ids[i] is not None and sets[i]]
    pairs = [(i, j) for i in ok for j in ok if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = _groups(len(rows), pairs)
    least = {}
    for i in ok:
        least[root[i]] = min(ids[i], least.get(root[i], 10**9))
    want = sorted((ids[i] if ids[i] is not None else -1, len(sets[i]), least[root[i]] if i in set(ok) else (ids[i] if ids[i] is not None else -1)) for i in range(len(rows)))
    got = mh.near_duplicates(frame(spark), mh.MinHash(block=block)).collect()
    num = lambda x: -1 if x is None else x
    assert sorted((num(r.doc_id), r.n_shingles, num(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_minhash_estimate_is_near_the_similarity():
    rng = np.random.default_rng(2)
    m = mh.MinHash(words=8, bands=128)
    common = rng.integers(0, 2**63, 800, dtype=np.uint64)
    a, b = (np.unique(np.concatenate((common, rng.integers(0, 2**63, 100, dtype=np.uint64)))) for _ in range(2))
    x, y = mh._planes(mh._minima([a, b], m), m)
    bits = np.bitwise_count(np.bitwise_or.reduce((x ^ y).reshape(m.bits, m.words), axis=0).view(np.uint64)).sum()
    c = 2.0**-m.bits
    assert abs(((1 - bits / 512) - c) / (1 - c) - 0.8) < 0.08


def _edits(a: str, b: str) -> int:
    """Levenshtein distance by the textbook table, a row at a time."""
    row = np.arange(len(b) + 1)
    other = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for i, c in enumerate(a, 1):
        least = np.minimum(row[1:] + 1, row[:-1] + (other != ord(c)))
        least = np.concatenate(([i], least)) - np.arange(len(b) + 1)
        row = np.minimum.accumulate(least) + np.arange(len(b) + 1)
    return int(row[-1])


def _alike(a: str, b: str) -> bool:
    return _edits(a, b) <= int(0.15 * max(len(a), len(b)) + 1e-9)


def _plain(line: str) -> str:
    """Lower case, digits as 0, other signs dropped, by its own means."""
    words = ("".join("0" if c.isdigit() else c for c in w.lower() if c.isalnum()) for w in line.split())
    return " ".join(w for w in words if w)


def _lines_left(rows):
    """(doc_id, text without its repeated lines, lines removed) by comparing all lines with all."""
    occ = [(10**9 if d is None else d, no, t, _plain(x)) for d, t, *_ in rows for no, x in enumerate((t or "").split("\n")) if _plain(x)]
    keys = list(dict.fromkeys(o[3] for o in occ))
    long = [i for i, k in enumerate(keys) if k.count(" ") > 1]
    root = dict(zip(keys, _groups(len(keys), [(i, j) for i in long for j in long if j < i and _alike(keys[i], keys[j])]), strict=True))
    first = {}
    for d, no, _, k in occ:
        first[root[k]] = min(first.get(root[k], (10**10, 0)), (d, no))
    gone = defaultdict(set)
    for d, no, t, k in occ:
        if first[root[k]] != (d, no):
            gone[d, t].add(no)
    out = []
    for d, t, *_ in rows:
        own = gone[10**9 if d is None else d, t]
        out.append((-1 if d is None else d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in own), len(own)))
    return out


def test_line_dedup(spark):
    rows = documents()
    out = ld.line_dedup(frame(spark))
    assert set(out.columns) == {"doc_id", "text", "lang", "n_words", "row_key", "n_lines", "n_removed"}
    got = [(-1 if r.doc_id is None else r.doc_id, r.text, r.n_removed) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(_lines_left(rows), key=repr)


def test_word_weights_count_every_line(spark):
    """3,000 documents of two lines, one of 30,000 characters before its second line: each word's weight follows all lines."""
    rows = [(i, f"alpha alpha w{i} common\n{'beta' if i % 3 else 'gamma'} common") for i in range(3000)] + [(3000, "x" * 30_000 + "\ngamma\n\n ..")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    p = ld.LineDedup()
    lines = Counter(ld.normal_line(x) for _, t in rows for x in t.split("\n") if ld.normal_line(x))
    held = Counter()
    for x, n in lines.items():
        for w in set(x.split()):
            held[w] += n
    words = sorted(held)
    bucket = ld.word_buckets(ld.normal_hashes(ld.pa.array(words)), p)
    own = Counter()
    for w, b in zip(words, bucket.tolist(), strict=True):
        own[b] += held[w]
    scales = ld.word_scales(docs, p)
    assert len(scales) == p.buckets
    assert (held["common"], held["alpha"], held["beta"], held["gamma"]) == (6000, 3000, 2000, 1001)
    want = [1 / np.log((lines.total() + 2) / own[b]) ** 2 for b in bucket.tolist()]
    assert np.allclose(scales[bucket], want, rtol=1e-5)


def test_line_dedup_takes_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d", 5, 6, 7), (2, "a b c d\nx", 8, 9, None)], "doc_id long, text string, `a.b` int, _row int, lines int")
    got = ld.line_dedup(docs)
    assert set(got.columns) == {"doc_id", "text", "a.b", "_row", "lines", "n_lines", "n_removed"}
    assert {(r["doc_id"], r["text"], r["a.b"], r["_row"], r["lines"]) for r in got.collect()} == {(1, "a b c d", 5, 6, 7), (2, "x", 8, 9, None)}
    assert {tuple(r) for r in ld.line_stage(spark, docs, "").collect()} == {(1, "a b c d", 5, 6, 7), (2, "x", 8, 9, None)}


@pytest.mark.parametrize("n_words", [6, 10, 15, 25, 50])
@pytest.mark.parametrize("kind", ["letter", "word"])
def test_share_of_similar_lines_found(spark, n_words, kind):
    """Of pairs with a letter or a word in twenty words changed, as far as the table of edits finds them alike, the share found."""
    rng = random.Random(n_words)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    rows, alike = [], 0
    for i in range(200):
        own = [word() for _ in range(n_words)]
        other = list(own)
        for k in rng.sample(range(n_words), max(1, n_words // 20)):
            at = rng.randrange(len(other[k]))
            other[k] = other[k][:at] + rng.choice("0123456789") + other[k][at + 1 :] if kind == "letter" else word()
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
        alike += _alike(rows[-2][1], rows[-1][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    removed = ld.line_dedup(docs).where("n_removed > 0").count()
    assert alike > 50 and 0.9 * alike <= removed <= alike


def test_repeated_lines_of_one_or_two_words_go(spark):
    rows = [(1, "Stteen Erachtz.\nab\n---\n\nab cd"), (2, "ab.\nstteen erachtz\n---\n\nab ce\nx y z"), (3, "ab cd\nAB"), (4, "abcdefghijklmnopqrst uvwxyz"), (5, "abcdefghijklmnopqrst uvwxyy")]
    got = {r.doc_id: (r.text, r.n_removed) for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("---\n\nab ce\nx y z", 2), 3: ("", 2), 4: (rows[3][1], 0), 5: (rows[4][1], 0)}


def test_simhash_is_the_majority_of_its_features():
    h = np.random.default_rng(3).integers(0, 2**63, 700, dtype=np.uint64)
    f = [int(x) for x in mix64(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in f) > len(f))
    assert int(ld.simhash(h, np.array([700]))[0]) == want


def test_edit_distances():
    rng = random.Random(1)
    xs, ys = [], []
    for k in range(900):
        a = "".join(rng.choice("abc é") for _ in range(rng.randrange([15, 15, 80, 300][k % 4])))
        b = list(a)
        for _ in range(rng.randrange(1 + len(a) // 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "xy"])
        xs.append(a), ys.append("".join(b) if k % 3 else "".join(rng.choice("abc") for _ in range(rng.randrange(15))))
    want = np.array([_edits(a, b) for a, b in zip(xs, ys, strict=True)])
    for sizes in ((4096, 12, 0), (7, 12, 0), (4096, 12, 8), (4096, 1)):
        for off in (-2, -1, 0, 1, 5):
            assert (within(xs, ys, want + off, *sizes) == (off >= 0)).all()
        assert (within(xs, ys, np.full(len(xs), 4), *sizes) == (want <= 4)).all()
    assert ld.similar(xs, ys, 0.85).tolist() == [_alike(a, b) for a, b in zip(xs, ys, strict=True)]
    assert len(within([], [], [])) == 0


@pytest.mark.parametrize("p", [sd.Repeats(), sd.Repeats(shard_bytes=2000), sd.Repeats(hot=2)])
def test_suffix_dedup(spark, p):
    rows = documents() + [(200, "ab" * 300, None, 0, 0), (201, "x" * 250, None, 0, 0), (202, "é" * 150 + "q", None, 0, 0)]
    texts = [(t or "").encode() for _, t, *_ in rows]
    count = Counter(t[i : i + p.length] for t in texts for i in range(len(t) - p.length + 1))
    want = []
    for (d, *_), t in zip(rows, texts, strict=True):
        m = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - p.length + 1):
            if count[t[i : i + p.length]] > 1:
                m[i : i + p.length] = 1
        kept = bytes(b for b, k in zip(t, m, strict=False) if not k)
        want.append((-1 if d is None else d, len(t), int(m.sum()), int((np.diff(np.concatenate(([0], m))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    docs = spark.createDataFrame(rows, frame(spark).schema).repartition(4)
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.suffix_dedup(docs, p, digests=True).collect()]
    assert sorted(got) == sorted(want)
    for r in sd.suffix_dedup(docs, p).collect():
        assert r.n_removed == sum(b - a for a, b in r.spans) == r.n_bytes - len(r.kept)


def test_minhash_stage_keeps_one_row_of_each_group(spark):
    a, b, c = ("the quick brown fox jumps over it", "an other text of quite some words", "one more text that nobody else has")
    rows = [(1, a, 1), (1, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (None, a, 5), (8, None, 6), (8, None, 6), (9, c, 7), (10, b.upper(), 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `x.text_key` int").repartition(2)
    got = mh.minhash_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, a, 1), (5, b, 3), (None, a, 5), (8, None, 6), (8, None, 6), (9, c, 7)], key=repr)


def test_empty_tables(spark):
    assert mh.near_duplicates(empty(spark)).count() == 0
    assert ld.line_dedup(empty(spark)).count() == 0
    assert sd.suffix_dedup(empty(spark)).count() == 0
