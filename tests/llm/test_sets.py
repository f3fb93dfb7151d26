"""Prefix trie, importance resampling and packing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import documents, empty, frame
from oracle import same
from tokenizers import Tokenizer

from sagelode.llm import packing, prefix_trie, resampling
from sagelode.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_resample"])
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


# prefix trie

TURNS = "conv_id long, turn long, role string, text string, depth string, ids long, n long"


def turns():
    rng = random.Random(3)
    texts = ["a b", "a  b", "c", "", None, "d e\tf", "Ü x"]
    out = []
    for c in range(90):
        for t in range(rng.randrange(1, 7)):
            out.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, ""]), texts[rng.randrange(7) if t else 0]))
    for c in range(200, 330):  # copies, more than a bucket holds
        out += [(c, t, "user", "same again") for t in range(9)]
    out += [(400, 0, "user", "x")] * 2 + [(None, 0, "user", "lost"), (401, None, None, None), (402, 0, "user", "y " * 30_000)]
    out += [(403, t, "user", f"{t % 3}") for t in range(120)]
    return [(*r, "clash", 1, 2) for r in out]


def trie_by_hand(rows):
    from xxhash import xxh64_intdigest

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((t is not None, t or 0, role, signed(xxh64_intdigest(text.encode(), 42)), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        seq = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, len(seq)))
    saved, leaves, children = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += not children[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c, n in m if n == len(p))
        out.append((m[0][0], len(p), members[p[:-1]][0][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("cfg", [prefix_trie.Trie(), prefix_trie.Trie(local=12, bunch=20, stretch=3), prefix_trie.Trie(local=1, bunch=1, stretch=1)])
def test_trie_equals_brute_force(spark, cfg):
    rows = turns()
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(4), cfg)
    assert sorted((tuple(r) for r in got.collect()), key=str) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    lost = spark.createDataFrame([(None, 1, "user", "x", "", 0, 0)], TURNS)
    assert prefix_trie.conversation_trie(lost).count() == 0


# resampling


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def resampled(docs, target, n=1, least=20, percent=10):
    grams = lambda w: [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(words_of(text))))
    for text in target:
        t.update(map(bucket, grams(words_of(text))))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    rows = []
    for d, text in docs:
        own = [gain(bucket(g)) for g in grams(words_of(text))]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    long = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], r[1]))
    place = {id(r): i + 1 for i, r in enumerate(long[: percent * len(long) // 100])}
    return sorted([(*r[:4], place.get(id(r))) for r in rows], key=str)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_brute_force(spark, n):
    docs = [(r[0], r[1]) for r in documents()] + [(200 + i, documents()[3][1]) for i in range(40)] + [(300, "Aa " * 300_000 + "ÀÉ x\x00y [ { \x7f")]
    target = [documents()[3][1], None, "", documents()[3][1] + " hash"]
    rows = spark.createDataFrame([(d, t, "id", 1, 2) for d, t in docs], "doc_id long, text string, word string, block long, rank long").repartition(3)
    other = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    cfg = resampling.Resampling(n=n, percent=30, block_bytes=3000)
    got = [tuple(r) for r in resampling.resample(rows, other, cfg).collect()]
    assert sorted(got, key=str) == resampled(docs, target, n, percent=30)


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(empty(spark), none).count() == 0
    docs = [(r[0], r[1]) for r in documents()]
    assert sorted((tuple(r) for r in resampling.resample(frame(spark), none).collect()), key=str) == resampled(docs, [])


# packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def placed(rows, capacity):
    """Checks that the pieces fill sequences without gaps, and gives the number of sequences."""
    own = defaultdict(list)
    for r in rows:
        own[r.sequence_id].append((r.offset, r.length))
    for pieces in own.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(own)


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("capacity", [32, 256, 2048])
def test_pieces_equal_the_library_and_fit(spark, capacity):
    docs = [(r[0], r[1]) for r in documents()] + [(500, "word " * 20_000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, length long, part string").repartition(3)
    cfg = packing.Packing(capacity=capacity, least=capacity // 16)
    got = packing.pack(df, PATH, cfg, ids=True).collect()
    tok, want, lengths = Tokenizer.from_file(PATH), Counter(), []
    for d, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        for i, at in enumerate([0, *range(first, len(ids), capacity)]):
            cut = ids[at : at + (capacity if i else first)]
            lengths.append(len(cut))
            want[d, i, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()), tuple(cut)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert placed(got, capacity) <= best_fit(lengths, capacity)


def test_sequences_hold_their_pieces(spark):
    cfg = packing.Packing(capacity=256, least=16)
    packed = packing.pack(frame(spark), PATH, cfg, ids=True).cache()
    own = defaultdict(list)
    for r in packed.collect():
        own[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for r in packing.sequences(packed).collect():
        pieces = sorted(own.pop(r.sequence_id))
        assert bytes(r.ids) == b"".join(p[2] for p in pieces) and r.n_tokens == sum(p[1] for p in pieces)
        assert r.ends == [p[0] + p[1] for p in pieces]
    assert not own
    packed.unpersist()


def test_nothing_is_packed_from_nothing(spark):
    assert packing.pack(empty(spark), PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_length(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(2049, np.int64)
    n = [30, 3000, 40_000, 5, 100_000, 2000][seed]
    lengths = np.clip(rng.lognormal(6, 1.2, n).astype(int), 1, 2048) if seed != 5 else rng.integers(700, 1400, n)
    np.add.at(counts, lengths, 1)
    if seed == 4:
        counts[700] += 50_000  # a third of all have one length
    plan = packing.plan(counts)
    runs = plan.runs()
    rank = {}
    for length, first, _base, _offset, copies in runs.tolist():
        assert first == rank.get(length, 0) or first > rank.get(length, 0)
        rank[length] = first
    filled = sum(n * (2048 - room) for room, own in enumerate(plan.room) for n, _ in own)
    assert filled == int((counts * np.arange(2049)).sum())
    if n <= 3000:
        assert plan.sequences() <= best_fit(lengths.tolist(), 2048) + n // 1000
