"""Tokenizers' operators against the libraries, byte for byte."""

import base64
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtures import documents, empty, frame
from sagelode.llm import byte_bpe, lm_scoring, token_counts, token_files
from sagelode.llm.common import shared_dir
from sagelode.llm.elias_fano import EliasFano, Trie
from sagelode.llm.pretokens import pack, segments, unpack

MULTI, JSON, PIECES = (P.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
CHARS = " \n\t'ab1!é\x1c\x85　sltd<|,.É٣"


def _tiktoken():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(MULTI), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=CHARS, max_size=14))
def test_segments_hold_whole_matches(text):
    enc = _ENC
    find = byte_bpe._matcher(P.PATTERN)()[1]
    assert "".join(segments(text)) == text
    assert [i for s in segments(text) for w in find(s) for i in enc.encode_ordinary(w)] == enc.encode_ordinary(text)


_ENC = _tiktoken()
_SEG = token_files.SegmentEncoder(JSON, 50)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=CHARS, max_size=14))
def test_segment_encoder_is_the_library(text):
    assert np.frombuffer(_SEG.encode([text])[0], "<u2").tolist() == _SEG.tokenizer.encode(text, add_special_tokens=False).ids


def test_byte_bpe_round_trip(spark):
    out = byte_bpe.decode(byte_bpe.encode(frame(spark), MULTI, P.PATTERN, block_chars=3000), MULTI).collect()
    want = sorted((str(d), _ENC.encode_ordinary(t or ""), (t or "").encode()) for d, t, *_ in documents())
    assert sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in out) == want
    assert byte_bpe.encode(empty(spark), MULTI, P.PATTERN).count() == 0


def test_ranks_file(tmp_path):
    (tmp_path / "x").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate((b"a", b"bc"))) + b"\n")
    assert byte_bpe.load_ranks(str(tmp_path / "x")) == {b"a": 0, b"bc": 1}


def test_starts_of_many_files(spark):
    files = [((n // 7 << 20) + n % 7, f"p{n}", 1, (n * 7919) % 13) for n in range(350) if n % 3]
    got = {r.file_no: r.start for r in token_files.with_starts(spark.createDataFrame(files, "file_no long, path string, docs long, tokens long")).collect()}
    assert got == {n: sum(t for m, _, _, t in files if m < n) for n, *_ in files}


@pytest.mark.parametrize("file_bytes", [256_000_000, 2000])
def test_token_files(spark, file_bytes):
    root = f"{shared_dir(spark)}/token-test-{file_bytes}"
    manifest = token_files.write_token_files(frame(spark), JSON, root, end_id=2, fmt=token_files.Format(file_bytes=file_bytes))
    text_key = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0, text_key(r[1])))
    start = 0
    want = []
    for d, t, *_ in rows:
        ids = [*_SEG.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, ids))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, list(r.ids)) for r in token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    assert got == want
    crc = {r.start: r.ids_crc32 for r in token_files.read_token_files(manifest, digests=True).collect()}
    assert crc == {s: zlib.crc32(np.array(i, "<u4").tobytes()) for _, s, i in want}
    # one document at a time
    for m in manifest.collect():
        f = token_files.TokenFile(m.path)
        for i in f.find(103):
            assert f.ids(i).tolist() in [w[2] for w in want if w[0] == 103]
    assert token_files.read_token_files(token_files.write_token_files(empty(spark), JSON, root + "-empty", 2)).count() == 0


@pytest.fixture(scope="module")
def unigram():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(PIECES, "rb").read())
    m.trainer_spec.model_type = 1  # the same pieces and scores read as a unigram vocabulary
    keep = [p for p in m.pieces if p.score > -1e9]
    del m.pieces[:]
    m.pieces.extend(keep)
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_token_counts_are_the_library_s(spark, unigram):
    v = token_counts.Unigram.from_model(PIECES)
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(frame(spark), v).collect())
    # sentencepiece sums scores in 32 bits, which are exact up to 2 ** 24: take texts short enough
    short = {str(d) for d, t, *_ in documents() if len(t or "") > 2500}
    want = sorted((str(d), len(unigram.encode(t or ""))) for d, t, *_ in documents() if str(d) not in short)
    assert [g for g in got if g[0] not in short] == want
    assert token_counts.token_counts(empty(spark), v).count() == 0


def test_token_count_ties_take_the_longest_last_piece():
    v = token_counts.Unigram((("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -9.0), ("c", -7.0)), dummy_prefix=False)
    assert token_counts.Counter(v).count("ab") == (1, -2.0)
    assert token_counts.Counter(v).count("abc") == (1, -9.0)
    assert token_counts.Counter(v).count("é") == (2, -19.0)
    assert token_counts.Counter(token_counts.Unigram(v.pieces, False, False)).count("éé")[0] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300), st.integers(0, 300), st.integers(0, 300))
def test_elias_fano(values, lo, hi):
    v = np.sort(np.array(values, np.int64))
    e, _ = EliasFano.read(EliasFano.build(v).to_bytes(), 0)
    lo, hi = sorted((min(lo, len(v)), min(hi, len(v))))
    assert (e.slice(lo, hi) == v[lo:hi]).all()


def test_trie():
    rng = np.random.default_rng(4)
    key = np.unique(rng.integers(0, 50, 900) * 1000 + rng.integers(0, 1000, 900))
    v, w, code = key // 1000, key % 1000, rng.integers(1, 65536, len(key)).astype(np.uint16)
    t = Trie.read(Trie.build(v, w, code))
    every = np.arange(60 * 1000)
    want = np.zeros(len(every), np.uint16)
    want[key] = code
    assert (t.find(every // 1000, every % 1000, step=64) == want).all()
    few = np.isin(every // 1000, [0, 7, 8, 49, 55])
    assert (t.find(every[few] // 1000, every[few] % 1000, step=64) == want[few]).all()


def test_pack():
    x = np.random.default_rng(0).integers(0, 2**32, 1000, dtype=np.uint32)
    assert (unpack(pack(x)) == x).all() and len(unpack(pack(x[:0]))) == 0


def test_trie_takes_stretches_apart_not_each_context(monkeypatch):
    n = 20_000
    v, w = np.repeat(np.arange(n), 3), np.tile([1, 5, 9], n)
    t = Trie.read(Trie.build(v, w, (np.arange(3 * n) % 65535 + 1).astype(np.uint16)))
    slices, plain = [], EliasFano.slice
    monkeypatch.setattr(EliasFano, "slice", lambda self, lo, hi: slices.append(hi - lo) or plain(self, lo, hi))
    asked = np.repeat(np.arange(0, n, 2), 2)
    got = t.find(asked, np.tile([5, 6], n // 2), step=16_000)
    want = np.zeros(n, np.int64)
    want[::2] = (3 * np.arange(0, n, 2) + 1) % 65535 + 1
    assert got.tolist() == want.tolist()
    assert len(slices) <= 2 + 3 * n // 16_000 + 1 and max(slices[2:]) <= 16_003


def test_lm_scores(spark):
    import math
    from collections import Counter

    model = lm_scoring.Model(weight=3.0, hot=50, block_chars=3000)
    rows = [(d, [*(t or "").encode().lower().split(), b"\n"]) for d, t, *_ in documents()]
    c, two = Counter(), Counter()
    for d, t in rows:
        if not lm_scoring.held_out(d):
            c.update(t)
            two.update(zip([b"^", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in rows:
        base = score = 0.0
        for a, w in zip([b"^", *t], t, strict=False):
            p = (c[w] + 0.5) / (n + 0.5 * (v + 1))
            ca = c[b"\n"] if a == b"^" else c[a]
            base += math.log10(p)
            score += math.log10((two[a, w] + model.weight * p) / (ca + model.weight))
        want.append((str(d), lm_scoring.held_out(d), len(t), sum(c[w] > 0 for w in t), n, base, score))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scoring.lm_scores(frame(spark), model).collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and abs(g[6] - w[6]) <= 2e-4 * w[2]
    assert lm_scoring.lm_scores(empty(spark)).count() == 0


def test_other_columns_play_no_part(spark):
    """Columns of clashing and dotted names, and an id of 32 bits."""
    from sagelode.llm import suffix_dedup

    plain = spark.createDataFrame([(1, "one two three"), (2, None), (3, "x" * 250)], "doc_id int, text string")
    docs = plain.selectExpr("*", "7 AS row_key", "8 AS text_key", "'b' AS block", "array(1) AS ids", "9 AS key", "10 AS `a.b`", "11 AS word", "12 AS shard", "13 AS path")
    vocabulary = token_counts.Unigram.from_model(PIECES)
    runs = (
        lambda d: token_counts.token_counts(d, vocabulary),
        lambda d: byte_bpe.encode(d, MULTI, P.PATTERN),
        lambda d: lm_scoring.lm_scores(d),
        lambda d: suffix_dedup.suffix_dedup(d, digests=True),
        lambda d: token_files.read_token_files(token_files.write_token_files(d, JSON, f"{shared_dir(spark)}/clash-{len(d.columns)}", 2)),
    )
    for run in runs:
        assert sorted(map(repr, run(docs).collect())) == sorted(map(repr, run(plain).collect()))
