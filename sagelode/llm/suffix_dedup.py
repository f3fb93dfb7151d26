"""Suffix-array dedup: bytes under a string of fixed length that starts more than once are removed.

Windows (strings of the fixed length) are first cut into pieces: neighbouring windows whose least 32-byte gram is the
same one, and that hold the same neighbourhood of it, make a piece, and the piece's key hashes that neighbourhood.
Equal windows lie in pieces of equal keys, so each key is a world of its own. Pieces with equal bytes repeat as a
whole; the others that share a key go, as short segments, to suffix-array shards: Larsson-Sadakane refinement sorts
their suffixes, Kasai's recurrence gives common prefixes, and a key that spans several shards is merged by binary search.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, materialize, mix64, odd_multipliers, record_batch, shuffle_width, table

I64 = np.int64


@dataclass(frozen=True)
class Repeats:
    """`length`: bytes of a repeated string (116 at least). A shard holds about `shard_bytes`. Keys of more than `hot`
    different pieces are resolved window by window, by digest, so that no key gathers in one task."""

    length: int = 200
    shard_bytes: int = 1_000_000
    hot: int = 8000

    gram = 32

    @property
    def side(self) -> int:
        return (self.length - self.gram) // 2


_TABLE = np.random.default_rng(17).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([U64(1)], np.full(n, base, U64))), dtype=U64)


def pieces(text: np.ndarray, ends: np.ndarray, p: Repeats) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, key, digest) of the pieces of documents laid end to end; `text` has their
    bytes, `ends` where each ends. Offsets are within the document."""
    n, span = len(text), p.length - p.gram + 1
    none = tuple(np.empty(0, t) for t in (I64, I64, I64, U64, U64))
    if n < p.length:
        return none
    with np.errstate(over="ignore"):
        one = _TABLE[text]
        level, width = one, 1
        mult = odd_multipliers(5, 31)
        for m in mult:
            level = level[:-width] * m + level[width:]
            width *= 2
        value = (mix64(level) & U64(0xFFFFFFFF00000000)) | np.arange(len(level), dtype=U64)
        low, width = value, 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        anchor = (low & U64(0xFFFFFFFF)).astype(I64)  # of each window
        doc = np.searchsorted(ends, np.arange(len(anchor)), "right")
        valid = np.arange(len(anchor)) + p.length <= ends[doc]
        left = anchor - np.arange(len(anchor)) >= p.side
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:] != doc[:-1])) + 1
        first = np.concatenate(([0], cut))
        count = np.diff(np.concatenate((first, [len(anchor)])))
        keep = valid[first]
        first, count = first[keep], count[keep]
        if not len(first):
            return none
        # substring hashes from one prefix sum: sum of table[byte] * base^-position, times base^start
        base = int(odd_multipliers(1, 71)[0])
        inverse = pow(base, -1, 1 << 64)
        prefix = np.concatenate(([U64(0)], np.cumsum(one * _powers(inverse, n - 1), dtype=U64)))
        power = _powers(base, n)
        at, side = anchor[first], left[first]
        start = np.where(side, at - p.side, at)
        around = (prefix[start + p.gram + p.side] - prefix[start]) * power[start]
        key = mix64(around + np.where(side, U64(1), U64(2)))
        stop = first + count - 1 + p.length
        digest = mix64((prefix[stop] - prefix[first]) * power[first] + (stop - first).astype(U64) * U64(0x9E3779B97F4A7C15))
    begin = np.concatenate(([0], ends[:-1]))
    d = doc[first]
    return d, first - begin[d], count, key, digest


def _documents(batches, limit: int = 300_000):
    """(row keys, bytes, ends) of some documents at a time, laid end to end."""
    rows, cells, size = [], [], 0
    for b in batches:
        for r, t in zip(b.column("row_key").to_pylist(), b.column("text"), strict=True):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            rows.append(r), cells.append(raw)
            size += len(raw)
            if size >= limit:
                yield np.array(rows, I64), np.frombuffer(b"".join(cells), np.uint8), np.cumsum([len(c) for c in cells])
                rows, cells, size = [], [], 0
    if rows:
        yield np.array(rows, I64), np.frombuffer(b"".join(cells), np.uint8), np.cumsum([len(c) for c in cells])


def piece_table(docs: DataFrame, p: Repeats) -> DataFrame:
    """Rows (key, digest, row_key, place): place is the first window's offset * 256 + windows - 1."""
    schema = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("row_key", pa.int64()), ("place", pa.int64())])

    def run(batches):
        for rows, text, ends in _documents(batches):
            d, first, count, key, digest = pieces(text, ends, p)
            if len(d):
                yield record_batch({"key": key.view(I64), "digest": digest.view(I64), "row_key": rows[d], "place": first * 256 + count - 1}, schema)

    return docs.mapInArrow(run, "key long, digest long, row_key long, place long")


REPEATED, SINGLE, SAMPLE = 0, 1, 2


def shared_pieces(found: DataFrame) -> DataFrame:
    """Of the pieces whose key occurs twice or more: (key, row_key, place, kind). REPEATED: another has the same bytes;
    SINGLE: none has; SAMPLE: besides, one of each set of equal pieces where the key has other ones. Rows stream past by
    key and digest; a run of any length needs the memory of a batch."""
    schema = pa.schema([("key", pa.int64()), ("row_key", pa.int64()), ("place", pa.int64()), ("kind", pa.int32())])

    def run(batches):
        held = [np.empty(0, I64)] * 4
        # what was let go of the run at hand: its key, its digest; whether the key has had another digest
        past = None

        def flush(done, more):
            nonlocal held, past
            k, d, r, x = (c[:done] for c in held)
            held = [c[done:] for c in held]
            same_k = np.concatenate(([past is not None and k[0] == past[0]], k[1:] == k[:-1]))
            same_d = same_k & np.concatenate(([past is not None and d[0] == past[1]], d[1:] == d[:-1]))
            next_k, next_d = np.append(same_k[1:], more and held[0][0] == k[-1]), np.append(same_d[1:], more and held[0][0] == k[-1] and held[1][0] == d[-1])
            shared, repeated = same_k | next_k, same_d | next_d
            kind = np.where(repeated, REPEATED, SINGLE)
            keep = shared
            samples = repeated & ~same_d  # first of its set
            out = [(k[keep], r[keep], x[keep], kind[keep]), (k[samples], r[samples], x[samples], np.full(samples.sum(), SAMPLE))]
            past = (k[-1], d[-1])
            return record_batch(dict(zip(schema.names, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)), schema)

        for b in batches:
            if not b.num_rows:
                continue
            held = [np.concatenate((h, b.column(c).to_numpy(zero_copy_only=False))) for h, c in zip(held, ("key", "digest", "row_key", "place"), strict=True)]
            if len(held[0]) > 1:
                yield flush(len(held[0]) - 1, True)
        if len(held[0]):
            yield flush(len(held[0]), False)

    dealt = found.repartition(shuffle_width(found.sparkSession), "key").sortWithinPartitions("key", "digest")
    return materialize(dealt.mapInArrow(run, "key long, row_key long, place long, kind int"), "shared-pieces")


def suffix_array(words: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their suffixes up to `depth` bytes, by Larsson-Sadakane refinement: groups of equal prefixes
    carry their first place in the order as rank, and only groups of several members are sorted again, by the rank
    `h` further on. `words` has the next 8 bytes of each position as a number, `room` the bytes up to its segment's end."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, I64)
    start = np.concatenate(([True], words[order][1:] != words[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    h = 8
    while h < depth:
        size = np.bincount(rank, minlength=n)
        places = np.flatnonzero(size[rank[order]] > 1)  # unsorted groups
        if not len(places):
            break
        at = order[places]
        ahead = np.where(room[at] > h, rank[np.minimum(at + h, n - 1)] + 1, 0)
        resort = np.argsort(rank[at] * (n + 1) + ahead, kind="stable")
        at, group, ahead = at[resort], rank[at][resort], ahead[resort]
        order[places] = at
        start = np.concatenate(([True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])))
        rank[at] = np.maximum.accumulate(np.where(start, places, 0))
        h *= 2
    return order


def common_prefixes(text, words, room, begin, n_windows, before, cap: int) -> np.ndarray:
    """For each window start the bytes it shares with the suffix `before` it in the order (-1: none), up to `cap`.
    Kasai's recurrence: of the next start it is one less at least; all segments take a step at once."""
    out = np.zeros(len(text), I64)
    have = np.zeros(len(begin), I64)
    for t in range(int(n_windows.max())):
        live = np.flatnonzero(t < n_windows)
        p = begin[live] + t
        q = before[p]
        ok = q >= 0
        live, p, q = live[ok], p[ok], q[ok]
        have = np.maximum(have - 1, 0)
        most = np.minimum(np.minimum(room[p], room[q]), cap)
        got = np.minimum(have[live], most)
        go = np.flatnonzero(got + 8 <= most)
        while len(go):
            go = go[words[p[go] + got[go]] == words[q[go] + got[go]]]
            got[go] += 8
            go = go[got[go] + 8 <= most[go]]
        go = np.flatnonzero(got < most)
        while len(go):
            go = go[text[p[go] + got[go]] == text[q[go] + got[go]]]
            got[go] += 1
            go = go[got[go] < most[go]]
        have[:] = 0
        have[live] = got
        out[p] = got
    return out


class Shard:
    """The suffix array of some segments; `repeated` marks the window starts whose string occurs twice in the shard."""

    def __init__(self, segments: list[bytes], length: int):
        self.length = length
        size = np.array([len(s) for s in segments], I64)
        self.begin = np.cumsum(size) - size
        self.n_windows = np.maximum(size - length + 1, 0)
        self.raw = b"".join(segments)
        text = np.frombuffer(self.raw, np.uint8)
        room = np.repeat(self.begin + size, size) - np.arange(len(text))
        padded = np.concatenate((text, np.zeros(8, np.uint8)))
        words = np.zeros(len(text), U64)
        for j in range(8):
            words = (words << U64(8)) | np.where(room > j, padded[j : j + len(text)], 0).astype(U64)
        self.order = suffix_array(words, room, length)
        before = np.empty(len(text), I64)
        before[self.order] = np.concatenate(([-1], self.order[:-1]))
        prefix = common_prefixes(text, words, room, self.begin, self.n_windows, before, length)
        # the order stops at a depth, so among suffixes equal to that depth the recurrence may promise too much: compare
        at = np.flatnonzero(prefix >= length)
        for j in [*range(0, length - 8, 8), length - 8]:
            at = at[words[at + j] == words[before[at] + j]]
        self.repeated = np.zeros(len(text), bool)
        self.repeated[at] = self.repeated[before[at]] = True

    def sorted_windows(self, lo: int, hi: int) -> np.ndarray:
        """Window starts of segments lo..hi-1 in suffix order."""
        inside = np.zeros(len(self.order), bool)
        for i in range(lo, hi):
            inside[self.begin[i] : self.begin[i] + self.n_windows[i]] = True
        return self.order[inside[self.order]]

    def window(self, at: int) -> bytes:
        return self.raw[at : at + self.length]


def merge_shards(old: Shard, old_range: tuple[int, int], new: Shard, new_range: tuple[int, int]) -> None:
    """Marks the windows of one key that two shards share: binary search of the windows of one in the order of the other."""
    mine, theirs = new.sorted_windows(*new_range), old.sorted_windows(*old_range)
    lo = 0
    for at in mine.tolist():
        w = new.window(at)
        lo = bisect.bisect_left(theirs, w, lo=lo, key=old.window)
        hit = lo
        while hit < len(theirs) and old.window(theirs[hit]) == w:
            old.repeated[theirs[hit]] = new.repeated[at] = True
            hit += 1


def _marked(row_keys, firsts, shard: Shard, lo: int, hi: int):
    """(row_key, place) of the runs of repeated windows of segments lo..hi-1."""
    for i in range(lo, hi):
        own = shard.repeated[shard.begin[i] : shard.begin[i] + shard.n_windows[i]]
        if own.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                yield row_keys[i], (firsts[i] + a) * 256 + b - a - 1


def shard_repeats(segments: DataFrame, p: Repeats) -> DataFrame:
    """Rows (row_key, place) of the repeated windows among `segments` (key, row_key, first, data)."""
    schema = pa.schema([("row_key", pa.int64()), ("place", pa.int64())])

    def run(batches):
        keys, rows, firsts, data, size = [], [], [], [], 0
        pending = []  # shards of a key that goes on: (shard, its range in it, row keys, firsts)

        def close(cut):
            """Builds a shard of the first `cut` segments held."""
            nonlocal keys, rows, firsts, data, size, pending
            out = []
            if cut:
                shard = Shard(data[:cut], p.length)
                head = bisect.bisect_right(keys[:cut], keys[0])
                if pending and pending[0][0] == keys[0]:
                    for _, old, where, *_ in pending:
                        merge_shards(old, where, shard, (0, head))
                else:
                    out += settle()
                goes_on = cut < len(keys) and keys[cut] == keys[cut - 1]
                tail = bisect.bisect_left(keys[:cut], keys[cut - 1]) if goes_on else cut
                if goes_on and tail == 0:
                    pending.append((keys[0], shard, (0, cut), rows[:cut], firsts[:cut]))
                else:
                    out += settle()
                    out += _marked(rows, firsts, shard, 0, tail)
                    if goes_on:
                        pending = [(keys[cut - 1], shard, (tail, cut), rows[:cut], firsts[:cut])]
                keys, rows, firsts, data = keys[cut:], rows[cut:], firsts[cut:], data[cut:]
                size = sum(map(len, data))
            return out

        def settle():
            nonlocal pending
            out = [x for _, s, where, r, f in pending for x in _marked(r, f, s, *where)]
            pending = []
            return out

        def batch(out):
            return record_batch({"row_key": [r for r, _ in out], "place": [x for _, x in out]}, schema)

        for b in batches:
            for k, r, f, d in zip(b.column("key").to_pylist(), b.column("row_key").to_pylist(), b.column("first").to_pylist(), b.column("data").to_pylist(), strict=True):
                if size >= p.shard_bytes:
                    # end at a key's end, unless one key fills more than a shard
                    cut = len(keys) if k != keys[-1] or size >= 2 * p.shard_bytes else 0
                    if cut:
                        keys.append(k), rows.append(r), firsts.append(f), data.append(d)
                        yield batch(close(cut))
                        continue
                keys.append(k), rows.append(r), firsts.append(f), data.append(d)
                size += len(d)
        out = close(len(keys))
        yield batch(out + settle())

    dealt = segments.repartition(shuffle_width(segments.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "row_key long, place long")


def repeated_windows(docs: DataFrame, p: Repeats) -> DataFrame:
    """Rows (row_key, places): the runs of repeated windows of each row of `docs` (row_key, text) that has any."""
    shared = shared_pieces(piece_table(docs, p))
    open_ = shared.where(F.col("kind") != REPEATED)
    counts = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("kind") == SINGLE).cast("int")).alias("singles")).where("n > 1 AND singles > 0")
    todo = open_.join(counts.select("key", (F.col("n") > p.hot).alias("hot")), "key")
    todo = todo.groupBy("row_key").agg(F.collect_list(F.struct("key", "place", "kind", "hot")).alias("w"))  # a row's own pieces
    length = p.length
    schema = pa.schema([("key", pa.int64()), ("row_key", pa.int64()), ("first", pa.int64()), ("data", pa.binary()), ("kind", pa.int32()), ("hot", pa.bool_())])

    def cut(batches):
        for b in batches:
            out = {c: [] for c in schema.names}
            size = 0
            for r, t, w in zip(b.column("row_key").to_pylist(), b.column("text"), b.column("w"), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                for x in w.as_py():
                    first, n = x["place"] >> 8, (x["place"] & 255) + 1
                    parts = [(x["key"], first, raw[first : first + n - 1 + length])]
                    if x["hot"]:  # window by window: the key is the digest of the whole string
                        windows = [(f, raw[f : f + length]) for f in range(first, first + n)]
                        parts = [(int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True), f, hashlib.blake2b(s, digest_size=16).digest()) for f, s in windows]
                    for k, f, s in parts:
                        for c, v in zip(schema.names, (k, r, f, s, x["kind"], x["hot"]), strict=True):
                            out[c].append(v)
                        size += len(s)
                    if size > 4_000_000:
                        yield record_batch(out, schema)
                        out, size = {c: [] for c in schema.names}, 0
            yield record_batch(out, schema)

    segments = docs.join(todo, "row_key").select("row_key", "text", "w").mapInArrow(cut, "key long, row_key long, first long, data binary, kind int, hot boolean")
    segments = materialize(segments, "segments")
    cold = shard_repeats(segments.where("NOT hot").select("key", "row_key", "first", "data"), p)
    hot = segments.where("hot")
    twice = hot.groupBy("data").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = hot.join(twice, "data").select("row_key", (F.col("first") * 256).alias("place"))
    whole = shared.where(F.col("kind") == REPEATED).select("row_key", "place")
    return materialize(whole.unionByName(cold).unionByName(hot).groupBy("row_key").agg(F.collect_set("place").alias("places")), "repeats")


def suffix_dedup(docs: DataFrame, p: Repeats = Repeats(), text: str = "text", digests: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, spans, kept), one for each row of `docs`.

    Every byte under a string of `p.length` bytes of UTF-8 that starts anywhere else too, in this document or another,
    is removed; strings don't cross documents, overlaps count, and all is judged on the input. spans are the maximal
    removed runs [begin, end); kept has the remaining bytes, which may cut a character. With `digests`, kept_sha256
    comes instead of spans and kept. Null texts count as empty. A repeated row makes every string of it repeat; null
    doc_ids pass through; an empty table gives no rows. A text of any length is taken whole, in one task. Columns of
    `docs` besides doc_id and text, whatever their names, play no part.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("row_key"), F.col(text).alias("text"))
    found = repeated_windows(keyed.select("row_key", "text"), p)
    length = p.length
    tail = [("kept_sha256", pa.string())] if digests else [("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())]
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), *tail])

    def run(batches):
        for b in batches:
            out = {c: [] for c in schema.names}
            for d, t, x in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("places"), strict=True):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                spans, kept = [], raw
                if x.is_valid:
                    place = np.sort(x.values.to_numpy())
                    lo, hi = place >> 8, (place >> 8) + (place & 255) + length
                    hi = np.maximum.accumulate(hi)
                    new = np.concatenate(([True], lo[1:] > hi[:-1]))
                    lo, hi = lo[new], hi[np.append(new[1:], True)]
                    spans = np.stack((lo, hi), axis=1).tolist()
                    kept = b"".join(raw[a:z] for a, z in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True))
                values = {"doc_id": d, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(spans)}
                values |= {"kept_sha256": hashlib.sha256(kept).hexdigest()} if digests else {"spans": spans, "kept": kept}
                for c, v in values.items():
                    out[c].append(v)
            yield record_batch(out, schema)

    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digests else "spans array<array<long>>, kept binary")
    return keyed.join(found, "row_key", "left").select("doc_id", "text", "places").mapInArrow(run, fields)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), digests=True)


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict = {}
