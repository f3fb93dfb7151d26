"""Best-fit packing: patterns of few documents fitted to the length histogram by non-negative least squares, the rest
packed best fit.

Only the histogram of piece lengths, `capacity` numbers, reaches the driver. The plan that it makes is as bounded: runs
of pieces of one length that go to like sequences. Which piece is the how-manieth of its length comes from counts of
each task and running sums over the tasks, so that nothing is sorted or gathered by length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_tables, materialize, record_batch, shared_size_join, table
from .token_files import encoder


@dataclass(frozen=True)
class Packing:
    """Sequences of at most `capacity` tokens. Patterns have two or three lengths from `least` on that fill a sequence
    exactly; shorter pieces are left as fillers. `steps` bounds the rounds of the fit and `columns` the patterns it
    takes up in one. Each of `shares` of the fitted counts is rounded and completed, and the plan with the fewest sequences
    stays. `memo` bounds what a worker's tokenizer remembers."""

    capacity: int = 2048
    end_id: int = 0
    least: int = 128
    steps: int = 32
    columns: int = 64
    shares: tuple = (1.0, 0.75, 0.5, 0.25)
    memo: int = 1_200_000


def patterns(counts: np.ndarray, least: int) -> np.ndarray:
    """All patterns (i, j, k), i >= j >= k, of lengths that occur, with i + j + k = len(counts) - 1; k = 0 in those of two."""
    capacity = len(counts) - 1
    own = np.flatnonzero(counts[:capacity])
    own = own[own >= max(1, least)]
    there = np.zeros(capacity + 1, bool)
    there[own] = True
    found = [np.empty((0, 3), np.int64)]
    for i in own[::-1].tolist():
        j = own[(own <= i) & (own >= (capacity - i + 1) // 2) & (own <= capacity - i)]
        k = capacity - i - j
        ok = (k == 0) | (there[k] & (k <= j))
        found.append(np.stack([np.full(ok.sum(), i), j[ok], k[ok]], axis=1))
    return np.concatenate(found)


def least_squares(p: np.ndarray, b: np.ndarray, steps: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of p, their counts): non-negative counts x that make the patterns' lengths fit b in the sense of least
    squares, by the active-set method; in each step the `columns` patterns of steepest gradient with no length in common
    join the active set."""
    active, x = np.empty(0, np.int64), np.empty(0)
    scale = 1 / np.sqrt(np.maximum(b, 1.0))  # a count's spread grows with its root
    rest = b.astype(float)

    def fit(cols):
        m = np.zeros((len(b), len(cols)))
        for side in range(3):
            np.add.at(m, (p[cols, side], np.arange(len(cols))), 1.0)
        m[0] = 0
        m *= scale[:, None]
        return np.linalg.solve(m.T @ m + 1e-9 * np.eye(len(cols)), m.T @ (b * scale))

    for _ in range(steps if len(p) else 0):
        w = rest * scale**2
        w[0] = 0
        gradient = w[p].sum(axis=1)
        gradient[active] = 0
        used, new = np.zeros(len(b), bool), []
        best = np.argpartition(-gradient, min(len(gradient) - 1, 20 * columns))[: 20 * columns]
        for c in best[np.argsort(-gradient[best], kind="stable")].tolist():
            if gradient[c] <= 1e-6 or len(new) == columns:
                break
            own = p[c][p[c] > 0]
            if not used[own].any():
                used[own] = True
                new.append(c)
        if not new:
            break
        active = np.concatenate([active, new]).astype(np.int64)
        while len(active):
            x = fit(active)
            if (x > 1e-9).all():
                break
            active = active[x > 1e-9]  # dropped patterns may come back by their gradient
        filled = np.zeros(len(b))
        for side in range(3):
            np.add.at(filled, p[active, side], x[: len(active)])
        filled[0] = 0
        rest = b - filled
    return active, x[: len(active)]


class _Plan:
    """Like sequences as (count, parts); the parts of a sequence are (length, copies, parts before)."""

    def __init__(self, capacity: int):
        self.capacity, self.room = capacity, [[] for _ in range(capacity + 1)]

    def put(self, count: int, room: int, parts) -> None:
        if count:
            self.room[room].append((count, parts))

    def best_fit(self, counts: np.ndarray) -> None:
        """Longest first, each into the fullest sequences that have room; all pieces of a length at once."""
        for length in range(self.capacity, 0, -1):
            left, r = int(counts[length]), length
            while left:
                while r <= self.capacity and not self.room[r]:
                    r += 1
                if r > self.capacity:
                    k = self.capacity // length
                    self.put(left // k, self.capacity - k * length, (length, k, None))
                    if left % k:
                        self.put(1, self.capacity - left % k * length, (length, left % k, None))
                    break
                n, parts = self.room[r].pop()
                m = min(n, left)
                self.put(n - m, r, parts)
                self.put(m, r - length, (length, 1, parts))
                left -= m
                r = length  # what has just been filled may be the fullest

    def sequences(self) -> int:
        return sum(n for own in self.room for n, _ in own)

    def runs(self) -> np.ndarray:
        """Columns length, first, base, offset, copies: pieces of `length` from the `first`-th on go to the sequences from
        `base` on, `copies` to each, from `offset` on. Sorted by length and first."""
        out, used, base = [], {}, 0
        for n, parts in (g for own in self.room for g in own):
            chain = []
            while parts:
                chain.append(parts[:2])
                parts = parts[2]
            offset = 0
            for length, k in reversed(chain):
                out.append((length, used.get(length, 0), base, offset, k))
                used[length] = used.get(length, 0) + n * k
                offset += length * k
            base += n
        return np.array(sorted(out), np.int64).reshape(-1, 5)


def plan(counts: np.ndarray, cfg: Packing = Packing()) -> _Plan:
    """The plan for counts[length] pieces of each length."""
    p = patterns(counts, cfg.least)
    b = counts.astype(float)
    b[: cfg.least] = 0
    b[cfg.capacity :] = 0
    active, x = least_squares(p, b, cfg.steps, cfg.columns)
    best = None
    for share in cfg.shares:
        left, out, repeats = counts.copy(), _Plan(cfg.capacity), np.floor(share * x + 1e-6).astype(np.int64)
        frac = share * x - repeats
        for up in (False, True):  # whole repeats first, then one more where the fraction says so and pieces are left
            for c in np.argsort(-frac if up else -repeats, kind="stable").tolist():
                lengths, each = np.unique(p[active[c]][p[active[c]] > 0], return_counts=True)
                m = min(int(frac[c] >= 0.5) if up else int(repeats[c]), int((left[lengths] // each).min()))
                if m > 0:
                    left[lengths] -= m * each
                    parts = None
                    for length, k in zip(lengths.tolist()[::-1], each.tolist()[::-1], strict=True):
                        parts = (length, k, parts)
                    out.put(m, 0, parts)
        out.best_fit(left)
        if best is None or out.sequences() < best.sequences():
            best = out
        if best.sequences() * cfg.capacity < int((counts * np.arange(cfg.capacity + 1)).sum()) + cfg.capacity:
            break  # no plan has fewer
    return best


def pieces(docs: DataFrame, tokenizer: str, cfg: Packing = Packing(), text: str = "text", ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, part, nth) and, if asked for, ids (little-endian unsigned 32-bit): the pieces of
    each row of `docs`. nth counts the pieces of one length in task `part`."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.binary())] if ids else []))
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long" + (", ids binary" if ids else "")
    capacity = cfg.capacity

    def run(batches):
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            enc = encoder(tokenizer, cfg.memo)
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                (raw,) = enc.encode([t.as_py() or ""])
                own = np.append(np.frombuffer(raw, enc.kind), cfg.end_id).astype("<u4")
                first = (len(own) - 1) % capacity + 1
                for i, at in enumerate([0, *range(first, len(own), capacity)]):
                    cut = own[at : at + (capacity if i else first)]
                    data = cut.tobytes()
                    rows.append((d, i, at, len(cut), zlib.crc32(data), part, int(seen[len(cut)]), data)[: len(schema)])
                    seen[len(cut)] += 1
            yield record_batch(dict(zip(schema.names, zip(*rows, strict=True) if rows else [[]] * len(schema), strict=True)), schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ddl)


def pack(docs: DataFrame, tokenizer: str, cfg: Packing = Packing(), text: str = "text", ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) and, if asked for, ids: every row of `docs` as its ids
    and the end id, cut only if longer than the capacity (the first piece may be shorter then), and its place in a sequence.

    Null and empty texts are the end id alone. Each of repeated rows and of rows without a doc_id is placed on its own.
    A text of any length is encoded whole. An empty table gives no rows. Other columns of `docs`, whatever their
    names, play no part. Pieces of one length are alike to the plan: which of them goes where follows the order of the tasks' rows.
    """
    rows = materialize(pieces(docs, tokenizer, cfg, text, ids), "pieces")
    counted = materialize(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(cfg.capacity + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    runs = plan(counts, cfg).runs()
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    firsts = materialize(counted.select("part", "length", before.alias("before")), "piece-firsts")
    drop_tables(counted)
    shared = docs.sparkSession.sparkContext.broadcast((runs, runs[:, 0] << 48 | runs[:, 1]))
    ranked = shared_size_join(rows, firsts, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before")).drop("part", "before")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*kept, "nth", *(["ids"] if ids else []))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())] + ([("ids", pa.binary())] if ids else []))

    def run(batches):
        runs, keys = shared.value
        for b in batches:
            length, nth = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
            own = runs[np.searchsorted(keys, length << 48 | nth, "right") - 1]
            nth = nth - own[:, 1]
            out = {c: b.column(c) for c in kept} | {"sequence_id": own[:, 2] + nth // own[:, 4], "offset": own[:, 3] + nth % own[:, 4] * length}
            yield record_batch(out | ({"ids": b.column("ids")} if ids else {}), schema)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids binary" if ids else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, n_tokens, ends array<long>, ids binary) of pieces packed with their ids: the ids of a sequence end to
    end, and where each piece ends. A group has at most `capacity` tokens."""
    own = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return own.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), F.transform("p", lambda x: x["offset"] + x["length"]).alias("ends"), joined.alias("ids"))


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op13_pack": op13_pack}
ORACLES: dict = {}
