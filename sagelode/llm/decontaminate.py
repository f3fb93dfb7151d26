"""Benchmark decontamination: spaced-seed hashes joined to the benchmark's, overlaps verified around each hit.

Seeds of documents that no seed of the benchmark can equal are dropped in the scan by a bit table of the benchmark's
seeds. The others are joined by their hash, which gives pairs of document and item; the texts of the pairs are then
aligned along the diagonals of their common seeds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, drop_tables, materialize, mix64, odd_multipliers, record_batch, shared_size_join, signed, table, text_slices, whole_row
from .line_dedup import text_hashes


@dataclass(frozen=True)
class Seeds:
    """Token positions under a 1 of a mask are hashed, those under a 0 may differ. Two texts overlap when `percent` % of
    some min(`window`, tokens of the item) aligned tokens agree; items of fewer tokens than the longest mask must occur
    as they are. The masks hit every such overlap: each way to place 5 differences in 20 tokens, or n / 4 in n = 11 to
    19, leaves all positions of some mask alone. The bit table has `sparse` bits a seed, `most_bits` bits at most:
    beyond, more seeds are joined than need be. `chunk` is how many items one row of a document is aligned with.
    """

    masks: tuple[str, ...] = ("111011", "11001011", "11111", "10100000111")
    window: int = 20
    percent: int = 75
    sparse: int = 64
    most_bits: int = 1 << 27
    chunk: int = 100

    def span(self) -> int:
        return max(map(len, self.masks))


def texts_tokens(texts: pa.Array):
    """For each text of an Arrow column the hashes of its words, in lower case without signs; words of signs only are left
    out, a null has none."""
    for lo, hi in text_slices(texts):
        h, n = text_hashes(texts.slice(lo, hi - lo))
        ends = np.cumsum(n)
        yield from (h[a:b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True))


def masked_hashes(tokens: np.ndarray, mask: str, salt: int) -> np.ndarray:
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, U64)
    mult = odd_multipliers(len(mask), 97 + salt)
    with np.errstate(over="ignore"):
        h = np.zeros(n, U64)
        for j, c in enumerate(mask):
            if c == "1":
                h += tokens[j : j + n] * mult[j]
    return mix64(h)


def seed_hashes(tokens: np.ndarray, seeds: Seeds) -> list[np.ndarray]:
    """The hashes at each position, for each mask."""
    return [masked_hashes(tokens, m, k) for k, m in enumerate(seeds.masks)]


def whole_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n tokens."""
    return masked_hashes(tokens, "1" * n, 1000 + n)


def agreement(tokens: np.ndarray, hashes: list[np.ndarray], item: np.ndarray, seeds: Seeds, step: int = 1 << 20) -> int:
    """The most tokens that agree in an aligned window, 0 if they are too few; `hashes` are those of `tokens`. Hits are taken in stretches of `step` at
    most, and only their diagonals are kept, so that texts of one repeated word need the memory of their length."""
    n, m = len(tokens), len(item)
    if not n or not m:
        return 0
    if m < seeds.span():
        return m if n >= m and (whole_hashes(tokens, m) == whole_hashes(item, m)).any() else 0
    marks = np.zeros(n + m, bool)  # of diagonal - m
    for own, theirs in zip(hashes, seed_hashes(item, seeds), strict=True):
        order = np.argsort(theirs, kind="stable")
        theirs = theirs[order]
        lo, hi = np.searchsorted(theirs, own, "left"), np.searchsorted(theirs, own, "right")
        at = np.flatnonzero(hi > lo)
        lo, count = lo[at], (hi - lo)[at]
        total = np.cumsum(count)
        begin = 0
        while begin < len(at):
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + step, "right")))
            c = count[begin:end]
            hit = order[np.repeat(lo[begin:end] - np.cumsum(c) + c, c) + np.arange(c.sum())]
            marks[np.repeat(at[begin:end], c) - hit + m] = True
            begin = end
    w = min(seeds.window, m)
    best = 0
    for diagonal in np.flatnonzero(marks) - m:
        a, b = max(diagonal, 0), min(diagonal + m, n)
        same = np.concatenate((np.zeros(w, np.int64), np.cumsum(tokens[a:b] == item[a - diagonal : b - diagonal])))
        same = np.concatenate((same, np.full(w - 1, same[-1])))  # windows may hang over the ends: nothing agrees there
        best = max(best, int((same[w:] - same[:-w]).max()))
        if best == w:
            break
    return best if 100 * best >= seeds.percent * w else 0


def _seed_table(items: DataFrame, seeds: Seeds) -> tuple[DataFrame, np.ndarray, list[int]]:
    """The benchmark's seeds as rows (hash, item_key, short), their bit table, and the lengths of short items."""
    schema = pa.schema([("hash", pa.int64()), ("item_key", pa.int64()), ("short", pa.int32())])

    def run(batches):
        for b in batches:
            for k, tokens in zip(b.column("item_key").to_pylist(), texts_tokens(b.column("text")), strict=True):
                short = len(tokens) if len(tokens) < seeds.span() else 0
                h = np.unique(np.concatenate(seed_hashes(tokens, seeds)) if not short else whole_hashes(tokens, short))
                yield record_batch({"hash": signed(h), "item_key": np.full(len(h), k, np.int64), "short": np.full(len(h), short, np.int32)}, schema)

    found = materialize(items.select("item_key", "text").mapInArrow(run, "hash long, item_key long, short int"), "item-seeds")
    bits = 1 << 16
    n = found.count()
    while bits < min(seeds.sparse * n, seeds.most_bits):
        bits *= 2
    place = F.explode(F.array(*[F.pmod(F.shiftrightunsigned("hash", k), F.lit(bits)) for k in _PROBES])).alias("place")
    words = found.select(place).groupBy((F.col("place") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 AS int))")).alias("value"))
    table_ = np.zeros(bits // 64, np.int64)
    got = words.toArrow()  # one row for 64 bits of the table
    table_[got.column("word").to_numpy()] = got.column("value").to_numpy()
    short = [r.short for r in found.where("short > 0").select("short").distinct().collect()]  # lengths below the longest mask's
    return found, table_, sorted(short)


def _row_key(text: str) -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), text).alias("row_key")


#: Shifts of a hash that give its places in the bit table.
_PROBES = (0, 32)


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), text: str = "text") -> DataFrame:
    """Rows (doc_id, row_key, item_id, n_same): each document row that shares a verified overlap with an item, once for
    each item. row_key hashes doc_id and text, so that rows of a repeated doc_id are told apart. Null and empty texts
    and items match nothing."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("item_id", "text").alias("item_key"), F.col("text").alias("item")).where("item <> ''")
    items = materialize(items.dropDuplicates(["item_key"]), "items")
    known, bit_table, short = _seed_table(items.select("item_key", F.col("item").alias("text")), seeds)
    shipped = docs.sparkSession.sparkContext.broadcast(bit_table.view(np.uint8))
    n_bits = 64 * len(bit_table)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key(text), F.col(text).alias("text"))
    schema = pa.schema([("row_key", pa.int64()), ("hash", pa.int64())])

    def scan(batches):
        table_ = np.unpackbits(shipped.value, bitorder="little").view(bool)
        for b in batches:
            rows, hashes = [np.empty(0, np.int64)], [np.empty(0, U64)]
            for r, tokens in zip(b.column("row_key").to_pylist(), texts_tokens(b.column("text")), strict=True):
                h = np.concatenate(seed_hashes(tokens, seeds) + [whole_hashes(tokens, n) for n in short])
                for k in _PROBES:
                    h = h[table_[(h >> U64(k)) & U64(n_bits - 1)]]
                if len(h):
                    h = np.unique(h)
                    hashes.append(h), rows.append(np.full(len(h), r, np.int64))
            yield record_batch({"row_key": np.concatenate(rows), "hash": signed(np.concatenate(hashes))}, schema)

    hits = base.select("row_key", "text").mapInArrow(scan, "row_key long, hash long")
    pairs = materialize(shared_size_join(hits, known.drop("short"), "hash").select("row_key", "item_key").distinct(), "pairs")
    chunk = F.ceil(F.row_number().over(Window.partitionBy("row_key").orderBy("item_key")) / F.lit(seeds.chunk))
    listed = shared_size_join(pairs.withColumn("chunk", chunk), items, "item_key").groupBy("row_key", "chunk").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    listed = materialize(listed.drop("chunk"), "pair-items")
    drop_tables(items, known, pairs)
    out_schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("item_id", pa.int64()), ("n_same", pa.int64())])

    def align(batches):
        for b in batches:
            out = {c: [] for c in out_schema.names}
            for d, r, tokens, own in zip(b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), texts_tokens(b.column("text")), b.column("items"), strict=True):
                hashes = seed_hashes(tokens, seeds)
                for item_id, item in zip(own.values.field("item_id").to_pylist(), texts_tokens(own.values.field("item")), strict=True):
                    n = agreement(tokens, hashes, item, seeds)
                    if n:
                        for c, v in zip(out, (d, r, item_id, n), strict=True):
                            out[c].append(v)
            yield record_batch(out, out_schema)

    return shared_size_join(base, listed, "row_key").mapInArrow(align, "doc_id long, row_key long, item_id long, n_same long")


def contamination(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds(), text: str = "text") -> DataFrame:
    """Rows (doc_id, contaminated, n_items, item_ids, n_same), one for each distinct (doc_id, text) of `docs`.

    item_ids are the items found, ascending; n_same is the most agreeing tokens in one window. Null or empty texts are
    clean; so is everything against an empty benchmark; no documents give no rows. Items without an item_id count but
    aren't listed. A text of any length counts whole. Rows that repeat doc_id and text give one row; columns of `docs`
    besides doc_id and text, whatever their names, play no part.
    """
    hits = materialize(benchmark_overlaps(docs, benchmark, seeds, text), "overlaps")
    hits = hits.groupBy("row_key").agg(F.countDistinct(F.struct("item_id")).alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("n_same").alias("n_same"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key(text)).distinct()
    out = keyed.join(hits, "row_key", "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("n_same", F.lit(0)).alias("n_same"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` without a verified overlap with the benchmark, unchanged; repeated rows share their fate."""
    hits = materialize(benchmark_overlaps(docs, table(spark, sf_dir, "benchmark")).select("row_key").distinct(), "contaminated")
    keyed = docs.select(whole_row(docs).alias("row"), _row_key("text"))
    return shared_size_join(keyed, hits, "row_key", "left_anti").select("row.*")


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES: dict = {}
