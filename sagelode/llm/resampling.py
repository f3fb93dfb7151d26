"""Target-distribution importance resampling over hashed n-grams, by an integer word dictionary.

Distinct words get numbers, n-grams are tuples of them, each distinct tuple is put back into bytes and hashed once, and
counts and gains are joined back by tuple. Documents are kept in blocks: what is shuffled by word or tuple is a row for each
block that has it, not a row for each occurrence.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_tables, materialize, record_batch, shared_size_join, shuffle_width, table
from .pretokens import pack, unpack


@dataclass(frozen=True)
class Resampling:
    """Runs of 1 to `n` words in `buckets`; of the documents of `least_words` words or more `percent` % are drawn, by
    `seed`. A block holds about `block_bytes` of text."""

    n: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024
    block_bytes: int = 6_000_000


#: Bytes of words as they are, A-Z in lower case, all others blank.
_TO_WORDS = bytes(b if b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if chr(b).isupper() else 32 for b in range(256))


def feature_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text after A-Z is lower-cased."""
    return text.translate(_TO_WORDS).split()


_LONGS = pa.list_(pa.int64())


class _Slots(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def word_rows(docs: DataFrame, side: int, cfg: Resampling, label: str) -> DataFrame:
    """Blocks (block, side, doc_ids, counts, words, stream) of the rows of `docs` (doc_id, text); stream numbers the words
    of all positions by their place in `words`."""
    schema = pa.schema([("block", pa.int64()), ("side", pa.int32()), ("doc_ids", _LONGS), ("counts", _LONGS), ("words", pa.list_(pa.string())), ("stream", pa.binary())])

    def run(batches):
        task, seq, size, ids, counts, slots, stream = TaskContext.get().partitionId(), 0, 0, [], [], _Slots(), array("I")

        def row():
            nonlocal seq, size, ids, counts, slots, stream
            words = pa.array([w.decode("utf-8", "replace") for w in slots], pa.string())
            flat = np.frombuffer(stream, np.uint32) if len(stream) else np.empty(0, np.uint32)
            out = {"block": [(task << 32) + (seq << 1) + side], "side": [side], "doc_ids": [ids], "counts": [counts], "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "stream": [pack(flat)]}
            seq, size, ids, counts, slots, stream = seq + 1, 0, [], [], _Slots(), array("I")
            return record_batch(out, schema)

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                words = feature_words(data)
                stream.extend(map(slots.__getitem__, words))
                ids.append(d)
                counts.append(len(words))
                size += len(data) + 16
                if size >= cfg.block_bytes:
                    yield row()
        if ids:
            yield row()

    rows = docs.mapInArrow(run, "block long, side int, doc_ids array<long>, counts array<long>, words array<string>, stream binary")
    return materialize(rows, label)


def tuple_rows(blocks: DataFrame, numbers: DataFrame, cfg: Resampling) -> DataFrame:
    """Blocks (block, side, doc_ids, words_of, features_of, tuples array<array<long>>, counts, stream): distinct tuples of word
    numbers, how often each occurs, and the tuples of each document by their place. `numbers` has (block, slots array<long>,
    ids array<long>)."""
    n = cfg.n
    schema = pa.schema(
        [("block", pa.int64()), ("side", pa.int32()), ("doc_ids", _LONGS), ("words_of", _LONGS), ("features_of", _LONGS), ("tuples", pa.list_(_LONGS)), ("counts", _LONGS), ("stream", pa.binary())]
    )

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                slots, ids, counts = (np.asarray(b.column(c)[i].values.to_numpy(zero_copy_only=False)) if b.column(c)[i].is_valid else np.empty(0, np.int64) for c in ("slots", "ids", "counts"))
                of = np.empty(len(ids), np.int64)
                of[slots] = ids
                words = of[unpack(b.column("stream")[i].as_py())]
                ends = np.cumsum(counts)
                place = np.arange(len(words)) - np.repeat(ends - counts, counts)  # in its document
                doc = np.repeat(np.arange(len(counts)), counts)
                tuples, widths, where, owner, base = [], [], [], [], 0
                for k in range(1, n + 1):
                    at = np.flatnonzero(place >= k - 1)
                    runs = np.stack([words[at - k + 1 + j] for j in range(k)], axis=1) if len(at) else np.empty((0, k), np.int64)
                    own, back = np.unique(runs[:, 0], return_inverse=True) if k == 1 else np.unique(runs, axis=0, return_inverse=True)
                    tuples.append(own.ravel())
                    widths.append(np.full(len(own), k))
                    where.append(back.ravel() + base)
                    owner.append(doc[at])
                    base += len(own)
                where, owner = np.concatenate(where), np.concatenate(owner)
                where = where[np.argsort(owner, kind="stable")]
                cuts = np.concatenate(([0], np.cumsum(np.concatenate(widths)))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(tuples).astype(np.int64)))
                out = {
                    **{c: b.column(c).slice(i, 1) for c in ("block", "side", "doc_ids")},
                    "words_of": b.column("counts").slice(i, 1),
                    "features_of": [np.bincount(owner, minlength=len(counts))],
                    "tuples": pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed),
                    "counts": [np.bincount(where, minlength=base)],
                    "stream": [pack(where.astype(np.uint32))],
                }
                yield record_batch(out, schema)

    joined = blocks.drop("words").join(numbers, "block", "left")
    rows = joined.mapInArrow(run, "block long, side int, doc_ids array<long>, words_of array<long>, features_of array<long>, tuples array<array<long>>, counts array<long>, stream binary")
    return materialize(rows, "tuple-blocks")


def _by_block(df: DataFrame, value: str, name: str) -> DataFrame:
    """(block, slots, `name`): the rows (block, slot, value) of each block as two lists, of the block's distinct items."""
    own = df.groupBy("block").agg(F.collect_list(F.struct("slot", value)).alias("p"))
    return own.select("block", F.col("p.slot").alias("slots"), F.col(f"p.{value}").alias(name))


def bucket_gains(hashed: DataFrame, cfg: Resampling) -> np.ndarray:
    """The gain of each bucket, from (bucket, raw, target): occurrences of each distinct tuple. `buckets` numbers at most are
    collected."""
    per = hashed.groupBy("bucket").agg(F.sum("raw").cast("double").alias("s"), F.sum("target").cast("double").alias("t")).collect()
    s, t = np.zeros(cfg.buckets), np.zeros(cfg.buckets)
    for r in per:
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + cfg.buckets) / ((s + 1) * (t.sum() + cfg.buckets)))).astype(np.int64)


def draw_score(doc_id: Column, weight: Column, seed: int) -> Column:
    """weight + floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256(`seed:doc_id`); no doc_id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def ranked(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """rank (long) by score, highest first, ties to the smaller doc_id (none first), for the floor(share * rows) first; the others have null. Rows
    are dealt by ranges of that order, each task numbers its own, and the tasks' row counts are added up."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features")]
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    schema = pa.schema([*[(c, pa.int64()) for c in rows.columns], ("part", pa.int64()), ("nth", pa.int64())])

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            columns = {c: b.column(c) for c in schema.names[:-2]}
            yield record_batch(columns | {"part": np.full(b.num_rows, part), "nth": np.arange(n + 1, n + b.num_rows + 1)}, schema)
            n += b.num_rows

    own = materialize(dealt.mapInArrow(run, ", ".join(f"{c} long" for c in schema.names)), "ranks")
    counts = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a number for each task
    before = materialize(counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), "n"), "rank-starts")
    drawn = share[0] * (before.agg(F.sum("n")).first()[0] or 0) // share[1]
    rank = F.col("nth") + F.col("before")
    return shared_size_join(own, before.drop("n"), "part").select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, cfg: Resampling = Resampling(), text: str = "text") -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one for each row of `docs`: its importance under the target's word
    runs against its own corpus's, and its place in the draw, null where it isn't drawn.

    Null and empty texts have no features and weight 0. Texts count whole at any length, repeated rows each on their
    own; rows of one doc_id and one score are ordered by their number of features. A null doc_id is hashed as empty. Empty
    `docs` give no rows; an empty target counts as zero everywhere. Other columns, whatever their names, play no part.
    """
    own = word_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), 0, cfg, "words")
    other = word_rows(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")), 1, cfg, "target-words")
    blocks = own.unionByName(other)

    words = blocks.select("block", F.posexplode("words").alias("slot", "word"))
    dictionary = materialize(words.select("word").distinct().select(F.monotonically_increasing_id().alias("id"), "word"), "dictionary")
    numbers = _by_block(words.join(dictionary, "word").select("block", F.col("slot").cast("long").alias("slot"), "id"), "id", "ids")
    grams = tuple_rows(blocks, numbers, cfg)
    drop_tables(own, other)

    each = grams.select("block", "side", F.posexplode(F.arrays_zip("tuples", "counts")).alias("slot", "g")).select("block", "side", F.col("slot").cast("long").alias("slot"), F.col("g.tuples").alias("tuple"), F.col("g.counts").alias("n"))
    sums = each.groupBy("tuple").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("raw"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("target"))
    spelled = sums.select("tuple", "raw", "target", F.posexplode("tuple").alias("at", "id")).join(dictionary, "id")
    spelled = spelled.groupBy("tuple").agg(F.first("raw").alias("raw"), F.first("target").alias("target"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    bucket = F.crc32(F.array_join(F.col("w.word"), " ").cast("binary")) % cfg.buckets
    hashed = materialize(spelled.select("tuple", bucket.cast("int").alias("bucket"), "raw", "target"), "hashed")
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(hashed, cfg))

    back = each.where("side = 0").select("block", "slot", "tuple").join(hashed.select("tuple", F.col("bucket").cast("long").alias("bucket")), "tuple")
    back = _by_block(back, "bucket", "buckets")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def weigh(batches):
        for b in batches:
            for i in range(b.num_rows):
                lists = {c: b.column(c)[i].values.to_numpy(zero_copy_only=False) if b.column(c)[i].is_valid else np.empty(0, np.int64) for c in ("slots", "buckets", "words_of", "features_of")}
                gain = np.zeros(len(lists["slots"]), np.int64)
                gain[lists["slots"]] = gains.value[lists["buckets"]]
                sums = np.concatenate(([0], np.cumsum(gain[unpack(b.column("stream")[i].as_py())])))
                ends = np.cumsum(lists["features_of"])
                total = sums[ends] - sums[ends - lists["features_of"]]
                yield record_batch({"doc_id": b.column("doc_ids")[i].values, "n_words": lists["words_of"], "n_features": lists["features_of"], "weight": total // np.maximum(lists["features_of"], 1)}, schema)

    weighed = grams.where("side = 0").drop("tuples", "counts").join(back, "block", "left")
    weighed = weighed.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long").withColumn("score", draw_score(F.col("doc_id"), F.col("weight"), cfg.seed))
    weighed = materialize(weighed, "weights")
    drop_tables(dictionary, grams, hashed)
    kept = ["doc_id", "n_features", "weight", "score"]
    short = weighed.where(F.col("n_words") < cfg.least_words).select(*kept, F.lit(None).cast("long").alias("rank"))
    return ranked(weighed.where(F.col("n_words") >= cfg.least_words).select(*kept), (cfg.percent, 100)).unionByName(short)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_resample": op12_resample}
ORACLES = {
    "op12_resample": """
WITH bit AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS v FROM bit),
lowered AS (
  SELECT 0 AS side, doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents
  UNION ALL
  SELECT 1, NULL, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') FROM benchmark),
each AS (SELECT side, row_no, unnest(w) AS word FROM lowered),
per AS (SELECT side, row_no, word, count(*) AS n FROM each GROUP BY ALL),
words AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex(encode(word))) // 2), lambda k: CAST('0x' || substr(hex(encode(word)), 2 * k + 1, 2) AS BIGINT))),
      lambda c, b: xor(c // 256, v[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM per), tab),
sums AS (SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END)::DOUBLE AS t FROM per JOIN words USING (word) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain FROM sums),
weights AS (SELECT row_no, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM per JOIN words USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row_no),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM lowered LEFT JOIN weights USING (row_no) WHERE side = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM placed
"""
}
