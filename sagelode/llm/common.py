"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, in local mode only, a temporary one where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sagelode-"))
            given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get()
    return found.rstrip("/")


#: Bytes of an Arrow batch while tables are written: a task holds a few times as much, in the executor and in Python.
BATCH_BYTES = "8m"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` once as Parquet in the shared folder and reads it back: this cuts the lineage, and a lost
    executor takes nothing with it. Unlike checkpoint() the last stage runs once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, BATCH_BYTES)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Removes what `materialize` wrote for tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(df: DataFrame) -> Column:
    """All columns of `df` as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lower_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased, as UTF-8; null gives none.
    bytes.split() and bytes.lower() follow exactly these ASCII rules."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class HashMemo(dict):
    """word -> 64-bit hash of `key(word)`, in two generations of `limit` / 2 words: when the young one is full it takes the
    place of the old one, so memory is bounded and frequent words stay."""

    def __init__(self, key=None, seed: int = 0, limit: int = 600_000):
        super().__init__()
        self.key, self.seed, self.limit, self.old = key, seed, limit // 2, {}

    def __missing__(self, word):
        h = self.old.get(word)
        if h is None:
            h = self.value(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = h
        return h

    def value(self, word) -> int:
        return xxhash.xxh64_intdigest(self.key(word) if self.key else word, self.seed)

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    """Bit mixer over uint64 (finaliser of a multiply-xorshift hash)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(33))


_BYTES = np.random.default_rng(23).integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([U64(1)], np.full(n, base, U64))), dtype=U64)


_POWERS = [np.empty(0, U64), np.empty(0, U64)]


def cell_hashes(cells: pa.Array, size: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the strings of an Arrow column without nulls, from one running sum over their bytes; about `size`
    bytes are taken at a time, which bounds the memory."""
    if not len(cells):
        return np.empty(0, U64)
    cells = cells.cast(pa.binary()) if not pa.types.is_string(cells.type) else cells
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1].astype(np.int64)
    data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)
    out, begin = np.empty(len(cells), U64), 0
    while begin < len(cells):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + size, "right")) - 1)
        own, part = ends[begin : end + 1] - ends[begin], data[ends[begin] : ends[end]]
        with np.errstate(over="ignore"):
            if len(_POWERS[0]) <= len(part):
                n = max(size, len(part))
                _POWERS[:] = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
            sums = np.concatenate(([U64(0)], np.cumsum(_BYTES[part] * _POWERS[0][: len(part)], dtype=U64)))
            out[begin:end] = mix64((sums[own[1:]] - sums[own[:-1]]) * _POWERS[1][own[:-1]] + np.diff(own).astype(U64) * U64(0xD1B54A32D192ED03))
        begin = end
    return out


def text_slices(texts: pa.Array, size: int = 1_500_000):
    """(begin, end) of slices of about `size` bytes of an Arrow column of texts."""
    total = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + size, "right")))
        yield begin, end
        begin = end


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes (fewer words: none)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, U64)
        for j, m in enumerate(odd_multipliers(width, 5)):
            h += words[j : j + n] * m
    return mix64(h)


def signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a, U64).view(np.int64)


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A side of at most so many rows, and so many numbers in their lists, is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS, BROADCAST_NUMBERS = 300_000, 2_000_000


def shared_size_join(big: DataFrame, side: DataFrame, on: str | list[str], how: str = "inner", listed: str | None = None, each: int = 1) -> DataFrame:
    """Joins `side`, a materialised table of small rows, to `big`: by broadcast if it is within the bounds, else by
    Spark's shuffled join. `listed` names a column of lists, of `each` numbers an item, which counts besides the rows."""
    numbers = F.sum(F.size(listed)) * each if listed else F.lit(0)
    found = side.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(numbers, F.lit(0)).alias("numbers")).first()
    small = found.rows <= BROADCAST_ROWS and found.numbers <= BROADCAST_NUMBERS
    return big.join(F.broadcast(side) if small else side, on, how)


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Rows (node, component) for the undirected `edges` (a long, b long); component is the least node reachable.

    Alternates large-star and small-star steps until nothing changes: each is a grouping and a join on the node, so
    a hub of any degree is pre-aggregated or split by the skew join, and nothing is gathered on the driver. The
    rounds grow with the logarithm of the longest chain. Null ends and self links give no edge; no edges, no rows.
    """
    cur = materialize(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label
    )
    seen = None
    while True:
        state = cur.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state.n == 0 or (seen is not None and (state.n, state.s) == seen):
            break
        seen = (state.n, state.s)
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        cur, old = materialize(small.distinct(), label), cur
        drop_tables(old)
    out = cur.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
    out = materialize(out, f"{label}-components")
    drop_tables(cur)
    return out
