"""MinHash near-dedup: b-bit signatures, band candidates, exact confirmation, connected groups."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, cell_hashes, drop_tables, materialize, mix64, odd_multipliers, record_batch, shared_size_join, signed, table, text_slices, whole_row, window_hashes
from .links import linked_components


@dataclass(frozen=True)
class MinHash:
    """`bands` x `rows` minima; `bits` low bits of each of the first 64 * `words` minima are packed.

    A pair at the threshold of 0.75 meets in no band with probability (1 - 0.75 ** rows) ** bands: 2.5e-7 here.
    `block` is how many sets of a band one task holds against others.
    """

    width: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 4
    bits: int = 4
    words: int = 2
    block: int = 1024
    seed: int = 11

    def finer(self) -> MinHash:
        """2,048 other minima of 2 bits: pairs under 0.69 instead of 0.55 are told from those at 0.75."""
        return replace(self, bands=512, rows=4, bits=2, words=32, seed=self.seed + 90)

    def least_estimate(self) -> float:
        """Five standard deviations of the estimate under the threshold: pairs below aren't confirmed."""
        j, c, k = self.percent / 100, 2.0**-self.bits, 64 * self.words
        p = j + (1 - j) * c
        return j - 5 * (p * (1 - p) / k) ** 0.5 / (1 - c)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text of an Arrow column the distinct 64-bit shingle hashes, sorted: runs of `width` words; with fewer words
    the whole sequence as one; none without words. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased."""
    cells = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = cells.flatten()
    some = pc.binary_length(words).to_numpy() > 0
    n = pc.list_value_length(cells).to_numpy().astype(np.int64)
    n = np.bincount(np.repeat(np.arange(len(n)), n)[some], minlength=len(n))
    h = cell_hashes(words)[some]
    runs = window_hashes(h, width)
    ends = np.cumsum(n)
    out = []
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        else:
            out.append(mix64(window_hashes(h[a:b], b - a) + U64(b - a)) if b > a else np.empty(0, U64))
    return out


def _minima(sets: list[np.ndarray], m: MinHash) -> np.ndarray:
    """(len(sets), bands * rows) minima; the sets are not empty."""
    k = m.bands * m.rows
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), k), np.uint32)
    buf = np.empty_like(flat)
    for i, a in enumerate(odd_multipliers(k, m.seed)):
        np.multiply(flat, a, out=buf)
        out[:, i] = np.minimum.reduceat((buf >> U64(32)).astype(np.uint32), starts)
    return out


def _planes(minima: np.ndarray, m: MinHash) -> np.ndarray:
    """The low `bits` bits of 64 * words minima as bit planes of 64-bit words: (rows, bits * words)."""
    low = minima[:, : 64 * m.words]
    planes = [np.packbits((low >> b & 1).astype(np.uint8), axis=1).view(np.int64) for b in range(m.bits)]
    return np.concatenate(planes, axis=1)


def signatures(docs: DataFrame, m: MinHash = MinHash(), text: str = "text") -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, set_key, sig array<long>, bands array<long>) for each row of `docs`.

    text_key is a hash of the text; set_key identifies the set (null for an empty one). Arrow batches are taken in slices of 1.5 MB.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.int64()), ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
    mult = odd_multipliers(m.rows, m.seed + 1)
    salt = odd_multipliers(m.bands, m.seed + 2)

    def piece(ids, keys, sets):
        full = [s for s in sets if len(s)]
        key, sig, band = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        if full:
            minima = _minima(full, m)
            planes = _planes(minima, m)
            with np.errstate(over="ignore"):
                b = signed(mix64((minima.reshape(len(full), m.bands, m.rows).astype(U64) * mult).sum(axis=2, dtype=U64) + salt).ravel()).reshape(len(full), m.bands)
            at = [i for i, s in enumerate(sets) if len(s)]
            for j, i in enumerate(at):
                with np.errstate(over="ignore"):
                    key[i] = int(signed(mix64(np.array([mix64(full[j]).sum(dtype=U64) + U64(len(full[j]))], U64)))[0])
                sig[i], band[i] = planes[j], b[j]
        return record_batch({"doc_id": ids, "text_key": keys, "n_shingles": [len(s) for s in sets], "set_key": key, "sig": sig, "bands": band}, schema)

    def run(batches):
        for b in batches:
            for lo, hi in text_slices(b.column("text")):
                ids, keys, texts = (b.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_key", "text"))
                yield piece(ids, keys, shingle_sets(texts, m.width))

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key long, sig array<long>, bands array<long>")


def estimate(x: str, y: str, m: MinHash) -> Column:
    """Collision-corrected similarity of the signatures in columns x and y, by bit counts."""
    differ = [F.get(x, F.lit(p * m.words + w)).bitwiseXOR(F.get(y, F.lit(p * m.words + w))) for w in range(m.words) for p in range(m.bits)]
    per_word = []
    for w in range(m.words):
        d = differ[w * m.bits]
        for p in range(1, m.bits):
            d = d.bitwiseOR(differ[w * m.bits + p])
        per_word.append(F.bit_count(d))
    match = 1 - sum(per_word[1:], per_word[0]) / (64.0 * m.words)
    c = 2.0**-m.bits
    return (match - c) / (1 - c)


def long_estimate(x: str, y: str, m: MinHash) -> Column:
    """The same for long signatures of two planes, by array functions: `estimate` spells out each word, too much code to compile."""
    differ = F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    either = F.zip_with(F.slice(differ, 1, m.words), F.slice(differ, m.words + 1, m.words), lambda p, q: p.bitwiseOR(q))
    match = 1 - F.aggregate(either, F.lit(0), lambda n, d: n + F.bit_count(d)) / (64.0 * m.words)
    c = 2.0**-m.bits
    return (match - c) / (1 - c)


def _confirm(schema, percent):
    """Pairs with their full sets in, pairs that link out."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sx"), b.column("sy"), strict=True):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield record_batch({"a": b.column("a").filter(pa.array(keep)), "b": b.column("b").filter(pa.array(keep))}, schema)

    return run


def fine_marks(sets: DataFrame, m: MinHash) -> DataFrame:
    """Rows (id, mark) of `sets` (id, data): the packed signature of all bands * rows minima of `m`."""
    schema = pa.schema([("id", pa.int64()), ("mark", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            own = [np.frombuffer(x.as_py(), U64) for x in b.column("data")]
            total = np.cumsum([len(x) for x in own])
            lo = 0
            while lo < len(own):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 200_000, "right")))
                yield record_batch({"id": b.column("id").slice(lo, hi - lo), "mark": list(_planes(_minima(own[lo:hi], m), m))}, schema)
                lo = hi

    return sets.select("id", "data").mapInArrow(run, "id long, mark array<long>")


def grouped(docs: DataFrame, m: MinHash = MinHash(), text: str = "text") -> DataFrame:
    """Rows (doc_id, text_key, n_shingles, set_key, component_id), one for each row of `docs`; component_id is null where
    the set is empty or the doc_id null.

    Equal sets collapse to one node before anything is compared. Nodes that share a band are candidates; their pairs
    go through the b-bit estimate and are confirmed on the full sets."""
    sigs = materialize(signatures(docs, m, text), "signatures")
    some = sigs.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    nodes = some.groupBy(F.col("set_key").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", F.col("sig").alias("mark"), "bands")).alias("r"))
    nodes = materialize(nodes.select("id", "n", F.col("r.doc_id").alias("first_id"), "r.mark", "r.bands"), "nodes")
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.col(text).alias("text")).where("first_id IS NOT NULL")
    seen: list[DataFrame] = []
    width = m.width

    def set_bytes(batches):
        schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("data", pa.binary())])
        for b in batches:
            sets = [s for lo, hi in text_slices(b.column("text")) for s in shingle_sets(b.column("text").slice(lo, hi - lo), width)]
            with np.errstate(over="ignore"):
                keys = [int(signed(mix64(np.array([mix64(s).sum(dtype=U64) + U64(len(s))], U64)))[0]) for s in sets]
            yield record_batch({"id": b.column("id"), "key": keys, "data": [s.tobytes() for s in sets]}, schema)

    linked = _confirm(pa.schema([("a", pa.int64()), ("b", pa.int64())]), m.percent)

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, data) of distinct ids: the full sets, built from the texts again, once for an id."""
        for known in seen:
            ids = ids.join(known.select("id"), "id", "left_anti")
        ids = materialize(ids, "sets-wanted-ids")
        wanted = materialize(shared_size_join(nodes.select("id", "first_id"), ids, "id"), "sets-wanted")
        found = shared_size_join(texts, wanted, "first_id").select("id", "text").mapInArrow(set_bytes, "id long, key long, data binary")
        seen.append(materialize(found.where("id = key").select("id", "data").dropDuplicates(["id"]), "sets"))
        drop_tables(ids, wanted)
        return reduce(DataFrame.unionByName, seen)

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs that link by their full sets."""
        sets = sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("data").alias("sx")), "a").join(sets.select(F.col("id").alias("b"), F.col("data").alias("sy")), "b")
        return both.mapInArrow(linked, "a long, b long")

    fine = m.finer()

    def marked(ids: DataFrame) -> DataFrame:
        return fine_marks(shared_size_join(sets_of(ids), ids, "id"), fine)

    members = nodes.select(F.explode("bands").alias("bucket"), "id")
    groups = linked_components(members, nodes.select("id", "mark"), lambda x, y: estimate(x, y, m) >= m.least_estimate(), confirm, "set", m.block, finer=(marked, lambda x, y: long_estimate(x, y, fine) >= fine.least_estimate()))
    named = shared_size_join(nodes.select("id", "n", "first_id"), groups.withColumnRenamed("node", "id"), "id", "left").where("n > 1 OR component IS NOT NULL")
    named = materialize(named.select("id", F.coalesce("component", "id").alias("component"), "first_id"), "set-named")
    least = materialize(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "set-least")
    named = materialize(shared_size_join(named, least, "component").select(F.col("id").alias("set_key"), "component_id"), "set-components")
    out = shared_size_join(sigs.drop("sig", "bands"), named, "set_key", "left")
    drop_tables(nodes, groups, least, *seen)
    alone = F.when(F.col("set_key").isNotNull(), F.col("doc_id"))
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", alone)))


def near_duplicates(docs: DataFrame, m: MinHash = MinHash(), text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of `docs`; component_id is the least doc_id of the
    connected group.

    Null or empty texts have an empty set and are linked with nothing. Rows with a null doc_id are never linked and
    kept, with a null component_id. Repeated rows share a component; of a repeated doc_id each row counts with its own
    set. A text of any length counts whole. An empty table gives no rows. Other columns of `docs`, whatever their names, play no part.
    """
    out = grouped(docs, m, text).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each connected group stays: that of the least doc_id, and of its rows that of the least hash of the
    text; rows that repeat doc_id and text count as one. Rows without a doc_id or without a word stay."""
    rows = materialize(grouped(docs).where("component_id IS NOT NULL").select("doc_id", "text_key", "component_id"), "stage-rows")
    firsts = rows.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_key")).alias("first")).where("n > 1")
    firsts = materialize(firsts.drop("n"), "stage-firsts")
    known = shared_size_join(rows, firsts, "component_id").select("doc_id", "text_key", (F.struct("doc_id", "text_key") == F.col("first")).alias("stays")).distinct()
    known = materialize(known, "stage-known")
    drop_tables(rows, firsts)
    keyed = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    keyed = shared_size_join(keyed, known, ["doc_id", "text_key"], "left")
    once = keyed.where("stays").dropDuplicates(["doc_id", "text_key"])
    return keyed.where("stays IS NULL").unionByName(once).select("row.*")


QUERIES = {"op6_minhash_dedup": op6_minhash_dedup}
ORACLES = {}
