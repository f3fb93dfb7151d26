"""Line dedup: join keys of least weighted word hashes, SimHash, edit similarity, one occurrence per connected group.

SimHash alone can't carry the candidate search: similar lines lie a median of 7 to 14 of 64 bits apart, and pigeonhole
blocks for 14 bits would have 4 bits each. So the blocks joined on hold least word hashes, and the SimHash of a line is a
check on the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, cell_hashes, drop_tables, materialize, mix64, odd_multipliers, record_batch, shared_size_join, signed, table, text_slices, whole_row
from .edits import within
from .links import linked_components

#: byte -> eight byte lanes, lane j holding bit j: sums of up to 255 features stay inside the lanes.
_LANES = (((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & U64(1)) << (U64(8) * np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


@dataclass(frozen=True)
class LineDedup:
    """Lines link when the edit similarity of their normalised texts, 1 - edits / longer length, reaches `similarity`
    and their 64-bit SimHashes (over pairs of adjacent words) differ in at most `distance` bits, a bound so wide that
    it only drops unrelated pairs. Candidates share one of `bands` join keys. A key is made of `minima` words, each
    the least of the line by a hash of its own, drawn by weight: a word's weight is the square of its inverse line
    frequency, counted over all lines of all documents in `buckets` buckets of word hashes.
    Lines of fewer than `min_words` normalised words link to equal ones only.
    """

    distance: int = 24
    bands: int = 12
    minima: int = 3
    similarity: float = 0.85
    min_words: int = 3
    buckets: int = 2**20


def normal_word(word: str) -> str:
    """Lower case, digits as 0, other signs dropped."""
    core = word.lower().rstrip(".,")
    if core.isalpha():
        return core
    return "".join("0" if c.isdigit() else c for c in word.lower() if c.isalnum())


def normal_line(line: str) -> str:
    return " ".join(filter(None, map(normal_word, line.split())))


def normal_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of the normalised words of an Arrow column; the low 6 bits are their characters, 63 for as many and more.
    Each distinct word is normalised once, and only those that aren't letters up to the last signs by Python."""
    coded = words.dictionary_encode()
    cells = coded.dictionary
    core = pc.utf8_rtrim(pc.utf8_lower(cells), ".,")
    other = pc.invert(pc.and_(pc.utf8_is_alpha(core), pc.invert(pc.match_substring_regex(cells, "[İΣ]"))))
    if pc.any(other).as_py():
        core = pc.replace_with_mask(core, other, pa.array(list(map(normal_word, cells.filter(other).to_pylist())), core.type))
    h = cell_hashes(core) & ~U64(63) | np.minimum(pc.utf8_length(core).to_numpy(), 63).astype(U64)
    return h[coded.indices.to_numpy()]


def text_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the normalised words, end to end; words of each text): words of signs only are left out, a null has none."""
    cells = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    h, n = normal_hashes(cells.flatten()), pc.list_value_length(cells).to_numpy().astype(np.int64)
    real = (h & U64(63)) > 0
    return h[real], np.bincount(np.repeat(np.arange(len(n)), n)[real], minlength=len(n))


def simhash(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each line over its pairs of adjacent words; `words` are the lines' word hashes, end to end, and
    a line of one word has no pair and gives 0. Single words would let the frequent ones decide the bits of long lines."""
    line = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    with np.errstate(over="ignore"):
        feats = mix64(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:])[line[:-1] == line[1:]]
    some = lengths > 1
    n = lengths[some] - 1
    out = np.zeros(len(lengths), U64)
    if not len(n):
        return out
    begin = np.cumsum(n) - n
    pieces = -(-n // 255)  # sums of up to 255 features
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    eight = feats.view(np.uint8).reshape(-1, 8)
    lanes = np.stack([np.add.reduceat(_LANES[eight[:, b]], cuts) for b in range(8)], axis=1)
    ones = lanes.view(np.uint8).reshape(len(cuts), 64)
    if len(cuts) > len(n):
        ones = np.add.reduceat(ones.astype(np.int64), first, axis=0)
    out[some] = np.packbits(2 * ones.astype(np.int64) > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


#: Counts that travel in one row.
_PART = 1024


def word_counts(docs: DataFrame, p: LineDedup) -> DataFrame:
    """Rows (part, n binary): of every line of `docs` (text) the distinct normalised words, counted by bucket of their hash, as
    64-bit numbers, `_PART` buckets a row; and in a row of its own, of part -1, the number of lines. A task holds one array of counts."""
    schema = pa.schema([("part", pa.int32()), ("n", pa.binary())])

    def run(batches):
        total, lines = np.zeros(p.buckets, np.uint32), 0
        for b in batches:
            for lo, hi in text_slices(b.column("text")):
                h, lengths = text_hashes(pc.split_pattern(pc.fill_null(b.column("text").slice(lo, hi - lo), ""), "\n").flatten())
                lines += int((lengths > 0).sum())
                line = np.repeat(np.arange(len(lengths)).astype(U64), lengths)
                with np.errstate(over="ignore"):
                    once = ~pd.Series(mix64(h + line * U64(0xD1B54A32D192ED03))).duplicated().to_numpy()
                total += np.bincount(word_buckets(h[once], p), minlength=p.buckets).astype(np.uint32)
        parts = [(k // _PART, own.tobytes()) for k in range(0, p.buckets, _PART) if (own := total[k : k + _PART]).any()]
        parts.append((-1, np.array([lines], np.uint32).tobytes()))
        yield record_batch({"part": [k for k, _ in parts], "n": [n for _, n in parts]}, schema)

    def added(own: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(n.as_buffer(), np.uint32) for n in own.column("n")], axis=0, dtype=np.int64)
        return pa.table({"part": own.column("part")[:1], "n": pa.array([total.tobytes()], pa.binary())}, schema=schema)

    return docs.select("text").mapInArrow(run, "part int, n binary").groupBy("part").applyInArrow(added, "part int, n binary")


def word_buckets(h: np.ndarray, p: LineDedup) -> np.ndarray:
    return (mix64(h) % U64(p.buckets)).astype(np.int64)


def word_scales(docs: DataFrame, p: LineDedup) -> np.ndarray:
    """1 / weight of the words of each bucket, by the lines of all documents that have one of them. The weights decide which lines
    are compared, not which are alike. The table has `p.buckets` numbers however large the corpus is."""
    counts, lines, held = word_counts(docs, p).toArrow(), 0, np.ones(p.buckets, np.int64)
    for part, n in zip(counts.column("part").to_pylist(), counts.column("n"), strict=True):
        n = np.frombuffer(n.as_buffer(), np.int64)
        if part < 0:
            lines = int(n[0])
        else:
            held[part * _PART : part * _PART + len(n)] = np.maximum(n, 1)
    return (1 / np.log((lines + 2) / np.minimum(held, max(lines, 1))) ** 2).astype(np.float32)


def band_keys(words: np.ndarray, lengths: np.ndarray, scales: np.ndarray, p: LineDedup) -> np.ndarray:
    """The `p.bands` join keys of each line; `words` are the lines' word hashes, end to end, one at least for each line.
    The least of -log(u) / weight falls on each word with a chance that is its share of the weight."""
    if not len(lengths):
        return np.empty((0, p.bands), U64)
    place, distinct = pd.factorize(words)
    inverse = scales[word_buckets(distinct, p)]
    starts = np.cumsum(lengths) - lengths
    mult = odd_multipliers(p.bands * p.minima, 41)
    out = np.empty((len(lengths), p.bands), U64)
    with np.errstate(over="ignore"):
        for band in range(p.bands):
            h = np.full(len(lengths), band, U64)
            for m in mult[band * p.minima : (band + 1) * p.minima]:
                u = (((distinct * m) >> U64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)
                least = np.minimum.reduceat((-np.log(u) * inverse)[place], starts)
                h = mix64(h * U64(0x9E3779B97F4A7C15) + least.view(np.uint32))
            out[:, band] = h
    return out


def line_table(docs: DataFrame, p: LineDedup) -> DataFrame:
    """Rows (key, sim, size, bands, row_key, doc_id, line_no) for each line of one word or more; key is a 64-bit hash of the
    normalised words, size the characters of the normalised line (null where a word has 63 or more), row_key a hash of doc_id and text. Lines of fewer than `p.min_words` words have no bands."""
    scales = word_scales(docs, p)
    schema = pa.schema([("key", pa.int64()), ("sim", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64())), ("row_key", pa.int64()), ("doc_id", pa.int64()), ("line_no", pa.int64())])

    def piece(row_keys, doc_ids, texts):
        lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        n = pc.list_value_length(lines).to_numpy().astype(np.int64)
        h, lengths = text_hashes(lines.flatten())
        keep = lengths > 0
        lengths = lengths[keep]
        starts = np.cumsum(lengths) - lengths
        if not len(lengths):
            return
        place = (np.arange(len(h)) - np.repeat(starts, lengths)).astype(U64)
        with np.errstate(over="ignore"):
            key = mix64(np.add.reduceat(mix64(h + place * U64(0xD1B54A32D192ED03)), starts) + lengths.astype(U64))
        chars = (h & U64(63)).astype(np.int64)
        size = pa.array(np.add.reduceat(chars, starts) + lengths - 1, mask=np.maximum.reduceat(chars, starts) == 63)
        fuzzy = lengths >= p.min_words
        keys = band_keys(h[np.repeat(fuzzy, lengths)], lengths[fuzzy], scales, p)
        ends = np.concatenate(([0], np.cumsum(fuzzy * p.bands)))
        bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(keys).ravel()))
        row, no = np.repeat(np.arange(len(n)), n)[keep], (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))[keep]
        at = pa.array(row)
        yield record_batch({"key": signed(key), "sim": signed(simhash(h, lengths)), "size": size, "bands": bands, "row_key": row_keys.take(at), "doc_id": doc_ids.take(at), "line_no": no}, schema)

    def run(batches):
        for b in batches:
            for lo, hi in text_slices(b.column("text")):
                yield from piece(*(b.column(c).slice(lo, hi - lo) for c in ("row_key", "doc_id", "text")))

    return docs.mapInArrow(run, "key long, sim long, size long, bands array<long>, row_key long, doc_id long, line_no long")


def similar(xs: list[str], ys: list[str], similarity: float) -> np.ndarray:
    """Whether 1 - edits / longer length reaches `similarity`, for each pair."""
    longer = np.array([max(len(x), len(y)) for x, y in zip(xs, ys, strict=True)], np.int64)
    return within(xs, ys, ((1 - similarity) * longer).astype(np.int64))


def duplicate_lines(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """Rows (row_key, lines array<long>): the line numbers (from 0) to remove from each row of `docs` that loses any.
    `docs` has row_key, doc_id and text. Of each connected group of lines the first stays, by doc_id and line number."""
    lines = materialize(line_table(docs, p), "lines")
    last = F.lit(2**63 - 1)
    first = F.min(F.struct(F.coalesce("doc_id", last).alias("d"), "line_no", "row_key")).alias("first")
    nodes = lines.groupBy(F.col("key").alias("id")).agg(F.count(F.lit(1)).alias("n"), first, F.first(F.struct("sim", "size")).alias("mark"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "line-nodes")
    seen: list[DataFrame] = []

    def texts(batches):
        schema = pa.schema([("id", pa.int64()), ("line", pa.string())])
        for b in batches:
            ids, data = [], []
            for t, w in zip(b.column("text"), b.column("w"), strict=True):
                own = (t.as_py() or "").split("\n")
                for x in w.as_py():
                    ids.append(x["id"])
                    data.append(normal_line(own[x["line_no"]]))
            yield record_batch({"id": ids, "line": data}, schema)

    def near(x: str, y: str) -> Column:
        """SimHashes are near, and the lengths don't differ by more edits than are allowed."""
        xs, ys = F.col(f"{x}.size"), F.col(f"{y}.size")
        lengths = F.abs(xs - ys) <= (1 - p.similarity) * F.greatest(xs, ys)
        return (F.bit_count(F.col(f"{x}.sim").bitwiseXOR(F.col(f"{y}.sim"))) <= p.distance) & F.coalesce(lengths, F.lit(True))

    def keep_similar(batches):
        for t in batches:
            keep = pa.array(similar(t.column("x").to_pylist(), t.column("y").to_pylist(), p.similarity))
            yield record_batch({c: t.column(c).filter(keep) for c in ("a", "b")}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    def confirm(pairs: DataFrame) -> DataFrame:
        """The pairs whose normalised lines, cut out of the texts for this, are similar."""
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        for known in seen:
            wanted = wanted.join(known.select("id"), "id", "left_anti")
        wanted = materialize(wanted, "line-wanted-ids")
        rows = shared_size_join(nodes.select("id", "first"), wanted, "id").groupBy("first.row_key").agg(F.collect_list(F.struct("first.line_no", "id")).alias("w"))  # a row's own lines at most
        drop_ids, wanted = wanted, materialize(rows, "line-wanted")
        found = shared_size_join(docs.select("row_key", "text"), wanted, "row_key", listed="w", each=2).mapInArrow(texts, "id long, line string")
        seen.append(materialize(found.dropDuplicates(["id"]), "line-texts"))
        drop_tables(drop_ids, wanted)
        text = reduce(DataFrame.unionByName, seen)
        both = pairs.join(text.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(text.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
        return both.mapInArrow(keep_similar, "a long, b long")

    groups = linked_components(nodes.select(F.explode("bands").alias("bucket"), "id"), nodes.select("id", "mark"), near, confirm, "line", rounds=(4,))
    named = shared_size_join(nodes.drop("bands", "mark"), groups.withColumnRenamed("node", "id"), "id", "left").where("n > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "id"))
    firsts = materialize(named.groupBy("component").agg(F.min("first").alias("f")), "line-firsts")
    named = materialize(shared_size_join(named.select("id", "component"), firsts, "component").select(F.col("id").alias("key"), "f"), "line-named")
    gone = shared_size_join(lines.drop("bands"), named, "key").where("NOT (row_key = f.row_key AND line_no = f.line_no)")
    out = materialize(gone.groupBy("row_key").agg(F.collect_set("line_no").alias("lines")), "line-gone")
    drop_tables(lines, nodes, groups, firsts, named, *seen)
    return out


def line_dedup(docs: DataFrame, p: LineDedup = LineDedup(), text: str = "text") -> DataFrame:
    """`docs` with its text without the removed lines, and n_lines and n_removed.

    Of each connected group of fuzzy lines the occurrence of the least (doc_id, line number) stays. Lines
    without a letter or digit always stay; those of fewer than `min_words` words go where an equal one came first. A null text stays null, with 0 lines; an empty one has one
    blank line. Rows with a null doc_id come last in the order. Rows that repeat doc_id and text count as one document
    and keep the same lines; an empty table gives no rows; other columns of any name pass through, but for n_lines and
    n_removed, which are replaced. A line of any length counts whole.
    """
    keyed = docs.select(whole_row(docs).alias("_row"), F.xxhash64("doc_id", text).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    gone = duplicate_lines(keyed.select("row_key", "doc_id", "text"), p)
    out = shared_size_join(keyed, gone, "row_key", "left", listed="lines")
    parts = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(parts).cast("long") - 1), "lines")  # in time with the lines, however many go
    left = F.array_join(F.transform(stay, lambda i: F.get(parts, i.cast("int"))), "\n")
    kept = F.when(F.col("lines").isNull(), F.col("text")).otherwise(left)
    n_lines, n_removed = F.coalesce(F.size(parts), F.lit(0)).cast("long"), F.coalesce(F.size("lines"), F.lit(0)).cast("long")
    out = out.select("_row", F.struct(kept.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed")).alias("_new"))
    names = ["`" + c.replace("`", "``") + "`" for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    return out.select(*[F.col(f"_row.{c}") for c in names], F.col("_new.text").alias(text), "_new.n_lines", "_new.n_removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated lines. A document of which nothing but blank lines is left goes: all its
    lines are in other documents. n_chars follows the text."""
    out = line_dedup(docs).where("n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*["`" + c.replace("`", "``") + "`" for c in docs.columns])


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES: dict = {}
