"""Language-model scoring: word n-grams of order two in Elias-Fano tries, trained and queried shard by shard."""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, lower_words, materialize, mix64, record_batch, shared_dir, shuffle_width, table
from .elias_fano import Trie
from .pretokens import BY_BLOCK_DDL, ByBlock, pack, per_word, unpack, word_blocks
from .token_files import filesystem

BEGIN, UNKNOWN, FIRST = 0, 1, 2
#: No word holds white space, so this can't be one.
END = "\n"
LOW = -12.0
_WORD = np.dtype([("id", "<u4"), ("c", "<u8")])


@dataclass(frozen=True)
class Model:
    """p(w | v) = (c(v, w) + weight * p(w)) / (c(v) + weight), p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). The first part,
    c(v, w) / (c(v) + weight), is what the tries hold. Contexts of more than `hot` tokens are spread over shards."""

    weight: float = 200.0
    hot: int = 2_000_000
    block_chars: int = 16_000_000


def held_out(doc_id: int | None) -> bool:
    """crc32 of the decimal doc_id, modulo 5, is 1; a null doc_id is for training."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _cutters():
    end = END.encode()
    return (lambda text: [*lower_words(text), end]), (lambda word: [word.decode("utf-8", "replace")])


def _codes(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round((np.log10(p) - LOW) / -LOW * 65534) + 1, 1, 65535).astype(np.uint16)


def _values(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10 ** ((code.astype(np.float64) - 1) / 65534 * -LOW + LOW), 0.0)


class Block:
    """A block's tokens by global id, with counts, and its distinct word pairs by shard."""

    def __init__(self, row: pa.Table, words: pa.Table, n_begin: int):
        slots, _, data = ByBlock.read(words)
        got = np.frombuffer(data, _WORD)
        ids, counts = np.full(len(slots), UNKNOWN, np.int64), np.zeros(len(slots), np.int64)
        ids[slots], counts[slots] = np.where(got["c"] > 0, got["id"].astype(np.int64) + FIRST, UNKNOWN), got["c"].astype(np.int64)
        stream = unpack(row.column("stream")[0].as_py())
        self.ids, self.counts = ids[stream], counts[stream]
        self.doc_ids = row.column("doc_ids")[0].as_py()
        self.lengths = np.array(row.column("counts")[0].as_py(), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.context = np.concatenate(([BEGIN], self.ids[:-1]))
        self.context_count = np.concatenate(([n_begin], self.counts[:-1]))
        self.context[self.starts], self.context_count[self.starts] = BEGIN, n_begin

    def pairs(self, shards: int, hot: int):
        """(shard, context, successor, context's count, occurrences in training documents) of the distinct pairs of known
        words, by shard, context and successor; and each position's place among them (-1: a word is unknown)."""
        known = np.flatnonzero((self.context != UNKNOWN) & (self.ids != UNKNOWN))
        key = self.context[known].astype(U64) << U64(32) | self.ids[known].astype(U64)
        distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
        train = np.repeat([not held_out(d) for d in self.doc_ids], self.lengths)[known]
        n = np.bincount(place[train], minlength=len(distinct))
        v, w, c = (distinct >> U64(32)).astype(np.int64), (distinct & U64(0xFFFFFFFF)).astype(np.int64), self.context_count[known][first]
        with np.errstate(over="ignore"):
            salt = mix64(w.astype(U64)) % (1 + c // hot).astype(U64)
            shard = (mix64(v.astype(U64) * U64(0x9E3779B97F4A7C15) + salt) % U64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        full = np.full(len(self.ids), -1)
        full[known] = at[place]
        return shard[order], v[order], w[order], c[order], n[order], full


def _sent(v, w, c, n) -> bytes:
    """Pairs sorted by context and successor, packed: contexts with their counts and successor numbers, successors as differences."""
    new = np.concatenate(([True], v[1:] != v[:-1]))
    first = np.flatnonzero(new)
    step = np.where(new, w, np.diff(w, prepend=0))
    parts = [pack(x) for x in (np.diff(v[first], prepend=0), np.diff(np.append(first, len(v))), c[first] & 0xFFFFFFFF, c[first] >> 32, step, n)]
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _received(data: bytes):
    parts, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(unpack(data[at + 8 : at + 8 + size]).astype(np.int64))
        at += 8 + size
    dv, size, c_low, c_high, step, n = parts
    first = np.cumsum(size) - size
    total = np.cumsum(step)
    w = total - np.repeat(total[first] - step[first], size)
    return np.repeat(np.cumsum(dv), size), w, np.repeat(c_low + (c_high << 32), size), n


def lm_scores(docs: DataFrame, model: Model = Model(), text: str = "text", root: str | None = None) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of `docs`.

    Tokens are the words [^\\x20\\x09-\\x0D]+ of the whole text with A-Z lower-cased, then one end. Counts come from the
    documents that aren't held out. base_score sums log10 p(w), score log10 p(w | v), with a begin before the first
    word. A null or empty text is one end. Rows of a repeated doc_id are scored, and train, each on its own; a null
    doc_id trains. An empty table gives no rows. A text longer than a block is a block of its own; columns of `docs`
    besides doc_id and text, whatever their names, play no part. The tries stay under `root`, by default in the shared folder.

    A word's counts and number come from its rows in the blocks, one a block; a pair's from its shard, one sorted list
    a block; both answer to the blocks. Nothing grows with the corpus but the number of blocks and shards.
    """
    spark = docs.sparkSession
    shards = shuffle_width(spark)
    root = root or f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    blocks = word_blocks(docs.select("doc_id", F.col(text).alias("text")), _cutters, model.block_chars, "lm_blocks", lambda d: not held_out(d))

    def number_words(batches):
        """Numbers the words of training documents, interleaved over the partitions, and answers id and count."""
        part, n = TaskContext.get().partitionId(), 0
        held, word, run = ByBlock(), None, []
        totals = np.zeros(3, np.int64)  # words, tokens, ends

        def close():
            nonlocal n, run
            c = sum(x for _, _, x in run)
            value = np.array([(n * shards + part if c else 0, c)], _WORD).tobytes()
            if c:
                n += 1
                totals[:] += (1, c, c if word == END else 0)
            out = held.add(np.array([b for b, _, _ in run], np.int64), np.array([s for _, s, _ in run], np.int64), [value] * len(run))
            run = []
            return out

        for b in batches:
            for w, block, slot, x in zip(*(b.column(c).to_pylist() for c in ("word", "block", "slot", "weight")), strict=True):
                if w != word:
                    if run and close():
                        yield held.take()
                    word = w
                run.append((block, slot, x))
        if run:
            close()
        yield held.take()
        yield record_batch({"block": [-1], "slots": [b""], "widths": [b""], "data": [totals.tobytes()]}, held.take().schema)

    words = materialize(per_word(blocks, number_words, BY_BLOCK_DDL), "lm-words")
    # three numbers from each partition
    sums = np.array([np.frombuffer(r.data, np.int64) for r in words.where("block < 0").select("data").collect()]).reshape(-1, 3).sum(axis=0)
    n_words, n_tokens, n_begin = map(int, sums)
    words = words.where("block >= 0")
    streams = blocks.select("block", "doc_ids", "counts", "stream")
    hot, weight = model.hot, model.weight

    pair_schema = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("data", pa.binary())])

    def send_pairs(key, row, own):
        if not row.num_rows:
            return pair_schema.empty_table()
        shard, v, w, c, n, _ = Block(row, own, n_begin).pairs(shards, hot)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])) if len(shard) else np.zeros(1, np.int64)
        out = {"block": [], "shard": [], "data": []}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out["block"].append(key[0].as_py()), out["shard"].append(int(shard[a])), out["data"].append(_sent(v[a:b], w[a:b], c[a:b], n[a:b]))
        return pa.table(out, schema=pair_schema)

    pairs = streams.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(send_pairs, "block long, shard long, data binary")

    def answer(key, rows):
        """Builds the shard's trie from the training pairs, writes it, maps it, and looks all distinct pairs up in one go: the work
        grows with the pairs of the shard, not with its blocks times the trie."""
        lists = [_received(x) for x in rows.column("data").to_pylist()]
        v, w, c, n = (np.concatenate(x) for x in zip(*lists, strict=True))
        cuts = np.cumsum([len(x[0]) for x in lists])[:-1]
        del lists
        distinct, first, place = np.unique(v.astype(U64) << U64(32) | w.astype(U64), return_index=True, return_inverse=True)
        del v, w
        count, c = np.bincount(place, weights=n, minlength=len(distinct)), c[first]
        v, w, seen = (distinct >> U64(32)).astype(np.int64), (distinct & U64(0xFFFFFFFF)).astype(np.int64), count > 0
        data = Trie.build(v[seen], w[seen], _codes(count[seen] / (c[seen] + weight)))
        fs, base = filesystem(root)
        fs.create_dir(base, recursive=True)
        path = f"{base}/shard-{key[0].as_py():06d}-{uuid.uuid4().hex}.trie"
        with fs.open_output_stream(path) as f:
            f.write(data)
        codes = [pack(x) for x in np.split(Trie.open(fs, path).find(v, w)[place], cuts)]
        return pa.table({"block": rows.column("block"), "shard": rows.column("shard"), "data": codes}, schema=pair_schema)

    answers = materialize(pairs.groupBy("shard").applyInArrow(answer, "block long, shard long, data binary"), "lm-answers")

    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    doc_schema = pa.schema(fields)

    def score(key, row, own):
        if not row.num_rows:
            return doc_schema.empty_table()
        shard = own.column("shard")
        block = Block(row, own.filter(pa.compute.is_null(shard)), n_begin)
        *_, place = block.pairs(shards, hot)
        got = own.filter(pa.compute.is_valid(shard)).sort_by("shard")
        codes = np.concatenate([unpack(x) for x in got.column("data").to_pylist()] or [np.empty(0, np.uint32)])
        single = (block.counts + 0.5) / (n_tokens + 0.5 * (n_words + 1))
        joint = np.zeros(len(place))
        joint[place >= 0] = _values(codes[place[place >= 0]])
        context = np.where(block.context == UNKNOWN, 0, block.context_count)
        p = joint + weight / (context + weight) * single
        total = lambda x: np.add.reduceat(x, block.starts)  # noqa: E731  every document has its end
        out = {
            "doc_id": block.doc_ids,
            "held_out": [held_out(d) for d in block.doc_ids],
            "n_tokens": block.lengths,
            "n_known": total((block.counts > 0).astype(np.int64)),
            "train_tokens": np.full(len(block.lengths), n_tokens),
            "base_score": total(np.log10(single)),
            "score": total(np.log10(p)),
        }
        return pa.table({k: pa.array(x, doc_schema.field(k).type) for k, x in out.items()}, schema=doc_schema)

    none = F.lit(None)
    both = words.select("block", none.cast("long").alias("shard"), "slots", "widths", "data").unionByName(
        answers.select("block", "shard", none.cast("binary").alias("slots"), none.cast("binary").alias("widths"), "data")
    )
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return streams.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(score, ddl)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
ORACLES: dict = {}
