"""Pre-tokens of texts in blocks: distinct words once, positions as packed numbers."""

from __future__ import annotations

import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, shuffle_width

#: White_Space other than blank and line feed (fixed values).
_RARE_SPACE = "\t\x0b\x0c\r\x85\xa0  -     　"
_RARE = re.compile(f"[{_RARE_SPACE}]")
_COMMON_SEGMENT = re.compile("[ \n]*[^ \n]+|[ \n]+")
_ANY_SEGMENT = re.compile(f"[ \n{_RARE_SPACE}]*[^ \n{_RARE_SPACE}]+|[ \n{_RARE_SPACE}]+")


def segments(text: str) -> list[str]:
    """Cuts a text after each run of non-space, before the white space that follows. Byte-level BPE patterns end a
    match at every such place and look no further ahead than the next segment's white space, so the matches of a text
    are those of its segments, one after another."""
    return (_ANY_SEGMENT if _RARE.search(text) else _COMMON_SEGMENT).findall(text)


def has_space_beside_blank(text: str) -> bool:
    """Whether white space stands next to a blank, or there is any besides blanks and line feeds."""
    return "  " in text or " \n" in text or "\n " in text or _RARE.search(text) is not None


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes under zstandard."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class BlockWriter:
    """Gathers documents until their text reaches `chars`, then gives one block row. Slots number a block's distinct
    words; the stream has one slot for each position, document after document. `pieces_of` cuts a text, `words_of` gives
    a piece's words; `counted` tells of a doc_id whether its words count in `weights`, one number for each slot."""

    MEMO = 200_000

    def __init__(self, pieces_of, words_of, chars: int, counted=None):
        self.pieces_of, self.words_of, self.chars, self.counted = pieces_of, words_of, chars, counted
        self.seq = 0
        self.reset()

    def reset(self):
        self.ids, self.counts, self.stream, self.slots, self.pieces, self.size = [], [], array("I"), {}, {}, 0

    def add(self, doc_id, text: str) -> None:
        slots, pieces, stream = self.slots, self.pieces, self.stream
        before = len(stream)
        for s in self.pieces_of(text):
            own = pieces.get(s)
            if own is None:
                if len(pieces) >= self.MEMO:
                    pieces.clear()
                own = pieces[s] = array("I", [slots.setdefault(w, len(slots)) for w in self.words_of(s)])
            stream += own
        self.ids.append(doc_id)
        self.counts.append(len(stream) - before)
        self.size += len(text)

    def row(self) -> dict:
        stream = np.frombuffer(self.stream, np.uint32) if len(self.stream) else np.empty(0, np.uint32)
        words = list(self.slots)
        weights = np.zeros(len(words), np.int64)
        if self.counted and len(words):
            chosen = np.repeat([self.counted(d) for d in self.ids], self.counts)
            weights = np.bincount(stream[chosen], minlength=len(words))
        order = np.argsort(-np.bincount(stream, minlength=len(words)), kind="stable")  # small numbers for frequent words
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        out = {
            "block": (TaskContext.get().partitionId() << 32) + self.seq,
            "doc_ids": self.ids,
            "counts": self.counts,
            "words": [words[i] for i in order],
            "weights": weights[order],
            "stream": pack(rank.astype(np.uint32)[stream] if len(words) else stream),
        }
        self.seq += 1
        self.reset()
        return out


def word_blocks(docs: DataFrame, cutters, chars: int, label: str, counted=None) -> DataFrame:
    """Rows (block, doc_ids, counts, words, weights, stream) of `docs` (doc_id, text), written once, as a table in the warehouse:
    block numbers stay as they are when executors are lost. The table is bucketed by block, so that what is joined back
    by block moves, and the streams don't. A text longer than `chars` is a block of its own. Null texts count as empty.
    cutters() gives (pieces_of, words_of)."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int64()), ("doc_ids", longs), ("counts", longs), ("words", pa.list_(pa.string())), ("weights", longs), ("stream", pa.binary())])

    def run(batches):
        w = BlockWriter(*cutters(), chars, counted)
        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                w.add(d, t.as_py() or "")
                if w.size >= chars:
                    yield record_batch({k: [v] for k, v in w.row().items()}, schema)
        if w.ids:
            yield record_batch({k: [v] for k, v in w.row().items()}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, doc_ids array<long>, counts array<long>, words array<string>, weights array<long>, stream binary")
    spark = docs.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").bucketBy(shuffle_width(spark), "block").saveAsTable(name)
    return spark.table(name)


class ByBlock:
    """Gathers answers for words by block, to send them as a few packed rows instead of one row a word."""

    def __init__(self, rows: int = 400_000):
        self.limit = rows
        self.rows, self.blocks, self.slots, self.values = 0, [], [], []

    def add(self, block: np.ndarray, slot: np.ndarray, values: list[bytes]) -> bool:
        self.blocks.append(block), self.slots.append(slot)
        self.values += values
        self.rows += len(values)
        return self.rows >= self.limit

    def take(self) -> pa.RecordBatch:
        """Rows (block, slots, widths, values): for each block its slots in order, the bytes of each value, and the values."""
        block = np.concatenate(self.blocks or [np.empty(0, np.int64)])
        slot = np.concatenate(self.slots or [np.empty(0, np.int64)])
        order = np.lexsort((slot, block))
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        out = {"block": [], "slots": [], "widths": [], "data": []}
        press = zstandard.ZstdCompressor(level=3).compress
        for own in np.split(order, cuts) if len(order) else []:
            cells = [self.values[i] for i in own.tolist()]
            out["block"].append(int(block[own[0]]))
            out["slots"].append(pack(np.diff(slot[own], prepend=0)))
            out["widths"].append(pack(np.array([len(c) for c in cells])))
            out["data"].append(press(b"".join(cells)))
        self.rows, self.blocks, self.slots, self.values = 0, [], [], []
        return record_batch(out, BY_BLOCK)

    @staticmethod
    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(slots, widths, values end to end) of a block's rows."""
        slots = [np.cumsum(unpack(x)) for x in table.column("slots").to_pylist()]
        widths = [unpack(x).astype(np.int64) for x in table.column("widths").to_pylist()]
        press = zstandard.ZstdDecompressor().decompress
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return join(slots), join(widths), b"".join(press(x) for x in table.column("data").to_pylist())


BY_BLOCK = pa.schema([("block", pa.int64()), ("slots", pa.binary()), ("widths", pa.binary()), ("data", pa.binary())])
BY_BLOCK_DDL = "block long, slots binary, widths binary, data binary"


def per_word(blocks: DataFrame, run, result: str) -> DataFrame:
    """Deals the words of all blocks by word and sorts them, so that equal words stand together, once for each block at
    most; `run` maps Arrow batches (block, slot, word, weight) and gives rows (block, slots, ...)."""
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "weights")).alias("slot", "w")).select("block", "slot", F.col("w.words").alias("word"), F.col("w.weights").alias("weight"))
    return words.repartition(shuffle_width(blocks.sparkSession), "word").sortWithinPartitions("word").mapInArrow(run, result)
