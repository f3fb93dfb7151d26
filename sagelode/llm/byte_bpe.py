"""Byte-level BPE: each distinct pre-token is encoded once, ids are joined back and put together by position."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, table
from .pretokens import BY_BLOCK_DDL, ByBlock, per_word, segments, unpack, word_blocks


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _matcher(pattern: str):
    """A function that gives the segments and the match function of a pattern; white space is Unicode's, as in the tokenizer's library."""

    def build():
        import regex

        return segments, regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}")).findall

    return build


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", block_chars: int = 32_000_000) -> DataFrame:
    """Rows (doc_id, ids array<int>), one for each row of `docs`: every match of `pattern` in the whole text encoded by
    the ranks in the file `vocabulary`, without special tokens.

    Words meet once for each block of documents, not once for each position: a word of a third of all positions costs
    a row for each block. Positions aren't exploded to rows: a block's stream names its distinct words by number, in
    order, and the ids joined back are put in their places by it. Null and empty texts give empty arrays; null and
    repeated doc_ids pass through; a text longer than a block is a block of its own; an empty table gives no rows.
    Columns of `docs` besides doc_id and text, whatever their names, play no part. The file must be at the same path
    on every executor.
    """
    blocks = word_blocks(docs.select("doc_id", F.col(text).alias("text")), _matcher(pattern), block_chars, "bpe_blocks")

    def encode_words(batches):
        import tiktoken

        one = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=load_ranks(vocabulary), special_tokens={}).encode_ordinary
        last, ids = None, b""
        held = ByBlock()
        for b in batches:
            out = []
            for w in b.column("word").to_pylist():
                if w != last:
                    last, ids = w, np.array(one(w), "<u4").tobytes()
                out.append(ids)
            if held.add(b.column("block").to_numpy(), b.column("slot").to_numpy().astype(np.int64), out):
                yield held.take()
        yield held.take()

    words = per_word(blocks, encode_words, BY_BLOCK_DDL)
    doc_schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def put_together(key, block: pa.Table, own: pa.Table):
        if not block.num_rows:
            return doc_schema.empty_table()
        slots, width, data = ByBlock.read(own)
        width = width // 4
        flat = np.frombuffer(data, "<u4").astype(np.int32)
        begin = np.empty(len(slots), np.int64)
        wide = np.empty(len(slots), np.int64)
        begin[slots], wide[slots] = np.cumsum(width) - width, width
        stream = unpack(block.column("stream")[0].as_py())
        ids, ends = [flat[:0]], [np.zeros(1, np.int64)]
        for lo in range(0, len(stream), 500_000):
            part = stream[lo : lo + 500_000]
            n = wide[part]
            stop = np.cumsum(n)
            ids.append(flat[np.repeat(begin[part] - stop + n, n) + np.arange(stop[-1])])
            ends.append(stop + ends[-1][-1])
        ends = np.concatenate(ends)
        offsets = ends[np.concatenate(([0], np.cumsum(block.column("counts")[0].as_py(), dtype=np.int64)))]
        docs = pa.array(block.column("doc_ids")[0].as_py(), pa.int64())
        return pa.table({"doc_id": docs, "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))}, schema=doc_schema)

    streams = blocks.select("block", "doc_ids", "counts", "stream")
    return streams.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(put_together, "doc_id long, ids array<int>")


class TokenBytes:
    """The token-byte table: all tokens' bytes end to end, looked up for arrays of ids at once."""

    def __init__(self, ranks: dict[bytes, int]):
        by_id = {i: t for t, i in ranks.items()}
        n = max(by_id, default=-1) + 1
        cells = [by_id.get(i, b"") for i in range(n)]
        self.width = np.array([len(c) for c in cells], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(cells), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.width[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.begin[ids] - ends + n, n) + np.arange(ends[-1])].tobytes() if len(ids) else b""


def decode(encoded: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """Rows of `encoded` (doc_id, ids array<int>) with `decoded` (binary): each id's bytes from the token-byte table, in
    order, by array lookup in every task. The table is as large as the vocabulary, whatever the corpus, and is read by every task.
    Null ids give null. With `digests`, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256
    come instead of ids and bytes, so that these needn't leave the task."""
    fields = [("doc_id", pa.int64())] + ([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    schema = pa.schema(fields)

    def run(batches):
        tokens = TokenBytes(load_ranks(vocabulary))
        decimal = [str(i) for i in range(len(tokens.width))]
        for b in batches:
            column = b.column("ids")
            ids = [None if not x.is_valid else x.values.to_numpy() for x in column]
            raw = [None if x is None else tokens.decode(x) for x in ids]
            out = {"doc_id": b.column("doc_id")}
            if digests:
                out["n_tokens"] = [None if x is None else len(x) for x in ids]
                out["ids_sha256"] = [None if x is None else hashlib.sha256(",".join(map(decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]
                out["decoded_sha256"] = [None if x is None else hashlib.sha256(x).hexdigest() for x in raw]
            else:
                out |= {"ids": column, "decoded": raw}
            yield record_batch(out, schema)

    names = {"int64": "long", "string": "string", "binary": "binary"}
    return encoded.select("doc_id", "ids").mapInArrow(run, ", ".join(f"{f.name} {names.get(str(f.type), 'array<int>')}" for f in schema))


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = _public()
    return decode(encode(table(spark, sf_dir, "documents"), vocabulary, pattern), vocabulary, digests=True)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row of `docs`, the hash being of the bytes that the ids decode to.
    Null texts have no ids; repeated rows come each; a table without rows gives none."""
    vocabulary, pattern = _public()
    encoded = decode(encode(docs, vocabulary, pattern), vocabulary)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict = {}
