"""Token-id files: each document's ids compressed on its own under one shared zstandard dictionary, with an index.

A file is: magic, payloads end to end, then the index (one record a document: doc_id, has_id, first token, tokens,
byte offset, bytes), then a footer of fixed size: sha256 of the dictionary, width of an id in bytes, number of
documents, index offset, magic. The dictionary lies beside the files. A reader takes the footer, then the index, then
only the bytes of the documents it wants.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, record_batch, shared_dir, shuffle_width, table
from .pretokens import has_space_beside_blank, segments

MAGIC = b"TOKZ0001"
FOOTER = "<32sIQQ8s"
RECORD = np.dtype([("doc_id", "<i8"), ("has_id", "<i8"), ("start", "<i8"), ("n", "<i8"), ("offset", "<i8"), ("bytes", "<i8")])


@dataclass(frozen=True)
class Format:
    """The dictionary of `dict_bytes` is trained on the ids of about `samples` documents of at most `sample_chars`
    characters, picked by a hash of doc_id: a bounded sample that has no say in what is stored. `memo` bounds the
    words whose ids a worker remembers, and twice the segments. A task starts a new file after `file_bytes`, which also
    bounds the index it holds."""

    dict_bytes: int = 65_536
    samples: int = 1000
    sample_chars: int = 20_000
    level: int = 3
    memo: int = 1_200_000
    file_bytes: int = 256_000_000


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


#: The pattern of the library's byte-level pre-tokenizer (fixed value), with its white space by name.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others
    follow from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Remembered(dict):
    """Answers of `make`, in two generations of `limit` / 2: when the young one is full it takes the place of the old
    one, so that what is asked for often stays."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class SegmentEncoder:
    """Ids of texts by a tokenizers file. Where the file's pre-tokenizer is byte-level with its own pattern, no prefix
    space and no normaliser, the library's model is asked for each distinct word once, and words and segments are
    remembered, `memo` of them at most; other files, and texts with an added token in them, go to the library whole."""

    def __init__(self, path: str, memo: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.find, self.letters, self.model = regex.compile(BYTE_LEVEL).findall, byte_letters(), self.tokenizer.model
        self.words = _Remembered(self._word, memo)
        self.pieces = _Remembered(self._segment, memo // 4)
        self.after_blank = _Remembered(self._after_blank, memo)

    def _cut(self, segment: str) -> list[str]:
        core = segment[1:]
        if segment[0] == " " and core.isalpha():
            return [segment]
        if segment[0] == " " and core[:-1].isalpha() and core[-1] in ".,;:!?":
            return [segment[:-1], core[-1]]
        return self.find(segment)

    def _word(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return array("H" if self.width == 2 else "I", [t.id for t in tokens]).tobytes()

    def _segment(self, segment: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self._cut(segment)))

    def _after_blank(self, core: str) -> bytes:
        if core.isalpha():  # one word, remembered here and not with the others
            return self._word(" " + core)
        if core[:-1].isalpha() and core[-1] in ".,;:!?":
            return self.after_blank[core[:-1]] + self.words[core[-1]]
        return self._segment(" " + core)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of `width` bytes."""
        out = []
        for text in texts:
            if not self.by_word or any(t in text for t in self.added):
                out.append(self._whole(text))
                continue
            if text[:1] not in ("", " ") and text[-1] != " " and not has_space_beside_blank(text):
                first, *rest = text.split(" ")  # each blank stands alone between words, and starts a segment
                out.append(self.pieces[first] + b"".join(map(self.after_blank.__getitem__, rest)))
            else:
                out.append(b"".join(map(self.pieces.__getitem__, segments(text))))
        return out


_ENCODERS: dict[tuple[str, int], SegmentEncoder] = {}


def encoder(path: str, memo: int) -> SegmentEncoder:
    """The worker's encoder of a file: what it remembers serves the tasks that follow."""
    if (path, memo) not in _ENCODERS:
        _ENCODERS[path, memo] = SegmentEncoder(path, memo)
    return _ENCODERS[path, memo]


def train_dictionary(docs: DataFrame, tokenizer: str, fmt: Format, text: str = "text") -> bytes:
    """Dictionary bytes from a bounded sample; empty when there is nothing to train on."""
    every = max(1, docs.count() // fmt.samples)
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).where(F.length(text).between(1, fmt.sample_chars))
    rows = [r[0] for r in picked.select(text).limit(2 * fmt.samples).collect()]
    samples = encoder(tokenizer, fmt.memo).encode(rows)
    try:
        return zstandard.train_dictionary(fmt.dict_bytes, samples, level=fmt.level).as_bytes()
    except zstandard.ZstdError:  # too few samples: their bytes serve as they are
        return b"".join(samples)[-fmt.dict_bytes :]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def with_starts(files: DataFrame) -> DataFrame:
    """(file_no, path, docs, tokens) and start, the tokens of the files before: a running sum inside each task's files,
    and the sums of the tasks before. The upper bits of file_no number the task."""
    files = files.withColumn("task", F.shiftright("file_no", 20))
    inside = F.sum("tokens").over(Window.partitionBy("task").orderBy("file_no")) - F.col("tokens")
    base = files.groupBy("task").agg(F.sum("tokens").alias("t"))
    base = base.withColumn("base", F.sum("t").over(Window.orderBy("task")) - F.col("t"))  # a row for each task
    return files.withColumn("inside", inside).join(base, "task").select("file_no", "path", "docs", "tokens", (F.col("inside") + F.col("base")).alias("start"))


class _Output:
    """A file that is written: documents one after another, then index and footer."""

    def __init__(self, fs, path: str, press: zstandard.ZstdCompressor, width: int):
        self.path, self.press, self.width, self.f = path, press, width, fs.open_output_stream(path)
        self.f.write(MAGIC)
        self.index, self.docs, self.tokens, self.offset = array("q"), 0, 0, len(MAGIC)  # an index record is six numbers

    def put(self, doc_id: int | None, raw: bytes) -> None:
        cell = self.press.compress(raw)
        self.f.write(cell)
        n = len(raw) // self.width
        self.index.extend((doc_id or 0, doc_id is not None, self.tokens, n, self.offset, len(cell)))
        self.docs, self.tokens, self.offset = self.docs + 1, self.tokens + n, self.offset + len(cell)

    def close(self, dictionary: bytes) -> None:
        self.f.write(np.array(self.index, "<i8").tobytes())
        self.f.write(struct.pack(FOOTER, hashlib.sha256(dictionary).digest(), self.width, self.docs, self.offset, MAGIC))
        self.f.close()


def write_token_files(docs: DataFrame, tokenizer: str, root: str, end_id: int | None = None, fmt: Format = Format(), text: str = "text") -> DataFrame:
    """Encodes every row of `docs` and writes files under `root` (a folder all executors share) in ascending doc_id
    order over the files; returns the manifest (file_no, path, docs, tokens, start), start counting the tokens in the files before.

    Null and empty texts have no ids but the end id. Rows with a null doc_id come first; rows of one doc_id are in the
    order of their text's hash, so that a doc_id of any number of rows is dealt to several tasks. A text of any length
    is one document. An empty table gives an empty manifest. Columns of `docs` besides doc_id and text, whatever their
    names, play no part. A task that runs again writes files of other names, and only those of finished tasks are in
    the manifest.
    """
    spark = docs.sparkSession
    data = train_dictionary(docs, tokenizer, fmt, text)
    fs, base = filesystem(root)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary") as f:
        f.write(data)
    shared = spark.sparkContext.broadcast(data)
    schema = pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        enc, out, seq = None, None, 0
        no = TaskContext.get().partitionId()
        fs, base = filesystem(root)

        def close():
            nonlocal out, seq
            out.close(shared.value)
            row = record_batch({"file_no": [(no << 20) + seq], "path": [out.path], "docs": [out.docs], "tokens": [out.tokens]}, schema)
            out, seq = None, seq + 1
            return row

        for b in batches:
            if not b.num_rows:
                continue
            if enc is None:
                enc, zd = encoder(tokenizer, fmt.memo), _dictionary(shared.value)
                if zd:
                    zd.precompute_compress(level=fmt.level)
                press = zstandard.ZstdCompressor(level=fmt.level, dict_data=zd)
                end = b"" if end_id is None else np.array([end_id], f"<u{enc.width}").tobytes()
            texts = [t or "" for t in b.column("text").to_pylist()]
            for d, raw in zip(b.column("doc_id").to_pylist(), enc.encode(texts), strict=True):
                out = out or _Output(fs, f"{base}/part-{no:05d}-{seq:05d}-{uuid.uuid4().hex}.tokz", press, enc.width)
                out.put(d, raw + end)
                if out.offset >= fmt.file_bytes:
                    yield close()
        if out:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(shuffle_width(spark), "doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
    files = materialize(rows.select("doc_id", "text").mapInArrow(run, "file_no long, path string, docs long, tokens long"), "token-files")
    return with_starts(files)


class TokenFile:
    """Reads one file: the index, and documents by their place in it."""

    def __init__(self, path: str):
        self.fs, self.path = filesystem(path)
        self.f = self.fs.open_input_file(self.path)
        size = self.f.size()
        head, self.width, n, at, magic = struct.unpack(FOOTER, self._at(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        with self.fs.open_input_stream(f"{self.path.rpartition('/')[0]}/dictionary") as f:
            data = f.read()
        if hashlib.sha256(data).digest() != head:
            raise ValueError(f"{path} was written under another dictionary")
        self.unpress = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        self.index = np.frombuffer(self._at(at, n * RECORD.itemsize), RECORD)

    def _at(self, offset: int, n: int) -> bytes:
        return self.f.read_at(n, offset)

    def ids(self, i: int) -> np.ndarray:
        r = self.index[i]
        raw = self.unpress.decompress(self._at(int(r["offset"]), int(r["bytes"])), max_output_size=int(r["n"]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def find(self, doc_id: int) -> list[int]:
        """Places of a document in the index, by binary search."""
        known = np.searchsorted(self.index["has_id"], 1)
        own = self.index["doc_id"][known:]
        return list(range(known + np.searchsorted(own, doc_id, "left"), known + np.searchsorted(own, doc_id, "right")))


def read_token_files(manifest: DataFrame, digests: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids array<long>) of all files; with `digests` the unsigned crc32 of the ids as
    little-endian 32-bit numbers comes instead of the ids."""
    last = ("ids_crc32", pa.int64()) if digests else ("ids", pa.list_(pa.int64()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def run(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                f = TokenFile(path)
                for lo in range(0, len(f.index), 2000):
                    own = f.index[lo : lo + 2000]
                    ids = [f.ids(i).astype("<u4") for i in range(lo, lo + len(own))]
                    yield record_batch(
                        {
                            "doc_id": [int(d) if h else None for d, h in zip(own["doc_id"], own["has_id"], strict=True)],
                            "start": own["start"] + start,
                            "n_tokens": own["n"].astype(np.int64),
                            last[0]: [zlib.crc32(x.tobytes()) for x in ids] if digests else ids,
                        },
                        schema,
                    )

    spread = manifest.select("path", "start").repartition(shuffle_width(manifest.sparkSession), "path")
    return spread.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last[0]} {'long' if digests else 'array<long>'}")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), root, end_id=2)
    return read_token_files(manifest, digests=True)


QUERIES = {"op3_token_files": op3_token_files}
ORACLES: dict = {}
