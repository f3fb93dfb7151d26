"""Token counts by a unigram vocabulary: Aho-Corasick finds the pieces, a Viterbi pass keeps score and count only."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, table

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass(frozen=True)
class Unigram:
    """Pieces with their scores. Blanks are MARK in pieces and texts; with `dummy_prefix` a text that isn't empty gets
    one in front. A character that no piece of one character covers is unknown: its score is the least of all scores
    less `unknown_penalty`, and it counts as its UTF-8 bytes with `byte_fallback`, else a run of them counts as one."""

    pieces: tuple[tuple[str, float], ...]
    dummy_prefix: bool = True
    byte_fallback: bool = True
    unknown_penalty: float = 10.0

    @staticmethod
    def from_model(path: str) -> Unigram:
        """The scored pieces of a sentencepiece file. Pieces of a placeholder score (-1e9) are left out."""
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = range(sp.vocab_size())
        plain = [i for i in n if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) and sp.get_score(i) > -1e9]
        return Unigram(tuple((sp.id_to_piece(i), sp.get_score(i)) for i in plain), byte_fallback=any(sp.is_byte(i) for i in n))


class Counter:
    """Best segmentations of texts as (pieces, score). A candidate replaces the best so far at its end only if its
    score is greater, and candidates come by ascending start: of equal scores the longest last piece wins."""

    def __init__(self, vocabulary: Unigram, limit: int = 300_000, longest: int = 64):
        import ahocorasick

        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.matches = None
        if vocabulary.pieces:
            self.automaton.make_automaton()
            self.matches = self.automaton.iter
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - vocabulary.unknown_penalty
        # a cut before MARK is safe when no piece goes on to a MARK after another character
        self.cut = all(MARK not in p.lstrip(MARK) for p, _ in vocabulary.pieces)
        self.counts, self.scores, self.limit, self.longest = {}, {}, limit, longest

    def best(self, s: str) -> tuple[int, float]:
        n = len(s)
        score, count, unknown = [float("-inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0

        def lone(end):  # the unknown character that ends here, after all longer candidates
            c = s[end - 1]
            if c not in self.single and (x := score[end - 1] + self.unknown) > score[end]:
                score[end], unknown[end] = x, True
                count[end] = count[end - 1] + (len(c.encode("utf-8", "surrogatepass")) if self.v.byte_fallback else not unknown[end - 1])

        at = 1
        for last, (length, value) in self.matches(s) if self.matches else ():
            end = last + 1
            while at < end:  # ends without (more) matches
                lone(at)
                at += 1
            x = score[end - length] + value
            if x > score[end]:  # matches of one end come longest first
                score[end], count[end], unknown[end] = x, count[end - length] + 1, False
        while at <= n:
            lone(at)
            at += 1
        return count[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = (MARK if self.v.dummy_prefix else "") + text.replace(" ", MARK)
        if not self.cut:
            return self.best(text)
        counts, scores, n, total, parts = self.counts, self.scores, 0, 0.0, []
        for s in _SEGMENT.findall(text):
            if s not in counts:
                c, x = self.best(s)
                if len(s) > self.longest:
                    n, total = n + c, total + x
                    continue
                if len(counts) >= self.limit:
                    n, total, parts = n + sum(map(counts.__getitem__, parts)), total + sum(map(scores.__getitem__, parts)), []
                    counts.clear(), scores.clear()
                counts[s], scores[s] = c, x
            parts.append(s)
        return n + sum(map(counts.__getitem__, parts)), total + sum(map(scores.__getitem__, parts))


def token_counts(docs: DataFrame, vocabulary: Unigram, text: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, score), one for each row of `docs`: pieces and score of the best segmentation of the
    whole text. Null and empty texts have 0 pieces and score 0.0. doc_ids pass through, null or repeated; an empty
    table gives no rows; columns besides doc_id and text, whatever their names, play no part. No shuffle: a worker
    remembers a bounded number of segments. Scores are summed in 64 bits; the tokenizer's library sums in 32, so that
    on texts of thousands of characters, whose sums 32 bits don't hold exactly, it may break near ties otherwise.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary, whatever the corpus

    def run(batches):
        counter = Counter(shared.value)
        for b in batches:
            got = [counter.count(t.as_py()) for t in b.column("text")]
            yield record_batch({"doc_id": b.column("doc_id"), "n_tokens": [n for n, _ in got], "score": [x for _, x in got]}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, score double")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), Unigram.from_model(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict = {}
