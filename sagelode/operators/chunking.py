"""Chunkers: separators tried in turn with an overlap, paragraphs folded by section, and provisions.

All work on the text of one row, so nothing is shuffled; the fold by section runs in Python on Arrow batches, the others are array
expressions with Spark's own higher-order functions.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.legal import CITATIONS

#: From the coarsest to single characters (fixed values).
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", "? ", "! ", "; ", " ", "")
_PARTS = "array<struct<done:boolean,parts:array<string>>>"


def _cut(text: Column, sep: str) -> Column:
    """`text` at each `sep`, which stays at the head of what follows it; no empty parts."""
    if not sep:
        return F.filter(F.split(text, ""), lambda s: s != "")
    own = F.split(text, "\\Q" + sep + "\\E", -1)
    return F.filter(F.transform(own, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.lit(sep), s))), lambda s: s != "")


def _runs(parts: Column, size: int) -> Column:
    """Neighbours of under `size` characters together as one that is done, each longer part alone as one that isn't."""
    n = F.size(parts)
    long = F.filter(F.transform(parts, lambda s, i: F.when(F.length(s) >= size, i)), lambda i: i.isNotNull())
    ends = F.concat(F.array(F.lit(-1)), long, F.array(n))
    steps = F.sequence(F.lit(0), F.size(ends) - 2)

    def both(j):
        a, b = F.get(ends, j), F.get(ends, j + 1)
        run = F.struct(F.lit(True).alias("done"), F.slice(parts, a + 2, b - a - 1).alias("parts"))
        return F.array(run, F.struct(F.lit(False).alias("done"), F.slice(parts, b + 1, 1).alias("parts")))

    return F.filter(F.flatten(F.transform(steps, both)), lambda x: F.size(x["parts"]) > 0)


def _merged(parts: Column, size: int, overlap: int) -> Column:
    """Parts end to end up to `size` characters; a chunk begins with the last parts of the one before, `overlap` characters of
    them at most."""
    state = "struct<out:array<string>,own:array<string>,total:int>"

    def step(acc, s):
        n = F.length(s)
        own, total = acc["own"], acc["total"]
        room = F.least(F.lit(overlap), F.lit(size) - n)
        back = F.aggregate(
            F.reverse(own),
            F.struct(F.lit(0).alias("k"), F.lit(0).alias("t"), F.lit(True).alias("open")),
            lambda a, x: F.when(a["open"] & (a["t"] + F.length(x) <= room), F.struct((a["k"] + 1).alias("k"), (a["t"] + F.length(x)).alias("t"), F.lit(True).alias("open"))).otherwise(
                F.struct(a["k"].alias("k"), a["t"].alias("t"), F.lit(False).alias("open"))
            ),
        )
        kept = F.slice(own, F.size(own) - back["k"] + 1, back["k"])
        full = F.struct(F.concat(acc["out"], F.array(F.array_join(own, ""))).alias("out"), F.concat(kept, F.array(s)).alias("own"), (back["t"] + n).alias("total"))
        more = F.struct(acc["out"].alias("out"), F.concat(own, F.array(s)).alias("own"), (total + n).alias("total"))
        return F.when((total + n > size) & (F.size(own) > 0), full).otherwise(more)

    none = F.array().cast("array<string>")
    end = lambda acc: F.when(F.size(acc["own"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["own"], "")))).otherwise(acc["out"])
    return F.aggregate(parts, F.struct(none.alias("out"), none.alias("own"), F.lit(0).alias("total")).cast(state), step, end)


def _round(sep: str, size: int):
    """Cuts what isn't done and holds `sep`."""

    def cut(x):
        own = F.get(x["parts"], F.lit(0))
        here = ~x["done"] & F.contains(own, F.lit(sep))
        return F.when(here, _runs(_cut(own, sep), size)).otherwise(F.array(x))

    return cut


def recursive_chunks(docs: DataFrame, size: int = 1200, overlap: int = 150, least: int = 80, separators=SEPARATORS, text: str = "text") -> DataFrame:
    """`docs` with a row for each chunk: chunk_no (from 0, counted before short ones go), chunk and n_chars.

    A text is cut at the first of `separators` that it holds; parts of under `size` characters are merged
    up to it with an overlap, longer ones are cut at the next separator. Chunks lose white space at their ends, and
    those of under `least` characters go. Null and empty texts give no rows. One bounded round for each separator, one
    row at a time: a text of any length stays in its row.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    out = docs.withColumn("_parts", F.array(F.struct(F.lit(False).alias("done"), F.array(F.coalesce(F.col(text), F.lit(""))).alias("parts"))).cast(_PARTS))
    for sep in separators:
        out = out.withColumn("_parts", F.flatten(F.transform("_parts", _round(sep, size))))
    chunks = F.flatten(F.transform("_parts", lambda x: F.when(x["done"], _merged(x["parts"], size, overlap)).otherwise(x["parts"])))
    out = out.withColumn("_parts", F.filter(F.transform(chunks, strip), lambda c: c != ""))
    out = out.select(*docs.columns, F.posexplode("_parts").alias("chunk_no", "chunk")).withColumn("n_chars", F.length("chunk"))
    return out.where(F.col("n_chars") >= least)


#: A paragraph that begins like this opens a section (fixed values).
SECTION_STARTS = (
    r"^\s*Section\s+\d+[\w\(\)]*",
    r"^\s*Sec\.\s*\d+[\w\(\)]*",
    r"^\s*Rule\s+\d+[\w\(\)]*",
    r"^\s*Article\s+\d+[\w\(\)]*",
    r"^\s*\d+\.\s+[A-Z]",
    r"^\s*\(\d+\)\s",
    r"^\s*\([a-z]\)\s",
    r"^\s*[A-Z]{2,}",
    r"^\s*Provided\s+that",
    r"^\s*Explanation[—\-\.]",
    r"^\s*WHEREAS",
    r"^\s*NOW,\s+THEREFORE",
)
#: Labels of sections (fixed values).
LABELS = (("Section", r"(?i)(?:Section|Sec\.)\s*(\d+[\w\(\)]*)"), ("Rule", r"(?i)Rule\s+(\d+[\w\(\)]*)"), ("Article", r"(?i)Article\s+(\d+[\w\(\)]*)"))


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def token_estimate(c: Column) -> Column:
    """Words times 1.35, rounded down."""
    return F.floor(n_words(c) * 1.35).cast("int")


_SPACE = " \t\n\x0b\f\r"
_SEPARATORS_AT_END = ("\x85", "\u2028", "\u2029")
_SENTENCE = re.compile(r"(?<=[.;])\s+", re.A)
_OPENS = re.compile("|".join(SECTION_STARTS), re.A)
_LABELS = [(k, re.compile(x, re.A)) for k, x in LABELS]


def _stripped(s: str) -> str:
    """`s` without what `^\\s+|\\s+$` matches in Java, whose $ also stands before a line separator at the end."""
    s = s.lstrip(_SPACE)
    return s[:-1].rstrip(_SPACE) + s[-1] if s[-1:] in _SEPARATORS_AT_END else s.rstrip(_SPACE)


def _estimate(s: str) -> int:
    """token_estimate of one text; words of bytes end at ASCII white space only, as \\s does."""
    return int(len(s.encode().split()) * 1.35)


def _sentences_up_to(para: str, most: int) -> list[str]:
    """The paragraph, or, where it is too long, its sentences (ended by . or ;) put together up to `most` tokens."""
    if _estimate(para) <= most:
        return [para]
    out, own, total = [], [], 0
    for s in _SENTENCE.split(para):
        n = _estimate(s)
        if own and total + n > most:
            out.append(" ".join(own))
            own, total = [], 0
        own.append(s)
        total += n
    return [*out, " ".join(own)]


def _label(s: str) -> str | None:
    return next((f"{k} {m[1]}" for k, x in _LABELS if (m := x.search(s))), None)


def _sections(text: str, most: int, overlap: int, paragraph: re.Pattern):
    """(chunk, labels) of one text, in one pass over its paragraphs."""
    own, total, labels, active = [], 0, [], None

    def flush():
        nonlocal own, total, labels
        joined = " ".join(own)
        last = b" ".join(joined.encode().split()[-overlap:]).decode() if overlap > 0 else ""
        done = (_stripped(joined), labels)
        own, total, labels = [last] if last else [], _estimate(last), [] if active is None else [active]
        return [done] if done[0] else []

    for para in filter(None, map(_stripped, paragraph.split(text))):
        for s in _sentences_up_to(para, most):
            n, opens = _estimate(s), _OPENS.match(s) is not None
            if opens:
                active = _label(s) or active
                if own:
                    yield from flush()
            if own and total + n > most:
                yield from flush()
            own.append(s)
            total += n
            if opens and active is not None and active not in labels:
                labels.append(active)
    yield from flush()


_CHUNK = pa.struct([("text", pa.string()), ("labels", pa.list_(pa.string()))])


def section_chunks(docs: DataFrame, most: int = 500, overlap: int = 80, paragraph: str = r"\n\s*\n", text: str = "text") -> DataFrame:
    """`docs` with a row for each chunk of paragraphs, cut at `paragraph`: chunk_no, chunk, section_label and section_labels.

    A chunk ends where a paragraph opens a section, or where it would hold more than `most` tokens; the next one begins with its
    last `overlap` words and the label that is in force. Paragraphs of more than `most` tokens are cut by sentences first.
    Null and empty texts give no rows. Python folds the paragraphs, a row at a time, on Arrow batches: as nested array expressions the
    fold is interpreted and copies its state with each paragraph.
    """
    cut = re.compile(paragraph, re.A)

    @F.arrow_udf("array<struct<text:string,labels:array<string>>>")
    def chunks(texts: pa.Array) -> pa.Array:
        return pa.array([[{"text": t, "labels": ls} for t, ls in _sections(x.as_py() or "", most, overlap, cut)] for x in texts], pa.list_(_CHUNK))

    chunks = chunks.asNondeterministic()  # else Spark infers a filter on the chunks and cuts each text twice
    out = docs.withColumn("_c", chunks(F.col(text)))
    out = out.select(*docs.columns, F.posexplode("_c").alias("chunk_no", "_c"))
    return out.select(*docs.columns, "chunk_no", F.col("_c.text").alias("chunk"), F.get("_c.labels", F.lit(0)).alias("section_label"), F.col("_c.labels").alias("section_labels"))


def provisions(docs: DataFrame, kind: str = "SEC", text: str = "text") -> DataFrame:
    """`docs` with a row for each provision: part_no, provision (the marker), structure and part, the marker and all
    text up to the next one. What stands before the first marker is left out; a text without a marker is one part."""
    pattern = dict(CITATIONS)[kind]
    marks, rest = F.regexp_extract_all(text, F.lit(pattern), 0), F.slice(F.split(text, pattern, -1), F.lit(2), F.greatest(F.size(F.split(text, pattern, -1)) - 1, F.lit(1)))
    cut = F.zip_with(marks, rest, lambda m, t: F.struct(m.alias("provision"), F.lit("PROVISION").alias("structure"), F.concat(m, F.lit(" "), t).alias("part")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("provision"), F.lit("STATUTE_BODY").alias("structure"), F.col(text).alias("part")))
    out = docs.select(*docs.columns, F.posexplode(F.when(F.size(marks) > 0, cut).otherwise(whole)).alias("part_no", "_p"))
    return out.select(*docs.columns, "part_no", "_p.provision", "_p.structure", "_p.part").where("part IS NOT NULL")
