"""Queries of the chunkers over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking
from ..sources.readers import table
from .text_queries import _ALL_SQL, _all_texts


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def recursive_chunks(spark, sf):
    """Chunks of 1,200 characters with an overlap of 150, without those under 80."""
    out = chunking.recursive_chunks(_docs(spark, sf))
    return out.select("doc_id", "chunk_no", "n_chars", F.substring(F.md5(F.concat_ws("_", "doc_id", "chunk_no")), 1, 16).alias("chunk_id"), F.md5("chunk").alias("chunk_md5"))


def section_chunks(spark, sf):
    """Lines put together up to 500 tokens, by section, with 80 words of overlap."""
    out = chunking.section_chunks(_docs(spark, sf), paragraph="\n")
    return out.select("doc_id", "chunk_no", chunking.token_estimate(F.col("chunk")).alias("tokens"), "section_label", F.array_join("section_labels", "|").alias("section_labels"), F.md5("chunk").alias("chunk_md5"))


def provision_split(spark, sf):
    """Statute texts by section markers."""
    out = chunking.provisions(_all_texts(spark, sf), text="q")
    return out.select("id", "part_no", "provision", "structure", F.md5("part").alias("part_md5"))


QUERIES = {f.__name__: f for f in (recursive_chunks, section_chunks, provision_split)}
_P = dict(chunking.CITATIONS)["SEC"]
ORACLES = {
    "provision_split": f"""WITH {_ALL_SQL}, m AS (SELECT id, q, regexp_extract_all(q, '{_P}') AS marks, string_split_regex(q, '{_P}') AS rest FROM s),
        n AS (SELECT *, unnest(CASE WHEN len(marks) > 0 THEN range(len(marks)) ELSE [0] END) AS k FROM m WHERE q IS NOT NULL)
        SELECT id, k::INTEGER AS part_no, CASE WHEN len(marks) > 0 THEN marks[k + 1] END AS provision, CASE WHEN len(marks) > 0 THEN 'PROVISION' ELSE 'STATUTE_BODY' END AS structure,
            md5(CASE WHEN len(marks) > 0 THEN marks[k + 1] || ' ' || rest[k + 2] ELSE q END) AS part_md5 FROM n""",
}
