"""Readers, and the chunk view that stands for a document corpus with folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.LongType(), False),
        T.StructField("rel_path", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

#: Folder of a document by its number modulo five.
FOLDERS = ("cgst acts", "circulars", "notifications", "high court case laws", "misc")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: chunk_id, rel_path (folder/year/source_number.pdf), lang, text."""
    folder = F.element_at(F.array(*[F.lit(f) for f in FOLDERS]), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(folder, F.lit("/"), (F.lit(2015) + F.col("doc_id") % 8).cast("string"), F.lit("/"), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), path.alias("rel_path"), "lang", "text")


CHUNKS_SQL = (
    "chunks AS (SELECT doc_id AS chunk_id, ["
    + ", ".join(f"'{f}'" for f in FOLDERS)
    + "][doc_id % 5 + 1] || '/' || (2015 + doc_id % 8) || '/' || source || '_' || doc_id || '.pdf' AS rel_path, lang, text FROM documents)"
)


def row_sentence(columns: list[str]) -> Column:
    """A row as "column: value. column: value", without nulls and unnamed columns."""
    named = [c for c in columns if c and not c.lower().startswith("unnamed")]
    return F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string")) for c in named])), ". ")


def read_csv_sentences(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True)
    return df.select(row_sentence(df.columns).alias("text"), F.col("_metadata.file_path").alias("rel_path"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("rel_path"))


def read_html(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    from ..functions.text import clean_text, html_strip

    return read_texts(spark, path).withColumn("text", clean_text(html_strip(F.col("text")))).where(F.length("text") >= least)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Malformed lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def list_files(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """path, size and time of the files below a folder with one of the extensions; no hidden files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    name = F.substring_index("path", "/", -1)
    return files.where(F.lower(name).rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$") & ~name.startswith(".") & ~F.col("path").contains("__MACOSX"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: the paragraphs that aren't blank, joined by line feeds. The archive's XML is read as it is."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def one(raw: bytes) -> str | None:
        try:
            root = ET.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ET.ParseError):
            return None
        texts = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
        return "\n".join(t for t in texts if t.strip())

    def paragraphs(frames):
        for f in frames:
            yield f.assign(text=f.content.map(one))[["rel_path", "text"]]

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select(F.col("path").alias("rel_path"), "content").mapInPandas(paragraphs, "rel_path string, text string").where("text IS NOT NULL")
