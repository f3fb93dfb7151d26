"""Tables that are replaced whole, sidecars merged into them, and caches that grow: safe to run again after a crash.

A version is data first and a mark last; readers go by the marks, so a version that died halfway or failed its check is
never seen. One writer at a time is assumed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import merge_new_wins


def _place(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def finished(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the folders `prefix`=number whose write ended."""
    fs, root = _place(spark, folder)
    names = [x.getPath() for x in fs.listStatus(root)] if fs.exists(root) else []
    done = [p for p in names if p.getName().startswith(f"{prefix}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def remove(spark: SparkSession, folder: str) -> None:
    fs, path = _place(spark, folder)
    fs.delete(path, True)


def version(spark: SparkSession, folder: str) -> int:
    """The newest version that is marked, 0 without any."""
    return max(finished(spark, f"{folder}/mark", "version"), default=0)


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    no = version(spark, folder)
    return spark.read.parquet(f"{folder}/data/version={no}") if no else None


def publish(df: DataFrame, folder: str, check: Callable[[DataFrame], None] | None = None, keep: int = 2) -> int:
    """Writes df as the next version and marks it unless check(what was written) raises; the `keep` newest versions stay.

    The check reads the files back: metrics observed on the way would count the rows of stages that ran again after a lost executor twice.
    """
    spark = df.sparkSession
    no = version(spark, folder) + 1
    df.write.mode("overwrite").parquet(f"{folder}/data/version={no}")
    if check:
        check(spark.read.parquet(f"{folder}/data/version={no}"))
    spark.range(1).select(F.lit(no).alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/mark/version={no}")
    for old in finished(spark, f"{folder}/mark", "version")[:-keep]:
        remove(spark, f"{folder}/mark/version={old}")
        remove(spark, f"{folder}/data/version={old}")
    return no


def merge_sidecar(spark: SparkSession, folder: str, sidecar: str, key: str, check: Callable[[DataFrame], None] | None = None) -> int | None:
    """Puts the finished batches of `sidecar` (batch=number) into the table in `folder`, as a new version, then removes them; None
    where there are none. Rows of a key replace those of earlier batches and of the table, so that a run after a crash between
    the two steps merges the same rows again to the same result. Where the check fails, table and sidecar stay as they were."""
    batches = finished(spark, sidecar, "batch")
    if not batches:
        return None
    merged = current(spark, folder)
    for b in batches:
        new = spark.read.parquet(f"{sidecar}/batch={b}")
        merged = new if merged is None else merge_new_wins(merged, new, key)
    no = publish(merged, folder, check)
    for b in batches:
        remove(spark, f"{sidecar}/batch={b}")
    return no


def work_list(chunks: DataFrame, cache: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, text): what the cache lacks, each key once (of several texts the greatest). A null key can't be cached."""
    return chunks.where(F.col(key).isNotNull()).join(cache.select(key), key, "left_anti").groupBy(key).agg(F.max("text").alias("text"))


def with_contexts(chunks: DataFrame, cache: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks with context and embed_text (context, a blank line, text); both null where the cache has none or an empty one."""
    known = cache.groupBy(key).agg(F.nullif(F.max("context"), F.lit("")).alias("context"))
    text = F.concat("context", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return chunks.join(known, key, "left").withColumn("embed_text", text)


def cached_contexts(spark: SparkSession, folder: str, key_type: str = "long", key: str = "chunk_id") -> DataFrame:
    """(key, context) of the finished batches of a cache."""
    schema = f"{key} {key_type}, context string"
    found = [f"{folder}/batch={b}" for b in finished(spark, folder, "batch")]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def enrich(chunks: DataFrame, folder: str, context: Column | Callable[[DataFrame], DataFrame], key: str = "chunk_id") -> DataFrame:
    """chunks (key, text) with their contexts, made only for the keys that the cache in `folder` lacks and added to it as one batch.

    `context` is an expression over `text`, or a function from (key, text) to (key, context). A failed context is cached as empty and
    isn't tried again; a batch that died halfway is made anew.
    """
    spark, kind = chunks.sparkSession, dict(chunks.dtypes)[key]
    todo = work_list(chunks, cached_contexts(spark, folder, kind, key), key)
    made = context(todo) if callable(context) else todo.withColumn("context", context)
    no = max(finished(spark, folder, "batch"), default=0) + 1
    made.select(key, F.coalesce("context", F.lit("")).alias("context")).write.mode("overwrite").parquet(f"{folder}/batch={no}")
    return with_contexts(chunks, cached_contexts(spark, folder, kind, key), key)
