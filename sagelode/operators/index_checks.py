"""Checks of a vector index against its documents, and the gate that an index has to pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import not_finite


def index_faults(vectors: DataFrame, width: int, documents: DataFrame | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_rows, n_bad, faults) for each key of the vectors, and of `documents` (key) if given.

    faults joins what is wrong with `|`, in this order: `no key`, `repeated`, `null vector`, `width`, `not finite` (NaN, infinite or
    null elements), `no document`, `no vector`; empty where nothing is. n_bad counts the elements that aren't finite.
    """
    v = F.col(vector)
    bad = F.coalesce(F.size(F.filter(v, not_finite)), F.lit(0))
    own = vectors.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(v.isNull(), 0).otherwise(bad)).cast("long").alias("n_bad"),
        F.count_if(v.isNull()).alias("_null"),
        F.count_if(v.isNotNull() & (F.size(v) != width)).alias("_width"),
    )
    both = own.withColumn("_doc", F.lit(True))
    if documents is not None:
        both = own.join(documents.select(key).distinct().withColumn("_doc", F.lit(True)), key, "full")
    named = (
        (F.col(key).isNull(), "no key"),
        (F.col("n_rows") > 1, "repeated"),
        (F.col("_null") > 0, "null vector"),
        (F.col("_width") > 0, "width"),
        (F.col("n_bad") > 0, "not finite"),
        (F.col("_doc").isNull(), "no document"),
        (F.col("n_rows").isNull(), "no vector"),
    )
    faults = F.concat_ws("|", *[F.when(c, F.lit(n)) for c, n in named])
    return both.select(key, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"), faults.alias("faults"))


def require_clean(faults: DataFrame, key: str = "vec_id") -> None:
    """Raises ValueError with the number of keys of each combination of faults and the least of them, if there are any."""
    found = faults.where("faults <> ''").groupBy("faults").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least")).orderBy("faults").collect()
    if found:
        raise ValueError("index: " + "; ".join(f"{r.n} x {r.faults}, first {r.least}" for r in found))
