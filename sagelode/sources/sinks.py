"""Writers: appends, rebuilds, merges by key and bounded histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def rebuild(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def merge_new_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `old` whose key isn't in `new`, and all of `new`."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def newest(df: DataFrame, n: int, order: list, by: list[str] | None = None) -> DataFrame:
    """The n newest rows, of each group of `by` if given."""
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def unexpired(df: DataFrame, ts: str, now, ttl: str) -> DataFrame:
    return df.where(F.col(ts) > F.lit(now) - F.expr(f"INTERVAL {ttl}"))
