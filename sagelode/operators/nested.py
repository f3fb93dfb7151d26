"""Documents that hold arrays of records: pushes into them by key and in order, and filtered pages of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled

#: Order of messages that are pushed together; rows equal in all of it may change places.
ORDER = ("ts", "role", "content")


def positions(df: DataFrame, by: str, order: tuple[str, ...], name: str = "position") -> DataFrame:
    """df with the number of each row among those of its `by`, from 0, in `order`.

    Rows go to ranges of (by, order), are numbered within their range, and the counts of the ranges before are added: a group of any size is
    spread over tasks, unlike in one window by key.
    """
    cut = settled(df.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    own = cut.withColumn("_at", F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)) - 1)
    return own.join(counts.drop("_n"), [by, "_range"]).withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_before", "_at")


def blocks(messages: DataFrame, size: int = 1000) -> DataFrame:
    """(session_id, block, messages, updated_at): rows (session_id, position, role, content, ts) as arrays of at most `size` records, in
    order of position, so that no session is one value however long it grows."""
    record = F.struct("position", "role", "content", "ts")
    out = messages.groupBy("session_id", F.floor(F.col("position") / size).cast("long").alias("block"))
    return out.agg(F.sort_array(F.collect_list(record)).alias("messages"), F.max("ts").alias("updated_at"))


def pushed(held: DataFrame, sessions: DataFrame, new: DataFrame, size: int = 1000) -> DataFrame:
    """The blocks `held` with the rows `new` (session_id, role, content, ts) put behind them.

    Rows whose session isn't in `sessions` (session_id), and rows of null or blank content, are left out. Only the last block of
    a session that grows is taken apart. The result is to be written before the next push, since `held` is read several times. Messages pushed together go by time, role and content, behind all that was there, whatever its time.
    """
    own = new.where(F.trim("content") != "").select("session_id", "role", "content", "ts").join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    last = held.groupBy("session_id").agg(F.max("block").alias("block")).join(own.select("session_id").distinct(), "session_id", "left_semi")
    ends = held.join(last, ["session_id", "block"], "left_semi")
    base = ends.select("session_id", (F.col("block") * size + F.size("messages")).alias("_base"))
    placed = positions(own, "session_id", ORDER).join(base, "session_id", "left").withColumn("position", F.col("position") + F.coalesce("_base", F.lit(0)))
    opened = ends.select("session_id", F.explode("messages").alias("m")).select("session_id", "m.*")
    made = blocks(opened.unionByName(placed.drop("_base")), size)
    return held.join(last, ["session_id", "block"], "left_anti").unionByName(made)


def find(df: DataFrame, equal: dict | None = None, like: dict | None = None, sort: list | None = None, skip: int = 0, limit: int = 20, without: tuple = ()) -> DataFrame:
    """A page of the rows whose columns equal the values of `equal` and match the patterns of `like`, whatever the case; null or empty
    values set no condition. `sort` must be a total order for pages that don't overlap."""
    for c, value in (equal or {}).items():
        df = df.where(F.col(c) == value) if value else df
    for c, pattern in (like or {}).items():
        df = df.where(F.col(c).rlike(f"(?i){pattern}")) if pattern else df
    return (df.orderBy(*sort) if sort else df).offset(skip).limit(limit).drop(*without)
