"""Structured Streaming over event tables. Each function takes a streaming DataFrame with (event_id, ts, user_id,
event_type, value) and gives one; `drain` runs one over what a source holds now."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import shared_folder


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A folder or file of Parquet as a stream, one file a trigger."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    one = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").limit(2).collect()
    single = len(one) == 1 and one[0].path.rstrip("/").endswith("/" + name)
    df = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def session_counts(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions that each event extends by the gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def over_limit(events: DataFrame, limit: int, width: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Users with more than `limit` events in a window."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") > limit)


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def budgets(events: DataFrame, limit: int, seconds: int, late: str = "1 day") -> DataFrame:
    """(user_id, event_id, used, allowed): a user's budget opens with an event, holds `limit` of them and closes after
    `seconds`; the next event opens another. A user's events are put in order within a trigger, which bounds what a task holds; one that comes later than others of
    its user counts in the budget that is open, and one behind the watermark not at all. State is two numbers a user, and
    goes when the watermark passes the budget's end."""

    def spend(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        own = pd.concat(list(frames))  # all of the trigger: Arrow cuts a group into several frames
        own = own.sort_values(["ts", "event_id"])
        rows = []
        for t, e in zip(own.ts.map(lambda x: int(x.timestamp() * 1e6)), own.event_id, strict=True):
            if start is None or t >= start + seconds * 1_000_000:
                start, used = int(t), 0
            used += 1
            rows.append((key[0], e, used, used <= limit))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "used", "allowed"])
        state.update((start, used))
        state.setTimeoutTimestamp(max(start // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    keyed = events.withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(spend, "user_id long, event_id long, used long, allowed boolean", "start long, used long", "append", GroupStateTimeout.EventTimeTimeout)


def feed(events: DataFrame, path: str, checkpoint: str, keep: int = 50):
    """A batch at a time: appends the batch to the log, and writes the newest `keep` events of the ring before and the batch
    as the ring that a reader replays. A batch that runs again writes the same folders."""

    def write(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={no}")
        new = spark.read.parquet(f"{path}/log/batch={no}")
        before = ring(spark, path, new.schema, no)
        both = new if before is None else before.unionByName(new)
        both.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep).write.mode("overwrite").parquet(f"{path}/ring/batch={no}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ring(spark: SparkSession, path: str, schema=None, before: int | None = None) -> DataFrame | None:
    """The newest ring of a feed, or the newest of the batches below `before`; none where there isn't any."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ring")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    batches = [n for n in (int(x.partition("=")[2]) for x in names if x.startswith("batch=")) if before is None or n < before]
    if not batches:
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/ring/batch={max(batches)}")


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives its result as a table, written a batch at a time in the folder that
    all executors share: the last batch in complete mode, else all of them."""
    root = f"{shared_folder(df.sparkSession)}/drained-{uuid.uuid4().hex}"
    last = []

    def write(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={no}")
        last[:] = [no]

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    where = f"{root}/out/batch={last[0]}" if mode == "complete" and last else f"{root}/out"
    return df.sparkSession.read.schema(df.schema).parquet(where) if last else df.sparkSession.createDataFrame([], df.schema)
