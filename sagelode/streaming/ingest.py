"""Incremental ingest: new files become postings, lengths and vectors of an index, a batch at a time; its states, and a log.

Each batch writes folders of its own number and nothing else, so a batch that runs again after a failure replaces what it
wrote. A document that comes again supersedes its earlier version when the index is read.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.versions import finished

PARTS = ("documents", "postings", "vectors")


def read_stream(spark: SparkSession, folder: str, schema, files: int = 1, name: str | None = None, size: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream: `files` a trigger, or, with `size`, as many as have so many bytes, one at least. A
    batch of one file leaves most of a cluster idle, and batches run one after another."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxBytesPerTrigger", size) if size else reader.option("maxFilesPerTrigger", files)
    return (reader.option("pathGlobFilter", name) if name else reader).parquet(folder)


def index_batch(batch: DataFrame, tokens: Column, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a batch of (doc_id, text) adds: documents (doc_id, n_tokens, text_sha256), postings (doc_id, token, tf) and
    vectors (doc_id, embedding). Of rows that repeat a doc_id the one of the greatest text counts; a null doc_id has no place in an index. A text
    without tokens has a length of 0 and no postings."""
    own = batch.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    cut = own.select("doc_id", "text", tokens.alias("t"))
    out = {
        "documents": cut.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2("text", 256).alias("text_sha256")),
        "postings": cut.select("doc_id", F.explode("t").alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf")),
    }
    if vectors is not None:
        out["vectors"] = own.select("doc_id").join(vectors.select("doc_id", "embedding"), "doc_id")
    return out


def ingest(stream: DataFrame, index: str, checkpoint: str, tokens: Column, vectors: DataFrame | None = None, before: Callable[[str, int], None] | None = None):
    """Starts a query that adds all that the stream holds to the index in the folder `index`, and stops. The
    documents of a batch are written last: only batches that have them are read, so one that died halfway shows nothing.
    before(part, batch number) is called ahead of each write."""

    def write(batch: DataFrame, no: int) -> None:
        batch.persist()  # read for each part
        made = index_batch(batch, tokens, vectors)
        for part in reversed(PARTS):
            if part in made:
                if before:
                    before(part, no)
                made[part].write.mode("overwrite").parquet(f"{index}/{part}/batch={no}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_part(spark: SparkSession, index: str, part: str, schema: str) -> DataFrame:
    """A part of the index as it stands: of each document the newest version, from finished batches."""
    batches = finished(spark, f"{index}/documents", "batch")
    if not batches:
        return spark.createDataFrame([], schema)

    def of(name, fields):
        found = [f"{index}/{name}/batch={b}" for b in batches]
        return spark.read.schema(f"{fields}, batch int").option("basePath", f"{index}/{name}").parquet(*found)

    newest = of("documents", "doc_id long").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return of(part, schema).join(newest, ["doc_id", "batch"]).drop("batch")


def compact(spark: SparkSession, index: str, to: str) -> None:
    """Writes the index as it stands into the folder `to` as one batch, without superseded versions."""
    for part, schema in (("vectors", "doc_id long, embedding array<float>"), ("postings", "doc_id long, token string, tf long"), ("documents", "doc_id long, n_tokens long, text_sha256 string")):
        if part != "vectors" or finished(spark, f"{index}/vectors", "batch"):
            read_part(spark, index, part, schema).write.mode("overwrite").parquet(f"{to}/{part}/batch=0")


#: The states of a document's ingest in order (fixed values); any of them may end in Failed.
STATES = ("Queued", "Extracting", "Cleaning", "Chunking", "Embedding", "Indexing", "Refreshing", "Completed")
#: state -> states that may follow
FLOW = {a: (b, "Failed") for a, b in zip(STATES, STATES[1:], strict=False)} | {"": ("Queued",), "Failed": ("Queued",), "Completed": ("Queued",), "TimedOut": ("Queued",)}


def transitions(changes: DataFrame, flow: dict = FLOW, stall: int = 3600, late: str = "1 hour", ends: tuple = ("Completed", "Failed")) -> DataFrame:
    """(doc_id, status, ts, before, verdict): each change of (doc_id, status, ts) held against the state of its document.

    verdict is `ok` where `flow` permits the status after the state before, and the state becomes it; `illegal` where it doesn't, `stale` where
    the change is older than the last one taken; neither changes the state. A document that stands still for `stall` seconds of event time
    outside `ends` gives a row `TimedOut`, and starts anew. Changes behind the watermark are dropped by Spark. A document's changes
    are put in order within a trigger.
    """
    known = {k: tuple(v) for k, v in flow.items()}

    def run(key, frames, state: GroupState):
        now, since = state.get if state.exists else ("", None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "status": ["TimedOut"], "ts": [pd.Timestamp(since, unit="us")], "before": [now], "verdict": ["timeout"]})
            return
        rows = []
        for status, ts in pd.concat(list(frames)).sort_values(["ts", "status"])[["status", "ts"]].itertuples(index=False):
            at = int(ts.value // 1000)
            verdict = "stale" if since is not None and at < since else "ok" if status in known.get(now, ()) else "illegal"
            rows.append((key[0], status, ts, now, verdict))
            if verdict == "ok":
                now, since = status, at
        if since is not None:
            state.update((now, since))
            if now not in ends:
                state.setTimeoutTimestamp(max(since // 1000 + stall * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["doc_id", "status", "ts", "before", "verdict"])

    keyed = changes.select("doc_id", "status", "ts").withWatermark("ts", late).groupBy("doc_id")
    return keyed.applyInPandasWithState(run, "doc_id long, status string, ts timestamp, before string, verdict string", "now string, since long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_status(changes: DataFrame) -> DataFrame:
    """(doc_id, status, ts): the newest change of each document, of equal times the greatest status."""
    newest = F.max(F.struct("ts", "status")).alias("m")
    return changes.groupBy("doc_id").agg(newest).select("doc_id", "m.status", "m.ts")


def log_sink(rows: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Starts a query that appends the stream to a Parquet log, exactly once over restarts: the sink's own commit log says which
    files count. With `every` a batch begins after each such time; without, all that is there is taken and the query ends."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def order_of_changes(events: DataFrame) -> DataFrame:
    """(doc_id, status, ts) from event rows: an event's user is the document."""
    return events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"))

