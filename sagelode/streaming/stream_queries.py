"""Queries that run a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from . import ingest, streams


def _events(spark, sf):
    return streams.read_table(spark, f"{sf}/events.parquet")


def stream_tumbling(spark, sf):
    out = streams.drain(streams.tumbling_counts(_events(spark, sf)), "complete")
    return out.select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n")


def stream_sliding(spark, sf):
    return streams.drain(streams.sliding_counts(_events(spark, sf)), "complete").select(F.unix_seconds("w.start").alias("start_s"), "n")


def stream_sessions(spark, sf):
    return streams.drain(streams.session_counts(_events(spark, sf)), "complete").select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def stream_budgets(spark, sf):
    """What 20 events a week leave to each user."""
    out = streams.drain(streams.budgets(_events(spark, sf), 20, 7 * 86_400))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("allowed"))


def stream_dedup(spark, sf):
    return streams.drain(streams.deduplicated(_events(spark, sf))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


#: Bytes of files that an ingested batch has.
BATCH = 512_000_000


def incremental_index(spark, sf):
    """Documents ingested as a stream of files with their vectors; of the index that results, each token's documents and
    occurrences, and the tokens of the documents that have a vector."""
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").schema
    # a table may be one file or a folder of part files
    single = spark.read.parquet(f"{sf}/documents.parquet").select("_metadata.file_name").first()
    stream = ingest.read_stream(spark, sf, schema, name="documents.parquet", size=BATCH) if single and single[0] == "documents.parquet" else ingest.read_stream(spark, f"{sf}/documents.parquet", schema, size=BATCH)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    ingest.ingest(stream, f"{root}/index", f"{root}/state", F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1), vectors).awaitTermination()
    posts = ingest.read_part(spark, f"{root}/index", "postings", "doc_id long, token string, tf long")
    own = ingest.read_part(spark, f"{root}/index", "vectors", "doc_id long, embedding array<float>").select("doc_id", F.lit(1).alias("has"))
    posts = posts.join(own, "doc_id", "left")
    return posts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.coalesce(F.sum(F.when(F.col("has") == 1, F.col("tf"))), F.lit(0)).alias("cf_with_vector"))


#: What may follow a kind of event.
EVENT_FLOW = {"": ("view", "signup"), "view": ("click", "error"), "click": ("view", "purchase", "error"), "purchase": ("view", "signup"), "signup": ("view", "error"), "error": ("view", "signup")}


def stream_transitions(spark, sf):
    """Each user's events as changes of a state, held against what may follow what."""
    e = _events(spark, sf).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("status"), "ts")
    out = streams.drain(ingest.transitions(e, EVENT_FLOW, stall=90 * 86_400, late="90 days"))
    return out.select("doc_id", F.unix_micros("ts").alias("ts_us"), "status", "before", "verdict")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_budgets, stream_dedup, incremental_index, stream_transitions)}
_FLOW = ", ".join(f"('{a}', '{b}')" for a, ends in EVENT_FLOW.items() for b in ends)
ORACLES = {
    "stream_tumbling": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT epoch(s)::BIGINT AS start_s, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1",
    "stream_sessions": "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, min(epoch_us(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, sid",
    "stream_dedup": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "incremental_index": """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents), p AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2)
        SELECT token, count(*) AS df, sum(tf)::BIGINT AS cf, coalesce(sum(CASE WHEN vec_id IS NOT NULL THEN tf END), 0)::BIGINT AS cf_with_vector FROM p LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1""",
    "stream_transitions": f"""WITH RECURSIVE flow(a, b) AS (VALUES {_FLOW}),
        e AS (SELECT user_id, event_type AS status, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS n FROM events),
        w AS (SELECT DISTINCT user_id, 0::BIGINT AS n, '' AS now, NULL::BIGINT AS ts_us, NULL::VARCHAR AS status, NULL::VARCHAR AS before, NULL::VARCHAR AS verdict FROM e
            UNION ALL SELECT w.user_id, e.n, CASE WHEN f.a IS NULL THEN w.now ELSE e.status END, e.ts_us, e.status, w.now, CASE WHEN f.a IS NULL THEN 'illegal' ELSE 'ok' END
            FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1 LEFT JOIN flow f ON f.a = w.now AND f.b = e.status)
        SELECT user_id AS doc_id, ts_us, status, before, verdict FROM w WHERE n > 0""",
}
