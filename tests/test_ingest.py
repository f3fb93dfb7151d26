"""Incremental ingest over several batches, failures and restarts; its state machine; the log."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from oracle import same
from sagelode.plans import catalogue
from sagelode.streaming import ingest, streams

TOKENS = lambda: F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)
DOCS = "doc_id long, text string"
FIRST = [(1, "alpha beta alpha"), (2, "beta gamma"), (3, None), (None, "lost"), (4, "")]
SECOND = [(2, "delta delta"), (5, "alpha 7"), (5, "alpha 7")]


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stands(spark, index):
    posts = ingest.read_part(spark, index, "postings", "doc_id long, token string, tf long")
    docs = ingest.read_part(spark, index, "documents", "doc_id long, n_tokens long, text_sha256 string")
    vecs = ingest.read_part(spark, index, "vectors", "doc_id long, embedding array<float>")
    return tuple(sorted(map(tuple, x.collect())) for x in (posts, docs, vecs))


def run(spark, tmp, name, batches, fail=None):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "doc_id long, embedding array<float>")
    index, failed = f"{tmp}/{name}", False
    for k, rows in enumerate(batches):
        add(spark, tmp / f"{name}-in", rows, DOCS)

        def before(part, no, k=k):
            if fail == (k, part) and not failed:
                raise RuntimeError("executor lost")

        def once():
            stream = ingest.read_stream(spark, f"{tmp}/{name}-in", DOCS)
            ingest.ingest(stream, index, f"{tmp}/{name}-state", TOKENS(), vectors, before).awaitTermination()

        if fail and fail[0] == k:
            with pytest.raises(Exception, match="executor lost"):
                once()
            if k:  # what died halfway doesn't show
                assert stands(spark, index)[0] == [(1, "alpha", 2), (1, "beta", 1), (2, "beta", 1), (2, "gamma", 1)]
            failed = True
        once()
    return stands(spark, index)


def test_batches_failures_and_one_run_give_one_index(spark, tmp_path):
    want = run(spark, tmp_path, "two", [FIRST, SECOND])
    assert want[0] == [(1, "alpha", 2), (1, "beta", 1), (2, "delta", 2), (5, "7", 1), (5, "alpha", 1)]
    assert [(d, n) for d, n, _ in want[1]] == [(1, 3), (2, 2), (3, 0), (4, 0), (5, 2)]
    assert [d for d, _ in want[2]] == [1, 2, 3, 4]
    for part in ("vectors", "postings", "documents"):
        assert run(spark, tmp_path, f"fails-{part}", [FIRST, SECOND], (1, part)) == want
    newest = [r for r in FIRST if r[0] != 2] + SECOND
    assert run(spark, tmp_path, "one", [newest]) == want
    ingest.compact(spark, f"{tmp_path}/two", f"{tmp_path}/compacted")
    assert stands(spark, f"{tmp_path}/compacted") == want
    assert stands(spark, f"{tmp_path}/nowhere") == ([], [], [])


@pytest.mark.parametrize(("size", "batches"), [(10**9, 1), (1, 3)])
def test_batches_by_bytes(spark, tmp_path, size, batches):
    """Files share a batch up to a number of bytes; one is taken at least."""
    for k in range(3):
        add(spark, tmp_path / "in", [(k, f"alpha w{k}")], DOCS)
    stream = ingest.read_stream(spark, f"{tmp_path}/in", DOCS, size=size)
    ingest.ingest(stream, f"{tmp_path}/index", f"{tmp_path}/state", TOKENS()).awaitTermination()
    assert len(ingest.finished(spark, f"{tmp_path}/index/documents", "batch")) == batches
    posts = ingest.read_part(spark, f"{tmp_path}/index", "postings", "doc_id long, token string, tf long")
    assert sorted(map(tuple, posts.collect())) == [x for k in range(3) for x in ((k, "alpha", 1), (k, f"w{k}", 1))]


CHANGES = "doc_id long, status string, ts timestamp"


def test_illegal_stale_late_and_timed_out_changes(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    batches = [
        [(1, "Extracting", at(1)), (1, "Queued", at(0)), (2, "Queued", at(0)), (2, "Chunking", at(2)), (3, "Queued", at(0))],
        [(1, "Cleaning", at(50)), (1, "Queued", at(0.5)), (2, "Failed", at(51)), (3, "Extracting", at(52))],
        [(1, "Chunking", at(150))],
        [(2, "Queued", at(95)), (3, "Cleaning", at(2)), (4, "Queued", at(151))],
        [(4, "Extracting", at(400))],
        [(4, "Cleaning", at(401))],
    ]
    got = []
    for k, rows in enumerate(batches):
        add(spark, tmp_path / "in", rows, CHANGES)
        stream = ingest.read_stream(spark, f"{tmp_path}/in", CHANGES)
        out = ingest.transitions(stream, stall=3600, late="1 hour")
        seen = []
        out.writeStream.foreachBatch(lambda b, no: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got += [(k, d, s, b, v) for d, s, _, b, v in seen]
    took = [x[1:] for x in got]
    for row in [
        (1, "Queued", "", "ok"), (1, "Extracting", "Queued", "ok"), (2, "Chunking", "Queued", "illegal"), (1, "Cleaning", "Extracting", "ok"), (1, "Queued", "Extracting", "stale"),
        (2, "Failed", "Queued", "ok"), (3, "Extracting", "Queued", "ok"), (1, "Chunking", "Cleaning", "ok"), (2, "Queued", "Failed", "ok"), (3, "TimedOut", "Extracting", "timeout"), (1, "TimedOut", "Chunking", "timeout"),
    ]:
        assert took.count(row) == 1, row
    assert (3, "Cleaning", "Extracting", "ok") not in took and (3, "Cleaning", "", "illegal") not in took  # behind the watermark


def test_latest_status(spark):
    rows = [(1, "Queued", datetime(2024, 1, 1)), (1, "Failed", datetime(2024, 1, 2)), (2, "A", datetime(2024, 1, 1)), (2, "B", datetime(2024, 1, 1))]
    assert sorted((r.doc_id, r.status) for r in ingest.latest_status(spark.createDataFrame(rows, CHANGES)).collect()) == [(1, "Failed"), (2, "B")]


def test_log_appends_once_over_restarts(spark, tmp_path):
    for k in range(3):
        add(spark, tmp_path / "in", [(k, f"q{k}")], DOCS)
        for _ in range(2):  # started again with nothing new
            ingest.log_sink(ingest.read_stream(spark, f"{tmp_path}/in", DOCS), f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/log").collect())) == [(k, f"q{k}") for k in range(3)]
    add(spark, tmp_path / "in", [(9, "late")], DOCS)
    running = ingest.log_sink(ingest.read_stream(spark, f"{tmp_path}/in", DOCS), f"{tmp_path}/log", f"{tmp_path}/state", every="1 second")
    running.processAllAvailable()
    running.stop()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4


def test_budget_order_across_arrow_batches(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(days=100 - i), 1, "view", 1.0) for i in range(100)]  # newest first
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        out = streams.drain(streams.budgets(streams.read_table(spark, f"{tmp_path}/events"), 3, 10 * 86_400))
        assert out.where("allowed").count() == 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["incremental_index", "stream_transitions"])
def test_query_equals_sql(spark, name):
    same(catalogue.QUERIES[name](spark, "/root/testdata/sf0.01"), catalogue.ORACLES[name], "/root/testdata/sf0.01")
