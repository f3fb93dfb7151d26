"""Streams over several files."""

import datetime as dt

from pyspark.sql import functions as F

from sagelode.streaming import streams

AT = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _write(spark, path, files):
    for n, rows in enumerate(files):
        spark.createDataFrame([(e, AT + dt.timedelta(seconds=s), u, "view", 1.0) for e, s, u in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return streams.read_table(spark, path)


def test_the_ring_keeps_what_came_before(spark, tmp_path):
    events = _write(spark, f"{tmp_path}/in", [[(i, i, 1) for i in range(10)], [(100, 3, 2)], [(101, 50, 2), (102, 51, 2)]])
    streams.feed(events, f"{tmp_path}/out", f"{tmp_path}/state", keep=5).awaitTermination()
    assert sorted(r.event_id for r in streams.ring(spark, f"{tmp_path}/out").collect()) == [7, 8, 9, 101, 102]
    assert spark.read.parquet(f"{tmp_path}/out/log").count() == 13
    assert streams.ring(spark, f"{tmp_path}/none") is None


def test_over_limit(spark, tmp_path):
    events = _write(spark, f"{tmp_path}/in", [[(i, i, 1) for i in range(20)] + [(50 + i, i, 2) for i in range(3)], [(90 + i, 5, 2) for i in range(3)]])
    got = streams.drain(streams.over_limit(events, 5), "complete").select("user_id", "n").collect()
    assert sorted(map(tuple, got)) == [(1, 20), (2, 6)]


def test_budgets_go_on_over_triggers(spark, tmp_path):
    events = _write(spark, f"{tmp_path}/in", [[(1, 0, 7), (2, 10, 7), (3, 20, 7)], [(4, 30, 7), (5, 100, 7)], [(6, 101, 8)]])
    out = streams.drain(streams.budgets(events, 3, 60)).orderBy("event_id").select("event_id", "used", "allowed").collect()
    assert sorted(map(tuple, out)) == [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, False), (5, 1, True), (6, 1, True)]
    assert streams.drain(streams.deduplicated(events)).agg(F.count("*")).first()[0] == 6
