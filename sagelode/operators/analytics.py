"""Usage figures, inventories, histories and evaluation of ranked runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition: Column, digits: int = 1) -> Column:
    """Per cent of the rows where the condition holds."""
    return F.round(100.0 * F.count_if(condition) / F.count(F.lit(1)), digits)


def daily_counts(df: DataFrame, ts: str, days: int) -> DataFrame:
    """(day, n) of the last days up to the latest one, oldest first, 0 where nothing happened."""
    last = df.agg(F.max(F.to_date(ts)).alias("last"))
    span = last.select(F.explode(F.expr(f"sequence(last - INTERVAL {days - 1} DAYS, last, INTERVAL 1 DAY)")).alias("day"))
    n = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return span.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def versions(df: DataFrame, key: str, order: list) -> DataFrame:
    """Adds version (from 1) and status: the latest row of a key is active, the others archived."""
    w = Window.partitionBy(key)
    v = F.row_number().over(w.orderBy(*order)).cast("long")
    return df.withColumn("version", v).withColumn("status", F.when(F.col("version") == F.count(F.lit(1)).over(w), "active").otherwise("archived"))


def latest(df: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def anchored_windows(df: DataFrame, user: str, ts: str, seconds: int) -> DataFrame:
    """Adds started: each user's first event starts a window of `seconds`, and the first event after its end the next.
    A user's events are folded in order of time; a user is one group, of that user's own events."""
    ordered = df.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), "event_id"))).alias("e"))
    width = seconds * 1_000_000
    start = F.lit(None).cast("long")
    step = lambda acc, x: F.struct(
        F.when(acc["start"].isNull() | (x["t"] >= acc["start"] + width), x["t"]).otherwise(acc["start"]).alias("start"),
        F.array_append(acc["out"], F.when(acc["start"].isNull() | (x["t"] >= acc["start"] + width), x["t"]).otherwise(acc["start"])).alias("out"),
    )
    folded = F.aggregate("e", F.struct(start.alias("start"), F.array().cast("array<bigint>").alias("out")), step, lambda acc: acc["out"])
    rows = ordered.select(user, F.explode(F.arrays_zip("e", folded.alias("s"))).alias("z"))
    return rows.select(user, F.col("z.e.event_id").alias("event_id"), F.col("z.s").alias("started"))


def best_ranks(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, stage, best): the best rank of any gold row at each stage."""
    return runs.join(gold, ["query_id", "chunk_id"]).groupBy("query_id", "stage").agg(F.min("rank").alias("best"))


def recall_and_mrr(best: DataFrame, n_queries: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """Recall over all queries and mean reciprocal rank over those with a hit, for each stage."""
    agg = [F.count_if(F.col("best") <= k).alias(f"hit{k}") for k in ks] + [F.avg(1.0 / F.col("best")).alias("mrr")]
    out = best.groupBy("stage").agg(*agg).crossJoin(F.broadcast(n_queries))  # one row
    return out.select("stage", *[F.round(F.col(f"hit{k}") / F.col("n"), 6).alias(f"recall_{k}") for k in ks], F.round("mrr", 6).alias("mrr"))


def first_failure(best: DataFrame, queries: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, n): of each query the first stage, in order, where no gold row is left; "generation" if none."""
    order = F.array(*[F.lit(s) for s in stages])
    seen = queries.select("query_id").join(best.groupBy("query_id").agg(F.collect_set("stage").alias("s")), "query_id", "left")
    lost = F.filter(order, lambda x: ~F.array_contains(F.coalesce("s", F.array().cast("array<string>")), x))
    return seen.select(F.coalesce(F.get(lost, F.lit(0)), F.lit("generation")).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def verdict(found: Column, total: Column) -> Column:
    pct = F.round(100.0 * found / total)
    return F.when(pct >= 80, "pass").when(pct >= 50, "partial").otherwise("fail")


def merge_overlay(base: DataFrame, overlay: DataFrame, key: str, arrays: list[str], weight: str) -> DataFrame:
    """Full outer join on the key: arrays united in order, the greater weight wins."""
    a, b = base.alias("a"), overlay.alias("b")
    empty = F.array().cast("array<string>")
    cols = [F.array_union(F.coalesce(F.col(f"a.{c}"), empty), F.coalesce(F.col(f"b.{c}"), empty)).alias(c) for c in arrays]
    on = F.col(f"a.{key}") == F.col(f"b.{key}")
    return a.join(b, on, "full").select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *cols, F.greatest(F.col(f"a.{weight}"), F.col(f"b.{weight}")).alias(weight))


def bands(c: Column, limits: list[tuple[float, str]], last: str) -> Column:
    return reduce(lambda rest, x: F.when(c < x[0], x[1]).otherwise(rest), reversed(limits), F.lit(last))
