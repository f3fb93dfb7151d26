"""Connected groups of linked ids from shared buckets, without the pairs within a group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_tables, materialize, record_batch, shared_size_join, shuffle_width


def bucket_rows(members: DataFrame) -> DataFrame:
    """From distinct (bucket long, id long): rows (bucket, leader, id) of the buckets with two ids or more. The leader is the id
    of the least of two hashes, by the parity of the bucket: buckets that a group of ids shares have few leaders between them. Each bucket's
    ids stream past in that order: a bucket of any size needs the memory of a batch."""
    schema = pa.schema([("bucket", pa.int64()), ("leader", pa.int64()), ("id", pa.int64())])

    def run(batches):
        held = None  # the row before: bucket, id, its bucket's leader, whether it was sent
        for batch in batches:
            k, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "id"))
            if not len(k):
                continue
            if held is not None:
                k, i = np.concatenate(([held[0]], k)), np.concatenate(([held[1]], i))
            new = np.concatenate(([True], k[1:] != k[:-1]))
            leader = i[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
            if held is not None:
                leader[k == held[0]] = held[2]
            shared = ~new
            shared[:-1] |= ~new[1:]
            sent = held is not None and held[3]
            send = shared.copy()
            send[0] &= not sent
            held = (k[-1], i[-1], leader[-1], bool(shared[-1] or (len(k) == 1 and sent)))
            if send.any():
                yield record_batch({"bucket": k[send], "leader": leader[send], "id": i[send]}, schema)

    draw = F.xxhash64(F.pmod("bucket", F.lit(2)), "id")
    dealt = members.repartition(shuffle_width(members.sparkSession), "bucket").sortWithinPartitions("bucket", draw)
    return dealt.mapInArrow(run, "bucket long, leader long, id long")


def _with_component(rows: DataFrame, components: DataFrame) -> DataFrame:
    """`rows` (id, ...) and the component of each id, itself where it has none yet."""
    return shared_size_join(rows, components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def merged_components(known: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """The components (node, component) that `known` and further `edges` (a, b) make: only the components that an edge
    connects are walked, not their ids again. `known` and `edges` are materialised."""
    root = lambda t, end: _with_component(t.withColumnRenamed(end, "id"), known).withColumnRenamed("component", end).drop("id")
    moved = connected_components(root(root(edges.select("a", "b"), "a"), "b"), f"{label}-moved")
    to = moved.toDF("component", "to")
    old = shared_size_join(known, to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = materialize(old.unionByName(moved.join(known.select("node"), "node", "left_anti")), label)
    drop_tables(moved)
    return out


def _outsiders(own: DataFrame, leaders: int, seed: int) -> DataFrame:
    """Pairs (a, b) of ids outside the largest component of their bucket with `leaders` ids of that component, drawn by
    hashes that all buckets share. `own` has (bucket, id, component)."""
    drawn = F.array(*[F.min(F.struct(F.xxhash64(F.lit(seed + j), "id").alias("h"), "id")).getField("id") for j in range(leaders)])
    sizes = own.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), drawn.alias("leaders"))
    largest = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "component", "leaders")).alias("m")).where("k > 1")
    outside = own.join(largest.select("bucket", "m.component", "m.leaders").withColumnRenamed("component", "main"), "bucket").where("component <> main")
    pairs = outside.select("id", F.explode("leaders").alias("leader"))
    return pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def linked_components(
    members: DataFrame,
    marks: DataFrame,
    near: Callable[[str, str], Column],
    confirm: Callable[[DataFrame], DataFrame],
    label: str,
    block: int = 1024,
    rounds: tuple = (2,),
    few: int = 8,
    finer: tuple[Callable[[DataFrame], DataFrame], Callable[[str, str], Column]] | None = None,
) -> DataFrame:
    """Rows (node, component) of the ids that are linked: two ids link when they share a bucket, `near` holds for their
    marks and `confirm` keeps their pair.

    `members` has distinct (bucket, id), `marks` (id, mark); near(x, y) is a condition on two mark columns, and
    confirm(pairs of a < b) gives the pairs that link. First each id is held against the leaders of its buckets only.
    In each of `rounds`, ids outside the largest component of a bucket of more than `few` are held against that many more ids of it;
    smaller buckets have few pairs. What is still apart is held against each other: pairs of one bucket in different components, by a join on
    bucket and salt, where a bucket is dealt to one salt per `block` ids. A pair counts in the least bucket that it shares, and
    a bucket of two ids not at all, as its one pair was held first.
    `finer` may give further marks (id, mark) for the rows (id) that are left, and a condition on them besides near. So no link is lost, and a group of like ids costs a few pairs for each id, not all its pairs.
    """
    shared = materialize(bucket_rows(members), f"{label}-buckets")
    ids = materialize(shared.select("id").distinct(), f"{label}-ids")
    marks = materialize(shared_size_join(marks, ids, "id"), f"{label}-marks")
    x, y = (marks.select(F.col("id").alias(i), F.col("mark").alias(m)) for i, m in (("a", "x"), ("b", "y")))

    def links(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialize(pairs.join(x, "a").join(y, "b").where(near("x", "y")).select("a", "b"), f"{label}-{name}")
        out = materialize(confirm(pairs).select("a", "b"), f"{label}-{name}-links")
        drop_tables(pairs)
        return out

    stars = shared.where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    edges = links(stars, "stars")
    known = connected_components(edges, f"{label}-near")
    own = shared.select("bucket", "id")
    used = [shared, ids, marks, edges]
    for k, leaders in enumerate(rounds):
        own = _with_component(own, known)
        apart = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("n > 2 AND lo <> hi").select("bucket", "n")
        own = materialize(own.join(apart, "bucket"), f"{label}-own")
        edges = links(_outsiders(own.where(F.col("n") > few), leaders, 100 * (k + 1)), f"round-{k}")
        used += [own, edges, known]
        own = own.select("bucket", "id")
        if not edges.isEmpty():
            known = merged_components(known, edges, f"{label}-near")

    own = _with_component(own, known)
    mixed = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("n > 2 AND lo <> hi")
    own = materialize(own.join(mixed.select("bucket", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("salts")), "bucket"), f"{label}-apart")
    keys = materialize(own.groupBy("id").agg(F.collect_set("bucket").alias("keys")), f"{label}-keys")  # no more than an id has buckets
    drop_tables(*{t.written: t for t in used if t is not marks and t is not known}.values())
    used = [marks, own, keys]
    marks = marks.join(keys, "id")
    if finer:
        more = materialize(finer[0](keys.select("id")).withColumnRenamed("mark", "more"), f"{label}-finer")
        marks = marks.join(more, "id")
        used.append(more)
    own = materialize(own.join(marks.select("id", F.struct(*[c for c in marks.columns if c != "id"]).alias("m")), "id"), f"{label}-apart-marks")
    left = own.select("bucket", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("a"), F.col("component").alias("ca"), F.col("m").alias("p"))
    right = own.select("bucket", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.col("id").alias("b"), F.col("component").alias("cb"), F.col("m").alias("q"))
    alike = near("p.mark", "q.mark") & (F.array_min(F.array_intersect("p.keys", "q.keys")) == F.col("bucket"))
    if finer:
        alike = alike & finer[1]("p.more", "q.more")
    cross = left.join(right, ["bucket", "salt"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike).select("a", "b")
    cross = materialize(cross, f"{label}-cross")
    edges = materialize(confirm(cross).select("a", "b"), f"{label}-cross-links")
    out = merged_components(known, edges, f"{label}-all")
    drop_tables(*{t.written: t for t in (*used, known, own, cross, edges)}.values())
    return out
