"""Edges between keys: co-citation, hierarchy, walks of bounded depth, levels."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .containment import above


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; in local mode, where none is set, a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="sagelode-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and cuts the lineage, so that plans of loops don't grow."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def width(spark: SparkSession, rows: int, each: int = 2_000_000) -> int:
    """Partitions for so many rows: those of the session's shuffles, more where a task would have over `each` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def spread_join(left: DataFrame, right: DataFrame, key: str, each: int = 250) -> DataFrame:
    """The inner join on `key` where few keys may have many rows on both sides: a key's rows of `left` are dealt into blocks of about `each`,
    its rows of `right` copied to each block, and blocks are dealt over more tasks the more rows come out. A copy of `right` serves
    `each` rows of `left`, so what is shuffled is small beside what is joined."""
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("_m")), key)
    sizes = settled(sizes.select(key, F.ceil(F.col("_n") / each).cast("long").alias("_blocks"), (F.col("_n") * F.col("_m")).alias("_rows")))
    rows = sizes.agg(F.sum("_rows")).first()[0] or 0
    n = width(left.sparkSession, rows)
    a = left.join(sizes.select(key, "_blocks"), key)
    a = a.withColumn("_block", F.pmod(F.xxhash64(*left.columns), F.col("_blocks"))).drop("_blocks").repartition(n, key, "_block")
    b = right.join(sizes.select(key, "_blocks"), key)
    b = b.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks").repartition(n, key, "_block")
    return a.join(b, [key, "_block"]).drop("_block")


def co_citation(pairs: DataFrame, doc: str, key: str) -> DataFrame:
    """(src, dst, n): keys cited in the same document, both ways, with the number of documents. A document cites a bounded number of
    keys; the pairs of all documents are counted first, so that those a task adds up stay bounded as well."""
    one = pairs.select(doc, key).distinct()
    total = one.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0
    both = one.join(one.withColumnRenamed(key, "dst"), doc).where(F.col(key) != F.col("dst")).select(F.col(key).alias("src"), "dst")
    return both.repartition(width(pairs.sparkSession, total), "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def symmetric(edges: DataFrame, relations: list[str]) -> DataFrame:
    """Adds the reverse of the edges of some relations."""
    back = edges.where(F.col("relation").isin(*relations)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")
    return edges.select("src", "dst", "relation").unionByName(back).distinct()


def without_existing(edges: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges that aren't there yet in either direction."""
    known = existing.select("src", "dst").unionByName(existing.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return edges.join(known, ["src", "dst"], "left_anti")


#: Nodes reached by a seed that go with it as a list, so that its next step needs no shuffle.
LISTED = 16


def walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hops): nodes within `depth` steps of each seed, at the fewest. Each step joins the frontier and leaves
    out what was reached before.

    A seed whose frontier is one node can't reach a node twice in a step: with at most `LISTED` nodes reached, its next step is made and
    held against the list of them within the rows, however many they become. The others' are made distinct and held against what
    was reached by shuffles.
    """
    reached = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops"))
    frontier = reached
    step = edges.select(F.col("src").alias("node"), "dst").distinct()
    for d in range(1, depth + 1):
        fronts = frontier.groupBy("seed").agg(F.count(F.lit(1)).alias("_n"))
        lists = reached.groupBy("seed").agg(F.count(F.lit(1)).alias("_r")).join(fronts, "seed").where((F.col("_n") == 1) & (F.col("_r") <= LISTED)).select("seed")
        lists = settled(reached.join(lists, "seed").groupBy("seed").agg(F.collect_list("node").alias("_known")))
        alone = frontier.select("seed", "node").join(lists, "seed")
        ahead = spread_join(alone, step, "node").where(~F.array_contains("_known", F.col("dst"))).select("seed", F.col("dst").alias("node"))
        rest = frontier.select("seed", "node").join(lists.select("seed"), "seed", "left_anti")
        new = spread_join(rest, step, "node").select("seed", F.col("dst").alias("node")).distinct()
        new = ahead.unionByName(new.join(reached.select("seed", "node"), ["seed", "node"], "left_anti")).withColumn("hops", F.lit(d))
        frontier = new if d == depth else settled(new)
        reached = reached.unionByName(frontier)
    return reached


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): 0 without predecessors, else one more than the greatest of theirs. Nodes on a cycle, or behind one, have none."""
    left = nodes.select("node").distinct()
    rest = edges.select("src", "dst").distinct()
    done = None
    for d in itertools.count():
        free = left.join(rest.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(d))
        free = settled(free)
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = settled(left.join(free.select("node"), "node", "left_anti"))
        rest = settled(rest.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
    out = nodes.select("node").distinct()
    return out.join(done, "node", "left") if done is not None else out.withColumn("level", F.lit(None).cast("int"))


def base_key(key: Column) -> Column:
    """The first three parts of a section's or rule's key that has more, else null."""
    parts = F.split(key, "_")
    return F.when(key.rlike("_(SEC|RUL|RULE)_") & (F.size(parts) > 3), F.array_join(F.slice(parts, 1, 3), "_"))


def related(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(query_id, node, hops, weight): what `seeds` (query_id, node) reach over `edges` (src, dst, weight) in at most `depth` steps, at
    the fewest steps, with the greatest product of weights of a path; the seeds of the query are left out. A node also goes the ways of its
    base key. Weights lie in (0, 1], so only a node's better path goes on.
    """
    step = edges.groupBy(F.col("src").alias("node"), "dst").agg(F.max("weight").alias("_w"))
    own = seeds.select("query_id", "node").distinct()
    best = frontier = own.select("query_id", "node", F.lit(0).alias("hops"), F.lit(1.0).alias("weight"))
    for d in range(1, depth + 1):
        ways = F.array_distinct(F.array_compact(F.array("node", base_key(F.col("node")))))
        starts = frontier.select("query_id", F.explode(ways).alias("node"), "weight")
        new = starts.join(step, "node").groupBy("query_id", F.col("dst").alias("node")).agg(F.max(F.col("weight") * F.col("_w")).alias("weight"))
        known = best.select("query_id", "node", F.col("weight").alias("_known"))
        frontier = new.join(known, ["query_id", "node"], "left").where("_known IS NULL OR _known < weight").select("query_id", "node", F.lit(d).alias("hops"), "weight")
        frontier = settled(frontier)
        best = settled(best.unionByName(frontier).groupBy("query_id", "node").agg(F.min("hops").alias("hops"), F.max("weight").alias("weight")))
    return best.join(own, ["query_id", "node"], "left_anti")


def expanded(found: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, chunk_id, node, hops, weight): rows of `pool` (chunk_id, keys) with a key that is a related node (`found`, of `related`) or
    lies under it; the node named is the one of the greatest weight, then the fewest hops, then the least."""
    own = pool.select("chunk_id", F.explode("keys").alias("k")).select("chunk_id", F.explode(above(F.col("k"))).alias("node")).distinct()
    best = F.min(F.struct((-F.col("weight")).alias("w"), "hops", "node")).alias("b")
    return found.join(own, "node").groupBy("query_id", "chunk_id").agg(best).select("query_id", "chunk_id", "b.node", "b.hops", (-F.col("b.w")).alias("weight"))


def root_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, path): the way from the root to each of `nodes` (node) over `edges` (child, parent), root first. It ends below a parent
    that would close a cycle; of several parents the least counts."""
    up = edges.groupBy(F.col("child").alias("_top")).agg(F.min("parent").alias("parent"))
    left = nodes.select("node").distinct().select("node", F.array("node").alias("path"), F.col("node").alias("_top"))
    done = None
    while True:
        left = settled(left.join(up, "_top", "left").withColumn("parent", F.when(~F.array_contains("path", F.col("parent")), F.col("parent"))))
        ended = left.where("parent IS NULL").select("node", "path")
        done = ended if done is None else done.unionByName(ended)
        left = left.where("parent IS NOT NULL").select("node", F.concat(F.array("parent"), "path").alias("path"), F.col("parent").alias("_top"))
        if left.isEmpty():
            return done
