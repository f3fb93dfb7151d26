"""Conversation prefix trie: MSD radix partitioning over dictionary-encoded turns, multikey quicksort of what is local.

A bucket holds the distinct conversations that share a prefix. Each round counts the buckets; one of more than `local` turns
is split by the turn after its longest common prefix, the others wait. Splitting emits the nodes of the common
prefix. When all are local, each is finished in a task by multikey quicksort, whose recursion emits the nodes
below, and the totals of subtrees go back up through the split buckets.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_tables, materialize, record_batch, shared_size_join, shuffle_width, table

_LONGS = pa.list_(pa.int64())
_KEY = ["pconv", "depth", "sym"]
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NONE = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Trie:
    """A bucket of more than `local` turns is split; a task finishes bunches of buckets of about `bunch` turns. Decimal
    conv_ids of one sequence are hashed in stretches of `stretch`."""

    local: int = 10_000
    bunch: int = 20_000
    stretch: int = 20_000


def encoded(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, t array<struct<..., id, words>>) of conversations in order of their turns; id numbers the
    distinct (role, text), words counts [^\\x20\\x09-\\x0D]+ of the text."""
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    entries = rows.select("role", "text").distinct().select("role", "text", F.monotonically_increasing_id().alias("id"), words.alias("words"))
    entries = materialize(entries, "turn-dictionary")
    coded = rows.join(entries, ["role", "text"]).select("conv_id", F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), "role", F.xxhash64("text"), "id", "words").alias("t"))
    out = materialize(coded.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words")), "conversations")
    drop_tables(entries)
    return out


def rebuilt(convs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Rows (conv_id, ids, words): the first h turns of the conversation that leads each `family` of ids, then the own turns
    after the first h, h = crc32(conv_id) mod `most`."""
    conv = F.col("conv_id")
    firsts = convs.where(F.pmod(conv, F.lit(family)) == 0).select(conv.alias("lead"), F.slice("ids", 1, most - 1).alias("lead_ids"), F.slice("words", 1, most - 1).alias("lead_words"))
    h = (F.crc32(conv.cast("string").cast("binary")) % most).cast("int")
    both = convs.withColumn("h", h).withColumn("lead", conv - F.pmod(conv, F.lit(family))).join(firsts, "lead", "left")
    none = F.array().cast("array<long>")
    parts = lambda c: F.concat(F.slice(F.coalesce(F.col(f"lead_{c}"), none), F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(1))))
    return both.select("conv_id", parts("ids").alias("ids"), parts("words").alias("words"))


def distinct_sequences(convs: DataFrame, cfg: Trie = Trie()) -> DataFrame:
    """Rows (ids, words, n, conv, ends): each distinct sequence once, with how many conversations are it, the least of them and
    the hash of their ids. Conversations are dealt by ranges of conv_id, and each task sends a sequence's ids as
    stretches of text, so a sequence that all have moves as few rows, which stream through the hash in order."""
    stretch = cfg.stretch
    part = pa.schema([("ids", _LONGS), ("words", _LONGS), ("n", pa.int64()), ("conv", pa.int64()), ("text", pa.string())])
    whole = pa.schema([("ids", _LONGS), ("words", _LONGS), ("n", pa.int64()), ("conv", pa.int64()), ("ends", pa.string())])

    def stretches(batches):
        held, own = None, []

        def row():
            return (*held, len(own), own[0], ",".join(map(str, own)))

        for b in batches:
            out = []
            for conv, ids, words in zip(*(b.column(c).to_pylist() for c in ("conv_id", "ids", "words")), strict=True):
                if held is not None and (ids != held[0] or len(own) >= stretch):
                    out.append(row())
                    own = []
                held = (ids, words)
                own.append(conv)
            if out:
                yield record_batch(dict(zip(part.names, zip(*out, strict=True), strict=True)), part)
        if own:
            yield record_batch(dict(zip(part.names, zip(row(), strict=True), strict=True)), part)

    def hashes(batches):
        held = None  # ids, words, n, conv, running hash

        def row():
            return (*held[:4], held[4].hexdigest())

        for b in batches:
            out = []
            for ids, words, n, conv, text in zip(*(b.column(c).to_pylist() for c in part.names), strict=True):
                if held is not None and ids == held[0]:
                    held[2] += n
                    held[4].update(b",")
                else:
                    if held is not None:
                        out.append(row())
                    held = [ids, words, n, conv, hashlib.sha256()]
                held[4].update(text.encode())
            if out:
                yield record_batch(dict(zip(whole.names, zip(*out, strict=True), strict=True)), whole)
        if held is not None:
            yield record_batch(dict(zip(whole.names, zip(row(), strict=True), strict=True)), whole)

    wide = shuffle_width(convs.sparkSession)
    sent = convs.repartitionByRange(wide, "conv_id").sortWithinPartitions("ids", "conv_id").mapInArrow(stretches, "ids array<long>, words array<long>, n long, conv long, text string")
    return sent.repartition(wide, "ids").sortWithinPartitions("ids", "conv").mapInArrow(hashes, "ids array<long>, words array<long>, n long, conv long, ends string")


class _Nodes:
    """Nodes as they are emitted, parents before children; totals of subtrees are added up backwards."""

    def __init__(self):
        self.rows = []  # conv, depth, parent, parent's conv, n, own tokens, ends

    def add(self, conv, depth, parent, parent_conv, n, words) -> int:
        self.rows.append([conv, depth, parent, parent_conv, n, 0, 0, (n - 1) * words, _NONE])
        return len(self.rows) - 1

    def finished(self) -> list[tuple]:
        out = []
        for conv, depth, parent, parent_conv, n, children, leaves, saved, ends in reversed(self.rows):
            leaves = leaves or 1
            if parent is not None:
                above = self.rows[parent]
                above[5] += 1
                above[6] += leaves
                above[7] += saved
            out.append((conv, depth, parent_conv, n, children, leaves, saved, ends, parent is None))
        return out


def multikey_nodes(bucket: tuple, rows: list[tuple], nodes: _Nodes) -> None:
    """Emits the nodes of one bucket: `rows` (ids, words, n, conv, ends) are distinct and share `depth` first ids. Each step parts
    the rows by one id into less, equal and greater; equal is a node, and goes on with the next id."""
    pconv, depth, _ = bucket
    top = nodes.add(min(r[3] for r in rows), depth, None, pconv if depth else None, sum(r[2] for r in rows), rows[0][1][depth - 1] if depth else 0)
    stack = [(rows, depth, top)]
    while stack:
        rows, d, parent = stack.pop()
        if len(rows) == 1:
            ids, words, n, conv, ends = rows[0]
            above = nodes.rows[parent]
            for at in range(d, len(ids)):
                parent = nodes.add(conv, at + 1, parent, above[0] if at == d else conv, n, words[at])
            nodes.rows[parent][8] = ends
            continue
        pivot = rows[len(rows) // 2][0]
        if len(pivot) == d:  # the one sequence that ends at this node
            nodes.rows[parent][8] = rows[len(rows) // 2][4]
            stack.append((rows[: len(rows) // 2] + rows[len(rows) // 2 + 1 :], d, parent))
            continue
        pivot = pivot[d]
        less, equal, greater = [], [], []
        for r in rows:
            ids = r[0]
            if len(ids) == d:
                nodes.rows[parent][8] = r[4]
            else:
                (equal if ids[d] == pivot else less if ids[d] < pivot else greater).append(r)
        stack += [(own, d, parent) for own in (less, greater) if own]
        node = nodes.add(min(r[3] for r in equal), d + 1, parent, nodes.rows[parent][0], sum(r[2] for r in equal), equal[0][1][d])
        stack.append((equal, d + 1, node))


def local_nodes(waiting: DataFrame, cfg: Trie) -> DataFrame:
    """The nodes of local buckets, with `top` at the first node of each."""
    fields = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _NODE.split(", ")]
    schema, bunch = pa.schema([*fields, ("top", pa.bool_())]), cfg.bunch

    def run(batches):
        nodes, held, rows, size = _Nodes(), None, [], 0

        def take():
            out = record_batch(dict(zip(schema.names, zip(*nodes.finished(), strict=True), strict=True)), schema)
            nodes.rows = []
            return out

        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*_KEY, "ids", "words", "n", "conv", "ends")]
            for pconv, depth, sym, *row in zip(*columns, strict=True):
                if held != (pconv, depth, sym):
                    if rows:
                        multikey_nodes(held, rows, nodes)
                    if size >= bunch:
                        yield take()
                        size = 0
                    held, rows = (pconv, depth, sym), []
                rows.append(row)
                size += len(row[0]) + 1
        if rows:
            multikey_nodes(held, rows, nodes)
            yield take()

    dealt = waiting.repartition(shuffle_width(waiting.sparkSession), *_KEY).sortWithinPartitions(*_KEY)
    return dealt.select(*_KEY, "ids", "words", "n", "conv", "ends").mapInArrow(run, _NODE + ", top boolean")


def trie_nodes(sequences: DataFrame, cfg: Trie = Trie()) -> DataFrame:
    """One row a node of the trie of distinct `sequences` (ids, words, n, conv, ends)."""
    active = materialize(sequences.select(F.lit(0).cast("long").alias("pconv"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("sym"), "ids", "words", "n", "conv", "ends"), "trie-active")
    large, waiting, used = [], [], [active]
    while True:
        stats = active.groupBy(*_KEY).agg(
            F.sum(F.size("ids") - F.col("depth") + 1).alias("turns"), F.min("ids").alias("lo"), F.max("ids").alias("hi"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
            F.min_by("words", "ids").alias("words"), F.min_by("ends", "ids").alias("ends"),
        )
        differ = F.expr("array_position(zip_with(lo, hi, (x, y) -> x <=> y), false)")
        common = F.when(differ == 0, F.size("lo")).otherwise(differ - 1).cast("long")
        stats = stats.where(F.col("turns") > cfg.local).withColumn("common", common)
        split = materialize(stats.select(*_KEY, "common", "n", "conv", "words", F.when(F.size("lo") == F.col("common"), F.col("ends")).otherwise(_NONE).alias("ends")), "trie-split")
        if split.isEmpty():
            waiting.append(active)
            drop_tables(split)
            break
        large.append(split)
        keys = materialize(split.select(*_KEY, "common", F.col("conv").alias("lead")), "trie-keys")
        told = shared_size_join(active, keys, _KEY, "left")
        waiting.append(told.where("common IS NULL").drop("common", "lead"))
        on = told.where("common IS NOT NULL AND size(ids) > common")
        active = materialize(on.select(F.col("lead").alias("pconv"), (F.col("common") + 1).alias("depth"), F.element_at("ids", (F.col("common") + 1).cast("int")).alias("sym"), "ids", "words", "n", "conv", "ends"), "trie-active")
        used += [keys, active]
    local = materialize(local_nodes(reduce(DataFrame.unionByName, waiting), cfg), "trie-local")
    drop_tables(*used)

    def upward(df):
        return df.where("top AND depth > 0").select(F.col("parent_conv_id").alias("conv"), (F.col("depth") - 1).alias("common"), "n_leaves", "saved_tokens")

    given, out = upward(local), [local]
    for split in reversed(large):
        totals = given.groupBy("conv", "common").agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        chain = split.join(totals, ["conv", "common"], "left").select("*", F.explode(F.sequence("depth", "common")).alias("at"))
        own = (F.col("n") - 1) * F.when(F.col("at") > 0, F.element_at("words", F.greatest(F.col("at"), F.lit(1)).cast("int"))).otherwise(0)
        onward = Window.partitionBy("conv", "common").orderBy(F.desc("at"))  # a chain is no longer than a conversation
        last, first = F.col("at") == F.col("common"), F.col("at") == F.col("depth")
        nodes = chain.select(
            F.col("conv").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == 0, None).when(first, F.col("pconv")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("below", F.lit(0)) + F.sum(own).over(onward)).cast("long").alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(_NONE).alias("ends_sha256"), first.alias("top"),
        )
        nodes = materialize(nodes, "trie-nodes")
        out.append(nodes)
        given = given.unionByName(upward(nodes))
    drop_tables(*large)
    return reduce(DataFrame.unionByName, out).drop("top")


def conversation_trie(turns: DataFrame, cfg: Trie = Trie(), rebuild=rebuilt) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one a node: a distinct
    sequence of first turns (role, text) of the conversations, which `rebuild` (None: nothing) changes before.

    Null role or text counts as empty, a null turn comes first; turns of one number are ordered by role and a hash of the
    text, and repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are left out. An empty table has
    no nodes. Texts count whole at any length. Other columns, whatever their names, play no part. A conversation's turn ids
    (numbers, not texts) are held by one task.
    """
    convs = encoded(turns)
    own = materialize(rebuild(convs) if rebuild else convs, "rebuilt")
    sequences = materialize(distinct_sequences(own, cfg), "sequences")
    drop_tables(convs, own)
    out = trie_nodes(sequences, cfg)
    drop_tables(sequences)
    return out


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {
    "op11_prefix_trie": """
WITH bit AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS v FROM bit),
convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda k: ord(k)::BIGINT)), lambda c, b: xor(c // 256, v[xor(c % 256, b) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), tab),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
parts AS (
  SELECT c.conv_id, i, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND i < h
  UNION ALL SELECT c.conv_id, i, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND i >= h),
seqs AS (SELECT c.conv_id, coalesce(s, []) AS s FROM convs c LEFT JOIN (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS s FROM parts GROUP BY conv_id) USING (conv_id)),
steps AS (SELECT conv_id, depth, len(s) = depth AS ends, s[1:depth] AS p, coalesce(s[depth].text, '') AS text FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS depth FROM seqs)),
grouped AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(text) AS text, sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM steps GROUP BY p, depth),
nodes AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS own FROM grouped),
children AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
ups AS (SELECT n.p[1:k] AS p, sum(own) AS saved, count(*) FILTER (c.n IS NULL) AS leaves FROM (SELECT *, unnest(range(depth + 1)) AS k FROM nodes) n LEFT JOIN children c ON c.p = n.p GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN ups u ON u.p = n.p LEFT JOIN children c ON c.p = n.p LEFT JOIN nodes up ON n.depth > 0 AND up.p = n.p[1:n.depth - 1]
"""
}
