"""Exact dense search: blocks of queries against all rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Products held at once in a task, and best ones remembered for its groups.
CELLS = 1_000_000


def _best(sims: np.ndarray, known: np.ndarray | None, k: int) -> np.ndarray:
    """The k greatest of each column, of `known` ones too, in no order; fewer where there are fewer."""
    both = sims if known is None else np.concatenate((known, sims))
    return both if len(both) <= k else np.partition(both, len(both) - k, axis=0)[len(both) - k :].copy()


def _candidates(batches, names: np.ndarray, q: np.ndarray, k: int, floor: float | None, schema: pa.Schema, cells: int = CELLS):
    """Rows (query_id, id, grp, sim) that may be among the k best of a query and group: those not below the k-th best seen so far in the
    task, with all that equal it. Products are made by tiles of about `cells`; what was seen only saves rows, so it may be forgotten."""
    seen: dict[tuple, np.ndarray] = {}
    held = 0
    wide = max(1, min(len(names), cells // 256))
    tall = max(1, cells // wide)
    for b in batches:
        grps = b.column("grp").dictionary_encode(null_encoding="encode")
        labels, codes = grps.dictionary.to_pylist(), grps.indices.to_numpy(zero_copy_only=False)
        for lo in range(0, b.num_rows, tall):
            part = b.slice(lo, tall)
            m = np.stack([v.values.to_numpy() for v in part.column("vec")]).astype(np.float64)
            ids, code = part.column("id").to_numpy(), codes[lo : lo + tall]
            order = np.argsort(code, kind="stable")
            edges = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1))
            for first in range(0, len(names), wide):
                own = names[first : first + wide]
                sim = m @ q[first : first + wide].T
                np.round(sim, 6, out=sim)
                for begin, end in zip(edges[:-1], edges[1:], strict=True):
                    at = order[begin:end]
                    s = sim if len(at) == len(sim) else sim[at]
                    if len(at) == len(sim):
                        at = np.arange(len(sim))
                    key = (labels[code[at[0]]], first)
                    before = seen.pop(key, None)
                    best = _best(s, before, k)
                    least = best.min(axis=0) if len(best) == k else np.full(len(own), -np.inf)
                    if floor is not None:
                        least = np.maximum(least, floor)
                    held += best.size - (0 if before is None else before.size)
                    if held > 4 * cells:
                        seen.clear()
                        held = best.size
                    seen[key] = best
                    i, j = np.nonzero(s >= least)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(own[j]), pa.array(ids[at[i]]), pa.array([key[0]] * len(i), pa.string()), pa.array(s[i, j])], schema=schema)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096, by: str | None = None, floor: float | None = None) -> DataFrame:
    """(query_id, id, grp, sim, rank): for each query the k rows of greatest inner product, ties by id; within each value
    of `by` where given, and from `floor` on. `vectors` has (id, vec[, by]), `queries` (query_id, vec).

    A block of queries at a time, of bounded size, goes to all tasks, which multiply matrices by tiles and keep what may be among the
    k best rows of a query; only those are shuffled.
    """
    spark = vectors.sparkSession
    parts = max(1, -(-queries.count() // block))
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vec", (F.col(by).cast("string") if by else F.lit("")).alias("grp"))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("grp", pa.string()), ("sim", pa.float64())])
    out = []
    for p in range(parts):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).collect()
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in own], np.int64), np.array([r.vec for r in own], np.float64)))

        def run(batches, sent=sent):
            names, q = sent.value
            yield from _candidates((b for b in batches if b.num_rows and len(names)), names, q, k, floor, schema)

        out.append(rows.mapInArrow(run, "query_id long, id long, grp string, sim double"))
    found = reduce(DataFrame.unionByName, out)
    w = Window.partitionBy("query_id", "grp").orderBy(F.desc("sim"), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
