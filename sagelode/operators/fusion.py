"""Fusing, weighting, capping and diversifying ranked lists. All lists have query_id and chunk_id."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a source's category (fixed values).
SOURCE_WEIGHTS = {"statute": 1.50, "notification": 1.20, "circular": 1.10, "case_law": 0.75, "other": 0.80}
#: Least rows of a category in a pool (fixed values).
QUOTAS = {"statute": 6, "case_law": 4, "circular": 4, "notification": 3}


def rrf(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """(query_id, chunk_id, rrf): sum of 1 / (k + rank) over lists ranked from 1."""
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "chunk_id", "rank") for x in lists])
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("rrf"))


def ranked(df: DataFrame, score: str, by: list[str] = ("query_id",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), "chunk_id")
    return df.withColumn("rank", F.row_number().over(w).cast("long"))


def weight_sources(df: DataFrame, score: str, category: str = "category") -> DataFrame:
    """Multiplies scores scaled to [0, 1] within the query by the category's weight."""
    w = Window.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    scaled = F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(1.0))
    weight = reduce(lambda rest, x: F.when(F.col(category) == x[0], x[1]).otherwise(rest), SOURCE_WEIGHTS.items(), F.lit(1.0))
    return df.withColumn("weighted", F.round(scaled * weight, 6))


def document_boost(df: DataFrame, document: str) -> DataFrame:
    """0.02 ln n where n > 1 rows of the pool share the document."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id", document))
    return df.withColumn("boost", F.round(F.when(n > 1, F.log(n) * 0.02).otherwise(F.lit(0.0)), 6))


def recency(year: Column, as_of: int) -> Column:
    age = F.lit(as_of) - year
    bands = [(0, 1.0), (1, 0.92), (2, 0.84), (3, 0.76), (5, 0.65), (8, 0.5)]
    return F.when(year.isNull(), 0.55).otherwise(reduce(lambda rest, x: F.when(age <= x[0], x[1]).otherwise(rest), reversed(bands), F.lit(0.35)))


def per_document_cap(df: DataFrame, document: str, score: str, most: int, capped: Column) -> DataFrame:
    """At most `most` rows of a document where `capped` holds; the others stay."""
    n = F.row_number().over(Window.partitionBy("query_id", document).orderBy(F.desc(score), "chunk_id"))
    return df.withColumn("_n", n).where(~capped | (F.col("_n") <= most)).drop("_n")


def fill_quotas(pool: DataFrame, candidates: DataFrame, quotas=QUOTAS, floor: float = 0.0) -> DataFrame:
    """Rows to add to `pool` (query_id, chunk_id, category) from `candidates` (the same and score), best first, until
    each category has its quota."""
    quota = reduce(lambda rest, x: F.when(F.col("category") == x[0], x[1]).otherwise(rest), quotas.items(), F.lit(0))
    have = pool.groupBy("query_id", "category").agg(F.count(F.lit(1)).alias("have"))
    new = candidates.where(F.col("score") > floor).join(pool.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    new = new.join(have, ["query_id", "category"], "left").withColumn("n", F.row_number().over(Window.partitionBy("query_id", "category").orderBy(F.desc("score"), "chunk_id")).cast("long"))
    return new.where(F.col("n") <= quota - F.coalesce("have", F.lit(0))).select("query_id", "chunk_id", "category", "score")


def priority_merge(lists: list[tuple[DataFrame, int]], cap: int = 80) -> DataFrame:
    """(query_id, chunk_id, src, pos): lists in order, the first `n` rows of each, first occurrence wins, `cap` in all."""
    rows = reduce(DataFrame.unionByName, [x.where(F.col("rank") <= n).select("query_id", "chunk_id", F.lit(i).alias("src"), "rank") for i, (x, n) in enumerate(lists)])
    first = rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct("src", "rank")).alias("f"))
    w = Window.partitionBy("query_id").orderBy("f.src", "f.rank", "chunk_id")
    return first.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= cap).select("query_id", "chunk_id", F.col("f.src").alias("src"), "pos")


def within_budget(df: DataFrame, length: Column, budget: int, order: list, by: str = "query_id") -> DataFrame:
    """Rows from the first on while their lengths sum to the budget at most."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(length).over(w)).where(F.col("used") <= budget)


def interleave(df: DataFrame, cls: str, order: list, first: str) -> DataFrame:
    """Alternates two classes by their own order, rows of `first` before the other's."""
    n = F.row_number().over(Window.partitionBy("query_id", cls).orderBy(*order))
    w = Window.partitionBy("query_id").orderBy("_n", F.when(F.col(cls) == first, 0).otherwise(1))
    return df.withColumn("_n", n).withColumn("pos", F.row_number().over(w).cast("long")).drop("_n")


def mmr(pool: DataFrame, top: int, weight: float = 0.72) -> DataFrame:
    """(query_id, chunk_id, pos): greedy choice by weight * relevance - (1 - weight) * likeness to the chosen.

    `pool` has (query_id, chunk_id, score, tokens) with few rows a query (a pool is capped at 80), each query being one
    group. Scores are scaled to [0, 1] first, so that negative ones can't stall it."""

    def pick(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        span = own.score.max() - own.score.min()
        rel = (own.score - own.score.min()) / span if span > 0 else own.score * 0 + 1.0
        sets = [frozenset(t) for t in own.tokens]
        left, chosen, near = list(range(len(own))), [], [0.0] * len(own)
        while left and len(chosen) < top:
            best = max(left, key=lambda i: (weight * rel[i] - (1 - weight) * near[i], -i))
            left.remove(best)
            chosen.append(best)
            for i in left:
                u = len(sets[i] | sets[best])
                near[i] = max(near[i], len(sets[i] & sets[best]) / u if u else 0.0)
        return pd.DataFrame({"query_id": own.query_id.iloc[chosen], "chunk_id": own.chunk_id.iloc[chosen], "pos": range(1, len(chosen) + 1)})

    return pool.groupBy("query_id").applyInPandas(pick, "query_id long, chunk_id long, pos long")
