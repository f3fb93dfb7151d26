"""Greedy packing, hybrid template scores, floors and injections, verification of citations, query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pack_paragraphs(text: Column, most: int = 500, separator: str = "\n") -> Column:
    """Paragraphs put together greedily up to `most` words a chunk; a longer paragraph is a chunk of its own."""
    words = lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    parts = F.filter(F.transform(F.split(text, separator), lambda p: F.struct(p.alias("p"), words(p).alias("n"))), lambda x: x["n"] > 0)
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        full = (acc["n"] > 0) & (acc["n"] + x["n"] > most)
        return F.struct(
            F.when(full, x["n"]).otherwise(acc["n"] + x["n"]).alias("n"),
            F.when(full | (acc["n"] == 0), x["p"]).otherwise(F.concat(acc["held"], F.lit(separator), x["p"])).alias("held"),
            F.when(full, F.array_append(acc["out"], acc["held"])).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["n"] > 0, F.array_append(acc["out"], acc["held"])).otherwise(acc["out"]))


def lexical_match(title: Column, query: Column, q_words: Column) -> Column:
    """1.0 for the title itself, 0.7 where the title holds the query, else 0.2 and 0.3 of the share of its words, or 0."""
    share = F.size(F.filter(q_words, lambda w: F.contains(F.lower(title), w))) / F.greatest(F.size(q_words), F.lit(1))
    return F.when(F.lower(title) == F.lower(query), 1.0).when(F.contains(F.lower(title), F.lower(query)), 0.7).when(share > 0, 0.2 + 0.3 * share).otherwise(0.0)


def library_score(title: Column, phrase: str, words: list[str]) -> Column:
    """100 for the phrase, 80 for all words, 50 times the share of them otherwise."""
    t = F.lower(title)
    hits = sum((F.contains(t, F.lit(w)).cast("int") for w in words[1:]), F.contains(t, F.lit(words[0])).cast("int"))
    return F.when(F.contains(t, F.lit(phrase)), 100.0).when(hits == len(words), 80.0).otherwise(50.0 * hits / len(words))


def category_floor(ranked: DataFrame, k: int, classes: list[str], least: int, score: float) -> DataFrame:
    """The k first rows of each query, and as many of the best later rows of `classes` scoring `score` as it takes for
    `least` of them. `ranked` has query_id, chunk_id, category, score and rank."""
    inside = ranked.where(F.col("rank") <= k)
    have = inside.where(F.col("category").isin(*classes)).groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    rest = ranked.where((F.col("rank") > k) & F.col("category").isin(*classes) & (F.col("score") >= score)).join(have, "query_id", "left")
    rest = rest.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return inside.withColumn("injected", F.lit(False)).unionByName(rest.where(F.col("n") <= least - F.coalesce("have", F.lit(0))).drop("n", "have").withColumn("injected", F.lit(True)))


def injection_cutoff(rows: DataFrame, k: int) -> DataFrame:
    """The k first rows that weren't injected, and all that were."""
    n = F.row_number().over(Window.partitionBy("query_id", "injected").orderBy("rank"))
    return rows.withColumn("_n", n).where(F.col("injected") | (F.col("_n") <= k)).drop("_n")


def expand(queries: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """(id, terms): up to `most` terms of the rules whose trigger a query holds and that aren't in it, in order of the rules.
    `rules` is a small dimension (ord, trigger, term)."""
    q = F.lower(F.col("q"))
    hit = queries.join(F.broadcast(rules), F.contains(q, F.col("trigger")) & ~F.contains(q, F.col("term")))
    hit = hit.groupBy("id", "term").agg(F.min("ord").alias("ord")).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("ord", "term")))
    terms = hit.where(F.col("n") <= most).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]), "|").alias("terms"))
    return queries.select("id").join(terms, "id", "left")


def provenance(runs: DataFrame, stages: list[str]) -> DataFrame:
    """(query_id, chunk_id, first_stage, signals, best): where a row first came in, all its stages and its best rank."""
    order = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    g = runs.groupBy("query_id", "chunk_id").agg(F.min_by("stage", order).alias("first_stage"), F.array_sort(F.collect_set("stage")).alias("s"), F.min("rank").alias("best"))
    return g.select("query_id", "chunk_id", "first_stage", F.array_join("s", "|").alias("signals"), "best")
