"""Which texts contain which short strings, and which keys stand above which, by equi-joins of any size.

A string is found by one of its words: a text that contains the string has a word that contains that word. The words of
all texts are few beside the texts, so only they are indexed by their substrings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"([\p{L}\p{N}]+)"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), 1)


def containing(needles: DataFrame, texts: DataFrame, gram: int = 4) -> DataFrame:
    """(needle, text_id), distinct: the texts (text_id, text) that contain each string of `needles` (needle).

    A string's key is its longest word, one with a digit before others; the first `gram` characters of the key meet those
    substrings of the texts' distinct words. Then the word, and last the whole text, are verified. Strings
    without a letter or digit, and null ones, are contained nowhere.
    """
    key = F.array_max(F.transform(_words(F.col("needle")), lambda w: F.struct(w.rlike("[0-9]").alias("d"), F.length(w).alias("n"), w.alias("w"))))["w"]
    own = needles.select("needle").distinct().withColumn("key", key).where("key IS NOT NULL").withColumn("gram", F.substring("key", 1, gram))
    lengths = sorted(r[0] for r in own.select(F.length("gram")).distinct().collect())  # `gram` numbers at most
    words = texts.where("text_id IS NOT NULL").select("text_id", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, F.lit(n)))
    parts = [F.when(F.length("word") >= n, starts(n)).otherwise(F.array().cast("array<string>")) for n in lengths]
    grams = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(*parts) if parts else F.array().cast("array<string>"))).alias("gram"))
    met = own.join(grams, "gram").where(F.contains("word", F.col("key"))).select("needle", "word")
    pairs = met.join(words, "word").select("needle", "text_id").distinct()
    return pairs.join(texts.select("text_id", "text"), "text_id").where(F.contains("text", F.col("needle"))).select("needle", "text_id").distinct()


def verify_citations(citations: DataFrame, sources: DataFrame, variants: Column) -> DataFrame:
    """(id, citation, variant, level): the first of a citation's variants that another text holds (`sources`: id, text); null where none does."""
    tried = citations.select("id", "citation", F.posexplode(variants).alias("level", "variant"))
    found = containing(tried.select(F.col("variant").alias("needle")), sources.select(F.col("id").alias("text_id"), "text"))
    # of each variant two texts are enough to know one that isn't the citation's own
    two = found.groupBy(F.col("needle").alias("variant")).agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi"))
    best = tried.join(two, "variant").where((F.col("lo") != F.col("id")) | (F.col("hi") != F.col("id"))).groupBy("id", "citation").agg(F.min(F.struct("level", "variant")).alias("f"))
    return citations.select("id", "citation").join(best, ["id", "citation"], "left").select("id", "citation", F.col("f.variant").alias("variant"), F.col("f.level").alias("level"))


def either_contains(cited: DataFrame, known: DataFrame) -> DataFrame:
    """(id, citation, verified): whether a string that the citation contains, or that contains it, stands with the same id in
    `known` (id, provision), whatever the case. The strings of both sides are compared by distinct value, not by row."""
    low = lambda c: F.lower(F.trim(c))
    c = cited.select("id", "citation", low("citation").alias("c")).distinct()
    k = known.where(F.trim("provision") != "").select("id", low("provision").alias("p")).distinct()
    cs, ps = c.select(F.col("c").alias("needle")).distinct(), k.select(F.col("p").alias("needle")).distinct()
    text = lambda df: df.select(F.col("needle").alias("text_id"), F.col("needle").alias("text"))
    inside = containing(cs, text(ps)).select(F.col("needle").alias("c"), F.col("text_id").alias("p"))
    around = containing(ps, text(cs)).select(F.col("text_id").alias("c"), F.col("needle").alias("p"))
    hits = c.join(inside.unionByName(around).distinct(), "c").join(k, ["id", "p"]).select("id", "citation").distinct().withColumn("hit", F.lit(True))
    return c.select("id", "citation").join(hits, ["id", "citation"], "left").select("id", "citation", F.coalesce("hit", F.lit(False)).alias("verified"))


def above(key: Column) -> Column:
    """array<string>: the keys whose prefix match takes `key` in: itself, and what it begins with up to a `_` or a letter."""
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(key), F.lit(1))), lambda i: (i == F.length(key)) | F.substring(key, i + 1, F.lit(1)).rlike("[_A-Za-z]"))
    return F.transform(cuts, lambda i: F.substring(key, F.lit(1), i))


def statute_first(queries: DataFrame, targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, target): chunks (chunk_id, keys) of which a key is a target of the query's topic or lies under it.
    `queries` has (query_id, topic), `targets` (topic, ord, target); of several targets the first by ord is named."""
    wanted = queries.join(targets, "topic").select("query_id", "ord", F.col("target").alias("key"))
    own = chunks.select("chunk_id", F.explode("keys").alias("k")).select("chunk_id", F.explode(above(F.col("k"))).alias("key")).distinct()
    return wanted.join(own, "key").groupBy("query_id", "chunk_id").agg(F.min_by("key", "ord").alias("target"))


def resolved(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(id, key): the asked keys (id, ord, key) that `index` (key) has, else their base key if it has that; each once, with the
    least ord."""
    k = F.upper(F.trim("key"))
    base = F.nullif(F.regexp_extract(k, r"^((?:CGST|IGST|UTGST|SGST)_(?:SEC|RULE?)_\d+[A-Z]?)", 1), F.lit(""))
    known = index.select("key").distinct()
    raw = asked.select("id", "ord", k.alias("key"), base.alias("base"))
    whole = raw.join(known, "key", "left_semi").select("id", "ord", "key")
    rest = raw.join(known, "key", "left_anti").where("base IS NOT NULL").select("id", "ord", F.col("base").alias("key")).join(known, "key", "left_semi")
    return whole.unionByName(rest).groupBy("id", "key").agg(F.min("ord").alias("ord"))
