"""Coverage of answers, mining of misses, and reports over what was ingested."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(c: Column) -> Column:
    return F.array_join(F.array_sort(c), "|")


def missing_concepts(texts: DataFrame, rules: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """(id, rule, trigger, missing) for each text that holds a trigger of a rule but not all its concepts. `texts` has id
    and text; `rules` are (name, triggers, concepts), and the first trigger found is the one named. One projection, no
    join. A null text triggers nothing."""
    t = F.lower("text")

    def judged(name, triggers, concepts):
        found = F.coalesce(*[F.when(F.contains(t, F.lit(x.lower())), F.lit(x)) for x in triggers])
        lacking = F.filter(F.array(*[F.lit(c) for c in concepts]), lambda c: ~F.contains(t, F.lower(c)))
        return F.struct(F.lit(name).alias("rule"), found.alias("trigger"), F.array_join(lacking, "|").alias("missing"))

    each = texts.select("id", F.explode(F.array(*[judged(*r) for r in rules])).alias("r"))
    return each.where("r.trigger IS NOT NULL AND r.missing <> ''").select("id", "r.*")


def is_cited(text: Column, key: Column) -> Column:
    """Whether a text names the authority of a key such as CGST_SEC_16, CGST_RUL_42 or CIRCULAR_183."""
    t, k = F.lower(text), F.lower(key)
    n = F.regexp_extract(k, r"(?:_sec_|_rul_|circular_)(.*)$", 1)

    def one_of(*forms):
        return F.exists(F.array(*[F.format_string(f, n) for f in forms]), lambda f: F.contains(t, f))

    return (
        F.when(F.contains(k, F.lit("_sec_")), one_of("section %s", "sec %s", "sec. %s", "sec.%s"))
        .when(F.contains(k, F.lit("_rul_")), one_of("rule %s"))
        .when(F.contains(k, F.lit("circular_")), one_of("circular %s", "circular no. %s", "circular no %s", "/%s/"))
        .otherwise(False)
    )


def answer_coverage(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(id, cited, missing, verdict): pass with none of the keys missing, partial with up to half of them, else fail."""
    judged = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(is_cited(F.col("text"), F.lit(k)), F.lit(False)).alias("hit")) for k in keys])
    pick = lambda hit: F.transform(F.filter("j", lambda x: x["hit"] == hit), lambda x: x["k"])
    n = F.size(pick(False))
    verdict = F.when(n == 0, "pass").when(n <= len(keys) // 2, "partial").otherwise("fail")
    return texts.select("id", judged.alias("j")).select("id", _joined(pick(True)).alias("cited"), _joined(pick(False)).alias("missing"), verdict.alias("verdict"))


def miss_rates(log: DataFrame, least: int, rate: float) -> DataFrame:
    """(topic, missing, n, misses, coverage, rate): what is missing in at least `rate` of a topic's queries, for topics of
    `least` queries or more. `log` has topic, coverage and missing, a list without repeats."""
    topics = log.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("coverage"), 4).alias("coverage")).where(F.col("n") >= least)
    misses = log.select("topic", F.explode("missing").alias("missing")).groupBy("topic", "missing").agg(F.count(F.lit(1)).alias("misses"))
    return misses.join(topics, "topic").withColumn("rate", F.round(F.col("misses") / F.col("n"), 4)).where(F.col("misses") / F.col("n") >= rate)


def band_counts(df: DataFrame, by: str, band: Column, names: list[str]) -> DataFrame:
    """Rows of each `by`, and how many fall in each named band."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(band == name).alias(name) for name in names])


def tag_changes(df: DataFrame, by: str, before: str, after: str) -> DataFrame:
    """Of each `by`: rows, rows whose tags changed, and tags added, two lists of tags being equal as sets."""
    old, new = F.array_distinct(before), F.array_distinct(after)
    added, gone = F.size(F.array_except(new, old)), F.size(F.array_except(old, new))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if((added > 0) | (gone > 0)).alias("changed"), F.sum(added).cast("long").alias("added"))


def reference_registry(refs: DataFrame, kind: Column, shown: int = 2) -> DataFrame:
    """(ref, kind, n_sources, sources): each reference with how many sources it has, and the first of them. Repeats go
    before the grouping, so that a frequent reference brings each of its sources once."""
    each = refs.select("ref", "source").distinct().groupBy("ref").agg(F.array_sort(F.collect_list("source")).alias("s"))
    return each.select("ref", kind.alias("kind"), F.size("s").cast("long").alias("n_sources"), F.array_join(F.slice("s", 1, shown), "|").alias("sources"))


def quota_use(found: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(name, used, allowed, pct) for each column of the one row of `found` that has a limit."""
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("long").alias("used"), F.lit(v).cast("long").alias("allowed")) for k, v in limits.items()])
    return found.select(F.explode(rows).alias("q")).select("q.*").withColumn("pct", F.round(100.0 * F.col("used") / F.col("allowed"), 2))


def keyword_pattern(keyword: str, synonyms: dict[str, list[str]]) -> str:
    """A pattern for lower-cased text: the keyword, and the other ways to write it. A rate may be that of one half or stand
    alone as a number; sub-sections, circular numbers, returns and amounts in crore have their usual forms."""
    k = keyword.lower()
    alone = lambda n: rf"(?:^|[^0-9]){re.escape(n)}(?:[^0-9]|$)"
    ways = [re.escape(w) for w in [k, *synonyms.get(k, [])]]
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)%", k):
        for n in (f"{float(m[1]):.12g}", f"{float(m[1]) / 2:.12g}"):
            ways += [re.escape(n) + "(?: per cent|%)", alone(n)]
    elif m := re.fullmatch(r"section\s+(\d+)\((\w+)\)", k):
        ways += [rf"{m[1]}\({m[2]}\)", rf"section {m[1]} \({m[2]}\)", rf"(?:sub-section|clause) \({m[2]}\) of section {m[1]}"]
    elif m := re.fullmatch(r"circular\s+(?:no\.?\s*)?(\d+)", k):
        ways += [rf"\b{m[1]}/", rf"no\.?\s*{m[1]}\b"]
    elif m := re.fullmatch(r"gstr-?(\w+)", k):
        ways.append(rf"gstr[ -]?{m[1]}")
    elif m := re.fullmatch(r"([\d.]+)\s+crore", k):
        ways += [rf"{100 * float(m[1]):.12g} lakh", rf"\b{re.escape(str(float(m[1])))}\b"]
    return "|".join(ways)


def keyword_coverage(texts: DataFrame, keywords: list[str], synonyms: dict[str, list[str]]) -> DataFrame:
    """(id, found, missing, pct): which keywords a text holds in some way of writing. A null text holds none."""
    t = F.coalesce(F.lower("text"), F.lit(""))
    judged = F.array(*[F.struct(F.lit(k).alias("k"), t.rlike(keyword_pattern(k, synonyms)).alias("hit")) for k in keywords])
    pick = lambda hit: F.transform(F.filter("j", lambda x: x["hit"] == hit), lambda x: x["k"])
    out = texts.select("id", judged.alias("j")).select("id", pick(True).alias("y"), pick(False).alias("n"))
    return out.select("id", _joined(F.col("y")).alias("found"), _joined(F.col("n")).alias("missing"), F.round(100.0 * F.size("y") / len(keywords), 1).alias("pct"))
