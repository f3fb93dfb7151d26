"""URL filters: rules by host and path, then empirical-Bayes host reputation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, whole_row

#: (verdict, host, path): a rule fits its host and all subdomains when the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Reputation:
    """A host is blocked when the upper posterior bound of its share of good pages, mean + z * sd, is under `floor`.
    `least_strength` and `most_strength` bound the prior strengths fitted by moments."""

    floor: float = 0.7
    z: float = 1.645
    least_strength: float = 1.0
    most_strength: float = 1000.0


#: Labels that form a suffix with a country's two letters, as in co.uk (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "go", "gob", "ne", "net", "or", "org")


def url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, suffix (last label, or the last two as in co.uk) and registered domain (suffix and the label before).

    Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end.
    Both are empty for null or where `://` is missing; then the domain and suffix are empty too. Columns of these names
    are replaced.
    """
    name = free_name(pages, "_rest")
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    out = pages.withColumn(name, F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(""))
    out = out.withColumn("host", F.translate(F.regexp_extract(name, "^[^/?#]*", 0), _UPPER, _LOWER))
    out = out.withColumn("path", F.regexp_extract(name, "^[^/?#]*([^?#]*)", 1)).drop(name)
    two = F.col("host").rlike(f"(^|\\.)({'|'.join(SECOND_LEVEL)})\\.[a-z][a-z]$")
    last = lambda k: F.substring_index("host", ".", -k)
    return out.withColumn("domain", F.when(two, last(3)).otherwise(last(2))).withColumn("suffix", F.when(two, last(2)).otherwise(last(1)))


def rule_match(rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, else nulls, as CASE chains over host and path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest ends up outermost
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _strength(stats: DataFrame, parent: str, r: Reputation) -> DataFrame:
    """One row (k): the beta prior's strength by moments from groups (n, good, mean of the parent)."""
    p = F.col(parent)
    spread = F.sum(F.col("n") * (F.col("good") / F.col("n") - p) * (F.col("good") / F.col("n") - p))
    noise = F.sum(p * (1 - p))
    room = F.sum(F.col("n") * p * (1 - p)) - noise
    rho = F.greatest((spread - noise) / room, F.lit(0.0))
    k = F.when(room > 0, F.when(rho > 0, (1 - rho) / rho).otherwise(r.most_strength))
    return stats.where("n > 0").agg(F.least(F.greatest(F.coalesce(k, F.lit(r.most_strength)), F.lit(r.least_strength)), F.lit(r.most_strength)).alias("k"))


def host_reputation(outcomes: DataFrame, r: Reputation = Reputation()) -> DataFrame:
    """Posterior of each host with labelled pages: rows (host, alpha, beta, bound).

    `outcomes` has host, domain, suffix and good (0 or 1; null: not labelled). Each level's mean is shrunk towards
    the level above by a beta prior of fitted strength: suffix towards the whole, domain to suffix, host to domain.
    Counts are pre-aggregated per host before any shuffle, so a host with a third of all pages costs one row a task.
    """
    hosts = outcomes.where("good IS NOT NULL").groupBy("host", "domain", "suffix").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("good").cast("double").alias("good"))
    whole = hosts.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("m0"))
    shrunk = lambda k, m: (F.col("good") + F.col(k) * F.col(m)) / (F.col("n") + F.col(k))

    def level(stats: DataFrame, parent: str, k: str) -> DataFrame:
        return stats.crossJoin(F.broadcast(_strength(stats, parent, r).withColumnRenamed("k", k)))  # one row

    suffixes = level(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).crossJoin(F.broadcast(whole)), "m0", "k1")
    suffixes = suffixes.select("suffix", shrunk("k1", "m0").alias("m1"))
    domains = level(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).join(suffixes, "suffix"), "m1", "k2")
    domains = domains.select("domain", shrunk("k2", "m1").alias("m2"))
    fitted = level(hosts.join(domains, "domain"), "m2", "k3")
    a, b = F.col("good") + F.col("k3") * F.col("m2"), F.col("n") - F.col("good") + F.col("k3") * (1 - F.col("m2"))
    fitted = fitted.select("host", a.alias("alpha"), b.alias("beta"))
    total = F.col("alpha") + F.col("beta")
    return fitted.withColumn("bound", F.col("alpha") / total + r.z * F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1))))


def url_filter(pages: DataFrame, rules=RULES, r: Reputation = Reputation(), url: str = "url", good: str = "good") -> DataFrame:
    """`pages` with host, path, rule and verdict. The longest fitting rule decides; else the host's reputation does,
    and hosts without labelled pages are allowed. The column `good` has a page's outcome: 0, 1 or null.

    Null and very long urls are judged like any; null ones get an empty host and are allowed. Repeated pages are judged
    alike and count once a row in the reputation; page ids, null ones too, play no part. An empty table gives no rows.
    Columns named host, path, rule or verdict are replaced, others pass through.
    """
    inner = url_parts(pages.select(whole_row(pages).alias("row"), F.col(url).alias("url"), F.col(good).alias("good")))
    bad = host_reputation(inner, r).where(F.col("bound") < r.floor).select(F.col("host").alias("bad"))
    name, verdict = rule_match(rules)
    out = inner.join(bad, F.col("host") == F.col("bad"), "left").withColumn("rule", name)
    out = out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("bad").isNotNull(), "block").otherwise("allow")))
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*[F.col("row").getField(c).alias(c) for c in rest], "host", "path", "rule", "verdict")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """`pages` with good: the label of the document a page shows, whose number is the second part of the url's path; null
    where there is none. A document of several labels is good if all of them are."""
    keyed = url_parts(pages.select(whole_row(pages).alias("row"), "url"))
    keyed = keyed.select("row", F.expr("try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') AS bigint)").alias("doc_id"))
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(good).alias("good"))
    return keyed.join(known, "doc_id", "left").select("row.*", "good")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the labels of the documents on the pages: good quality and not toxic."""
    pages = page_outcomes(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op9_url_filters": op9_url_filters}

_R = Reputation()


def _moments(parent: str) -> str:
    spread, noise, room = f"sum(n * (good / n - {parent}) * (good / n - {parent}))", f"sum({parent} * (1 - {parent}))", f"(sum(n * {parent} * (1 - {parent})) - sum({parent} * (1 - {parent})))"
    rho = f"greatest(({spread} - {noise}) / {room}, 0)"
    return f"least(greatest(coalesce(CASE WHEN {room} > 0 THEN CASE WHEN {rho} > 0 THEN (1 - {rho}) / {rho} ELSE {_R.most_strength} END END, {_R.most_strength}), {_R.least_strength}), {_R.most_strength})"


def _case(pick) -> str:
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"


ORACLES = {
    "op9_url_filters": f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
q AS (
  SELECT page_id, host, path, array_to_string(list_slice(l, -k - 1, -1), '.') AS domain, array_to_string(list_slice(l, -k, -1), '.') AS suffix
  FROM (SELECT *, string_split(host, '.') AS l, CASE WHEN regexp_matches(host, '(^|\\.)({"|".join(SECOND_LEVEL)})\\.[a-z][a-z]$') THEN 2 ELSE 1 END AS k FROM p)),
lab AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id),
hosts AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS good FROM q JOIN lab ON doc_id = try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') AS BIGINT) GROUP BY ALL),
w AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS m0 FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(m0) AS m0 FROM hosts, w GROUP BY suffix),
s1 AS (SELECT suffix, (good + k * m0) / (n + k) AS m1 FROM s0, (SELECT {_moments("m0")} AS k FROM s0)),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(good) AS good, any_value(m1) AS m1 FROM hosts JOIN s1 USING (suffix) GROUP BY suffix, domain),
d1 AS (SELECT domain, (good + k * m1) / (n + k) AS m2 FROM d0, (SELECT {_moments("m1")} AS k FROM d0)),
h0 AS (SELECT host, n, good, m2 FROM hosts JOIN d1 USING (domain)),
h1 AS (SELECT host, good + k * m2 AS a, n - good + k * (1 - m2) AS b FROM h0, (SELECT {_moments("m2")} AS k FROM h0)),
bad AS (SELECT host FROM h1 WHERE a / (a + b) + {_R.z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < {_R.floor})
SELECT page_id, host, path, {_case(lambda v, h, p: h + p)} AS rule,
       coalesce({_case(lambda v, h, p: v)}, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM q"""
}
