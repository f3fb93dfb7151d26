"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, whole_row

SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus (fixed values).
STOP_WORDS = tuple(
    "the of and to in a is that it for on was be with as by at from this are or have not "
    "le la les de des et un une en que qui dans pour sur pas est au du ce avec "
    "der die das und zu den von mit ein eine ist im auf für nicht sich auch es dem "
    "el los las y por se con su para lo como una del al no".split()
)


@dataclass(frozen=True)
class Rule:
    """A document fails when `metric` lies outside [low, high]; `min_words` exempts shorter texts."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


RULES = (
    Rule("length", "n_words", low=20, high=1_000_000),
    Rule("word_length", "mean_word_chars", low=2.5, high=10.0),
    Rule("symbols", "symbol_ratio", high=0.02),
    Rule("shouting", "upper_ratio", high=0.4),
    Rule("letters", "alpha_ratio", low=0.6),
    Rule("stop_words", "stop_ratio", low=0.06, min_words=40),
    Rule("stop_variety", "stop_ratio", high=0.7, min_words=40),
    Rule("repeated_lines", "dup_line_ratio", high=0.4),
    Rule("ellipsis_lines", "ellipsis_ratio", high=0.3),
    Rule("bullet_lines", "bullet_ratio", high=0.9),
)


_HELPERS = ("_text", "_words", "_lines", "_windows", "_seq")


def _repeated_words(words: str, windows: str) -> Column:
    """Words that lie in 8-word windows found twice or more. Windows are compared by 64-bit hash within one text;
    texts without a repeated hash stop after one pass through a hash set."""
    return F.expr(f"""
        CASE WHEN size({words}) < 9 THEN 0L
             WHEN size(array_distinct({windows})) = size({windows}) THEN 0L
             ELSE aggregate(
               transform(
                 array(sort_array(transform({windows}, (h, i) -> struct(h AS h, i AS i)))),
                 s -> array_sort(transform(
                   filter(s, (x, j) -> coalesce(get(s, j - 1).h = x.h, false) OR coalesce(get(s, j + 1).h = x.h, false)),
                   x -> x.i))),
               0L,
               (acc, starts) -> acc + aggregate(
                 transform(starts, (p, j) -> cast(least(8, coalesce(get(starts, j + 1) - p, 8)) AS bigint)), 0L, (a, v) -> a + v))
        END""")


def quality_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the metric columns to `docs`. Null or blank texts have no words: counts are 0 and ratios 0.0.

    Everything is a per-row expression: no shuffle, no Python. Columns of `docs` with the metrics' names are replaced,
    all others pass through.
    """
    raw, words, lines, windows, seq = (free_name(docs, n) for n in _HELPERS)
    body = F.coalesce(F.col(text), F.lit(""))
    one = docs.withColumn(raw, body)
    two = one.withColumn(words, F.filter(F.split(raw, SPACE), lambda w: w != "")).withColumn(
        lines, F.filter(F.split(raw, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    )
    three = two.withColumn("n_words", F.size(words).cast("long")).withColumn(
        windows, F.expr(f"CASE WHEN size({words}) >= 9 THEN transform(sequence(1, size({words}) - 7), i -> xxhash64(slice({words}, i, 8))) ELSE array() END")
    )
    lower = F.lower(F.regexp_replace(raw, "[.,;:!?]", ""))
    four = three.withColumns(
        {
            "n_repeat_words": _repeated_words(words, windows),
            "word_chars": F.length(F.translate(raw, SPACE_CHARS, "")).cast("long"),
            "n_chars_all": F.length(raw).cast("long"),
            "n_symbols": (F.length(raw) - F.length(F.translate(raw, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_upper": F.length(F.regexp_replace(raw, "\\P{Lu}+", "")).cast("long"),
            "n_letters": F.length(F.regexp_replace(raw, "\\P{L}+", "")).cast("long"),
            "n_stop": F.size(F.filter(F.split(lower, SPACE), lambda w: w.isin(*STOP_WORDS))).cast("long"),
            "n_ellipsis": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("..."))).cast("long"),
            "n_bullets": F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^[-*•]"))).cast("long"),
            seq: F.monotonically_increasing_id(),  # where it is used, a filter isn't pushed below, to compute all this again
        }
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return four.withColumns(
        {
            "mean_word_chars": ratio("word_chars", "n_words"),
            "symbol_ratio": ratio("n_symbols", "word_chars"),
            "upper_ratio": ratio("n_upper", "n_letters"),
            "alpha_ratio": ratio("n_letters", "word_chars"),
            "stop_ratio": ratio("n_stop", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "ellipsis_ratio": ratio("n_ellipsis", "n_lines"),
            "bullet_ratio": ratio("n_bullets", "n_lines"),
        }
    ).drop(raw, words, lines, windows)


def failed(rule: Rule) -> Column:
    out = F.lit(False)
    if rule.low is not None:
        out = out | (F.col(rule.metric) < rule.low)
    if rule.high is not None:
        out = out | (F.col(rule.metric) > rule.high)
    return out & (F.col("n_words") >= rule.min_words)


def _judged(docs: DataFrame, rules: tuple[Rule, ...], text: str) -> DataFrame:
    m = quality_metrics(docs, text)
    m = m.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    m = m.withColumn("failed_rules", F.array_compact(F.array(*[F.when(failed(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>"))
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """`docs` with the metrics, `base_failed` (under 20 words, or over 30 % of the words in repeated 8-word windows),
    `failed_rules` (names, in table order) and `kept`.

    A null or empty text has no words and so fails. Repeated rows are judged each on its own; an empty table gives
    no rows; nulls in other columns play no part. A text of any length counts whole. Columns named like the metrics or
    verdicts are replaced, others pass through.
    """
    return _judged(docs, rules, text).drop(free_name(docs, "_seq"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows of `docs` that pass, unchanged; repeated rows all stay."""
    judged = _judged(docs.select(whole_row(docs).alias("_row"), "text"), RULES, "text")
    return judged.where(F.col("kept") & (F.col("_seq") >= 0)).select("_row.*")


QUERIES = {"op8_quality_rules": op8_quality_rules}

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: The kept rows' metrics in DuckDB; used by the oracle of op8 and as the first stage of the pipeline's tests.
VERDICT_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g') <> '') AS lines
  FROM documents),
win AS (
  SELECT rid, i, list_slice(words, i, i + 7) AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 9)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS n_upper,
         length(regexp_replace(t, '\\P{{L}}+', '', 'g')) AS n_letters,
         len(list_filter(regexp_split_to_array(lower(regexp_replace(t, '[.,;:!?]', '', 'g')), '[\\x20\\x09-\\x0D]+'), lambda x: x IN ({_STOPS}))) AS n_stop,
         len(list_filter(lines, lambda x: rtrim(x) LIKE '%...')) AS n_ellipsis,
         len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^[-*•]'))) AS n_bullets
  FROM w LEFT JOIN rep USING (rid)),
r AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
         CASE WHEN n_letters > 0 THEN n_upper / n_letters ELSE 0 END AS upper_ratio,
         CASE WHEN word_chars > 0 THEN n_letters / word_chars ELSE 0 END AS alpha_ratio,
         CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0 END AS ellipsis_ratio,
         CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END AS bullet_ratio
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"(n_words >= {r.min_words} AND ({' OR '.join([f'{r.metric} < {r.low}'] * (r.low is not None) + [f'{r.metric} > {r.high}'] * (r.high is not None))}))" for r in RULES)}) AS kept
FROM r"""
ORACLES = {"op8_quality_rules": VERDICT_SQL}
