"""Citations, amounts, tax formulas and number checks as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Citation patterns and the part each gives a key (fixed values).
CITATIONS = (
    ("SEC", r"(?i)(?:Section|Sec\.|u/s|\bS\.)\s*(\d+[A-Z]*(?:\(\d+\))*(?:\([a-z]\))*)"),
    ("RULE", r"(?i)(?:Rule|u/r)\s+(\d+[A-Z]*(?:\(\d+\))*(?:\([a-z]\))*)"),
    ("NOTIF", r"(?i)Notification\s+No\.?\s*(\d+[/-]\d+)"),
    ("CIRC", r"(?i)Circular\s+No\.?\s*(\d+[/-]\d+[/-]\d+)"),
    ("SCHED", r"(?i)Schedule\s+(III|II|IV|VI|V|I|[1-6])"),
)
#: Of each kind of citation words of which every match holds one, in lower case: they are sought first, as the patterns take much longer.
CITATION_WORDS = {"SEC": ("section", "sec.", "u/s", "s."), "RULE": ("rule", "u/r"), "NOTIF": ("notification",), "CIRC": ("circular",), "SCHED": ("schedule",)}
ACT = r"(?i)(?:CGST|IGST|SGST|UTGST|GST)\s+Act"
#: Numbers that need no source (fixed values).
SAFE_NUMBERS = ("0", "1", "2", "3", "4", "5", "10", "100")
RATE = r"(\d+(?:\.\d+)?)\s*(?:%|per\s*cent)"
RUPEES = r"(?:₹|Rs\.?|INR)\s*([\d,]+(?:\.\d+)?)"
DAYS = r"(\d+)\s*(?:days?|months?|years?)"


def normal_citation(kind: Column | str, value: Column, act: str = "CGST") -> Column:
    v = F.upper(F.translate(F.trim(value), "/-()", "___"))
    return F.concat(F.lit(f"{act}_"), F.lit(kind) if isinstance(kind, str) else kind, F.lit("_"), v)


def citation_keys(text: Column, act: str = "CGST") -> Column:
    """Distinct keys in order of their kind, then of the text, whatever their case; ACT where an act is named."""
    of_kind = lambda k: lambda v: normal_citation(k, v, act)
    none, t = F.array().cast("array<string>"), F.lower(text)
    named = F.when(t.contains("act") & text.rlike(ACT), F.array(F.lit("ACT"))).otherwise(none)
    found = [F.when(text.isNull() | any_of(t, CITATION_WORDS[k]), F.transform(F.regexp_extract_all(text, F.lit(p), 1), of_kind(k))).otherwise(none) for k, p in CITATIONS]
    return F.array_distinct(F.concat(*found, named))


def canonical_key(key: Column) -> Column:
    """One spelling for keys of the older vocabularies."""
    k = F.regexp_replace(key, "_RUL_", "_RULE_")
    k = F.regexp_replace(k, "_SCH_", "_SCHED_")
    return F.regexp_replace(k, r"^(?:[A-Z]+_)?CIRC_(\d+)(?:_.*)?$", "CIRCULAR_$1")


def base_key(key: Column) -> Column:
    return F.substring_index(key, "_", 3)


def query_refs(q: Column) -> Column:
    """Section, rule, schedule and circular keys of a query; both acts where none is named in it."""
    t = F.lower(q)
    named = [(w, F.when(t.contains(w), F.lit(a))) for w, a in (("cgst", "CGST"), ("igst", "IGST"), ("sgst", "SGST"), ("utgst", "UTGST"))]
    acts = F.array_compact(F.array(*[c for _, c in named]))
    acts = F.when(F.size(acts) > 0, acts).otherwise(F.array(F.lit("CGST"), F.lit("IGST")))

    def each(pattern, part):
        found = F.regexp_extract_all(t, F.lit(pattern), 1)
        return F.flatten(F.transform(found, lambda n: F.transform(acts, lambda a: F.concat(a, F.lit(part), n))))

    schedules = F.transform(F.regexp_extract_all(t, F.lit(r"\bschedule\s+([ivxlcdm]+|\d+)\b"), 1), lambda n: F.concat(F.lit("CGST_SCHED_"), F.upper(n)))
    circulars = F.transform(F.regexp_extract_all(t, F.lit(r"\bcircular\s+(?:no\.?\s*)?(\d{2,3})\b"), 1), lambda n: F.concat(F.lit("CIRCULAR_"), n))
    return F.array_distinct(F.concat(each(r"\bsec(?:tion)?\s*\.?\s*(\d+)", "_SEC_"), each(r"\brule\s+(\d+)", "_RULE_"), schedules, circulars))


def _number(c: Column, pattern: str) -> Column:
    return F.replace(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def amount(c: Column) -> Column:
    """The first amount, with lakh as 1e5 and crore as 1e7, as decimal(18,2)."""
    t = F.lower(c)
    crore = _number(t, r"([\d,]+(?:\.\d+)?)\s*crore") * 10_000_000
    lakh = _number(t, r"([\d,]+(?:\.\d+)?)\s*lakh") * 100_000
    plain = _number(t, r"(?:₹|rs\.?|inr)\s*([\d,]+(?:\.\d+)?)")
    return F.coalesce(crore, lakh, plain).cast("decimal(18,2)")


def percentage(c: Column) -> Column:
    return _number(F.lower(c), RATE)


def days(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(c), r"(\d+)\s*days?", 1), F.lit("")).cast("int")


def credit_reversal(amt: Column, pct: Column) -> Column:
    return F.round(amt * pct / 100, 2).cast("decimal(18,2)")


def capital_goods_reversal(amt: Column, pct: Column) -> Column:
    """A sixtieth a month, rounded, then the exempt share."""
    return F.round(F.round(amt / 60, 2) * pct / 100, 2).cast("decimal(18,2)")


def delay_interest(amt: Column, n_days: Column, rate: int = 18) -> Column:
    return F.round(amt * rate * n_days / F.lit(36500), 2).cast("decimal(18,2)")


def tax_parts(amt: Column, rate: Column) -> Column:
    tax = F.round(amt * rate / 100, 2).cast("decimal(18,2)")
    return F.struct(tax.alias("tax"), F.round(tax / 2, 2).cast("decimal(18,2)").alias("half"), (amt + tax).cast("decimal(18,2)").alias("total"))


def numeric_claims(c: Column) -> Column:
    rates = F.transform(F.regexp_extract_all(c, F.lit(RATE), 1), lambda x: F.concat(x, F.lit("%")))
    rupees = F.transform(F.regexp_extract_all(c, F.lit(RUPEES), 1), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.array_sort(F.array_distinct(F.concat(rates, rupees, F.regexp_extract_all(c, F.lit(DAYS), 1))))


def ungrounded(answer: Column, context: Column) -> Column:
    """Claims of the answer that the context holds neither as a claim nor as text."""
    known = numeric_claims(context)
    bare = lambda x: F.replace(x, F.lit("%"), F.lit(""))
    return F.filter(numeric_claims(answer), lambda x: ~bare(x).isin(*SAFE_NUMBERS) & ~F.array_contains(known, x) & ~F.contains(context, bare(x)))


def citation_variants(c: Column) -> Column:
    """The citation, then without sub-clauses, then its number."""
    base = F.regexp_replace(c, r"\([^)]*\)", "")
    return F.array_distinct(F.array(F.lower(c), F.lower(base), F.lower(F.regexp_extract(c, r"(\d+[A-Z]*)", 1))))


def safety_band(confidence: Column) -> Column:
    return F.when(confidence < 0.4, "refuse").when(confidence < 0.65, "caution").when(confidence < 0.8, "review").otherwise("ok")


def any_of(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])
