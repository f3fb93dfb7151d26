"""Text shaping as Column expressions: cleaning, quality, paths, chunk ids, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscore of any script, as Java and RE2 both read it.
WORD = r"[\p{L}\p{N}_]+"

#: Folder names of each category, asked in this order (fixed values).
CATEGORY_FOLDERS = (
    ("case_law", ("high court case laws", "supreme court case laws", "aar", "other app result")),
    ("circular", ("circulars", "circular", "icai", "brochures", "faqs", "circulars(2017-2025)")),
    ("notification", ("notification", "notifications", "rate_notifications_2.0")),
    ("statute", ("act", "rules", "cgst", "igst", "utgst", "export", "cgst acts", "igst acts", "igst rules")),
)

STOP_WORDS = ("the", "of", "and", "to", "in", "is", "for", "on", "with", "as", "by", "at", "be", "or", "an", "that", "this", "it", "from", "are")


def clean_text(c: Column) -> Column:
    """Drops form feeds and other control characters, collapses blanks and long runs of line feeds, trims."""
    c = F.regexp_replace(c, "\x0c", "")
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.regexp_replace(c, "[\\x00-\\x09\\x0B-\\x1F\\x7F]", "")
    return F.regexp_replace(c, "^[ \n]+|[ \n]+$", "")


def fold_marks(c: Column) -> Column:
    """Typographic quotes and dashes as plain ones."""
    return F.translate(c, "‘’“”–—", "''\"\"--")


def alpha_quality(c: Column) -> Column:
    """Share of letters among the characters; 0.0 for an empty or null text."""
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"\P{L}", "")) / F.length(c)).otherwise(F.lit(0.0))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def meaningful_ratio(c: Column) -> Column:
    """Share of words of letters only that are longer than two characters."""
    w = words(c)
    good = F.size(F.filter(w, lambda x: x.rlike(r"^\p{L}{3,}$")))
    return F.when(F.size(w) > 0, good / F.size(w)).otherwise(F.lit(0.0))


def html_strip(c: Column) -> Column:
    return F.regexp_replace(c, "<.*?>", "")


def ladder(cases: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda rest, x: F.when(x[0], F.lit(x[1])).otherwise(rest), reversed(cases), F.lit(default))


def has(c: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def document_type(path: Column) -> Column:
    p = F.lower(path)
    return ladder(
        [
            (has(p, "act", "cgst", "igst"), "Statute"),
            (has(p, "rule"), "Rules"),
            (has(p, "notification"), "Notification"),
            (has(p, "circular"), "Circular"),
            (has(p, "case laws", "aar"), "Case Law"),
            (has(p, "faq"), "FAQ"),
        ],
        "Other",
    )


def category(path: Column) -> Column:
    """First category with a folder that is a component of the path, or of four characters at least and the start of one."""
    p = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))

    def fits(folders):
        whole = reduce(lambda a, b: a | b, [F.concat(F.lit("/"), p).contains(f"/{f}/") for f in folders])
        starts = [F.concat(F.lit("/"), p).contains(f"/{f}") for f in folders if len(f) >= 4]
        return reduce(lambda a, b: a | b, [whole, *starts])

    return ladder([(fits(folders), name) for name, folders in CATEGORY_FOLDERS], "other")


def source_priority(path: Column) -> Column:
    """1 (an act) to 10 (unknown): lower is more authoritative."""
    p = F.lower(path)
    act = has(p, "cgst acts", "igst acts", "utgst", "/act/") | p.startswith("act/") | (has(p, "cgst", "igst") & p.contains("act") & ~p.contains("rules"))
    return ladder(
        [
            (act, 1),
            (has(p, "rules"), 2),
            (has(p, "notification"), 3),
            (has(p, "circular"), 4),
            (has(p, "icai"), 5),
            (has(p, "aar", "advance"), 6),
            (has(p, "high court", "supreme court"), 7),
            (has(p, "form", "apl"), 8),
            (has(p, "excel", ".xlsx"), 9),
        ],
        10,
    )


def authority_weight(path: Column) -> Column:
    """(11 - priority) / 10, so that more is better."""
    return (11 - source_priority(path)) / 10.0


def _group(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def path_year(path: Column) -> Column:
    """A four-digit component, else one between separators, from 2010 to 2030."""
    y = F.coalesce(_group(path, r"(?:^|/)(\d{4})/"), _group(path, r"[-_](\d{4})[-_.]")).cast("int")
    return F.when(y.between(2010, 2030), y)


def circular_key(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    n = F.coalesce(_group(name, r"(?:circular|cir)[-_. ]*(?:no[-_. ]*)?(\d{1,3})"), _group(name, r"^(\d{1,3})-\d{1,3}-\d{4}"))
    return F.when(n.isNotNull(), F.concat(F.lit("CIRCULAR_"), n.cast("int").cast("string")))


def act_prefix(path: Column) -> Column:
    p = F.lower(path)
    return ladder([(has(p, "utgst"), "UTGST"), (has(p, "igst"), "IGST")], "CGST")


def case_name(filename: Column) -> Column:
    c = F.regexp_replace(filename, r"\.[A-Za-z0-9]+$", "")
    c = F.translate(c, "+_", "  ")
    return F.trim(F.regexp_replace(c, r" - [A-Z ]+$", ""))


def chunk_id(doc_type: Column, name: Column, structure: Column, text: Column, index: Column) -> Column:
    """TYP_NAME_STRUCTURE_hash; the hash covers the position, so that equal texts in one document differ."""
    digest = F.substring(F.md5(F.concat_ws("|", name, index.cast("string"), text)), 1, 6)
    return F.concat_ws("_", F.upper(F.substring(doc_type, 1, 3)), F.upper(F.substring(F.regexp_replace(name, "[^A-Za-z0-9]", ""), 1, 20)), structure, digest)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)


def reference_tokens(c: Column) -> Column:
    """Word tokens, then compound references (section_16_2), hyphen codes (drc-01) and circular numbers."""
    t = F.lower(c)
    compound = F.transform(
        F.regexp_extract_all(t, F.lit(r"\b((?:section|rule|schedule|article|clause)\s+\d+(?:[(\w)]+)*)"), 1), lambda x: F.regexp_replace(x, "[^a-z0-9]", "_")
    )
    codes = F.regexp_extract_all(t, F.lit(r"\b([a-z]{2,5}-[0-9a-z_]+)\b"), 1)
    circulars = F.transform(F.regexp_extract_all(t, F.lit(r"\b(?:circular|cir)[-_.\s]*(?:no\.?[-_.\s]*)?(\d{2,3})\b"), 1), lambda x: F.concat(F.lit("circular_"), x))
    return F.concat(tokens(c), compound, codes, circulars)


def simple_tokens(c: Column, stop=STOP_WORDS) -> Column:
    """Runs of ASCII letters and digits longer than one that aren't stop words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1), lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def char_windows(c: Column, width: int = 1500, step: int = 1300, tail: int = 200) -> Column:
    """Windows of `width` characters every `step`, as array of (at, text)."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.length(c) - tail) - 1, F.lit(step))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.substring(c, i + 1, F.lit(width)).alias("text")))


def word_windows(c: Column, size: int = 800, overlap: int = 100) -> Column:
    w = words(c)
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i + 1, size), " ").alias("text")))


def with_context(context: Column, text: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\n"), text)).otherwise(text)


def cache_key(c: Column) -> Column:
    return F.sha2(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), 256)


def key_matches(citation: Column, target: Column) -> Column:
    """SEC_17 matches SEC_17, SEC_17_5 and SEC_17A, not SEC_170."""
    after = F.substring(citation, F.length(target) + 1, F.lit(1))
    return (citation == target) | (F.startswith(citation, target) & after.rlike("[_A-Za-z]"))


def path_url(base: str, path: Column) -> Column:
    return F.concat(F.lit(base), F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")))
