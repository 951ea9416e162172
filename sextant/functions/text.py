"""Column functions for designators, citations, dates and free text. All are built-in Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a search ignores.
STOPWORDS = [
    "a", "an", "the", "and", "or", "of", "to", "for", "with", "in", "on", "at",
    "by", "from", "as", "is", "are", "was", "were", "be", "been", "that", "this",
    "it", "specification", "requirements", "standard", "indian", "code", "practice",
]

# Words that tell a ministry, in order of precedence, and the one without such a word.
MINISTRIES = [
    ("steel", "Ministry of Steel"),
    ("iron", "Ministry of Steel"),
    ("cement", "Department for Promotion of Industry and Internal Trade (DPIIT)"),
    ("electronics", "Ministry of Electronics and Information Technology (MeitY)"),
    ("information technology", "Ministry of Electronics and Information Technology (MeitY)"),
    ("chemical", "Ministry of Chemicals and Petrochemicals"),
    ("petrochemical", "Ministry of Chemicals and Petrochemicals"),
    ("fertilizer", "Ministry of Chemicals and Petrochemicals"),
    ("heavy industry", "Ministry of Heavy Industries"),
    ("transformer", "Ministry of Heavy Industries"),
    ("cable", "Ministry of Heavy Industries"),
    ("motor", "Ministry of Heavy Industries"),
    ("textile", "Ministry of Textiles"),
    ("garment", "Ministry of Textiles"),
    ("cloth", "Ministry of Textiles"),
    ("solar", "Ministry of New and Renewable Energy (MNRE)"),
    ("renewable", "Ministry of New and Renewable Energy (MNRE)"),
    ("food", "Ministry of Consumer Affairs, Food and Public Distribution"),
    ("water", "Ministry of Consumer Affairs, Food and Public Distribution"),
    ("consumer", "Ministry of Consumer Affairs, Food and Public Distribution"),
    ("hallmarking", "Ministry of Consumer Affairs, Food and Public Distribution"),
    ("gold", "Ministry of Consumer Affairs, Food and Public Distribution"),
    ("silver", "Ministry of Consumer Affairs, Food and Public Distribution"),
    ("road", "Ministry of Road Transport and Highways (MoRTH)"),
    ("helmet", "Ministry of Road Transport and Highways (MoRTH)"),
    ("vehicle", "Ministry of Road Transport and Highways (MoRTH)"),
    ("toy", "Department for Promotion of Industry and Internal Trade (DPIIT)"),
    ("footwear", "Department for Promotion of Industry and Internal Trade (DPIIT)"),
    ("leather", "Department for Promotion of Industry and Internal Trade (DPIIT)"),
    ("plywood", "Department for Promotion of Industry and Internal Trade (DPIIT)"),
    ("wood", "Department for Promotion of Industry and Internal Trade (DPIIT)"),
    ("glass", "Department for Promotion of Industry and Internal Trade (DPIIT)"),
    ("boiler", "Department for Promotion of Industry and Internal Trade (DPIIT)"),
    ("cylinder", "Ministry of Petroleum and Natural Gas"),
    ("gas", "Ministry of Petroleum and Natural Gas"),
    ("petroleum", "Ministry of Petroleum and Natural Gas"),
    ("environment", "Ministry of Environment, Forest and Climate Change"),
    ("medical", "Ministry of Health and Family Welfare"),
    ("drug", "Ministry of Health and Family Welfare"),
]
DEFAULT_MINISTRY = "Department for Promotion of Industry and Internal Trade (DPIIT)"

# Roman part numerals.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}

# Scripts by Unicode block, in order of precedence, and locale codes.
SCRIPTS = [("[\\u0900-\\u097F]", "hi"), ("[\\u0980-\\u09FF]", "bn"), ("[\\u0A80-\\u0AFF]", "gu"), ("[\\u0B80-\\u0BFF]", "ta"), ("[\\u0C00-\\u0C7F]", "te")]
LOCALES = [
    ("[\\u0900-\\u097F]", "hi-IN"), ("[\\u0B80-\\u0BFF]", "ta-IN"), ("[\\u0C00-\\u0C7F]", "te-IN"), ("[\\u0C80-\\u0CFF]", "kn-IN"), ("[\\u0980-\\u09FF]", "bn-IN"),
    ("[\\u0A80-\\u0AFF]", "gu-IN"), ("[\\u0D00-\\u0D7F]", "ml-IN"), ("[\\u0A00-\\u0A7F]", "pa-IN"), ("[\\u0B00-\\u0B7F]", "od-IN"),
]


def tokens(text: Column) -> Column:
    """Search tokens: designators joined to one token, other words of two letters or digits at least, no stopwords; repeats stay."""
    t = low = F.lower(F.coalesce(text, F.lit("")))
    for pattern, put in ((r"\bis\s+(\d+)\b", "is_$1"), (r"\bis/iso\s+(\d+)\b", "is_iso_$1"), (r"\bis/iec\s+(\d+)\b", "is_iec_$1"), (r"\bfe\s+(\d+[a-z]?)\b", "fe_$1")):
        t = F.regexp_replace(t, pattern, put)
    t = F.when(low.rlike(r"\b(?:is(?:/iso|/iec)?|fe)\s+\d"), t).otherwise(low)
    words = F.regexp_extract_all(t, F.lit(r"(?<![\p{L}\p{N}_])[a-z0-9_]{2,}+(?![\p{L}\p{N}_])"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def bigrams(words: Column) -> Column:
    """Words and pairs of neighbours, joined by one space."""
    after = F.slice(words, F.lit(2), F.size(words))
    return F.concat(words, F.array_compact(F.zip_with(words, after, lambda a, b: F.concat(a, F.lit(" "), b))))


def canonical_key(text: Column) -> Column:
    """Look-up key: upper case, without spaces, brackets, slashes, colons, dashes and underscores."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), r"[\s()/:\-_]+", "")


def node_id(text: Column) -> Column:
    """Runs of other characters than letters and digits become one underscore; none at either end."""
    return F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")


def bare_number(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)^IS(/ISO|/IEC)?\s*", "")


def base_designator(text: Column) -> Column:
    return F.trim(F.substring_index(text, ":", 1))


def year_of(text: Column) -> Column:
    """The year behind a colon, else the first year of the 20th or 21st century; null without one."""
    year = F.coalesce(F.nullif(F.regexp_extract(text, r":\s*(\d{4})", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit("")))
    return year.cast("int")


def part_number(text: Column) -> Column:
    """The part of a citation as an Arabic number: digits as they are, Roman numerals up to twelve, one misread letter."""
    raw = F.lower(F.regexp_extract(text, r"(?i)\bpart\s*([0-9]+|[ivxl]+)\b", 1))
    roman = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    return F.when(raw.rlike("^[0-9]+$"), raw.cast("int")).otherwise(F.element_at(roman, F.regexp_replace(raw, "l", "i")))


def _cleaned_citation(text: Column) -> Column:
    raw = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), "[.,;:]+$", "")
    raw = F.regexp_replace(raw, r"(?i)^[li]\s*ec\b", "IEC")
    raw = F.regexp_replace(F.regexp_replace(raw, r"(?i)^is\s*/\s*", "IS/"), r"\s+", " ")
    return F.regexp_replace(raw, r"(?i)\s*\((?:in various|all parts|parts? \d+ to \d+)[^)]*\)", "")


def _citation_parts(raw: Column) -> Column:
    year = F.coalesce(F.nullif(F.regexp_extract(raw, r":\s*(\d{4})\b", 1), F.lit("")), F.nullif(F.regexp_extract(raw, r"\d\D*\b((?:19|20)\d{2})$", 1), F.lit("")))
    rest = F.regexp_replace(raw, r"(?i)\(?\s*\bpart\s*(?:[0-9]+|[ivxl]+)\b\s*\)?", " ")
    rest = F.when(raw.rlike(r":\s*\d{4}\b"), F.regexp_replace(rest, r":\s*\d{4}\b", "")).otherwise(F.regexp_replace(rest, r"(\d\D*)\b(?:19|20)\d{2}$", "$1"))
    rest = F.trim(F.regexp_replace(F.regexp_replace(rest, r"[:\s-]+$", ""), r"\s+", " "))
    return F.struct(raw.alias("raw"), part_number(raw).alias("part"), year.alias("year"), rest.alias("rest"))


def _joined_citation(p: Column) -> Column:
    base = F.when(p["rest"].rlike(r"(?i)^(?:IS|ISO|IEC|ASTM|EN|DIN|BS)\b"), p["rest"]).otherwise(F.concat(F.lit("IS "), p["rest"]))
    out = F.concat(base, F.coalesce(F.concat(F.lit(" (Part "), p["part"].cast("string"), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(":"), p["year"]), F.lit("")))
    return F.when(p["raw"] == "", "").otherwise(out)


def normalise_citations(texts: Column) -> Column:
    """One notation for an array of citations: PREFIX number (Part n):year.

    A number at the end is a year only behind another number, so `IS 1904` is no
    year.  Each step is a pass over the array, so that nothing is worked out twice.
    """
    return F.transform(F.transform(F.transform(texts, _cleaned_citation), _citation_parts), _joined_citation)


def normalise_citation(text: Column) -> Column:
    return F.get(normalise_citations(F.array(text)), F.lit(0))


def parse_date(text: Column) -> Column:
    """A date from ISO, day-month-year or worded notation; the next notation is tried where one gives no date, else null.

    Months are named in full or by three letters.
    """
    iso = F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    numeric = r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\b"
    dmy = F.concat_ws("-", *(F.regexp_extract(text, numeric, k) for k in (1, 2, 3)))
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    short = "|".join(m[:3] for m in months.split("|"))
    worded = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({months}|{short}),?\s+(\d{{4}})\b"
    month = F.initcap(F.substring(F.regexp_extract(text, worded, 2), 1, 3))
    dmon = F.concat_ws("-", F.regexp_extract(text, worded, 1), month, F.regexp_extract(text, worded, 3))
    return F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), F.try_to_date(dmy, "d-M-yyyy"), F.try_to_date(dmon, "d-MMM-yyyy"))


def citation_key(text: Column, year: bool = True, prefix: bool = True) -> Column:
    """A light notation of a number for joins: one space, parts in brackets, no marks at the end; with its year or without, with the prefix put before it or not."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " ")
    t = t if year else F.regexp_replace(t, r":\s*\d{4}", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\s*:\s*Part\s*(\d+)", " (Part $1)"), r"(?i)(?<!\()\bPart\s*(\d+)", "(Part $1)")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[.,;:]+$", ""), r"\s+", " "))
    # By a pattern, as a condition would work out all of this once more for each of its branches.
    return F.regexp_replace(t, r"^(?!IS|\z)", "IS ") if prefix else t


def lifecycle(text: Column) -> Column:
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.when(up.contains("WITHDRAWN"), "WITHDRAWN").when(up.rlike("SUPERSEDED|SUPERCEDED|SUPERSEDING"), "SUPERSEDED").otherwise("ACTIVE")


def script(text: Column, blocks: list[tuple[str, str]] = SCRIPTS, default: str = "en") -> Column:
    """The language of the first block of which the text has a character."""
    out = F.lit(default)
    for pattern, name in reversed(blocks):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def mostly_ascii(text: Column, most: float = 0.05) -> Column:
    return F.length(F.regexp_replace(text, "[\\x00-\\x7F]", "")) / F.greatest(F.lit(1), F.length(text)) < most


def clean_html(html: Column) -> Column:
    """Text of markup: tags to spaces, two entities resolved, white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", " "), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.replace(F.replace(t, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")), r"\s+", " "))


def context(text: Column, found: Column, reach: int = 75) -> Column:
    """The lower-cased text around the first place of `found`; empty where it isn't there."""
    at = F.position(found, text)
    start = F.greatest(F.lit(1), at - reach)
    return F.when(at > 0, F.lower(F.substring(text, start, at - start + F.length(found) + reach))).otherwise("")


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the text holds any of the words, anywhere."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def whole_word(text: Column, words: list[str]) -> Column:
    return text.rlike(r"\b(?:" + "|".join(w.replace(".", r"\.").replace("/", "/") for w in words) + r")\b")


def first_class(text: Column, classes: list[tuple[str, list[str]]], default: str | None = None, whole: bool = True) -> Column:
    """The first class of which the text has a keyword."""
    out = F.lit(default)
    for name, words in reversed(classes):
        out = F.when(whole_word(text, words) if whole else any_of(text, words), name).otherwise(out)
    return out


def keywords(text: Column, words: list[str]) -> Column:
    """array of the words that stand whole in the text, wherever they do; of several that begin at one place the longest. The text is gone through once."""
    ends: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        ends.setdefault(w[0], []).append(re.escape(w[1:]))
    one = "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in ends.items())
    return F.regexp_extract_all(text, F.lit(rf"\b(?=({one})\b)"), F.lit(1))


def first_found(found: Column, classes: list[tuple[str, list[str]]], words: list[str]) -> Column:
    """The same as `first_class`, from what `keywords` found of all words: a longer one also holds those that it begins with."""
    out = F.lit(None).cast("string")
    for name, own in reversed(classes):
        holds = [w for w in words if any(re.match(rf"{re.escape(o)}\b", w) for o in own)]
        out = F.when(F.exists(found, lambda k: k.isin(holds)), name).otherwise(out)  # noqa: B023
    return out


def ministry(order: Column, product: Column, rules: list[tuple[str, str]] = MINISTRIES, default: str = DEFAULT_MINISTRY) -> Column:
    """The ministry of the first word that an order's name or its product holds."""
    said = F.lower(F.concat_ws(" ", order, product))
    return first_class(said, [(name, [word]) for word, name in rules], default, whole=False)


def clean_list(values: Column) -> Column:
    """White space collapsed, blanks dropped, the first of equal values kept, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v.isNotNull() & (v != "")))


def bounded_score(score: Column) -> Column:
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.01), score)), 4)


def band(score: Column, low: float = 0.25) -> Column:
    return F.when(score >= 0.65, "STRONG").when(score >= 0.40, "MODERATE").when(score >= low, "LOW").otherwise("INSUFFICIENT")


def licence_key(text: Column) -> Column:
    """The first seven digits; null with fewer."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 7, F.substring(digits, 1, 7))


def weighted_checksum(key: Column) -> Column:
    """Sum of each digit times its place, modulo 7."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.lit(0), lambda acc, i: acc + F.substring(key, i, F.lit(1)).cast("int") * i) % 7


def scheme_label(text: Column) -> Column:
    """One label for each way to write a certification scheme; others stay as they are."""
    t = F.trim(text)
    return (
        F.when(t.contains("Scheme-II") | t.contains("CRS"), "Scheme-II (CRS)").when(t.contains("Scheme-I") | t.contains("ISI"), "Scheme-I")
        .when(t.contains("Hallmark"), "Hallmarking").when(t.contains("Scheme-X"), "Scheme-X").otherwise(t)
    )


def series(text: Column) -> Column:
    """base and part (null without one) of a designator."""
    return F.struct(F.trim(F.regexp_replace(F.substring_index(text, ":", 1), r"(?i)\s*\(?\s*\bpart\b.*$", "")).alias("base"), part_number(text).alias("part"))


def gazette(text: Column) -> Column:
    """number and day of a notification."""
    number = F.nullif(F.regexp_extract(text, r"(?i)\b((?:S\.?\s*O\.?|G\.?\s*S\.?\s*R\.?)\s*\d+\s*\(?E?\)?)", 1), F.lit(""))
    return F.struct(F.trim(number).alias("number"), parse_date(text).alias("day"))
