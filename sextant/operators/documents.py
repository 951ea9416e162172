"""Whole documents: labelled fields, sections, metadata, references, and texts made from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, citation_key, lifecycle, normalise_citation, normalise_citations

# Headings, notation of references, and words that speak of tests.
HEADING = r"(?i)(?:^|\n)\s*(?:(?:SECTION\s+)?2\s+(?:NORMATIVE\s+)?REFERENCES\b|Clause\s+2\b|Normative\s+references\b)"
FOLLOWING = r"(?i)\n\s*(?:(?:SECTION\s+)?3\s+(?:TERMINOLOGY|DEFINITIONS|REQUIREMENTS|MATERIALS|SYMBOLS|GENERAL|SCOPE)\b|3\s+[A-Z\s]{4,}\b)"
STRICT_SECTIONS = [
    r"(?is)(2\s+(?:NORMATIVE\s+)?REFERENCES?.*?)(?=\n\s*3\s+[A-Z])", r"(?is)(Clause\s+2.*?REFERENCES?.*?)(?=\n\s*3\s+[A-Z])",
    r"(?is)(SECTION\s+2.*?REFERENCES?.*?)(?=\n\s*3\s+[A-Z])", r"(?is)(2\s+APPLICABLE\s+STANDARDS.*?)(?=\n\s*3\s+[A-Z])",
]
PART = r"(?:\s*(?:\(Part\s*[0-9IVXLCDM]+\)|Part\s*[0-9IVXLCDM]+))?(?:\s*:\s*\d{4})?"
EXPLICIT = rf"(?i)\b(?:IS(?:/ISO)?(?:/IEC)?\s+\d+|(?:[lI]\s*EC|ISO|ASTM|EN|BS)\s+[A-Z\d\-]+){PART}"
TABLE_ROW = rf"(?i)^\s*([1-9]\d+{PART})(?:\b|\s|$)"
NOT_A_ROW = r"(?i)^(?:IS\s+No|Title|Page|Table|Section)\b"
LINE_CITATION = r"(?i)\b(IS\s+\d+(?:[\s:\-]+(?:Part\s*\d+|\([^)]+\)))?)"
LINE_ROW = r"(?i)^\s*(\d{2,}(?:\s*(?:Part\s*\d+|\([^)]+\)))?(?:\s*:\s*\d{4})?)\s+(.*)"
TEST_WORDS = ["test", "testing", "method", "determination", "analysis", "sampling", "tensile", "bend", "impact", "compressive", "flexural", "sieve", "vicat", "hardness", "measurement", "dimensions", "resistance", "tolerances"]


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern's group matches first; null where it doesn't, or matches nothing."""
    return F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))


def completed_number(text: Column, prefix: str = "IS ") -> Column:
    """A scraped number without footnote stars, with the prefix where it has none."""
    plain = F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("*"), F.lit("")), r"\s+", " "))
    return F.when(plain == "", None).when(F.startswith(plain, F.lit(prefix.strip())), plain).otherwise(F.concat(F.lit(prefix), plain))


def labelled_fields(blobs: DataFrame, text_col: str = "description") -> DataFrame:
    """blobs with division, section, committee, designator, amendments, superseded_by, ics_code and status, each behind its label in one text.

    A committee is the code in brackets at the section, else the section; no
    successor is named by blanks, `none` or `decided by council`.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    section = _found(t, r"(?i)Section Name:\s*([^\n\r]+?)(?=\s*Designator of Legally|[\n\r]|$)")
    newer = _found(t, r"(?i)Superceded by:\s*([^\n\r.]+)")
    return blobs.withColumns({
        "division": F.coalesce(_found(t, r"(?i)Division Name:\s*([^\n\r]+?)(?=\s*Section Name:|[\n\r]|$)"), F.lit("General")), "section": F.coalesce(section, F.lit("")),
        "committee": F.coalesce(_found(section, r"\(([A-Z]{2,4}\s*\d+)\)"), section, F.lit("")),
        "designator": completed_number(_found(t, r"(?i)Designator of Legally Binding Document:\s*([^\n\r]+?)(?=\s*Title of Legally|[\n\r]|$)")),
        "amendments": F.coalesce(_found(t, r"Number of Amendments:\s*(\d+)").cast("int"), F.lit(0)),
        "superseded_by": F.when(~F.lower(newer).isin("none", "decided by council"), newer), "ics_code": F.coalesce(_found(t, r"(?i)ICS Code:\s*([\d.]+)"), F.lit("")), "status": lifecycle(t),
    })


def section(text: Column) -> Column:
    """The section of references, from its heading to the next section's; without a heading the whole text."""
    start = F.regexp_instr(text, F.lit(HEADING))
    rest = F.substring(text, start, F.length(text))
    stop = F.regexp_instr(F.substring(rest, F.lit(2), F.length(text)), F.lit(FOLLOWING))
    return F.when(start == 0, text).when(stop == 0, rest).otherwise(F.substring(rest, F.lit(1), stop))


def strict_section(text: Column, fallback: int = 0) -> Column:
    """The section by the first of four patterns that matches; else the first `fallback` characters of the text."""
    return F.coalesce(*(_found(text, p) for p in STRICT_SECTIONS), F.substring(text, 1, fallback) if fallback else F.lit(""))


def references(docs: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int | None = None) -> DataFrame:
    """id_col, cited: references of each document's section in one notation, explicit ones and then rows of tables, in order, once.

    A row is a number at the start of a line; a lone year and headers of tables
    are none.
    """
    part = docs.withColumn("section", section(F.coalesce(F.col(text_col), F.lit(""))))
    lines = F.filter(F.transform(F.split("section", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(NOT_A_ROW) & x.rlike(TABLE_ROW))
    rows = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, TABLE_ROW, 1))), lambda x: ~x.rlike(r"^(?:19|20)\d{2}$"))
    cited = F.array_distinct(F.filter(normalise_citations(F.concat(F.regexp_extract_all("section", F.lit(EXPLICIT), 0), rows)), lambda c: c != ""))
    return part.select(id_col, (F.slice(cited, 1, most) if most else cited).alias("cited"))


def metadata(docs: DataFrame, text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """docs with own_number, own_year, scope (two to eleven lines behind the heading) and keywords (ten words of the title, of four letters at least)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    number = normalise_citation(F.regexp_extract(t, r"(?i)\b(IS\s+\d+(?:\s*(?:\(Part\s*\d+\)|Part\s*\d+))?(?:\s*:\s*\d{4})?)\b", 1))
    out = docs.withColumn("own_number", F.coalesce(F.nullif(number, F.lit("")), F.lit("IS Unknown")))
    year = F.coalesce(_found(F.col("own_number"), r":\s*(\d{4})\b"), _found(t, r"\b(19\d{2}|20\d{2})\b")).cast("int")
    scope = _found(t, r"(?i)(?:^|\n)\s*(?:1\s+)?SCOPE\b\s*([^\n\r]+(?:\n[^\n\r]+){1,10})")
    title = F.coalesce(F.col(title_col), F.lit("")) if title_col else F.lit("")
    words = F.slice(F.transform(F.regexp_extract_all(title, F.lit(r"\b[A-Za-z]{4,}\b"), 0), F.lower), 1, 10)
    return out.withColumns({"own_year": year, "scope": F.coalesce(F.when(F.length(scope) >= 10, scope), F.concat(F.lit("Standard specification for "), F.col("own_number"))), "keywords": words})


def line_edges(docs: DataFrame, id_col: str = "item_no", text_col: str = "text", fallback: int = 15_000) -> DataFrame:
    """source, target, relationship, clause, description: references of documents line by line, once each, the first line counts.

    A line's explicit citation comes first; else, behind a header of a table, the
    number that starts it.  A document doesn't cite itself.
    """
    text = strict_section(F.coalesce(F.col(text_col), F.lit("")), fallback)
    lines = docs.select(F.col(id_col).alias("source"), F.posexplode(F.transform(F.split(text, "\n"), lambda x: F.trim(x))).alias("line", "said"))
    header = F.contains("said", F.lit("IS No.")) | F.contains("said", F.lit("IS Number"))
    before = Window.partitionBy("source").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("in_table", F.coalesce(F.max(header).over(before), F.lit(False))).where(~header)
    explicit, row = F.regexp_extract("said", LINE_CITATION, 1), F.regexp_extract("said", LINE_ROW, 1)
    own = explicit != ""
    told = F.when(own, F.regexp_replace(F.trim(F.replace("said", explicit, F.lit(""))), r"^[\s:\-–]+", "")).otherwise(F.trim(F.regexp_extract("said", LINE_ROW, 2)))
    found = lines.where(own | (F.col("in_table") & (row != ""))).select(
        "source", "line", citation_key(F.when(own, explicit).otherwise(F.concat(F.lit("IS "), row)), year=False).alias("target"),
        F.when(any_of(F.lower("said"), TEST_WORDS), "TESTED_BY").otherwise("NORMATIVE_REF").alias("relationship"), F.when(own, "references").otherwise("table of references").alias("clause"), F.substring(told, 1, 250).alias("description"),
    ).where("target != source")
    first = found.groupBy("source", "target", "relationship").agg(F.min_by(F.struct("clause", "description"), "line").alias("first"))
    return first.select("source", "target", "relationship", "first.*")


def clause_text(number: Column, status: Column, order: Column, date: Column) -> Column:
    """A clause that cites an item, by the state of the order that governs it; without an order it is voluntary."""
    said = F.concat(F.lit("Supplies shall conform to "), number)
    return (
        F.when(order.isNull() | status.isNull(), F.concat(said, F.lit("; conformity is voluntary, no order applies.")))
        .when(status == "MANDATORY_IN_FORCE", F.concat(said, F.lit(" and bear the standard mark, under "), order, F.lit(" in force since "), date.cast("string"), F.lit(".")))
        .when(status == "PENDING_FUTURE_DATE", F.concat(said, F.lit("; the standard mark becomes mandatory on "), date.cast("string"), F.lit(" under "), order, F.lit(".")))
        .when(status == "RESCINDED", F.concat(said, F.lit("; "), order, F.lit(" is rescinded, the mark is voluntary.")))
        .when(status == "SUPERSEDED_BY_SUBSEQUENT_ORDER", F.concat(said, F.lit("; "), order, F.lit(" gave way to a later order, which is to be checked.")))
        .otherwise(F.concat(said, F.lit("; the date of "), order, F.lit(" is not verified.")))
    )


def amendment_notices(schedule: DataFrame) -> DataFrame:
    """doc_id, notice: the amendment schedule (doc_id, sl_no, existing, amended) of each document as one text."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("sl_no", "existing", "amended"))), lambda r: F.concat(r["sl_no"].cast("string"), F.lit(". "), r["existing"], F.lit(" -> "), r["amended"]))
    return schedule.groupBy("doc_id").agg(F.concat(F.lit("CORRIGENDUM\n"), F.array_join(rows, "\n")).alias("notice"))

