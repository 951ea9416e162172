"""Tables in pages, header values carried down, sections, gates, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_html, clean_list


def html_items(pages: DataFrame, tag: str = "li") -> DataFrame:
    """page_id, place, text: the cleaned content of every element of a tag."""
    found = F.regexp_extract_all("html", F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1)
    return pages.select("page_id", F.posexplode(found).alias("place", "raw")).select("page_id", F.col("place").cast("long").alias("place"), clean_html(F.col("raw")).alias("text"))


def html_rows(pages: DataFrame) -> DataFrame:
    """page_id, place, cells: rows of tables whose first cell starts with a digit."""
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1), clean_html)
    return pages.select("page_id", F.posexplode(rows).alias("place", "row")).select("page_id", "place", cells.alias("cells")).where(F.get("cells", F.lit(0)).rlike("^[0-9]"))


def grouped_rows(pages: DataFrame) -> DataFrame:
    """page_id, place, category, notification, cells: rows of three cells or more of grouped tables.

    A row of one cell names the category of the rows below it; a fourth cell that
    speaks of an order is the notification of its row and of those below.
    """
    rows = F.regexp_extract_all("html", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1), clean_html)
    flat = pages.select("page_id", F.posexplode(rows).alias("place", "row")).select("page_id", F.col("place").cast("long").alias("place"), cells.alias("cells"))
    first, said = F.get("cells", F.lit(0)), F.get("cells", F.lit(3))
    flat = carried_down(flat, F.when((F.size("cells") == 1) & (first != "") & ~F.startswith(first, F.lit("Sr")), first), ["page_id"], ["place"], "category")
    flat = carried_down(flat, F.when(said.rlike("Order|S\\.O\\.|Notification"), said), ["page_id"], ["place"], "notification")
    return flat.where(F.size("cells") >= 3).select("page_id", "place", "category", "notification", "cells")


def carried_down(rows: DataFrame, value: Column, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with the last value that isn't null, up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def gate(records: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """records with `failed`, the names of rules that don't hold; a rule that is null doesn't hold."""
    return records.withColumn("failed", F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in rules.items())), lambda x: x.isNotNull()))


def validated(records: DataFrame, numbers: list[str], lists: list[str], shortest: dict[str, int], kinds: dict[str, list[str]]) -> DataFrame:
    """records with numbers completed, lists cleaned, and `failed`, what doesn't hold (null where all does).

    A number may not be blank, and gets its prefix where it has none; a year is
    1900 to 2050 or null; texts in `shortest` have a least length, columns in
    `kinds` one of some values, and lists at least one entry.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    done = lambda c: F.when(plain(c) == "", "").when(plain(c).rlike(r"(?i)^(?:IS|IS/ISO|IS/IEC)\b"), plain(c)).otherwise(F.concat(F.lit("IS "), plain(c)))
    rows = records.withColumns({c: done(c) for c in numbers} | {c: clean_list(F.coalesce(F.col(c), F.array())) for c in lists})
    rules = {c: F.col(c) != "" for c in numbers} | {"year": F.col("year").isNull() | F.col("year").between(1900, 2050)}
    rules |= {c: F.length(F.col(c)) >= n for c, n in shortest.items()} | {c: F.col(c).isin(v) for c, v in kinds.items()} | {c: F.size(c) > 0 for c in lists}
    return gate(rows, rules).withColumn("failed", F.when(F.size("failed") > 0, F.col("failed")))


def ratio(passed: Column, applies: Column) -> Column:
    """Share of rows that pass among those a metric applies to; null where it applies to none."""
    return F.round(F.count_if(passed & applies) / F.nullif(F.count_if(applies), F.lit(0)), 6)


def section(text: Column, heading: str = r"\d+\s+REFERENCES", following: str = r"\d+\s+[A-Z]") -> Column:
    """From a heading to the next one; the whole text without such a section."""
    found = F.regexp_extract(text, rf"(?s)(?:^|\n)({heading}.*?)(?:\n{following}|$)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), text)
