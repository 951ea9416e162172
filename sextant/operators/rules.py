"""Operators that apply a small table of rules: keyword look-ups, reranking by weights, provenance and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import band, bounded_score
from ..sources.scratch import written
from .matching import MOST_RULES, contained, held, literal, matched  # noqa: F401  MOST_RULES is part of this module's interface


def first_match(texts: DataFrame, rules: DataFrame, id_col: str, whole_word: bool = True, default: str | None = None) -> DataFrame:
    """id_col, rule_id of the first rule (rule_id, ord, keyword) whose keyword the text has; the default (or null) without one."""
    low, word = F.lower(F.coalesce(texts["text"], F.lit(""))), F.col("keyword")
    rules = rules.where("keyword is not null").withColumn("needs", literal(word) if whole_word else word)
    within = lambda t, r: F.coalesce(F.contains(t, r["needs"]), F.lit(True)) & (F.regexp_like(t, F.concat(F.lit(r"\b"), r["keyword"], F.lit(r"\b"))) if whole_word else F.lit(True))
    rows = held(texts, rules, low, within)
    if rows is not None:
        first = F.array_min(F.transform("held", lambda r: F.struct(r["ord"].alias("ord"), r["rule_id"].alias("rule_id"))))["rule_id"]
        return rows.select(id_col, F.coalesce(first, F.lit(default)).alias("rule_id"))
    hit, needs = (F.regexp_like("low", F.concat(F.lit(r"\b"), word, F.lit(r"\b"))), literal(word)) if whole_word else (F.contains(F.col("low"), word), word)
    found = matched(texts, rules.drop("needs"), id_col, low, needs, hit).groupBy(id_col).agg(F.min_by("rule_id", F.struct("ord", "rule_id")).alias("rule_id"))
    return texts.select(id_col).join(found, id_col, "left").select(id_col, F.coalesce("rule_id", F.lit(default)).alias("rule_id"))


def either_contains(items: DataFrame, rules: DataFrame, id_col: str, key: str) -> DataFrame:
    """id_col, rule_id of the first rule whose keyword contains the item's key or is contained in it; null without one."""
    rules = rules.select("rule_id", "ord", "keyword")
    held = contained(items, rules, id_col, F.col(key), "keyword").select(id_col, "rule_id", "ord")
    names = items.select(F.col(id_col).alias("__item"), F.col(key).alias("__key"))
    holds = contained(rules.withColumn("__rule", F.struct("rule_id", "ord")), names, "__rule", F.col("keyword"), "__key").select(F.col("__item").alias(id_col), "__rule.rule_id", "__rule.ord")
    found = held.unionByName(holds).groupBy(id_col).agg(F.min_by("rule_id", F.struct("ord", "rule_id")).alias("rule_id"))
    return items.select(id_col).join(found, id_col, "left")


def reranked(ranked: DataFrame, queries: DataFrame, rules: DataFrame) -> DataFrame:
    """qid, doc_id, score, rank, label: scores plus the weights of rules (ord, word, item_no, weight) that a query's words and an item meet.

    A rule meets an item by its whole number.  ranked: qid, doc_id, item_no, score;
    only rows that are ranked already can move.
    """
    ranked = written(ranked)  # asked twice
    asked = contained(queries, rules.select("word", "item_no", "weight"), "qid", F.lower("text"), "word").select("qid", "item_no", "weight")
    extra = ranked.join(asked, ["qid", "item_no"]).groupBy("qid", "doc_id").agg(F.sum("weight").alias("extra"))
    scored = ranked.join(extra, ["qid", "doc_id"], "left").select("qid", "doc_id", bounded_score(F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).withColumn("label", band(F.col("score")))


def provenance(description: Column) -> Column:
    return F.when(F.contains(F.lower(description), F.lit("chronologically supersedes")), "CHRONOLOGICAL_INFERRED").otherwise("CURATED_UNVERIFIED")


def display_label(number: Column, order: Column, title: Column, node: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(number), blank(order), blank(title), node)


def category(kind: Column, label: Column) -> Column:
    return F.when((kind == "order") | F.lower(label).contains("order"), "order").when(F.lower(label).rlike("test|sampling"), "test").otherwise("standard")


def rows_after_header(lines: DataFrame, header: Column, by: str, order: str) -> DataFrame:
    """lines with in_table: whether a header line comes before."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("in_table", F.coalesce(F.max(header).over(w), F.lit(False)))


def with_following(lines: DataFrame, stop: Column, by: str, order: str, most: int = 3) -> DataFrame:
    """lines with context: the line and up to `most` lines after it, until one that stops."""
    w = Window.partitionBy(by).orderBy(order)
    text, go = F.col("text"), F.lit(True)
    for k in range(1, most + 1):
        go = go & ~F.coalesce(F.lead(stop, k).over(w), F.lit(True))
        text = F.concat_ws(" ", text, F.when(go, F.lead("text", k).over(w)))
    return lines.withColumn("context", text)
