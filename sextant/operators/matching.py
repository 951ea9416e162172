"""Many rules against many texts: which texts hold which phrases.

Every phrase chooses one of its grams (three characters, or the whole of a shorter
phrase): the one that the fewest phrases have.  A text can hold a phrase only if it
has that gram, so texts' grams and rules meet in a join by equality, and only what
meets is looked at. Rules without a phrase that every match has meet every text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import small_side

#: Rules are mostly a table that a person writes; up to this many rows are broadcast, more are joined in shuffles.
MOST_RULES = 10_000
#: Grams that are broadcast at most, to leave out those of texts that no rule has.
MOST_GRAMS = 200_000
GRAM = 3
#: Rules that are tried one after another in the row of a text; of more, only those that share a gram with it are.
FEW_RULES = 64


def grams(text: Column) -> Column:
    """The different runs of one to GRAM characters of a text, and the empty one."""
    each = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *each))


def chosen(phrases: DataFrame) -> DataFrame:
    """phrase, gram: of every different phrase its longest gram that the fewest phrases have, ties to the smallest."""
    own = phrases.select("phrase").distinct().select("phrase", F.explode(grams(F.col("phrase"))).alias("gram")).where(F.length("gram") == F.least(F.length("phrase"), F.lit(GRAM)))
    counted = own.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    return counted.groupBy("phrase").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def literal(pattern: Column) -> Column:
    """A pattern that stands for itself; null for one with signs of regular expressions."""
    return F.when(~pattern.rlike(r"[\\^$.|?*+()\[\]{}]"), pattern)


def held(texts: DataFrame, rules: DataFrame, text: Column, hit: Callable[[Column, Column], Column]) -> DataFrame | None:
    """texts with `held`, an array of the rules (structs) that each row's text holds, without any shuffle of texts; None where rules are more than FEW_RULES.

    hit: whether a text and a rule's struct meet.
    """
    if rules.limit(FEW_RULES + 1).count() > FEW_RULES:
        return None
    one = rules.agg(F.collect_list(F.struct(*rules.columns)).alias("__rules"))
    rows = texts.withColumn("__low", text).crossJoin(F.broadcast(one))
    return rows.withColumn("held", F.filter("__rules", lambda r: hit(F.col("__low"), r))).drop("__low", "__rules")


def matched(texts: DataFrame, rules: DataFrame, id_col: str, text: Column, needs: Column, hit: Column) -> DataFrame:
    """id_col and the columns of rules, for every text and rule that meet.

    text: what is looked at, `low` in `hit`.  needs: a phrase that is in all texts
    that the rule matches; null if there is none.  hit: whether they meet, of `low`
    and the rule's columns.  Null texts meet nothing; every row of a text and of a
    rule counts.
    """
    names = rules.columns
    rows = texts.select(id_col, text.alias("low")).where("low is not null")
    asked = rules.withColumn("__phrase", F.coalesce(needs, F.lit("")))
    asked = asked.join(chosen(asked.select(F.col("__phrase").alias("phrase"))).withColumnsRenamed({"phrase": "__phrase", "gram": "__gram"}), "__phrase").drop("__phrase")
    few = small_side(rules, MOST_RULES) is not rules
    if few:
        met = rows.withColumn("__gram", F.explode(grams(F.col("low")))).join(F.broadcast(asked), "__gram")
        return met.where(hit).select(id_col, *names)
    # Long texts don't travel with their grams: pairs of ids and rules are found first.
    known = small_side(asked.select("__gram").distinct(), MOST_GRAMS)
    has = rows.select(id_col, F.explode(grams(F.col("low"))).alias("__gram")).join(known, "__gram", "left_semi").distinct()
    return has.join(asked, "__gram").drop("__gram").join(rows, id_col).where(hit).select(id_col, *names)


def contained(texts: DataFrame, rules: DataFrame, id_col: str, text: Column, phrase: str) -> DataFrame:
    """id_col and the columns of rules whose phrase the text holds; a null phrase is in none."""
    rules = rules.where(F.col(phrase).isNotNull())
    return matched(texts, rules, id_col, text, F.col(phrase), F.contains(F.col("low"), F.col(phrase)))
