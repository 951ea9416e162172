"""Revisions of one designator: successor edges, branches, series, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import keep_first
from .rules import either_contains


def distinct_years(revisions: DataFrame) -> DataFrame:
    """The first revision of each designator and year."""
    return keep_first(revisions, ["base", "year"], [F.col("rev_no"), F.col("rev_id")])


def successors(revisions: DataFrame) -> DataFrame:
    """SUPERSEDES edges between consecutive years of a designator."""
    order = Window.partitionBy("base").orderBy("year", "rev_no", "rev_id")
    rows = distinct_years(revisions).withColumn("newer", F.lead("rev_id").over(order)).withColumn("newer_no", F.lead("rev_no").over(order)).where("newer is not null")
    return rows.select(F.col("newer").alias("source"), F.col("rev_id").alias("target"), F.lit("SUPERSEDES").alias("relationship"), F.lit(0.95).alias("confidence"), F.concat(F.col("newer_no"), F.lit(" chronologically supersedes "), F.col("rev_no")).alias("description"))


def resolution(edges: DataFrame, loaded: str | None = None) -> DataFrame:
    """For each superseded node: how many successors it has, whether that is a single one, and the first of them: by the column `loaded`, or the smallest."""
    first = F.min("source") if loaded is None else F.min_by("source", F.struct(loaded, "source"))
    return edges.groupBy(F.col("target").alias("node")).agg(F.count_distinct("source").alias("successors"), first.alias("first_successor")).withColumn(
        "resolution", F.when(F.col("successors") == 1, "RESOLVED").otherwise("AMBIGUOUS_BRANCHING")
    )


def series_edges(items: DataFrame) -> DataFrame:
    """items (item_id, base, part, title): edges from each part to the first part, TESTED_BY where the title speaks of tests."""
    first = items.groupBy("base").agg(F.min_by("item_id", F.struct("part", "item_id")).alias("target"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    tested = F.lower("title").rlike("test|method|sampling|analysis")
    return items.join(first, "base").where("item_id != target").select(F.col("item_id").alias("source"), "target", F.when(tested, "TESTED_BY").otherwise("NORMATIVE_REF").alias("relationship"), F.lit(0.96).alias("confidence"))


def timeline(revisions: DataFrame) -> DataFrame:
    """base, first_year, last_year, milestones: years in order as one string."""
    return distinct_years(revisions).groupBy("base").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.array_join(F.transform(F.sort_array(F.collect_list("year")), lambda y: y.cast("string")), ">").alias("milestones")
    )


def milestones(items: DataFrame, marks: DataFrame, revisions: DataFrame) -> DataFrame:
    """item_id, designator, origin, milestones (an array of year, revision, event by year) of every item (item_id, item_no).

    marks: ord, designator, year, revision, event.  The first designator that an
    item's number holds, or that holds it, gives its milestones (origin curated);
    other items have their revisions (base, year, rev_no; base is an item's number),
    one a year, without an event (origin revisions), or an empty array (none).
    """
    names = marks.groupBy(F.col("designator").alias("keyword")).agg(F.min("ord").alias("ord")).withColumn("rule_id", F.col("keyword"))
    told = items.select("item_id", "item_no").join(either_contains(items.where("item_no != ''"), names, "item_id", "item_no").withColumnRenamed("rule_id", "designator"), "item_id", "left")
    mark = F.sort_array(F.collect_list(F.struct("year", "revision", "event")))
    curated = marks.groupBy("designator").agg(mark.alias("curated"))
    own = distinct_years(revisions).select(F.col("base").alias("item_no"), "year", F.col("rev_no").alias("revision"), F.lit(None).cast("string").alias("event"))
    # Only items without marks look at revisions.
    own = own.join(told.where("designator is null").select("item_no"), "item_no", "left_semi").groupBy("item_no").agg(mark.alias("own"))
    rows = told.join(curated, "designator", "left").join(own, "item_no", "left")
    origin = F.when(F.col("curated").isNotNull(), "curated").when(F.col("designator").isNull() & F.col("own").isNotNull(), "revisions").otherwise("none")
    marked = F.coalesce("curated", F.when(F.col("designator").isNull(), F.col("own")), F.array().cast(curated.schema["curated"].dataType))
    return rows.select("item_id", "designator", origin.alias("origin"), marked.alias("milestones"))
