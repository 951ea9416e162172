"""Legal orders: status as of a date, and the order that governs an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_date
from ..sources.scratch import small_side, written

#: Evaluation dates are few; up to this many are broadcast, more are crossed in blocks.
MOST_DATES = 1000

# Which status prevails.
PRIORITY = {"MANDATORY_IN_FORCE": 4, "PENDING_FUTURE_DATE": 3, "UNVERIFIED_EFFECTIVE_DATE": 2, "SUPERSEDED_BY_SUBSEQUENT_ORDER": 1, "RESCINDED": 0}


def dated(orders: DataFrame) -> DataFrame:
    """orders with effective_date and standing: rescinded or superseded, whatever the date; each text is parsed once."""
    said = F.concat_ws(" ", "order_name", "effective_raw")
    standing = F.when(said.rlike(r"(?i)\brescind"), "RESCINDED").when(said.rlike(r"(?i)\bsuperseded by\b"), "SUPERSEDED_BY_SUBSEQUENT_ORDER")
    return orders.withColumn("effective_date", parse_date(F.col("effective_raw"))).withColumn("standing", standing)


def status_asof(orders: DataFrame, dates: DataFrame) -> DataFrame:
    """Every order at every evaluation date (dates: rows of `evaluation_date`); adds effective_date and temporal_status.

    What an order says is parsed before it meets the dates.
    """
    date = F.col("effective_date")
    by_date = F.when(date.isNull(), "UNVERIFIED_EFFECTIVE_DATE").when(date <= F.col("evaluation_date"), "MANDATORY_IN_FORCE").otherwise("PENDING_FUTURE_DATE")
    return dated(orders).crossJoin(small_side(dates, MOST_DATES)).withColumn("temporal_status", F.coalesce("standing", by_date)).drop("standing")


def governing(status: DataFrame) -> DataFrame:
    """For each item and date: the order that prevails, by status, then latest date, then smallest id, how many there are, and the names of the others."""
    rank = F.coalesce(*(F.when(F.col("temporal_status") == s, p) for s, p in PRIORITY.items()))
    best = F.max_by(F.struct("order_id", "order_name", "temporal_status", "effective_date"), F.struct(rank, F.coalesce(F.col("effective_date").cast("string"), F.lit("")), -F.col("order_no")))
    return status.groupBy("item_id", "evaluation_date").agg(best.alias("g"), F.count(F.lit(1)).alias("orders"), F.collect_set("order_name").alias("names")).select(
        "item_id", "evaluation_date", "g.order_id", "g.temporal_status", F.col("g.effective_date").alias("effective_date"), "orders", (F.size("names") - 1).cast("long").alias("competing"),
        F.array_join(F.sort_array(F.array_except("names", F.array("g.order_name"))), "; ").alias("others"), (F.col("g.temporal_status") == "MANDATORY_IN_FORCE").alias("is_mandatory")
    )


def governing_asof(orders: DataFrame, asked: DataFrame, numbered: bool = False) -> DataFrame:
    """The same as `governing` for the asked pairs (item_id, evaluation_date) of items that have orders, without every order at every date.

    Orders and asked dates of an item are sorted together, and the last order in
    force is carried along; before the first, the latest order is the pending
    one.  What doesn't depend on the date is one row an item.  Orders are first
    reduced to one a day, and repeated pairs count once, so an item sorts days,
    however often it is asked for.  With `numbered`, the governing order's
    order_no is there too.  What orders say is parsed once, into a written table.
    """
    rows = written(dated(orders).select("item_id", "order_id", "order_no", "order_name", "effective_date", "standing"))
    lively = F.col("standing").isNull() & F.col("effective_date").isNotNull()
    one = F.struct("order_id", "order_name", "effective_date", "order_no")
    rank = F.coalesce(*(F.when(F.coalesce("standing", F.lit("UNVERIFIED_EFFECTIVE_DATE")) == s, p) for s, p in PRIORITY.items()))
    place = F.struct(rank, F.coalesce(F.col("effective_date").cast("string"), F.lit("")), -F.col("order_no"))
    about = rows.groupBy("item_id").agg(
        F.max_by(F.when(lively, one), F.when(lively, place)).alias("latest"), F.max_by(F.when(~lively, one), F.when(~lively, place)).alias("idle"),
        F.max_by(F.when(~lively, F.coalesce("standing", F.lit("UNVERIFIED_EFFECTIVE_DATE"))), F.when(~lively, place)).alias("idle_status"), F.count(F.lit(1)).alias("orders"), F.collect_set("order_name").alias("names"),
    )
    days = rows.where(lively).groupBy("item_id", F.col("effective_date").alias("day")).agg(F.min_by(one, "order_no").alias("o"))
    wanted = asked.select("item_id", F.col("evaluation_date").alias("day")).distinct()
    both = days.withColumn("asked", F.lit(False)).unionByName(wanted.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    sweep = Window.partitionBy("item_id").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("held", F.last("o", ignorenulls=True).over(sweep)).where("asked").select("item_id", F.col("day").alias("evaluation_date"), "held")
    status = F.when(F.col("held").isNotNull(), "MANDATORY_IN_FORCE").when(F.col("latest").isNotNull(), "PENDING_FUTURE_DATE").otherwise(F.col("idle_status"))
    out = held.join(about, "item_id").withColumn("g", F.coalesce("held", "latest", "idle")).withColumn("temporal_status", status)
    return out.select(
        "item_id", "evaluation_date", "g.order_id", "temporal_status", F.col("g.effective_date").alias("effective_date"), "orders", (F.size("names") - 1).cast("long").alias("competing"),
        F.array_join(F.sort_array(F.array_except("names", F.array("g.order_name"))), "; ").alias("others"), (F.col("temporal_status") == "MANDATORY_IN_FORCE").alias("is_mandatory"),
        *([F.col("g.order_no").alias("order_no")] if numbered else []),
    )


def mandated(orders: DataFrame, edges: DataFrame) -> DataFrame:
    """orders (order_id, …) once for each item that a MANDATED_BY edge leads from, as item_id."""
    links = edges.where("relationship = 'MANDATED_BY'").select(F.col("source").alias("item_id"), F.col("target").alias("order_id")).distinct()
    return orders.drop("item_id").join(links, "order_id")


def inherited(items: DataFrame, own: DataFrame, successors: DataFrame) -> DataFrame:
    """Each item's governing order, or that of its last successor (node, end), which is then named in via."""
    own = written(own)  # three joins read it
    mine = items.select("item_id").join(own, "item_id", "left")
    missing = mine.where("order_id is null").select("item_id").join(successors.select(F.col("node").alias("item_id"), F.col("end").alias("via")), "item_id")
    theirs = missing.join(own.withColumnRenamed("item_id", "via"), "via")
    return mine.where("order_id is not null").withColumn("via", F.lit(None).cast("string")).unionByName(theirs.select(*mine.columns, "via"))


def rank_orders(status: DataFrame) -> DataFrame:
    rank = F.coalesce(*(F.when(F.col("temporal_status") == s, p) for s, p in PRIORITY.items()))
    order = Window.partitionBy("item_id", "evaluation_date").orderBy(rank.desc(), F.col("effective_date").desc_nulls_last(), "order_no")
    return status.withColumn("place", F.row_number().over(order))


def directory(orders: DataFrame, issuer: str | None = None, text: str | None = None) -> DataFrame:
    """Orders whose issuer holds a text, and whose name, number or date as written holds another, whatever the case; both may be missing."""
    holds = lambda c, said: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(said.lower()))
    rows = orders if issuer is None else orders.where(holds("issuer", issuer))
    return rows if text is None else rows.where(holds("order_name", text) | holds("order_id", text) | holds("effective_raw", text))
