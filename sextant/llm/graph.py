"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, label for every node with a link; label is the smallest node of its component.

    Every round takes the smallest label among a node's neighbours and then the
    label of that label, so that long chains shorten quickly; it ends when no
    label changes.  Each round's labels are a written table; the one before goes.
    Links with a null end are left out, repeated ones and those of a node to
    itself change nothing; without links the result is empty.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = written(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = written(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("label")))
    before = labels
    while True:
        near = edges.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = written(step.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label")))
        done = step.where("label < old").isEmpty()
        discard(before)
        if done:
            return step.select("node", "label")
        labels, before = step.select("node", "label"), step
