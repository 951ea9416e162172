"""Tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_path(spark: SparkSession) -> str:
    """A path that nothing is at yet, in the folder of `spark.checkpoint.dir`; where that is unset, in a local one if all of Spark runs on this machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base.rstrip('/')}/sextant-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows from a written table (see `fresh_path`): lineage ends, and executors may be lost."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows in as many tasks as there are cores, if there were fewer; a small table in one file is otherwise one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_side(rows: DataFrame, most: int) -> DataFrame:
    """All rows, marked for broadcast only when counted and at most `most`; joins without an equality then work block by block."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
