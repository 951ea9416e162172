"""What all operators of this subpackage share: inputs, scratch tables, shards."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder of `spark.checkpoint.dir`; where that is unset, a local one if all of Spark runs on this machine, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base.rstrip('/')}/sextant-{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends there and any executor may be lost."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table from `written` that nothing reads any more."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """Two longs that tell rows apart by id and text; equal rows share them.

    The first is the id, or for a null id 64 bits of the text's SHA-256; the
    second is 63 other bits of it, and whether the id is null.
    """
    return row_key_of(id_col, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))


def row_key_of(id_col: str, digest: Column) -> tuple[Column, Column]:
    """`row_key` from the SHA-256 itself."""
    part = lambda at: F.conv(F.substring(F.hex(digest), at, 15), 16, 10).cast("long")
    some = F.col(id_col).cast("long")
    return F.coalesce(some, part(17)), F.shiftleft(part(1), 1).bitwiseOR(some.isNull().cast("long"))


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and the row key rd, rt (see `row_key`).

    Rows that share an id but not a text stay apart, with a null id too; equal
    rows share a key and, rightly, every per-document result.
    """
    rd, rt = row_key(id_col, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), rd.alias("rd"), rt.alias("rt"))


def salted(shards: DataFrame, rows: DataFrame, key: str, most: int, spread: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column `salt`: a key with more than `most` rows is dealt to several salts.

    `shards` (few rows a key) is repeated for every salt of its key; `rows` are
    spread by `spread`.  Row counts are pre-aggregated before they are
    shuffled; the join that brings them to the rows has one row a key.
    """
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("salts"))
    sizes = written(sizes)
    left = shards.join(sizes, key).select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).drop("salts")
    right = rows.join(sizes, key).withColumn("salt", F.pmod(spread, F.col("salts")).cast("int")).drop("salts")
    return left, right


#: Rows of ids that are broadcast at most; beyond it, joins shuffle. An id row takes about 50 bytes.
BROADCAST_ROWS = 1 << 18


def small_side(rows: DataFrame) -> DataFrame:
    """The rows (a written table of ids), marked for broadcast only when counted and few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def by_place(docs: DataFrame, *wanted: str) -> DataFrame:
    """docs with the wanted columns under their names and all others as `extra_0`, `extra_1`, by place; whatever they were called, nothing clashes.

    `toDF(*docs.columns)` gives the old names back to columns in the old order.
    """
    return docs.toDF(*(c if c in wanted else f"extra_{k}" for k, c in enumerate(docs.columns)))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without rows whose (rd, rt) of `keyed_texts` is in dropped; of rows that repeat id and text, one stays.

    Ids of what is dropped are sent to the documents, not documents to them,
    while they are few.
    """
    rd, rt = row_key(id_col, text_col)
    keyed = by_place(docs, id_col, text_col).withColumns({"rd_": rd, "rt_": rt})
    gone = dropped.select(F.col("rd").alias("rd_"), F.col("rt").alias("rt_")).distinct()
    kept = keyed.join(small_side(written(gone)), ["rd_", "rt_"], "left_anti")
    twice = small_side(written(keyed.groupBy("rd_", "rt_").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")))
    if not twice.isEmpty():
        more = kept.join(twice, ["rd_", "rt_"], "left_semi").dropDuplicates(["rd_", "rt_"])
        kept = kept.join(twice, ["rd_", "rt_"], "left_anti").unionByName(more)
    return kept.drop("rd_", "rt_").toDF(*docs.columns)
