"""Scans and sinks. Schemas are given, never inferred; missing inputs fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """A CSV file with a header: fields trimmed, each cast or null where it can't be, rows without a key left out."""
    raw = spark.read.schema(StructType([StructField(f.name, StringType()) for f in schema.fields])).csv(path, header=True)
    cast = lambda f: F.trim(F.col(f.name)).try_cast(f.dataType).alias(f.name)
    return raw.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "").select(*(cast(f) for f in schema.fields))


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A file that holds one array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One record a line; lines that aren't are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def parsed_lines(lines: DataFrame, schema: StructType) -> DataFrame:
    """lines with the record's fields, and rejected: the line itself where it is no such record, else null.

    Blank lines are left out; of a rejected line, fields are null.  A field of the
    schema that lines have already replaces it.
    """
    marked = StructType([*schema.fields, StructField("__rejected", StringType())])
    rows = lines.where(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("__r", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__rejected"}))
    bad = F.col("__r.__rejected")
    fields = {f.name: F.when(bad.isNull(), F.col("__r").getField(f.name)) for f in schema.fields}
    return rows.withColumns(fields | {"rejected": bad}).drop("__r", "value")


def read_json_lines_checked(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One record a line, malformed ones too: the fields, rejected (see `parsed_lines`), and the file that a line stands in."""
    return parsed_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")), schema)


def quarantined(records: DataFrame, failed: Column, path: str) -> dict[str, int]:
    """Writes records to two sinks in one pass, path/verdict=valid and path/verdict=rejected; gives the counts (rows, valid, rejected), taken as rows are written.

    `failed` is whether a record is rejected; null is valid.  Reasons are columns
    of the records.
    """
    seen, bad = Observation(), F.coalesce(failed, F.lit(False))
    rows = records.withColumn("verdict", F.when(bad, "rejected").otherwise("valid"))
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("verdict") == "valid").alias("valid"), F.count_if(F.col("verdict") == "rejected").alias("rejected")]
    rows.observe(seen, *counts).write.mode("overwrite").partitionBy("verdict").parquet(path)
    return seen.get


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files: UTF-8, or Latin-1 where that isn't valid."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1")).alias("text"))


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_graph(edges: DataFrame, path: str) -> None:
    """Edges by relationship, so that reading one relationship prunes the others."""
    edges.write.mode("overwrite").partitionBy("relationship").parquet(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """file, rows, bytes of Parquet files."""
    meta = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size")
    return meta.groupBy(F.col("file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.max("file_size").alias("bytes"))


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, nodes that are active, edges, distinct relationships."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("status") == "ACTIVE").alias("active"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("relationship").alias("relationships"))
    return n.crossJoin(e)


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, label, rows: nodes by type and by status, edges by relationship; a null label counts as unknown."""
    each = lambda rows, column, what: rows.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("label")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(what).alias("what"), "label", "rows")
    return each(nodes, "node_type", "nodes by type").unionByName(each(nodes, "status", "nodes by status")).unionByName(each(edges, "relationship", "edges by relationship"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, `report`: the counts of `type_counts` as one JSON record, a map of labels for each kind; to be written with `write_json_lines` or as text."""
    maps = type_counts(nodes, edges).groupBy("what").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "rows")))).alias("counts"))
    return maps.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("what", F.to_json("counts").alias("counts")))))).alias("report"))


def latest(records: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last record of each key."""
    names = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("r")).select(*keys, "r.*")
