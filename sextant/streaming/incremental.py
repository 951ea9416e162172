"""Incremental forms: ingest without duplicates, and audits of documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from ..operators import audit
from ..operators.retrieval import small
from ..sources.scratch import written

#: A table that is read anew whenever it is looked at.
Dimension = Callable[[SparkSession], DataFrame]


def arriving(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """New Parquet files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def ingest(stream: DataFrame, key: str, time: str, path: str, checkpoint: str, late: str | None = None) -> StreamingQuery:
    """Append each key once, however late or often it comes again. Takes what is there and ends; a later call resumes.

    Of rows of one key in a batch, the earliest stays; null is a key too.  Rows
    go to path/ingest_query=…/ingest_batch=…, and a batch that is run again
    replaces itself; keys that any other batch has written are left out.  One
    ingest at a time may write to a path.  `late` has no meaning any more, as
    nothing is too late; it stays for callers that give it.
    """

    def batch(rows: DataFrame, number: int) -> None:
        run = rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        first = Window.partitionBy(key).orderBy(F.col(time).asc_nulls_last())
        fresh = rows.withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__place")
        known = _known(rows.sparkSession, path, rows.schema[key], run, number)
        if known is not None:
            fresh = fresh.join(known, fresh[key].eqNullSafe(known["__known"]), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/ingest_query={run}/ingest_batch={number}")

    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _known(spark: SparkSession, path: str, key: StructField, run: str, number: int) -> DataFrame | None:
    """Keys in the folder, without those of the batch itself; None where there is no folder yet."""
    schema = StructType([key]).add("ingest_query", "string").add("ingest_batch", "long")
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    own = (F.col("ingest_query") == run) & (F.col("ingest_batch") == number)
    return rows.where(~F.coalesce(own, F.lit(False))).select(F.col(key.name).alias("__known"))


STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def ingest_keyed(stream: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append each key once, from keyed state instead of what was written before: a batch costs what it brings. Takes what is there and ends; a later call resumes.

    Keys are kept for good, on the executors' disks and in the checkpoint (changes
    only, batch by batch), so a key is known however late it comes again; null is a
    key too. A row of the key's first batch stays; of several in that batch any one
    (`ingest` keeps the earliest, and reads all keys for it).
    """
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in STATE}
    try:
        for name, value in STATE.items():
            conf.set(name, value)
        return stream.dropDuplicates([key]).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def audit_arrivals(stream: DataFrame, superseded: DataFrame | Dimension, path: str, checkpoint: str, mandated: DataFrame | Dimension | None = None, index: str | None = None) -> StreamingQuery:
    """Scores of new documents (doc_id, text) against superseded citations and orders (as in `audit.findings`); a batch that is run again replaces itself.

    Either table may be a function of the session that gives it; then every batch
    has it as it is at that time.  With `index`, each batch writes there what its
    documents cite (see `citation_index`), for later changes of the tables.
    """
    now = lambda table, spark: table(spark) if callable(table) else table

    def batch(docs: DataFrame, number: int) -> None:
        spark = docs.sparkSession
        found = audit.findings(docs, now(superseded, spark), now(mandated, spark))
        audit.scores(docs, found).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if index is not None:
            citation_index(docs).write.mode("overwrite").parquet(f"{index}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def citation_index(docs: DataFrame) -> DataFrame:
    """base, doc_id: which documents cite a designator, once each, without its year; the inverted form of `audit.citations`."""
    cited = audit.citations(docs).select("doc_id", F.explode("cited").alias("citation"))
    return cited.select(F.trim(F.substring_index("citation", ":", 1)).alias("base"), "doc_id").distinct()


def changed(before: DataFrame | None, after: DataFrame | None) -> DataFrame | None:
    """base of all rows (citation and other columns) that only one version of a table has; None where there is neither version."""
    if before is None and after is None:
        return None
    before, after = (after.limit(0) if before is None else before), (before.limit(0) if after is None else after)
    names = sorted(set(before.columns) | set(after.columns))
    full = lambda t: t.select(*(F.col(c) if c in t.columns else F.lit(None).alias(c) for c in names)).distinct()
    both = full(before).withColumn("__side", F.lit(0)).unionByName(full(after).withColumn("__side", F.lit(1)))
    return both.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(F.col("citation").alias("base")).distinct()


def audited_again(docs: DataFrame, index: DataFrame, scores: DataFrame, superseded: tuple[DataFrame, DataFrame], mandated: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> tuple[DataFrame, DataFrame]:
    """Scores after a change of the tables that audits look at, and the ids (doc_id) of the documents that were audited again.

    superseded, mandated: the version before and the one after (see
    `audit.findings`).  Only documents that cite a designator whose rows differ
    are read and audited; index is that of `citation_index` over all documents,
    scores are those of the version before.
    """
    bases = changed(*superseded)
    orders = changed(*mandated)
    bases = written((bases if orders is None else bases.unionByName(orders)).distinct())
    ids = written(index.join(small(bases), "base", "left_semi").select("doc_id").distinct())
    again = written(docs.join(small(ids), "doc_id", "left_semi"))
    new = audit.scores(again, audit.findings(again, superseded[1], mandated[1]))
    return scores.join(small(ids), "doc_id", "left_anti").unionByName(new.select(*scores.columns)), ids
