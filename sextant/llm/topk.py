"""Exact top-k search by inner product, with vectors in buckets by length.

Vectors are dealt to buckets of similar length, longest first.  A query first
meets the longest bucket; its k-th best score there is a threshold that only
rises.  A bucket whose longest vector, times the query's length, can't reach the
threshold is never sent the query.  Elsewhere the threshold becomes a local one
on the cosine, and by it a bucket is pruned by length (low cosines: vectors too
short to reach it) or by coordinate (high cosines: the query's largest
coordinates bound those of any vector at that angle); what is left is verified
by products of integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Vectors of a bucket, queries of a block (both bound a task's memory), coordinates looked at, cosine from which they are.
BUCKET, BLOCK, FOCUS, COSINE = 4096, 4096, 3, 0.4


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, dim, norm, v: floor(scale * x) of the components, as doubles, which hold such integers exactly."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, norms, out = [], [], [], []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                if x is None or any(c is None for c in x):
                    continue
                x = np.array(x, np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scale * x)
                    if not np.isfinite(v).all():
                        continue
                    norms.append(float(np.sqrt(v @ v)))
                ids.append(i)
                dims.append(len(v))
                out.append(v.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(out, pa.binary())], names=["vec_id", "dim", "norm", "v"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null and v is not null")
    return rows.mapInArrow(emit, "vec_id long, dim int, norm double, v binary")


#: Ends of what a long holds; scores beyond count as these.
_LEAST, _MOST = -(2**63), 2**63 - 1


def _products(a: np.ndarray, biggest: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a (with their biggest components) with b, all integers in doubles: exact, cut at the ends of a long."""
    with np.errstate(over="ignore"):
        safe = biggest * np.abs(b).max(initial=0) * max(1, a.shape[1]) < 2**53
    if safe.all():
        return (a @ b).astype(np.int64)
    out = np.zeros(len(a), np.int64)
    out[safe] = (a[safe] @ b).astype(np.int64)
    wide = [int(x) for x in b.tolist()]
    for i in np.flatnonzero(~safe).tolist():
        out[i] = min(max(sum(int(x) * y for x, y in zip(a[i].tolist(), wide)), _LEAST), _MOST)
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], ~score[near]))[:k]]  # ~ turns the order round for every long


_HIT = "query_id long, vec_id long, score long, tested long"


def _search(k: int):
    """A block of queries (with their thresholds so far) and a bucket of vectors -> each query's best of it."""

    def run(queries: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in _HIT.split(", ")})
        if queries.empty or bucket.empty:
            return empty
        bucket = bucket.sort_values("norm", ascending=False, ignore_index=True)
        v = np.frombuffer(b"".join(bucket["v"]), "<f8").reshape(len(bucket), -1)
        ids, norm = bucket["vec_id"].to_numpy(), bucket["norm"].to_numpy()
        unit = v / np.maximum(norm, 1e-300)[:, None]
        biggest = np.abs(v).max(axis=1, initial=0)
        out = []
        for q_id, q_norm, q_bytes, floor in zip(queries["vec_id"], queries["norm"], queries["v"], queries["floor"]):
            q = np.frombuffer(q_bytes, "<f8")
            take = np.arange(len(v))
            if np.isfinite(floor) and abs(floor) < 2**62 and 0 < q_norm < 1e150 and norm[0] < 1e150:
                take = take[: np.searchsorted(-norm, -(floor / q_norm) * (1 - 1e-9), "right")] if floor > 0 else take
                cosine = floor / (q_norm * max(norm[0], 1e-300))
                if COSINE <= cosine <= 1 and len(take):
                    q_unit = q / q_norm
                    for f in np.argsort(-np.abs(q_unit), kind="stable")[:FOCUS]:
                        middle, reach = q_unit[f] * cosine, np.sqrt(max(0.0, 1 - q_unit[f] ** 2) * (1 - cosine**2))
                        high = 1.0 if q_unit[f] >= cosine else middle + reach
                        low = -1.0 if -q_unit[f] >= cosine else middle - reach
                        x = unit[take, f]
                        take = take[(x >= low - 1e-9) & (x <= high + 1e-9)]
            take = take[ids[take] != q_id]
            if not len(take):
                continue
            score = _products(v[take], biggest[take], q)
            best = _best(score, ids[take], k)
            out.append(pd.DataFrame({"query_id": q_id, "vec_id": ids[take[best]], "score": score[best], "tested": len(take)}))
        return pd.concat(out, ignore_index=True) if out else empty

    return run


def search(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products for every query among all vectors but its own.

    is_query: SQL condition on vec_id.  Returns query_id, rank (from 1), vec_id,
    score; ties go to the smaller vec_id, and a query with fewer candidates has
    fewer rows.  Only vectors of the same dimension are compared.

    Vectors that are null, or hold null or non-finite components (scaled ones
    too), and rows without an id take no part.  Rows that repeat are candidates
    each; as queries they count once, and rows that share the query's id are its
    own.  A score beyond the range of a long counts as its end.  An empty table
    gives an empty result; other columns aren't read.
    """
    base = written(integers(vectors, id_col, vector_col, scale))
    n = base.count()
    buckets = max(1, -(-n // BUCKET))
    dealt = written(
        base.repartitionByRange(buckets, F.col("dim"), F.col("norm").desc(), F.xxhash64("vec_id"), F.monotonically_increasing_id()).withColumn("bucket", F.spark_partition_id())
    )
    about = written(dealt.groupBy("dim", "bucket").agg(F.max("norm").alias("longest")))
    first = about.groupBy("dim").agg(F.max_by("bucket", F.struct("longest", -F.col("bucket"))).alias("first"))
    queries = base.where(is_query.replace(id_col, "vec_id") if id_col != "vec_id" else is_query).dropDuplicates(["vec_id", "v"])
    blocks = max(1, -(-queries.count() // BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    per_block = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else dealt.withColumn("block", F.lit(0))

    def scan(asked: DataFrame) -> DataFrame:
        keys = ["dim", "bucket", "block"]
        return asked.groupBy(*keys).cogroup(per_block.join(asked.select(*keys).distinct(), keys, "left_semi").groupBy(*keys)).applyInPandas(_search(k), _HIT)

    opened = queries.join(first, "dim").select("vec_id", "dim", "norm", "v", "block", F.col("first").alias("bucket"), F.lit(float("-inf")).alias("floor"))
    begun = written(scan(opened))
    floors = begun.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor"))
    floors = floors.withColumnRenamed("query_id", "vec_id")
    rest = (
        queries.join(first, "dim").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        .join(about, "dim").where(F.col("bucket") != F.col("first"))
        .where(F.col("norm") * F.col("longest") * (1 + 1e-9) >= F.col("floor"))
        .select("vec_id", "dim", "norm", "v", "block", "bucket", "floor")
    )
    hits = begun.unionByName(scan(rest))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
