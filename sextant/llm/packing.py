"""Best-fit packing with certified bounds.

Documents longer than a sequence are cut: full pieces are sequences of their
own, what is over is their first piece.  First pieces are packed in partitions
of bounded size by best-fit decreasing.  For each partition, lower bounds from
dual-feasible functions certify how few sequences would do; partitions that meet
their bound are final.  In the others, sequences that are full are final too, and
the rest of the documents is exchanged between partitions, two at least, and
packed again, for as long as that saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .token_store import _ids
from .units import give_back

#: Documents of a partition, roughly.
PARTITION_DOCUMENTS = 50_000


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that documents need at least; counts[s] is how many have size s.

    The greatest bound over compositions of dual-feasible functions: U_t puts
    sizes over capacity - t to the full and those under t to nothing, u_k rounds
    a size to k-ths of the capacity.  Each gives the sum of what it makes of the
    sizes, in sequences, rounded up.
    """
    size = np.arange(capacity + 1)
    best = 0
    for t in range(0, capacity // 2 + 1, max(1, capacity // 128)):
        u = np.where(size > capacity - t, capacity, np.where(size < t, 0, size))
        best = max(best, -(-int((counts * u).sum()) // capacity))
        for k in (1, 2, 3, 4, 5, 7, 9, 12):
            times = (k + 1) * u
            exact = times % capacity == 0
            scaled = np.where(exact, k * u, times // capacity * capacity)  # in k-ths of the capacity
            best = max(best, -(-int((counts * scaled).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each document, and what is left in each bin."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, left = 0, []  # free: bit r is set while a bin with room r is there
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = free >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            r, b = capacity, len(left)
            left.append(capacity)
        where[i], offset[i] = b, capacity - r
        left[b] = r - s
        if r - s:
            room[r - s].append(b)
            free |= 1 << (r - s)
    return where, offset, np.array(left, np.int64)


_PACKED = "item long, size int, part int, bin long, offset long, room int, bins long, bound long"


def _partition(capacity: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "item"], ignore_index=True)
        sizes = frame["size"].to_numpy(np.int64)
        where, offset, left = best_fit(sizes, capacity)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        return pd.DataFrame({"item": frame["item"], "size": frame["size"], "part": frame["part"], "bin": where, "offset": offset, "room": left[where], "bins": len(left), "bound": bound})

    return run


def pack(items: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Bins for items (item long, unique; size int, 1 to capacity).

    Returns (item, sequence_id, offset) and the certificates (round, part,
    bins, bound) of every partition that was packed.  Items are dealt to
    partitions by a hash, so that each task holds about PARTITION_DOCUMENTS.  A
    round that doesn't save a bin is undone and the last one, so rounds end.
    """
    size = items.select("item", F.col("size").cast("int").alias("size"))
    rows = size.count()
    if not rows:
        empty = items.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).limit(0)
        return empty, items.sparkSession.createDataFrame([], "part int, bins long, bound long, round int")

    def packed(left: DataFrame, parts: int, turn: int) -> DataFrame:
        dealt = left.withColumn("part", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(parts)).cast("int"))
        return written(dealt.groupBy("part").applyInPandas(_partition(capacity), _PACKED).withColumn("round", F.lit(turn)))

    about = lambda df: df.groupBy("round", "part").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
    open_ = (F.col("bins") > F.col("bound")) & (F.col("room") > 0)
    now, placed, proof = packed(size, -(-rows // PARTITION_DOCUMENTS), 0), [], []
    proof.append(about(now))
    turn = 0
    while True:
        left = now.where(open_)
        count, bins = left.agg(F.count(F.lit(1)), F.count_distinct("part", "bin")).first()
        if not count:
            break
        turn += 1
        again = packed(left.select("item", "size"), max(2, -(-count // PARTITION_DOCUMENTS)), turn)
        proof.append(about(again))
        if again.select("part", "bin").distinct().count() >= bins:
            break
        placed.append(now.where(~open_))
        now = again
    placed.append(now)
    number = lambda df: df.select("item", (F.col("round").cast("long") * F.lit(2**56) + F.col("part").cast("long") * F.lit(2**28) + F.col("bin")).alias("sequence_id"), "offset")
    return reduce(DataFrame.unionByName, map(number, placed)), reduce(DataFrame.unionByName, proof)


_CUT = "item long, doc_id long, n_tokens long, size int, crcs array<long>, ids binary"


def _cut(tokenizer_path: str, end_id: int, capacity: int, keep_ids: bool):
    """Texts -> a row for each document: its number, the size of its first piece, and the crc32 of each piece."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(tokenizer_path, end_id)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 40
        for batch in batches:
            item, count, first, crcs, ids = [], [], [], [], []
            for begin in range(0, batch.num_rows, 64):
                for x in encode(batch.column("text").slice(begin, 64).to_pylist()):
                    n = len(x) // 4
                    size = (n - 1) % capacity + 1
                    edges = [0, *range(4 * size, 4 * n + 1, 4 * capacity)]
                    item.append(number)
                    count.append(n)
                    first.append(size)
                    crcs.append([zlib.crc32(x[a:b]) for a, b in zip(edges, edges[1:])])
                    ids.append(x if keep_ids else None)
                    number += len(edges) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(first, pa.int32()), pa.array(crcs, pa.list_(pa.int64())), pa.array(ids, pa.binary())],
                names=["item", "doc_id", "n_tokens", "size", "crcs", "ids"],
            )
            give_back()

    return emit


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every document's pieces with their places in sequences of at most `capacity` tokens.

    A document is the ids of its text and end_id; only longer ones are cut, and
    only their first piece is shorter than a sequence.  Returns a row for each
    piece: doc_id, piece (from 0), start (the document's ids before it), length,
    ids_crc32, sequence_id, offset, and with keep_ids the piece's ids.

    Null text counts as empty, so every document has a piece (the end id).  Rows
    that repeat, or share an id, are packed each; null ids are kept.  An empty
    table gives an empty result; other columns aren't read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = written(texts.mapInArrow(_cut(tokenizer_path, end_id, capacity, keep_ids), _CUT))
    bins, _ = pack(cut.where(F.col("size") < capacity).select("item", "size"), capacity)
    piece, first = F.col("piece"), F.col("piece") == 0
    start = F.when(first, F.lit(0)).otherwise(F.col("size") + (piece - 1) * capacity).cast("long")
    length = F.when(first, F.col("size")).otherwise(F.lit(capacity)).cast("long")
    columns = [
        "doc_id", piece, start.alias("start"), length.alias("length"), F.col("crc").alias("ids_crc32"),
        F.when(first & F.col("sequence_id").isNotNull(), F.col("sequence_id")).otherwise(-(F.col("item") + piece) - 1).alias("sequence_id"),
        F.when(first & F.col("offset").isNotNull(), F.col("offset")).otherwise(F.lit(0)).cast("long").alias("offset"),
    ]
    if keep_ids:
        columns.append(F.substring("ids", (4 * start + 1).cast("int"), (4 * length).cast("int")).alias("ids"))
    return cut.join(bins, "item", "left").select("*", F.posexplode("crcs").alias("piece", "crc")).select(*columns)
