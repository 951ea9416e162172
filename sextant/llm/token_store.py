"""Token-ID output: blocks of separately compressed documents under one shared zstandard dictionary.

A store is a folder with two Parquet tables, so that Spark's own readers and
committers move its bytes on any file system:

* `dictionary`: one row: the dictionary, its SHA-256 and the width of an id;
* `blocks`: a row for each block of documents that follow each other by id:
  part and seq (their order), first_id and last_id, dict_sha256, ids (document
  ids, 8 bytes each), absent (1 where the id is null), counts (ids of each
  document, 8 bytes each), offsets (n + 1 places in the payload, 8 bytes each),
  n_tokens, payload (one zstandard frame a document, one behind the other).

Integers are little-endian.  A document is read alone: its block's offsets give
its frame, and only that frame is decompressed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import Encoder

#: Documents that the dictionary is trained on (twice as many at most), ids taken of each, and bytes of the dictionary.
TRAINING_DOCUMENTS, TRAINING_IDS, DICTIONARY_BYTES = 2000, 2048, 1 << 16
BLOCK_DOCUMENTS, BLOCK_BYTES, LEVEL = 1024, 1 << 22, 3


def _ids(path: str, end_id: int):
    """An encoder of lists of texts that appends end_id to each; made once in a worker."""
    encoder = Encoder.from_file(path)
    end = np.array([end_id], "<u4").tobytes()
    return lambda texts: [x + end for x in encoder.encode(texts)]


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def _wide(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, width: int) -> bytes:
    """A dictionary from the id arrays of about TRAINING_DOCUMENTS documents, chosen by a hash of the id, and TRAINING_IDS ids from the middle of each."""
    step = max(1, docs.count() // TRAINING_DOCUMENTS)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).limit(2 * TRAINING_DOCUMENTS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(tokenizer_path, end_id)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4") for x in encode(batch.column("text").to_pylist())]
            middle = [x[(max(0, len(x) - TRAINING_IDS)) // 2 :][:TRAINING_IDS] for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array([_narrow(x.tobytes(), width) for x in middle], pa.binary())], names=["sample"])

    samples = sorted(bytes(r.sample) for r in chosen.select("text").mapInArrow(emit, "sample binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: their content itself serves
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


_BLOCK = "part int, seq long, first_id long, last_id long, dict_sha256 string, ids binary, absent binary, counts binary, offsets binary, n_docs long, n_tokens long, payload binary"
_BLOCK_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("dict_sha256", pa.string()), ("ids", pa.binary()), ("absent", pa.binary()), ("counts", pa.binary()), ("offsets", pa.binary()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])


def _pack(tokenizer_path: str, end_id: int, width: int, dictionary: bytes):
    sha = hashlib.sha256(dictionary).hexdigest()

    def block(part: int, seq: int, ids: list[int | None], counts: list[int], frames: list[bytes]) -> pa.RecordBatch:
        known = [i for i in ids if i is not None]
        offsets = np.concatenate([np.zeros(1, "<i8"), np.cumsum([len(f) for f in frames], dtype="<i8")])
        row = {
            "part": part, "seq": seq, "first_id": min(known, default=None), "last_id": max(known, default=None), "dict_sha256": sha, "ids": np.array([i or 0 for i in ids], "<i8").tobytes(),
            "absent": bytes(i is None for i in ids), "counts": np.array(counts, "<i8").tobytes(), "offsets": offsets.tobytes(), "n_docs": len(ids), "n_tokens": sum(counts), "payload": b"".join(frames),
        }
        return pa.RecordBatch.from_pylist([row], _BLOCK_ARROW)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(tokenizer_path, end_id)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_content_size=True)
        context = TaskContext.get()
        part, seq, size = context.partitionId() if context else 0, 0, 0
        ids, counts, frames = [], [], []
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                rows = batch.slice(begin, 64)
                for i, x in zip(rows.column("doc_id").to_pylist(), encode(rows.column("text").to_pylist())):
                    frames.append(compressor.compress(_narrow(x, width)))
                    ids.append(i)
                    counts.append(len(x) // 4)
                    size += len(frames[-1])
                    if len(ids) >= BLOCK_DOCUMENTS or size >= BLOCK_BYTES:
                        yield block(part, seq, ids, counts, frames)
                        ids, counts, frames, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield block(part, seq, ids, counts, frames)

    return emit


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, an end id behind each, in ascending order of doc_id.

    Null text counts as empty (its only id is the end id).  Null ids come first;
    rows that share an id follow each other by text, equal rows are all kept.  An
    empty table gives a store without blocks; other columns aren't read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tokenizer = Encoder.from_file(tokenizer_path).tokenizer
    width = 2 if max(tokenizer.get_vocab_size(True), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(texts, tokenizer_path, end_id, width)
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest(), width)], "dictionary binary, sha256 string, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_pack(tokenizer_path, end_id, width, dictionary), _BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _opened(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row.dictionary).hexdigest() != row.sha256:
        raise ValueError("the store's dictionary doesn't have the hash kept with it")
    return bytes(row.dictionary), row.sha256, row.width


_DOC = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _unpack(dictionary: bytes, sha: str, width: int, only: frozenset[int] | None = None, keep_ids: bool = True):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != sha:
                    raise ValueError("a block was written with another dictionary")
                ids, counts, offsets = (np.frombuffer(row[k], "<i8") for k in ("ids", "counts", "offsets"))
                starts = row["start"] + np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
                out = []
                for k in range(row["n_docs"]):
                    if only is not None and (row["absent"][k] or int(ids[k]) not in only):
                        continue
                    x = _wide(opener.decompress(row["payload"][offsets[k] : offsets[k + 1]]), width)
                    out.append((None if row["absent"][k] else int(ids[k]), int(starts[k]), len(x) // 4, zlib.crc32(x), x if keep_ids else None))
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return emit


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with start, the ids of all documents before them; sums within parts, then over the few parts."""
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    small = blocks.select("part", "seq", "n_tokens")
    parts = small.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = small.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("inside"))
    starts = within.join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))
    return blocks.join(starts, ["part", "seq"])


def read_store(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (bytes, 4 an id; null without keep_ids)."""
    dictionary, sha, width = _opened(spark, path)
    return _placed(spark, path).mapInArrow(_unpack(dictionary, sha, width, keep_ids=keep_ids), _DOC)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The same for some documents: only blocks that can hold them are read, and only their frames decompressed."""
    dictionary, sha, width = _opened(spark, path)
    wanted = F.array(*(F.lit(int(i)) for i in doc_ids))
    may = F.exists(wanted, lambda i: (i >= F.col("first_id")) & (i <= F.col("last_id")))
    return _placed(spark, path).where(may).mapInArrow(_unpack(dictionary, sha, width, frozenset(doc_ids)), _DOC)
