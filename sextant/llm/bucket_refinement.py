"""Suffix-array dedup: repeated byte strings, by bucket-pointer refinement.

Suffixes get buckets by their first bytes; buckets are refined by sorting on the
bucket identifiers of the suffixes at later offsets, and every round reuses the
identifiers that the round before has updated (`repeats.refine`), until suffixes
in one bucket agree for `length` bytes.  Suffixes of a whole corpus are never
sorted at once: a string of `length` bytes that recurs has one anchor at the
same offset in all its copies (see `repeats`), so buckets start with the texts
around anchors whose gram recurs, and those of a gram are refined in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import copied, list_column, merge_spans, refine, repeated_spans
from .tables import keyed_texts
from .units import Texts, byte_values, slices

#: Bytes of the anchors' grams, and contexts of a gram that are refined in one task.
GRAM, GROUP_CONTEXTS = 32, 1 << 14


def _bytes(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return byte_values(part.data), part.data, part.bounds


def _around(part: Texts, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, pa.Array]]:
    return copied(part.data, part.bounds[doc] + first, part.bounds[doc] + last)


def _refined(length: int):
    def solve(h: np.ndarray, n: np.ndarray, left: np.ndarray, around: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = next(slices(around, 1 << 62))
        start, _ = refine(part.data, 8, part.bounds, left, h, length)
        whole = np.flatnonzero(n > 1)  # every window of such a context recurs, with the context
        who = np.searchsorted(part.bounds, start, "right") - 1
        keep = n[who] == 1
        who, start = who[keep], start[keep]
        head = np.ones(len(who), bool)
        head[1:] = (who[1:] != who[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(who)) - 1 if len(first) else first
        base = part.bounds[who[first]]
        return np.concatenate([whole, who[first]]), np.concatenate([np.zeros(len(whole), np.int64), start[first] - base]), np.concatenate([np.diff(part.bounds)[whole], start[last] + length - base])

    return solve


def _window(length: int):
    return lambda i: F.sha2(F.substring("around", (i + 1).cast("int"), F.lit(length)), 256)


_CUT = "doc_id long, text string, kept_bytes binary, spans array<struct<s: long, e: long>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_CUT_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("kept_bytes", pa.binary()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, (s, e) = list_column(batch.column("spans"), ["s", "e"])
        ids = batch.column("doc_id").to_pylist()
        for part in slices(batch.column("text")):
            out = []
            for i in range(len(part)):
                data = part.data[part.bounds[i] : part.bounds[i + 1]]
                mine = slice(offsets[part.first + i], offsets[part.first + i + 1])
                start, end = merge_spans(s[mine], e[mine])
                keep = np.ones(len(data), bool)
                for a, b in zip(start.tolist(), end.tolist()):
                    keep[a:b] = False
                kept = data[keep].tobytes() if len(start) else data.tobytes()
                out.append({"doc_id": ids[part.first + i], "text": kept.decode("utf-8", "ignore"), "kept_bytes": kept, "spans": [{"s": a, "e": b} for a, b in zip(start.tolist(), end.tolist())], "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(start), "kept_sha256": hashlib.sha256(kept).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, _CUT_ARROW)


def drop_repeated_bytes(docs: DataFrame, length: int = 200, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_CONTEXTS) -> DataFrame:
    """Each document without the bytes of strings that recur.

    A byte goes when a string of `length` bytes that covers it also starts
    anywhere else, in the same document or another; every copy goes.  Returns
    doc_id, text (what is left; bytes of a character cut in half are left out),
    kept_bytes (all that is left), spans (s, e; maximal), n_bytes, n_removed,
    n_spans, kept_sha256.

    Null text counts as empty.  Rows are documents: rows that repeat count as
    copies of each other, null ids are kept.  Texts under `length` bytes are
    unchanged, an empty table gives an empty result, other columns aren't read.
    """
    texts = keyed_texts(docs, id_col, text_col)
    spans = repeated_spans(texts, _bytes, _around, _refined(length), _window(length), length, gram, group_limit)
    return texts.join(spans, ["rd", "rt"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, _CUT)
