"""Substring dedup on words: repeated-phrase automata.

1. Confirm: `repeats` gathers the texts around anchors whose phrase (a short gram
   that every long window around it chooses) recurs, each different one once; a
   shard confirms which windows of `window` words occur more than once, joins
   those that always occur together to passages, and keeps one copy of each.
2. Compile: a shard's passages become an Aho-Corasick automaton over word
   numbers (pyahocorasick).
3. Stream: everything around anchors with a phrase of the shard, from all
   documents, runs through the shard's automaton.  Where a passage occurs is
   known from its matches only.

Text without an anchor whose phrase recurs can't hold a passage, and text that
occurs around many anchors alike is streamed once for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .repeats import copied, list_column, merge_spans, refine, repeated_spans
from .tables import keyed_texts, row_key
from .units import Texts, slices

#: Words of a phrase, and contexts of a phrase that one automaton takes.
PHRASE, GROUP_CONTEXTS = 8, 1 << 14


def _words(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, bounds = part.word_ids()
    return ids[:, 0], ids, bounds


def _around(part: Texts, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, pa.Array]]:
    words = part.words()
    return copied(part.data, words.start[words.bounds[doc] + first], words.end[words.bounds[doc] + last - 1])


def _numbers(around: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of each context as numbers of this shard (exact: by the words themselves), and bounds."""
    ids: dict[bytes, int] = {}
    rows = [[ids.setdefault(w, len(ids)) for w in x.split()] for x in around.to_pylist()]
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(r) for r in rows], dtype=np.int64)])
    return np.fromiter((x for r in rows for x in r), np.int64, int(bounds[-1])), bounds


def confirmed(numbers: np.ndarray, bounds: np.ndarray, at: np.ndarray, group: np.ndarray, n: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """One copy of each passage: the words of windows that occur more than once, joined where they always follow each other."""
    start, bucket = refine(numbers, max(1, int(numbers.max(initial=0)).bit_length()), bounds, at, group, window)
    length = np.diff(bounds)
    common = np.flatnonzero((n > 1) & (length >= window))
    more = np.concatenate([np.arange(bounds[i], bounds[i + 1] - window + 1) for i in common.tolist()]) if len(common) else np.zeros(0, np.int64)
    more = np.setdiff1d(more, start, assume_unique=True)  # windows of one context only, but of many anchors
    bucket = np.concatenate([bucket, np.arange(len(more)) + int(bucket.max(initial=-1)) + 1])
    start = np.concatenate([start, more])
    order = np.argsort(start)
    start, bucket = start[order], bucket[order]
    if not len(start):
        return []
    who = np.searchsorted(bounds, start, "right") - 1
    follows = np.zeros(len(start), bool)
    follows[:-1] = (start[1:] == start[:-1] + 1) & (who[1:] == who[:-1])
    after = np.where(follows, np.append(bucket[1:], -1), -1)
    kinds = int(bucket.max()) + 1
    size = np.bincount(bucket, minlength=kinds)
    low, high = np.full(kinds, kinds), np.full(kinds, -1)
    np.minimum.at(low, bucket, after)
    np.maximum.at(high, bucket, after)
    goes_on = (low == high) & (high >= 0) & (size[np.maximum(high, 0)] == size)  # all places of a window go on to the same one, that has no other
    first = np.full(kinds, len(start))
    np.minimum.at(first, bucket, np.arange(len(start)))
    mine = np.zeros(len(start), bool)
    mine[first[first < len(start)]] = True
    joined = np.zeros(len(start), bool)
    joined[1:] = mine[1:] & mine[:-1] & follows[:-1] & goes_on[bucket[:-1]]
    begins = np.flatnonzero(mine & ~joined)
    ends = np.flatnonzero(mine & ~np.append(joined[1:], False))
    return [tuple(numbers[a : b + window].tolist()) for a, b in zip(start[begins].tolist(), start[ends].tolist())]


def _located(window: int):
    def solve(h: np.ndarray, n: np.ndarray, left: np.ndarray, around: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers, bounds = _numbers(around)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for passage in confirmed(numbers, bounds, left, h, n, window):
            automaton.add_word(passage)
        found: list[tuple[int, int, int]] = []
        if len(automaton):
            automaton.make_automaton()
            for i in range(len(h)):
                covered: list[tuple[int, int]] = []  # apart and ascending; matches come by their ends
                for end_at, length in automaton.iter(tuple(numbers[bounds[i] : bounds[i + 1]].tolist())):
                    begin = end_at + 1 - length
                    while covered and covered[-1][1] >= begin:
                        begin = min(begin, covered.pop()[0])
                    covered.append((begin, end_at + 1))
                found += [(i, a, b) for a, b in covered]
        who, s, e = np.array(found, np.int64).reshape(-1, 3).T
        return who, s, e

    return solve


def _window(window: int):
    return lambda i: F.sha2(F.array_join(F.slice(F.split(F.col("around").cast("string"), "[\\x20\\x09-\\x0D]+"), (i + 1).cast("int"), window), " "), 256)


_CUT = "text string, spans array<struct<s: long, e: long>>, n_words long, n_removed long, kept_sha256 string"
_CUT_ARROW = pa.schema([("text", pa.string()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, (s, e) = list_column(batch.column("spans"), ["s", "e"])
        carried = [c for c in batch.schema.names if c not in ("text", "spans")]
        for part in slices(batch.column("text")):
            out = []
            for i in range(len(part)):
                words = part.data[part.bounds[i] : part.bounds[i + 1]].tobytes().split()
                mine = slice(offsets[part.first + i], offsets[part.first + i + 1])
                start, end = merge_spans(s[mine], e[mine])
                kept, done = [], 0
                for a, b in zip(start.tolist(), end.tolist()):
                    kept += words[done:a]
                    done = b
                kept = b" ".join(kept + words[done:])
                out.append({"text": kept.decode() if len(start) else part.data[part.bounds[i] : part.bounds[i + 1]].tobytes().decode(), "spans": [{"s": a, "e": b} for a, b in zip(start.tolist(), end.tolist())], "n_words": len(words), "n_removed": int((end - start).sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()})
            own = [batch.column(c).slice(part.first, len(part)) for c in carried]
            yield pa.RecordBatch.from_arrays([*own, *pa.RecordBatch.from_pylist(out, _CUT_ARROW).columns], names=[*carried, *_CUT_ARROW.names])


def drop_repeated_words(docs: DataFrame, window: int = 35, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_CONTEXTS, carry: list[str] | None = None) -> DataFrame:
    """Each document without the words of passages that recur.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  A word goes when a window of
    `window` words that covers it also starts anywhere else, in the same
    document or another; every copy goes.  Returns doc_id, the columns named in
    carry as they are, text (unchanged where nothing goes, else the words left,
    joined by one space), spans (s, e; maximal, in words), n_words, n_removed
    and kept_sha256 (of the words left, joined by one space).

    Null text counts as empty.  Rows are documents: rows that repeat count as
    copies of each other, null ids are kept.  Texts under `window` words keep
    all words, an empty table gives an empty result; columns that aren't named
    aren't read.  Those carried can have any name; one that a column above has
    too is there twice, behind doc_id and as said above.
    """
    texts = keyed_texts(docs, id_col, text_col)
    spans = repeated_spans(texts, _words, _around, _located(window), _window(window), window, phrase, group_limit)
    rd, rt = row_key(id_col, text_col)
    kept = [f"c{i}" for i in range(len(carry or []))]
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(carry or [], kept)), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), rd.alias("rd"), rt.alias("rt"))
    rows = rows.join(spans, ["rd", "rt"], "left").select("doc_id", *kept, "text", "spans")
    out = rows.mapInArrow(_cut, StructType([f for f in rows.schema if f.name not in ("text", "spans")] + StructType.fromDDL(_CUT).fields))
    return out.toDF("doc_id", *(carry or []), *out.columns[1 + len(kept) :]) if carry else out


def cleaned(docs: DataFrame, window: int = 35, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with `drop_repeated_words`' text for their own; columns can have any name."""
    carry = [c for c in docs.columns if c != text_col]
    out = drop_repeated_words(docs, window, phrase, id_col, text_col, carry=carry)
    out = out.toDF(*(f"c{i}" for i in range(len(out.columns))))
    place = {c: i + 1 for i, c in enumerate([*carry, text_col])}
    return out.select(*(F.col(f"c{place[c]}").alias(c) for c in docs.columns))
