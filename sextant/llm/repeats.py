"""Windows of a fixed length that recur anywhere in a corpus, found exactly.

Shared by the two operators on repeated substrings: `bucket_refinement` (units
are bytes) and `phrase_automata` (units are words).

1. Every window of `window` units chooses the smallest `gram`-gram that it
   contains; that place is an anchor.  Equal windows choose equal grams at the
   same offset, so only windows whose anchor's gram recurs can recur.
2. The context of an anchor is the text from its first window's start to its
   last window's end, so every window lies in one context.  Contexts that are
   equal as a whole become one row with their number, counted before anything
   is gathered, and the text of one of them.
3. Contexts of a gram are gathered and told apart by `refine`, which sorts
   windows on bucket identifiers of later offsets, down to the units themselves.
   A gram with very many contexts is split further: its windows become rows.
4. What is found in a context holds for all anchors that have it.

Only a hash of each anchor is shuffled for the whole corpus: about two in
window - gram of its positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, small_side, written
from .units import CONTEXT_BYTES, SEGMENT_UNITS, Rolling, Texts, chosen, digests, mix, pieces, slices

#: From a slice of texts: a 64-bit value of each unit, what a unit is (rows to digest), and the bounds of each text's units.
Units = Callable[[Texts], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: From a slice of texts and ranges of its units: the bytes of each range.
Around = Callable[[Texts, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, int, pa.Array]]]

#: Rows of one gram that a task joins, before the gram is dealt to several tasks; contexts that a task refines at once.
GRAM_ROWS, BATCH_CONTEXTS = 1 << 14, 4096

_PLACE = (np.int64(24), np.int64(12), np.int64(0xFFF))


def pack_place(pos: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return pos.astype(np.int64) << _PLACE[0] | left.astype(np.int64) << _PLACE[1] | right.astype(np.int64)


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the anchor is in its text, and the units of its context before and from there."""
    return place >> _PLACE[0], place >> _PLACE[1] & _PLACE[2], place & _PLACE[2]


def place_columns(place: str = "place") -> tuple[Column, Column, Column]:
    return F.shiftright(place, 24), F.shiftright(place, 12).bitwiseAND(F.lit(0xFFF)), F.col(place).bitwiseAND(F.lit(0xFFF))


def anchored(values: np.ndarray, content: np.ndarray, bounds: np.ndarray, window: int, gram: int, limit: int = SEGMENT_UNITS) -> Iterator[tuple[np.ndarray, ...]]:
    """Gram, context, text number and place of every anchor, by segments of `limit` windows.

    An anchor whose windows start in two segments comes twice, with some of its
    windows each time; every window comes once.
    """
    total = len(values)
    for low in range(0, total - window + 1, limit):
        high = min(low + limit, total - window + 1)
        end = high + window - 1
        grams = Rolling(values[low:end]).grams(gram)
        at, first, last = (x + low for x in chosen(grams, gram, window, np.clip(bounds, low, end) - low))
        if not len(at):
            continue
        last += window
        doc = np.searchsorted(bounds, at, "right") - 1
        left, right = at - first, last - at
        ctx = digests(content, first, last) ^ mix((left << 12 | right).astype(np.uint64))
        yield grams[at - low].view(np.int64), ctx.view(np.int64), doc, pack_place(at - bounds[doc], left, right)


def anchors(texts: DataFrame, units: Units, window: int, gram: int) -> DataFrame:
    """One row for each anchor: h (its gram), ctx (its context), rd, rt, place."""
    if window >= 1 << 12:
        raise ValueError("window must be below 4096 units")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rd, rt = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("rd", "rt"))
            for part in slices(batch.column("text")):
                values, content, bounds = units(part)
                for h, ctx, doc, place in anchored(values, content, bounds, window, gram):
                    row = doc + part.first
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, ctx, rd[row], rt[row], place)], names=["h", "ctx", "rd", "rt", "place"])

    return texts.select("rd", "rt", "text").mapInArrow(emit, "h long, ctx long, rd long, rt long, place long")


@dataclass
class Recurring:
    """members: anchors whose gram recurs. kinds: their different contexts, with n (members) and one of them (rd, rt, place)."""

    members: DataFrame
    kinds: DataFrame


def recurring(texts: DataFrame, units: Units, window: int, gram: int) -> Recurring:
    """Anchors whose gram recurs; a gram that very many have is dealt to several tasks by what else tells its rows apart."""
    found = written(anchors(texts, units, window, gram))
    grams = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    most = max(GRAM_ROWS, found.count() // 100_000)  # so that at most 100,000 grams are dealt
    hot = written(grams.where(F.col("c") > most).select("h", F.ceil(F.col("c") / most).cast("int").alias("salts")))
    few = small_side(hot)
    left = found.join(few, "h", "left").withColumn("salt", F.pmod(F.xxhash64("ctx", "rd", "rt", "place"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = grams.join(few, "h", "left").select("h", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    members = written(left.join(right, ["h", "salt"]).select("h", "ctx", "rd", "rt", "place"))
    discard(found)
    kinds = members.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rd", "rt", "place")).alias("one"))
    return Recurring(members, written(kinds.select("h", "ctx", "n", "one.*")))


CONTEXT = "h long, ctx long, n long, rd long, rt long, place long, around binary"
_NAMES = [c.split()[0] for c in CONTEXT.split(", ")]


def contexts(texts: DataFrame, found: Recurring, around: Around) -> DataFrame:
    """The units of one anchor of each context, as bytes, beside its row of `kinds`."""
    asked = found.kinds.groupBy("rd", "rt").agg(F.collect_list(F.struct("h", "ctx", "n", "place")).alias("anchors"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rd, rt = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("rd", "rt"))
            key = np.stack([rd, rt], axis=1)
            new = np.ones(len(key), bool)  # rows that repeat follow each other in a sorted join; one of them is enough
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            new[:1] = before is None or (key[:1] != before).any()
            before, batch = key[-1:] if len(key) else before, batch.filter(pa.array(new))
            offsets, (h, ctx, n, place) = list_column(batch.column("anchors"), ["h", "ctx", "n", "place"])
            rd, rt = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("rd", "rt"))
            for part in slices(batch.column("text")):
                mine = slice(offsets[part.first], offsets[part.first + len(part)])
                doc = np.repeat(np.arange(len(part)), np.diff(offsets[part.first : part.first + len(part) + 1]))
                if not len(doc):
                    continue
                pos, left, right = unpack_place(place[mine])
                columns = [h[mine], ctx[mine], n[mine], rd[doc + part.first], rt[doc + part.first], place[mine]]
                for i, j, content in around(part, doc, pos - left, pos + right):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i:j]) for x in columns] + [content], names=_NAMES)

    return texts.select("rd", "rt", "text").join(asked, ["rd", "rt"]).mapInArrow(emit, CONTEXT)


def copied(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, pa.Array]]:
    """The bytes first[i] to last[i] of data, by pieces: i from, i to, and an array of them."""
    size = last - first
    for i, j in pieces(size, CONTEXT_BYTES):
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size[i:j])])
        take = np.repeat(first[i:j] - ends[:-1], size[i:j]) + np.arange(ends[-1])
        yield i, j, pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(data[take])]).cast(pa.binary())


def named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket identifier for each key, equal for equal keys, and how many keys each has."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = sorted_keys[1:] != sorted_keys[:-1]
    bucket = np.empty(len(keys), np.int64)
    bucket[order] = np.cumsum(head) - 1
    return bucket, np.bincount(bucket) if len(keys) else np.zeros(0, np.int64)


def refine(units: np.ndarray, bits: int, bounds: np.ndarray, at: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts, in `units`, of windows that another context of the same group has at the same place, and the bucket of each.

    Context i is units[bounds[i]:bounds[i + 1]], its anchor at[i] units behind
    its start; units are numbers below 2**bits.  Suffixes first get the bucket
    of the few units that they start with, their group and their place by the
    anchor.  A bucket is refined by sorting on the bucket identifiers `pointer`
    of the suffixes that start where the known part ends, so that what is known
    of all suffixes doubles in every round and each round reuses the updates of
    the one before; a suffix alone in its bucket is final and left out, and so
    is one that starts with it.  Buckets hold equal units, exactly.
    """
    total = len(units)
    length = np.diff(bounds)
    who = np.repeat(np.arange(len(length), dtype=np.int32), length)
    rest = np.repeat(bounds[1:].astype(np.int32), length) - np.arange(total, dtype=np.int32)
    place = np.arange(4096, total + 4096, dtype=np.int32) - np.repeat((bounds[:-1] + at).astype(np.int32), length)
    known = max(1, min(window, 32 // bits))
    _, group = np.unique(group, return_inverse=True)
    live = np.flatnonzero(rest >= known)
    word = np.zeros(len(live), np.uint64)
    for k in range(known):
        word = word << np.uint64(bits) | units[live + k].astype(np.uint64)
    if bits * known <= 32 and len(length) < 1 << 19:
        keys = (word << np.uint64(13) | place[live].astype(np.uint64)) << np.uint64(19) | group[who[live]].astype(np.uint64)
    else:
        keys = named(word)[0] * (int(group.max(initial=0)) + 1) + group[who[live]]
        keys = named(keys)[0] * 8192 + place[live]
    pointer = np.full(total, -1, np.int64)

    def update(live: np.ndarray, keys: np.ndarray) -> np.ndarray:
        bucket, size = named(keys)
        several = size[bucket] > 1
        pointer[live[~several]] = -1
        pointer[live[several]] = bucket[several]
        return live[several]

    live = update(live, keys)
    while known < window and len(live):
        step = min(known, window - known)
        dead = live[rest[live] < known + step]
        live = live[rest[live] >= known + step]
        later = pointer[live + step]
        alone = later < 0
        most = int(pointer.max()) + 1
        keys = pointer[live[~alone]] * most + later[~alone]
        gone, live = np.concatenate([dead, live[alone]]), live[~alone]
        # identifiers of this round replace those of the last one only now, for all suffixes at once
        live = update(live, keys)
        pointer[gone] = -1
        known += step
    return live, pointer[live]


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans as maximal ones."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.ones(len(start), bool)
    head[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(head)
    return start[first], end[np.append(first[1:], len(start)) - 1]


SOLVED = "h long, ctx long, s long, e long"
#: Contexts of whole grams, as columns and their bytes -> context number, and first and last unit of what recurs in it.
Solve = Callable[[np.ndarray, np.ndarray, np.ndarray, pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _solved(solve: Solve):
    """Contexts, all those of a gram one behind the other -> spans of what recurs in each, counted from its anchor."""

    def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        h, ctx, n, place = (rows.column(k).combine_chunks().to_numpy() for k in ("h", "ctx", "n", "place"))
        _, left, _ = unpack_place(place)
        who, s, e = solve(h, n, left, rows.column("around").combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h[who], ctx[who], s - left[who], e - left[who])], names=["h", "ctx", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            h = batch.column("h").to_numpy()
            if not len(h):
                continue
            if rows >= BATCH_CONTEXTS and h[0] != held[-1].column("h")[-1].as_py():
                yield answer(held)
                held, rows = [], 0
            begin = 0
            for edge in (np.flatnonzero(h[1:] != h[:-1]) + 1).tolist():
                if rows + edge - begin >= BATCH_CONTEXTS:
                    yield answer([*held, batch.slice(begin, edge - begin)])
                    held, rows, begin = [], 0, edge
            held.append(batch.slice(begin))
            rows += len(h) - begin
        if held:
            yield answer(held)

    return run


def _by_window(rows: DataFrame, window: int, content: Callable[[Column], Column]) -> DataFrame:
    """The spans of contexts of grams too common for one task: a row for each window, counted map-side before it is shuffled."""
    _, left, right = place_columns()
    windows = rows.select("h", "ctx", "n", "around", left.alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), left + right - window)).alias("i")).select(
        "h", "ctx", "n", (F.col("i") - F.col("left")).alias("s"), content(F.col("i")).alias("w")
    )
    again = windows.groupBy("h", "s", "w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    some = windows.where("n = 1").join(again, ["h", "s", "w"]).select("h", "ctx", "s", (F.col("s") + window).alias("e"))
    return rows.where("n > 1").select("h", "ctx", (-left).alias("s"), right.alias("e")).unionByName(some)


def repeated_spans(texts: DataFrame, units: Units, around: Around, solve: Solve, content: Callable[[Column], Column], window: int, gram: int, group_limit: int) -> DataFrame:
    """rd, rt, spans (s, e): units covered by windows that recur, maybe none, for texts that may have any; texts as from `keyed_texts`.

    A gram with more than group_limit different contexts isn't gathered in one
    task: its windows become rows.
    """
    found = recurring(texts, units, window, gram)
    hot = written(found.kinds.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > group_limit).select("h"))
    rows = contexts(texts, found, around)
    split = not hot.isEmpty()
    if split:
        rows = written(rows)
    plain = rows.join(small_side(hot), "h", "left_anti") if split else rows
    solved = plain.repartition("h").sortWithinPartitions("h").mapInArrow(_solved(solve), SOLVED)
    if split:
        solved = solved.unionByName(_by_window(rows.join(small_side(hot), "h", "left_semi"), window, content))
    solved = written(solved.distinct())
    pos, _, _ = place_columns()
    span = F.when(F.col("s").isNotNull(), F.struct((pos + F.col("s")).alias("s"), (pos + F.col("e")).alias("e")))
    return found.members.join(solved, ["h", "ctx"], "left").groupBy("rd", "rt").agg(F.collect_set(span).alias("spans"))


def list_column(column: pa.Array, fields: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and the flat fields of an array-of-struct column; null counts as empty."""
    n = len(column)
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])[: n + 1], [flat.field(f).to_numpy(zero_copy_only=False) for f in fields]
