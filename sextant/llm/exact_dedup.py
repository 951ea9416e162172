"""Exact dedup against a history of digests, by minimal perfect hashing.

The history is a table of shards.  A shard holds a minimal perfect hash over its
distinct digests (levels of bit arrays, a key's place is the rank of its bit)
and a slot for each: the full digest, the locator of the winner (its id) and how
many rows had the digest.  A new row is looked up in its shard: the slot's
digest is compared byte for byte, so rows the history doesn't know are told
apart for certain; these are grouped among themselves.  History, members and
new groups together are the next history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import row_key_of, salted, without, written

#: Digests of a shard, rows that one task looks up in one shard, bits a key at each level, bytes of a slot.
SHARD_DIGESTS, SHARD_ROWS, GAMMA, SLOT = 20_000, 100_000, 2, 49


def _keys(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each 32-byte digest."""
    words = digests.view("<u8")
    return words[:, 1].copy(), words[:, 2].copy()


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    h = (a + np.uint64(level) * (b | np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def build_hash(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct digests (n, 32), and each digest's slot."""
    a, b = _keys(digests)
    slot, left, levels, base = np.zeros(len(digests), np.int64), np.arange(len(digests)), [], 0
    while len(left):
        size = max(64, GAMMA * len(left))
        at = _place(a[left], b[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        slot[left[mine]] = base + (np.cumsum(alone) - 1)[at[mine]]
        base += int(alone.sum())
        levels.append(alone)
        left = left[~mine]
        if len(levels) > 200:
            raise ValueError("digests of a shard must be distinct")
    return levels, slot


def find_slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot that each digest would have; -1 where no level has its bit."""
    a, b = _keys(digests)
    slot, left, base = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
    for level, bits in enumerate(levels):
        at = _place(a[left], b[left], level, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits)
        slot[left[hit]] = base + rank[at[hit]] - 1
        base += int(rank[-1]) if len(rank) else 0
        left = left[~hit]
    return slot


_SHARD = "shard int, sizes binary, bits binary, slots binary"


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    digests = np.frombuffer(b"".join(frame["digest"]), np.uint8).reshape(-1, 32)
    levels, slot = build_hash(digests)
    slots = np.zeros((len(digests), SLOT), np.uint8)
    slots[slot, :32] = digests
    slots[slot, 48] = frame["winner"].isna()
    slots[slot, 32:40] = np.array([0 if pd.isna(w) else int(w) for w in frame["winner"].astype(object)], "<i8")[:, None].view(np.uint8)
    slots[slot, 40:48] = frame["size"].to_numpy(np.int64).astype("<i8")[:, None].view(np.uint8)
    sizes = np.array([len(x) for x in levels], "<i8").tobytes()
    return pd.DataFrame([{"shard": frame["shard"].iloc[0], "sizes": sizes, "bits": b"".join(np.packbits(x).tobytes() for x in levels), "slots": slots.tobytes()}])


def _shard_of(shards: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


class History:
    """Shards of digests, each with a winner's id and a number of rows."""

    def __init__(self, shards: DataFrame, count: int):
        self.shards, self.count = shards, count

    @classmethod
    def build(cls, groups: DataFrame) -> History:
        """From digest (32 bytes, distinct), winner, size; digests are spread evenly, so shards are of bounded size."""
        groups = written(groups.select("digest", F.col("winner").cast("long").alias("winner"), F.col("size").cast("long").alias("size")))
        count = max(1, -(-groups.count() // SHARD_DIGESTS))
        return cls(written(groups.withColumn("shard", _shard_of(count)).groupBy("shard").applyInPandas(_build, _SHARD)), count)

    def look_up(self, rows: DataFrame) -> DataFrame:
        """rows (rid, digest) with known, winner and size; the last two are null for digests that the history doesn't know.

        A shard that many rows ask for, because one digest is common, is read by several tasks.
        """
        rows = rows.select("rid", "digest", _shard_of(self.count).alias("shard"))
        shards, asked = salted(self.shards, rows, "shard", SHARD_ROWS, F.xxhash64("rid"))
        left = shards.select("shard", "salt", F.lit(0).alias("kind"), "sizes", "bits", "slots", F.lit(None).cast("long").alias("rid"), F.lit(None).cast("binary").alias("digest"))
        nothing = [F.lit(None).cast("binary").alias(c) for c in ("sizes", "bits", "slots")]
        right = asked.select("shard", "salt", F.lit(1).alias("kind"), *nothing, "rid", "digest")
        both = left.unionByName(right).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        return both.mapInArrow(_looked_up, "rid long, digest binary, known boolean, winner long, size long")


    def verdicts(self, rows: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 for rows (rid, digest), all of which the history knows."""
        return self.look_up(rows).select(
            F.col("rid").alias("doc_id"), F.col("winner").alias("keep_id"), F.col("size").alias("group_size"), F.col("rid").eqNullSafe(F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
        )


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted so that a shard comes before the rows that ask for it; only one shard is held."""
    now, levels, slots = None, [], np.zeros((0, SLOT), np.uint8)
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        shard, salt = batch.column("shard").to_numpy(), batch.column("salt").to_numpy()
        edge = np.flatnonzero((kind[1:] != kind[:-1]) | (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(kind)]):
            if a == b:
                continue
            if kind[a] == 0:
                now = (shard[a], salt[a])
                levels, at = [], 0
                packed = np.frombuffer(batch.column("bits")[a].as_py(), np.uint8)
                for size in np.frombuffer(batch.column("sizes")[a].as_py(), "<i8").tolist():
                    levels.append(np.unpackbits(packed[at : at + -(-size // 8)])[:size].astype(bool))
                    at += -(-size // 8)
                slots = np.frombuffer(batch.column("slots")[a].as_py(), np.uint8).reshape(-1, SLOT)
                continue
            part = batch.slice(a, b - a)
            digests = np.frombuffer(b"".join(part.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
            if now != (shard[a], salt[a]):
                slot = np.full(len(digests), -1)
            else:
                slot = find_slots(levels, digests)
            known = slot >= 0
            got = slots[np.maximum(slot, 0)] if len(slots) else np.zeros((len(slot), SLOT), np.uint8)
            known &= (got[:, :32] == digests).all(axis=1)
            number = lambda lo: np.ascontiguousarray(got[:, lo : lo + 8]).view("<i8").ravel()
            yield pa.RecordBatch.from_arrays(
                [part.column("rid"), part.column("digest"), pa.array(known), pa.array(number(32), mask=~known | (got[:, 48] == 1)), pa.array(number(40), mask=~known)],
                names=["rid", "digest", "known", "winner", "size"],
            )


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of shards as rows."""
    for batch in batches:
        for data in batch.column("slots").to_pylist():
            slots = np.frombuffer(data, np.uint8).reshape(-1, SLOT)
            number = lambda lo: np.ascontiguousarray(slots[:, lo : lo + 8]).view("<i8").ravel()  # noqa: B023, E731
            whole = np.ascontiguousarray(slots[:, :32])
            digest = pa.Array.from_buffers(pa.binary(), len(slots), [None, pa.py_buffer(np.arange(0, 32 * len(slots) + 1, 32, dtype=np.int32)), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([digest, pa.array(number(32), mask=slots[:, 48] == 1), pa.array(number(40))], names=["digest", "winner", "size"])


def add(history: History | None, rows: DataFrame) -> DataFrame:
    """digest, winner, size of all that the history and the rows (rid, digest) hold; the largest id wins."""
    own = [F.max("rid").alias("winner"), F.count(F.lit(1)).alias("size")]
    if history is None:
        return rows.groupBy("digest").agg(*own)
    found = written(history.look_up(rows))
    members = found.where("known").groupBy("digest").agg(*own)
    strangers = found.where("not known").groupBy("digest").agg(*own)
    old = history.shards.select("slots").mapInArrow(_slots, "digest binary, winner long, size long")
    return old.unionByName(members).unionByName(strangers).groupBy("digest").agg(F.max("winner").alias("winner"), F.sum("size").alias("size"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid (the id) and digest (SHA-256) of every row; null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("rid"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


def drop_copies(docs: DataFrame, history: History | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, History]:
    """For every row whether it stays, and the history with these rows.

    Returns doc_id, keep_id (the id of the row that stays), group_size, kept and
    text_sha256.  Of equal texts, in the history and in these rows, the largest
    id stays.

    Null text counts as empty.  Null ids are smaller than all others; a group of
    null ids only has a null keep_id.  Rows that repeat an id and its text are
    all marked kept where that id stays.  An empty table gives an empty result;
    other columns aren't read.
    """
    rows = written(digests(docs, id_col, text_col))
    new = History.build(add(history, rows))
    return new.verdicts(rows), new


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group of equal texts; which one and odd cases: see `drop_copies`."""
    verdicts, _ = drop_copies(docs, None, id_col, text_col)
    lost = verdicts.where("not kept").select(F.col("doc_id"), F.unhex("text_sha256").alias("digest"))
    rd, rt = row_key_of("doc_id", F.col("digest"))
    return without(docs, lost.select(rd.alias("rd"), rt.alias("rt")), id_col, text_col)
