"""Merkle manifest of a dataset: a tree of digests a group of rows, kept as a postorder append log.

Nodes are lowercase hex SHA-256 of their children's hex digests, one behind the
other; the last node of a level may have one child only, and levels end where one
node remains.  Node (h, j) stands h levels over the leaves and covers leaves
j * 2^h up to (j + 1) * 2^h - 1.

**Log.**  Nodes are written in the order in which an appending writer completes
them.  With the last leaf l that a node covers, its position is

    2 * l - popcount(l) + h

since l leaves before it complete 2 * l - popcount(l) nodes, and then its own path
completes upwards; nodes at the right edge complete when the log is closed, in the
same order.  So a subtree is one stretch of the log, and a sibling's address
follows from its height and number alone (`position`).

**Builders.**  Aligned blocks of 2^high leaves are built by one task each,
whatever group they are of; a block's nodes are one segment of the log, one row of
it.  The block roots are the leaves of the next round, until one root a group
remains.  Each round is a written table of a 2^high-th of the rows before.

**Proofs.**  A block's lower siblings all lie in its own segment.  The siblings
over a block are the same for all its leaves: they are the proof of its root among
the blocks, which is extracted from that round's segments and joined to the block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: 2 to this power leaves are a block.
BLOCK_LEVELS = 10


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(n: int) -> int:
    """Levels over the leaves of a tree of n leaves."""
    return max(n - 1, 0).bit_length()


def position(h: int, j: int, n: int) -> int:
    """The place of node (h, j) in the log of n leaves."""
    last = min((j + 1) << h, n) - 1
    return 2 * last - last.bit_count() + h


def siblings(i: int, n: int) -> list[int]:
    """The places of the siblings of leaf i, from below; a node without a sibling gives none."""
    found = []
    for h in range(levels(n)):
        other = (i >> h) ^ 1
        if other << h < n:
            found.append(position(h, other, n))
    return found


def log_of(leaves: list[str], top: int) -> list[str]:
    """The nodes of a block of leaves in the order of completion, with levels up to `top` over them.

    One open node a level waits for its sibling; at the end, open nodes are
    completed upwards.
    """
    log: list[str] = []
    waiting: list[str | None] = [None] * (top + 1)
    for leaf in leaves:
        node, h = leaf, 0
        log.append(node)
        while h < top and waiting[h] is not None:
            node, waiting[h] = digest(waiting[h], node), None
            log.append(node)
            h += 1
        waiting[h] = node
    open_node: str | None = None
    for h in range(top):
        left = waiting[h]
        if open_node is None and left is None:
            continue
        open_node = digest(*(x for x in (left, open_node) if x is not None))
        log.append(open_node)
    return log


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with each one's number by order, from 0, nulls first; one row a task is summed up."""
    placed = written(rows.repartitionByRange(F.col(order).asc_nulls_first()).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    inside = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(F.col(order).asc_nulls_first())) - 1)
    return inside.join(before, "_part").withColumn(name, F.col("_before") + F.col("_k")).drop("_part", "_before", "_k")


def indexed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows (with `grp`) and gid, the number of their group by its name, i, their number in it by order, and n, its rows; also how many groups there are.

    Rows are range-partitioned by group and order, so a group may be spread over
    many tasks; rows are counted by task and group, and those counts, never the
    rows, meet the groups.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    placed = written(rows.repartitionByRange(F.col("grp").asc_nulls_first(), *by).withColumn("part", F.spark_partition_id()))
    counts = written(placed.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("c")))
    groups = written(numbered(counts.groupBy("grp").agg(F.sum("c").alias("n")), "grp", "gid"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("grp").orderBy("part")) - F.col("c"))
    before = before.alias("b").join(groups.alias("g"), F.col("b.grp").eqNullSafe(F.col("g.grp"))).select(F.col("b.part").alias("part_"), F.col("b.grp").alias("grp_"), "before", "gid", "n")
    inside = placed.withColumn("k", F.row_number().over(Window.partitionBy("grp", "part").orderBy(*by)) - 1)
    met = inside.join(before, F.col("grp").eqNullSafe(F.col("grp_")) & (F.col("part") == F.col("part_")))
    return met.withColumn("i", F.col("before") + F.col("k")).drop("part", "part_", "grp_", "before", "k", "c"), groups.count()


_SEGMENT = "gid long, block long, n long, nodes array<string>, root string"
_SEGMENT_ARROW = pa.schema([("gid", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("nodes", pa.list_(pa.string())), ("root", pa.string())])


def _segment(high: int):
    """The segment of one block of 2^high leaves and its root."""

    def build_one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        first = rows.slice(0, 1).to_pylist()[0]
        log = log_of(rows.column("leaf").to_pylist(), min(levels(first["n"]), high))
        return pa.Table.from_pylist([{"gid": first["gid"], "block": first["i"] >> high, "n": first["n"], "nodes": log, "root": log[-1]}], _SEGMENT_ARROW)

    return build_one


def build(leaves: DataFrame, high: int = BLOCK_LEVELS) -> list[DataFrame]:
    """The log's segments, round by round, from leaves (gid, i, n, leaf); the last round has one segment a group, with its root."""
    rounds, rows = [], leaves.select("gid", "i", "n", "leaf")
    while True:
        blocks = rows.withColumn("block", F.shiftright("i", high))
        rounds.append(written(blocks.groupBy("gid", "block").applyInArrow(_segment(high), _SEGMENT)))
        if rounds[-1].where(F.col("n") > 1 << high).isEmpty():
            return rounds
        rows = rounds[-1].select("gid", F.col("block").alias("i"), F.shiftright(F.col("n") + ((1 << high) - 1), high).alias("n"), F.col("root").alias("leaf"))


def _siblings(nodes: list[str], block: int, n: int, i: int, high: int) -> tuple[list[str | None], str]:
    """The siblings of leaf i inside its block, one a level, and L, R or - for each: to the left, to the right, none."""
    first = position(0, block << high, n)
    path, sides = [], []
    for h in range(min(levels(n), high)):
        other = (i >> h) ^ 1
        there = other << h < n
        path.append(nodes[position(h, other, n) - first] if there else None)
        sides.append("-" if not there else "L" if other < i >> h else "R")
    return path, "".join(sides)


def _level(wanted: DataFrame, segments: DataFrame, above: DataFrame, high: int) -> DataFrame:
    """wanted (gid, i, more) with path, sides, subroot and root: siblings from the segment of their block, then those over it.

    `above` has one row a block: gid, block, over, over_sides, subroot, root.
    """
    rows = wanted.withColumn("block", F.shiftright("i", high))
    known = segments.select("gid", "block", "n", "nodes").join(above, ["gid", "block"])
    names = wanted.columns

    def extract(left: pa.Table, right: pa.Table) -> pa.Table:
        segment = right.to_pylist()[0]
        found = [_siblings(segment["nodes"], segment["block"], segment["n"], i, high) for i in left.column("i").to_pylist()]
        new = {"path": pa.array([x + segment["over"] for x, _ in found], pa.list_(pa.string())), "sides": pa.array([x + segment["over_sides"] for _, x in found], pa.string())}
        new |= {k: pa.array([segment[k]] * len(found), pa.string()) for k in ("subroot", "root")}
        return pa.Table.from_arrays([*(left.column(c) for c in names), *new.values()], names=[*names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields) + ", path array<string>, sides string, subroot string, root string"
    return rows.groupBy("gid", "block").cogroup(known.groupBy("gid", "block")).applyInArrow(extract, schema)


def proofs(leaves: DataFrame, rounds: list[DataFrame], over: DataFrame | None = None, high: int = BLOCK_LEVELS) -> DataFrame:
    """leaves (gid, i, more) with path, sides, subroot and root, from the last round down.

    `over` has what stands over a group's root (gid, over, over_sides, root); without
    it, that root is the root.
    """
    last = rounds[-1].select("gid", "block", F.col("root").alias("subroot"))
    if over is None:
        above = last.withColumns({"over": F.array().cast("array<string>"), "over_sides": F.lit(""), "root": F.col("subroot")})
    else:
        above = last.join(over, "gid")
    for k in reversed(range(1, len(rounds))):
        blocks = written(_level(rounds[k - 1].select("gid", F.col("block").alias("i")), rounds[k], above, high))
        above = blocks.select("gid", F.col("i").alias("block"), F.col("path").alias("over"), F.col("sides").alias("over_sides"), "subroot", "root")
    return _level(leaves, rounds[0], above, high)


def fold(leaf: Column, path: Column, sides: Column) -> Column:
    """The root that a leaf and its siblings give."""
    steps = F.transform(path, lambda sibling, k: F.struct(sibling.alias("sibling"), F.substring(sides, k + 1, F.lit(1)).alias("side")))
    join = lambda node, s: F.when(s["side"] == "L", F.concat(s["sibling"], node)).when(s["side"] == "R", F.concat(node, s["sibling"])).otherwise(node)
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(join(node, s), 256))


def document_leaves(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id", counted_col: str = "n_chars") -> DataFrame:
    """doc_id, grp, leaf and tampered: the leaf of the row with 1 more in counted_col, where 7 divides the CRC-32 of the id, else null.

    A leaf is the digest of all columns, each as its UTF-8 byte count, a colon and
    itself, or `-` for a null.  Rows with a null id aren't tampered with.
    """
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    own = {c: F.col(f"`{c}`").cast("string") for c in columns}
    more = own | {counted_col: (F.col(f"`{counted_col}`").cast("decimal(20,0)") + 1).cast("decimal(20,0)").cast("string")}
    leaf = lambda values: F.sha2(F.concat(*(field(v) for v in values.values())), 256)
    some = F.crc32(own[id_col].cast("binary")) % 7 == 0
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{group_col}`").alias("grp"), leaf(own).alias("leaf"), F.when(some, leaf(more)).alias("tampered"))


def verified(leaves: DataFrame, high: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for leaves (doc_id, grp, leaf, tampered).

    A tree a group, its leaves by doc_id, null ids first, then by digest, so rows
    that share an id have a place each and equal rows may change places.  The
    groups' roots, by name and the null group first, are the leaves of the last
    tree.  folded_root starts from `tampered` where that isn't null.  An empty
    table gives an empty result.
    """
    rows, groups = indexed(leaves.select("doc_id", "grp", "leaf", "tampered"), ["doc_id", "leaf"])
    rows = written(rows.select("gid", "i", "n", "doc_id", "leaf", "tampered"))
    rounds = build(rows, high)
    subroots = rounds[-1].select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("i"), F.lit(groups).cast("long").alias("n"), F.col("root").alias("leaf"))
    top = written(proofs(subroots.select("gid", "i"), build(subroots, high), high=high))
    over = top.select(F.col("i").alias("gid"), F.col("path").alias("over"), F.col("sides").alias("over_sides"), "root")
    out = proofs(rows.select("gid", "i", "doc_id", "leaf", "tampered"), rounds, over, high)
    folded = out.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path"), F.col("sides")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("path", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "path", "sides")
