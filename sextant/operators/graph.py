"""Typed citation graphs as two tables: nodes (id, …) and edges (source, target, relationship, …)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare_number, canonical_key
from ..sources.scratch import small_side, written

#: Node ids that are broadcast at most, to leave out edges of other nodes before they are shuffled.
MOST_NODES = 1_000_000
#: Kinds of ids, by what stands before their number, that are numbered at most.
MOST_PREFIXES = 64
NO_LOOPS = ("NORMATIVE_REF", "TESTED_BY", "SUPERSEDES")


def without_loops(edges: DataFrame) -> DataFrame:
    """No blank ends, and no edge of a node to itself for the relationships that can't have one."""
    return edges.where("source != '' and target != ''").where(~(F.col("relationship").isin(*NO_LOOPS) & (F.col("source") == F.col("target"))))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def consolidated(edges: DataFrame) -> DataFrame:
    """Edges of all sources, the most trusted (smallest priority) of each (source, target, relationship); descriptions cut to 250."""
    rows = without_loops(edges).withColumn("description", F.substring("description", 1, 250))
    return keep_first(rows, ["source", "target", "relationship"], [F.col("priority"), F.col("description")])


def completed_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, node_type, status of nodes and of edge ends that no node has; targets of SUPERSEDES are superseded."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("source_type").alias("node_type"), F.lit(False).alias("old")), F.struct(F.col("target").alias("id"), F.col("target_type").alias("node_type"), (F.col("relationship") == "SUPERSEDES").alias("old")))).alias("e")).select("e.*")
    new = ends.groupBy("id").agg(F.min("node_type").alias("node_type"), F.max("old").alias("old"))
    new = new.join(nodes.select("id"), "id", "left_anti")
    return nodes.select("id", "node_type", "status").unionByName(new.select("id", "node_type", F.when(F.col("old"), "SUPERSEDED").otherwise("ACTIVE").alias("status")))


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship").agg(F.count(F.lit(1)).alias("edges"))


def both_ways(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"), "relationship", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("neighbour"), "relationship", F.lit("in").alias("direction")))


def one_hop(edges: DataFrame) -> DataFrame:
    """node, neighbour, category; six categories by relationship and direction."""
    kind, out = F.col("relationship"), F.col("direction") == "out"
    category = (
        F.when((kind == "NORMATIVE_REF") & out, "normative_references").when(kind == "NORMATIVE_REF", "cited_by").when((kind == "TESTED_BY") & out, "test_methods")
        .when((kind == "MANDATED_BY") & out, "orders").when((kind == "SUPERSEDES") & out, "supersedes").when(kind == "SUPERSEDES", "superseded_by")
    )
    return both_ways(edges).withColumn("category", category).where("category is not null").select("node", "neighbour", "category").distinct()


def _nearest(near: DataFrame, most: int) -> DataFrame:
    """node, neighbour: the `most` smallest neighbours of each node; a hub is cut before it is shuffled."""
    pairs = near.select("node", "neighbour").distinct()
    order = Window.partitionBy("node").orderBy("neighbour")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def _split(node: str) -> dict[str, Column]:
    """A node's id as what stands before its last digits and their number, or where they don't give it back, as it is."""
    prefix = F.rtrim(F.col(node), F.lit("0123456789"))
    number = F.substring(F.col(node), F.length(prefix) + 1, F.length(node)).try_cast("int")
    fits = F.coalesce(F.concat(prefix, number.cast("string")) == F.col(node), F.lit(False))
    return {f"{node}_prefix": F.when(fits, prefix), f"{node}_number": F.when(fits, number), f"{node}_whole": F.when(~fits, F.col(node))}


def _numbered(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, Callable[[Column], Column]]:
    """Edges (source, target), written once, and different seeds (seed, node) with one number for a node's id, and what makes the id of a number.

    Ids that a number doesn't give back, or of more than MOST_PREFIXES kinds, stay as they are.  The
    node of a seed that is no end of an edge may be null.
    """
    start = seeds.select(F.col("id").alias("seed")).distinct()
    if any(edges.schema[c].dataType.simpleString() != "string" for c in ("source", "target")):
        return written(edges.select("source", "target")), start.withColumn("node", F.col("seed")), lambda c: c
    split = written(edges.select(*(c.alias(k) for end in ("source", "target") for k, c in _split(end).items())))
    whole = split.where("source_whole is not null or target_whole is not null").isEmpty()
    kinds = split.select(F.explode(F.array("source_prefix", "target_prefix")).alias("prefix")).where("prefix is not null").distinct().limit(MOST_PREFIXES + 1)
    prefixes = sorted(r.prefix for r in kinds.collect()) if whole else []
    if not prefixes or len(prefixes) > MOST_PREFIXES:
        id_of = lambda end: F.coalesce(f"{end}_whole", F.concat(f"{end}_prefix", F.col(f"{end}_number").cast("string"))).alias(end)
        return split.select(id_of("source"), id_of("target")), start.withColumn("node", F.col("seed")), lambda c: c
    most = split.agg(F.max(F.greatest("source_number", "target_number"))).first()[0]
    n, known = len(prefixes), F.array(*map(F.lit, prefixes))
    kind = "int" if (most + 1) * n < 1 << 31 else "long"
    number = lambda end: (F.col(f"{end}_number").cast("long") * n + F.array_position(known, F.col(f"{end}_prefix")) - 1).cast(kind)
    start = start.select("seed", *(c.alias(k) for k, c in _split("seed").items()))
    node = F.when(F.array_contains(known, F.col("seed_prefix")) & (F.col("seed_number") <= most), number("seed"))
    named = lambda c: F.concat(F.element_at(known, (c % n + 1).cast("int")), F.floor(c / n).cast("string"))
    return split.select(number("source").alias("source"), number("target").alias("target")), start.select("seed", node.alias("node")), named


def _expanded(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, id, hop of whole expansions.

    Nodes travel as numbers, and what leaves a node as one array, which is laid
    out only where all that its seed reaches is.
    """
    edges, start, named = _numbered(edges, seeds)
    start = written(start)
    some = start.select("node").where("node is not null").distinct()
    near = both_ways(edges.withColumn("relationship", F.lit(None).cast("string"))).select("node", "neighbour").join(small_side(some, MOST_NODES), "node", "left_semi")
    first = written(near.where("neighbour != node").distinct())
    out = edges.groupBy(F.col("source").alias("neighbour")).agg(F.collect_set("target").alias("ids"), F.bool_or(F.col("target").isNull()).alias("blank"))
    far = first.join(out, "neighbour").select("node", F.lit(2).alias("hop"), F.when(F.col("blank"), F.array_append("ids", F.lit(None).cast(edges.schema["target"].dataType))).otherwise(F.col("ids")).alias("ids"))
    rows = some.select("node", F.lit(0).alias("hop"), F.array("node").alias("ids")).unionByName(first.select("node", F.lit(1).alias("hop"), F.array("neighbour").alias("ids"))).unionByName(far)
    found = rows.repartition("node").select("node", "hop", F.explode("ids").alias("id")).groupBy("node", "id").agg(F.min("hop").alias("hop"))
    found = found.select(named(F.col("node")).alias("seed"), named(F.col("id")).alias("id"), "hop")
    return found.unionByName(start.where("node is null").select("seed", F.col("seed").alias("id"), F.lit(0).alias("hop")))


def two_hop(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """seed, id, hop: both directions from the seed, then out-edges only; a node keeps its first hop, and the nearest `most` stay, ties to smaller ids.

    With `most`, no node passes on more than so many neighbours: of those at most
    as many are near already as leave room for fewer, so the rows are those of the
    whole expansion.  Seeds that are full after the first hop make no second one.
    Edges of other nodes than seeds, and then than those of seeds that aren't full,
    are left out before they are shuffled.
    """
    if most is None:
        return _expanded(edges, seeds)
    start = seeds.select(F.col("id").alias("seed")).distinct()
    near = both_ways(edges).join(small_side(start.withColumnRenamed("seed", "node"), MOST_NODES), "node", "left_semi")
    first = written(_nearest(near, most).select(F.col("node").alias("seed"), F.col("neighbour").alias("id")).where("id != seed"))
    onward = first.join(first.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 < most).select("seed"), "seed", "left_semi")
    leaving = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour"))
    leaving = leaving.join(small_side(onward.select(F.col("id").alias("node")).distinct(), MOST_NODES), "node", "left_semi")
    out = _nearest(leaving, most).select(F.col("node").alias("id"), F.col("neighbour").alias("next"))
    second = onward.join(out, "id").select("seed", F.col("next").alias("id"))
    found = start.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hop")).unionByName(first.withColumn("hop", F.lit(1))).unionByName(second.withColumn("hop", F.lit(2)))
    found = found.groupBy("seed", "id").agg(F.min("hop").alias("hop"))
    order = Window.partitionBy("seed").orderBy("hop", "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def _marks(node: Column) -> list[tuple[Column, Column]]:
    """The three places, word and bit, that a node has among the 8 words of `_marked`."""
    h = F.xxhash64(node)
    places = [F.shiftright(h, by).bitwiseAND(511) for by in (0, 9, 18)]
    return [(F.shiftright(p, 6).cast("int"), p.bitwiseAND(63).cast("int")) for p in places]


def _marked(nodes: DataFrame) -> DataFrame:
    """seed, source, marks: the nodes of a seed that edges are followed from, each with the marks of all nodes of that seed."""
    one = F.lit(1).cast("long")
    words = [F.bit_or(reduce(lambda a, b: a.bitwiseOR(b), (F.when(word == i, F.call_function("shiftleft", one, bit)).otherwise(F.lit(0).cast("long")) for word, bit in _marks(F.col("id"))))) for i in range(8)]
    sets = nodes.groupBy("seed").agg(F.collect_list(F.when(F.col("hop") < 2, F.col("id"))).alias("from"), F.array(*words).alias("marks"))
    return sets.select("seed", "marks", F.explode("from").alias("source"))


def _may_have(node: Column) -> Column:
    """Whether a row's marks have those of a node: always for a node of its seed, seldom for others."""
    return reduce(lambda a, b: a & b, (F.call_function("shiftright", F.get("marks", word), bit).bitwiseAND(1) == 1 for word, bit in _marks(node)))


def neighbourhood(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of `two_hop`, and its links: seed, source, target, relationship.

    Links are the different edges that an expansion follows (all of the seed's, and
    those that leave nodes of the first hop) between nodes that stay.  An edge onto
    the seed leaves a node of the first hop, so all links leave a node of a hop
    below 2.  Most edges from there lead to no node that stays: they are seen where
    they are joined, by marks of the seed's nodes, and only those that may be links
    are shuffled to be looked up.
    """
    nodes = written(two_hop(edges, seeds, most))
    kept = nodes.where("hop < 2").select(F.col("id").alias("source")).distinct()
    leaving = edges.select("source", "target", "relationship")
    if kept.limit(MOST_NODES + 1).count() <= MOST_NODES:
        leaving = leaving.join(F.broadcast(kept), "source", "left_semi")
    may = _marked(nodes).join(leaving, "source").where(_may_have(F.col("target")))
    links = may.select("seed", "source", "target", "relationship").join(nodes.select("seed", F.col("id").alias("target")), ["seed", "target"], "left_semi")
    return nodes, links.select("seed", "source", "target", "relationship").distinct()


def subgraph(edges: DataFrame, roots: DataFrame, with_orders: bool = True, most: int | None = None) -> DataFrame:
    """Distinct out-edges of the roots; with `most`, so many of each root, by relationship and target."""
    kept = edges if with_orders else edges.where("relationship != 'MANDATED_BY'")
    found = kept.join(roots.select(F.col("id").alias("source")), "source", "left_semi").select("source", "target", "relationship").distinct()
    if most is None:
        return found
    order = Window.partitionBy("source").orderBy("relationship", "target")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def merged_nodes(loads: DataFrame, keep: str = "last") -> DataFrame:
    """One row of each id of loads (id, load, title, department, status): of the last load or the first, then by title, with defaults for what is blank."""
    order = [F.col("load").desc() if keep == "last" else F.col("load"), F.col("title")]
    default = lambda c, value: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(value)).alias(c)
    return keep_first(loads.where("id != ''"), ["id"], order).select("id", "load", default("title", ""), default("department", "General"), default("status", "ACTIVE"))


def chain_ends(links: DataFrame) -> DataFrame:
    """node, end, steps: where following links (node, next; one each) leads; a cycle ends at its smallest node.

    Every round doubles the step, so a chain of n needs log2(n) rounds; rounds
    are written tables, and they end when no pointer moves.  A pointer that
    still moves after as many steps as there are links is on a cycle or leads to
    one: the link of each cycle's smallest node is cut, and what is left is
    followed anew.  The smallest node itself has 0 steps.
    """
    links = written(links.select("node", "next"))
    ends, turning = _followed(links, links.count())
    if turning is None:
        return ends
    # After that many steps every pointer is on its cycle, reaches all of it, and has passed the smallest node.
    cut = written(turning.join(turning.select(F.col("next").alias("node")).distinct(), "node", "left_semi").where("node = least").select("node"))
    ends, _ = _followed(written(links.join(cut, "node", "left_anti")), None)
    return ends.unionByName(cut.select("node", F.col("node").alias("end"), F.lit(0).cast("long").alias("steps")))


def _followed(links: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Ends of links, and None; or the pointers (node, next, least) that still move after `most` steps, least being the smallest node passed."""
    pointers, turns = written(links.select("node", "next", F.lit(1).cast("long").alias("steps"), F.col("node").alias("least"))), 0
    while True:
        onward = pointers.select(F.col("node").alias("next"), F.col("next").alias("after"), F.col("steps").alias("more"), F.col("least").alias("lower"))
        moved = pointers.join(onward, "next", "left").select(
            "node", F.coalesce("after", "next").alias("next"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.least("least", "lower").alias("least"), F.col("after").isNotNull().alias("moved")
        )
        moved = written(moved)
        turns += 1
        if moved.where("moved").isEmpty():
            return moved.select("node", F.col("next").alias("end"), "steps"), None
        pointers = moved.drop("moved")
        # One round more: a chain of `most` steps has stopped by then.
        if most is not None and 2 ** (turns - 1) >= most:
            return moved.select("node", F.col("next").alias("end"), "steps"), moved.where("moved").select("node", "next", "least")


def _searched(edges: DataFrame, pairs: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Pairs with their number; pair, length of those that are connected; and for both ends what was reached (pair, node, d, parent).

    Every step reads the edges (a written table) and keeps those of its rim before anything is shuffled.
    """
    near = both_ways(edges.select("source", "target", F.lit(None).cast("string").alias("relationship"))).select("node", "neighbour")
    todo = written(pairs.select("source", "target").distinct().withColumn("pair", F.xxhash64("source", "target")))
    seen = {end: todo.select("pair", F.col(end).alias("node"), F.lit(0).alias("d"), F.lit(None).cast(todo.schema[end].dataType).alias("parent")) for end in ("source", "target")}
    rim = dict(seen)
    found = todo.where("source = target").select("pair", F.lit(0).alias("length"))
    step = 0
    while most is None or step < most:
        step += 1
        end, other = ("source", "target") if step % 2 else ("target", "source")
        # A pair goes on while both its rims hold nodes: where one is empty, that end's whole component has been seen.
        open_rim = rim[end].join(found, "pair", "left_anti").join(rim[other].select("pair").distinct(), "pair", "left_semi")
        leaving = near.join(small_side(open_rim.select("node").distinct(), MOST_NODES), "node", "left_semi")
        grown = open_rim.join(leaving, "node").groupBy("pair", F.col("neighbour").alias("node")).agg(F.min("node").alias("parent"))
        fresh = grown.join(seen[end], ["pair", "node"], "left_anti")
        rim[end] = written(fresh.select("pair", "node", F.lit((step + 1) // 2 if end == "source" else step // 2).alias("d"), "parent"))
        if rim[end].isEmpty():
            break
        seen[end] = seen[end].unionByName(rim[end])
        met = rim[end].join(seen[other].select("pair", "node", F.col("d").alias("e")), ["pair", "node"]).groupBy("pair").agg(F.min(F.col("d") + F.col("e")).alias("length"))
        found = written(found.unionByName(met))
    return todo, found, seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """source, target, length of pairs of nodes, edges taken either way; null where no path joins them, or none of `most` steps.

    Frontiers of both ends grow in turn, so that each reaches half as far; a
    node is never visited twice by one pair.  Without `most` they grow until
    every pair has met or has no node left to visit.
    """
    todo, found, _ = _searched(written(edges.select("source", "target")), pairs, most)
    return todo.join(found, "pair", "left").select("source", "target", "length")


def _among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes (node), those of others left out before anything is shuffled."""
    kept = small_side(nodes.select("node").distinct(), MOST_NODES)
    return edges.join(kept.withColumnRenamed("node", "source"), "source", "left_semi").join(kept.withColumnRenamed("node", "target"), "target", "left_semi")


def path_steps(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """source, target, step, node, relationship: the nodes of one shortest path of each connected pair.

    edges: a written table, as every step of the search reads it.
    Of several paths, the one over the smallest node in the middle, and from
    there to both ends over the smallest node that is one step nearer.  A step's
    relationship is the smallest of the edges onto its node, else INVERSE_ and
    the smallest of those back; the first step is START, or IDENTICAL where the
    path has no other.
    """
    todo, found, seen = _searched(edges, pairs, most)
    half = F.floor((F.col("length") + 1) / 2).cast("int")
    sides = {"source": seen["source"].join(found, "pair").where(F.col("d") == half), "target": seen["target"].join(found, "pair").where(F.col("d") == F.col("length") - half)}
    middle = sides["source"].select("pair", "node", "length").join(sides["target"].select("pair", "node"), ["pair", "node"])
    middle = written(middle.groupBy("pair", "length").agg(F.min("node").alias("node")).withColumn("step", half))
    path = middle.select("pair", "step", "node")
    for end, by in (("source", -1), ("target", 1)):
        here = middle
        while True:
            here = written(here.join(seen[end].select("pair", "node", "parent"), ["pair", "node"]).where("parent is not null").select("pair", "length", F.col("parent").alias("node"), (F.col("step") + by).alias("step")))
            if here.isEmpty():
                break
            path = path.unionByName(here.select("pair", "step", "node"))
    path = written(path.withColumn("before", F.lag("node").over(Window.partitionBy("pair").orderBy("step"))))
    kinds = _among(edges, path).groupBy("source", "target").agg(F.min("relationship").alias("kind"))
    forth, back = (kinds.select(F.col(a).alias("before"), F.col(b).alias("node"), F.col("kind").alias(c)) for a, b, c in (("source", "target", "forth"), ("target", "source", "back")))
    told = path.join(forth, ["before", "node"], "left").join(back, ["before", "node"], "left").join(todo, "pair")
    first = F.when(F.col("source") == F.col("target"), "IDENTICAL").otherwise("START")
    return told.select("source", "target", "step", "node", F.when(F.col("step") == 0, first).otherwise(F.coalesce("forth", F.concat(F.lit("INVERSE_"), "back"))).alias("relationship"))


def path_checks(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, nodes, last, broken of every path of `path_steps`: how many nodes it has, its last step, and how many steps follow no edge of their relationship."""
    w = Window.partitionBy("source", "target").orderBy("step")
    rows = steps.withColumn("before", F.lag("node").over(w))
    back = F.startswith("relationship", F.lit("INVERSE_"))
    rows = rows.withColumns({"a": F.when(back, F.col("node")).otherwise(F.col("before")), "b": F.when(back, F.col("before")).otherwise(F.col("node")), "kind": F.regexp_replace("relationship", "^INVERSE_", "")})
    known = _among(edges, steps).select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("relationship").alias("kind")).distinct().withColumn("known", F.lit(True))
    told = rows.join(known, ["a", "b", "kind"], "left")
    at_ends = ((F.col("step") == 0) & (F.col("node") != F.col("source"))) | F.col("known").isNull() & (F.col("step") > 0)
    ends = F.max_by("node", "step")
    sums = told.groupBy("source", "target").agg(F.count(F.lit(1)).alias("nodes"), F.max("step").cast("long").alias("last"), F.count_if(at_ends).alias("wrong"), ends.alias("end"))
    return sums.select("source", "target", "nodes", "last", (F.col("wrong") + F.when(F.col("end") != F.col("target"), 1).otherwise(0)).alias("broken"))


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """node, and how many different neighbours of each category `one_hop` has for it."""
    kinds = ("normative_references", "test_methods", "orders", "cited_by")
    return one_hop(edges).groupBy("node").agg(*(F.count_if(F.col("category") == k).alias(k) for k in kinds))


def clusters(items: DataFrame, by: str, most: int = 8, default: str = "General") -> DataFrame:
    """cluster, items, clusters: the largest groups by what stands before a bracket, blanks under a default label, and how many groups there are."""
    named = items.select(F.coalesce(F.nullif(F.trim(F.substring_index(by, "(", 1)), F.lit("")), F.lit(default)).alias("cluster"))
    counts = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("items"))
    return counts.crossJoin(counts.agg(F.count(F.lit(1)).alias("clusters"))).orderBy(F.col("items").desc(), "cluster").limit(most)


def aliases(catalog: DataFrame) -> DataFrame:
    """key, item_id: by id, full number and bare number; a key of several items belongs to the first kind, then the smallest id."""
    kinds = [(0, F.col("item_id")), (1, F.col("item_no")), (2, bare_number(F.col("item_no")))]
    keys = catalog.select("item_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), canonical_key(c).alias("key")) for k, c in kinds))).alias("a")).where("a.key != ''")
    return keys.groupBy("a.key").agg(F.min_by("item_id", F.struct("a.kind", "item_id")).alias("item_id"))


def resolved(citations: DataFrame, alias: DataFrame, raw: str = "raw") -> DataFrame:
    """citations, each row, with item_id: the key itself, then with the prefix, then without the year; the first that is known."""
    text = F.col(raw)
    plain = F.regexp_replace(text, r"\s*:\s*\d{4}\s*$", "")
    tries = F.array(canonical_key(text), canonical_key(F.concat(F.lit("IS"), text)), canonical_key(plain), canonical_key(F.concat(F.lit("IS"), plain)))
    given = F.struct(*citations.columns).alias("given")
    numbered = written(citations.select(given, F.monotonically_increasing_id().alias("row"), tries.alias("tries")))  # written, so that a row keeps its number
    rows = numbered.select("given", "row", F.posexplode("tries").alias("stage", "key"))
    found = rows.join(alias, "key", "left").groupBy("row").agg(F.any_value("given").alias("given"), F.min_by("item_id", F.when(F.col("item_id").isNotNull(), F.col("stage"))).alias("item_id"))
    return found.select("given.*", "item_id")

