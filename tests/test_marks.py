"""Links are looked up only where a seed's marks say that they may be some."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sextant.operators import graph


def test_marks(spark):
    nodes = spark.createDataFrame([(f"S{s}", f"IS_{s * 1000 + i}", min(i, 2)) for s in range(40) for i in range(50)], "seed string, id string, hop int")
    marked = graph._marked(nodes)
    assert marked.count() == 80 and {r.source for r in marked.where("seed = 'S3'").collect()} == {"IS_3000", "IS_3001"}
    own = nodes.select("seed", F.col("id").alias("target")).join(marked, "seed")
    assert own.where(~graph._may_have(F.col("target"))).isEmpty()
    others = marked.crossJoin(spark.range(2000).select(F.concat(F.lit("SUP_"), "id").alias("target")))
    assert others.where(graph._may_have(F.col("target"))).count() < 0.06 * others.count()


def test_only_possible_links_are_looked_up(spark):
    rng = random.Random(2)
    rows = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}", rng.choice("XY")) for _ in range(300)] + [(f"n{i}", f"far{i}_{j}", "X") for i in range(40) for j in range(100)]
    edges = spark.createDataFrame([*rows, rows[0], ("n1", None, "X"), (None, "n1", "X")], "source string, target string, relationship string")
    seeds = [f"n{i}" for i in range(0, 40, 4)] + ["none"]
    nodes, links = graph.neighbourhood(edges, spark.createDataFrame([(s,) for s in seeds], "id string"), 30)
    kept = {}
    for r in nodes.collect():
        kept.setdefault(r.seed, {})[r.id] = r.hop
    want = {(s, a, b, k) for s, ids in kept.items() for a, b, k in rows if a in ids and b in ids and (ids[a] < 2 or ids[b] == 0)}
    got = [tuple(r) for r in links.collect()]
    assert set(got) == want and len(got) == len(want) > 100
    below = links._jdf.queryExecution().optimizedPlan().toString().split("LeftSemi", 1)[1]
    assert "xxhash64" in below
