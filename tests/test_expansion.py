"""Whole expansions lay nodes out only where a seed's are together, and number ids that can be."""

from __future__ import annotations

import random

import pytest

from sextant.operators import graph


def brute(rows, seeds):
    out = {}
    for s in seeds:
        first = {b for a, b, _ in rows if a == s} | {a for a, b, _ in rows if b == s}
        first = {n for n in first if n is not None and n != s} if s is not None else set()
        second = {b for a, b, _ in rows if a is not None and a in first}
        for hop, ids in ((2, second), (1, first), (0, {s})):
            out.update({(s, i): hop for i in ids})
    return {(s, i, hop) for (s, i), hop in out.items()}


NAMES = {
    "numbers": lambda i: f"IS_{i}" if i % 3 else f"SUP_{i}",
    "far": lambda i: f"IS_{i * 30_000_000}" if i % 3 else f"{i}",
    "other": lambda i: ["IS_%d", "IS_0%d", "n", "IS_99999999999%d", ""][i % 5].replace("%d", str(i)) or f"é{i}x",
}


@pytest.mark.parametrize("kind", NAMES)
def test_expansion(spark, kind):
    rng, name = random.Random(4), NAMES[kind]
    rows = [(name(rng.randint(0, 60)), name(rng.randint(0, 60)), "X") for _ in range(150)]
    rows += [rows[0], (name(1), None, "X"), (None, name(2), "X"), (name(7), name(7), "X")]
    seeds = [name(i) for i in range(0, 70, 3)] + ["none", "IS_99", "IS_2147483647", "SUP_007", "XX_1", None]
    edges = spark.createDataFrame(rows, "source string, target string, relationship string")
    got = [tuple(r) for r in graph.two_hop(edges, spark.createDataFrame([(s,) for s in [*seeds, seeds[0]]], "id string")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, set(seeds))


def test_nodes_are_shuffled_in_arrays(spark, monkeypatch):
    edges = spark.createDataFrame([(f"IS_{i}", f"IS_{(i * j + 1) % 50}", "X") for i in range(50) for j in range(20)], "source string, target string, relationship string")
    seeds = spark.createDataFrame([(f"IS_{i}",) for i in range(0, 50, 2)], "id string")
    plan = graph.two_hop(edges, seeds)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(ids") < plan.index("RepartitionByExpression") < plan.index("collect_set")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "source long, target long")
    assert sorted(map(tuple, graph.two_hop(edges.selectExpr("*", "'X' relationship"), spark.createDataFrame([(1,)], "id long")).collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
