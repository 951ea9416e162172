"""Edges away from a path are left out before the steps of paths are told and checked."""

from __future__ import annotations

from sextant.operators import graph


def test_edges_of_paths_only(spark):
    edges = spark.createDataFrame([("a", "b", "R"), ("a", "b", "R"), ("c", "b", "S"), ("c", "d", "R"), ("x", "y", "R"), ("y", "z", "R"), ("a", "a", "R"), (None, "a", "R")], "source string, target string, relationship string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "z"), ("x", "x")], "source string, target string")
    steps = graph.path_steps(edges, pairs)
    told = [(r.source, r.target, r.step, r.node, r.relationship) for r in steps.orderBy("source", "step").collect()]
    assert told == [("a", "d", 0, "a", "START"), ("a", "d", 1, "b", "R"), ("a", "d", 2, "c", "INVERSE_S"), ("a", "d", 3, "d", "R"), ("x", "x", 0, "x", "IDENTICAL")]
    checks = graph.path_checks(steps, edges)
    assert sorted((r.source, r.nodes, r["last"], r.broken) for r in checks.collect()) == [("a", 4, 3, 0), ("x", 1, 0, 0)]
    for table in (steps, checks):
        assert "LeftSemi" in table._jdf.queryExecution().optimizedPlan().toString()
