"""Expansions leave out edges of other nodes before they are grouped."""

from __future__ import annotations

from sextant.operators import graph


def test_only_edges_of_seeds_are_grouped(spark, monkeypatch):
    seen, whole = [], graph._nearest
    monkeypatch.setattr(graph, "_nearest", lambda near, most: seen.append({r.node for r in near.select("node").distinct().collect()}) or whole(near, most))
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("d", "a", "X"), ("f", "g", "X"), ("g", "f", "X"), ("a", "a", "X")], "source string, target string, relationship string")
    seeds = spark.createDataFrame([("a",), ("a",), ("none",)], "id string")
    got = {tuple(r) for r in graph.two_hop(edges, seeds, most=9).collect()}
    assert got == {("a", "a", 0), ("none", "none", 0), ("a", "b", 1), ("a", "d", 1), ("a", "c", 2)}
    assert seen[0] == {"a"} and seen[1] <= {"b", "d"}
