"""Rules by grams against plain search, paths, neighbourhoods, quarantine, milestones and keyed state."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sextant.operators import graph, matching, recommend, revisions, rules
from sextant.sources import readers


def _planned(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(params=[10_000, 0], ids=["few", "many"])
def bound(request, monkeypatch):
    """Rules are broadcast, or joined in shuffles."""
    monkeypatch.setattr(matching, "MOST_RULES", request.param)


def test_phrases_against_plain_search(spark, bound):
    dice = random.Random(5)
    word = lambda: "".join(dice.choice("abc ") for _ in range(dice.randrange(0, 6)))
    texts = [(i % 35, "".join(dice.choice("abc ") for _ in range(dice.randrange(0, 30)))) for i in range(40)] + [(90, None), (None, "abc"), (91, ""), (92, "x\U0001f600y z"), (92, "x\U0001f600y z")]
    phrases = [(i, word()) for i in range(40)] + [(50, None), (51, ""), (52, "\U0001f600y"), (53, "abc"), (53, "abc")]
    made = matching.contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(phrases, "k int, phrase string"), "id", F.col("text"), "phrase")
    want = sorted((i, k, p) for i, t in texts for k, p in phrases if i is not None and t is not None and p is not None and p in t)
    assert sorted(tuple(r) for r in made.where("id is not null").collect()) == want


def test_rules_of_any_number(spark, bound):
    texts = spark.createDataFrame([(1, "Tor steel bars"), (2, "toresteel"), (3, None), (4, "c++ code, cost 5")], "qid int, text string")
    made = spark.createDataFrame([("a", 2, "steel"), ("b", 1, "bars?"), ("c", 0, "ore"), ("d", 3, "cost \\d")], "rule_id string, ord int, keyword string")
    assert dict(map(tuple, rules.first_match(texts, made, "qid").collect())) == {1: "b", 2: None, 3: None, 4: "d"}
    assert dict(map(tuple, rules.first_match(texts, made, "qid", whole_word=False, default="z").collect())) == {1: "a", 2: "c", 3: "z", 4: "z"}
    items = spark.createDataFrame([(1, "IS 45"), (2, "IS 4"), (3, "IS"), (4, ""), (5, None), (6, "x")], "item int, no string")
    keys = spark.createDataFrame([("a", 1, "IS 456"), ("b", 0, "IS 4"), ("c", 2, None)], "rule_id string, ord int, keyword string")
    assert dict(map(tuple, rules.either_contains(items, keys, "item", "no").collect())) == {1: "b", 2: "b", 3: "b", 4: "b", 5: None, 6: None}
    idioms = spark.createDataFrame([(2, r"\bs\w+l\b", "metal", "s"), (1, r"bars", "rods", None), (3, "c\\+\\+", "language", "c++")], "ord int, pattern string, addition string, needs string")
    assert dict(map(tuple, recommend.idioms(texts, idioms).collect())) == {1: "rods metal", 2: "", 3: "", 4: "language"}


def test_no_loops_over_all_pairs(spark):
    """A hundred thousand rules: no nested loop and no product in the plan, and the right rows."""
    table = spark.range(100_000).select(F.format_string("r%06d", "id").alias("rule_id"), F.col("id").cast("int").alias("ord"), F.format_string("phrase %06d", "id").alias("keyword"))
    texts = spark.range(200).select("id", F.format_string("text of phrase %06d here", F.col("id") * 499).alias("text"))
    for whole in (True, False):
        found = rules.first_match(texts, table, "id", whole_word=whole)
        assert "NestedLoop" not in _planned(found) and "CartesianProduct" not in _planned(found)
        assert {(r.id, r.rule_id) for r in found.collect()} == {(i, f"r{i * 499:06}") for i in range(200)}


def _expanded(edges, seed, most):
    """Plain breadth-first rule: hop by id, the nearest `most`, and followed links between them."""
    first = {b for a, b, _ in edges if a == seed} | {a for a, b, _ in edges if b == seed}
    hops = {b: 2 for a, b, _ in edges if a in first} | dict.fromkeys(first, 1) | {seed: 0}
    kept = dict(sorted(hops.items(), key=lambda x: (x[1], x[0]))[:most])
    return {(seed, n, h) for n, h in kept.items()}, {(seed, *e) for e in edges if e[0] in kept and e[1] in kept and (kept[e[0]] < 2 or kept[e[1]] == 0)}


@pytest.mark.parametrize("most", [1, 2, 5, 9, 100, None])
def test_neighbourhoods(spark, most):
    dice = random.Random(8)
    rows = [(f"n{dice.randrange(25):02}", f"n{dice.randrange(25):02}", dice.choice("RS")) for _ in range(60)]
    seeds = ["n00", "n01", "n02", "alone", "n00"]
    nodes, links = graph.neighbourhood(spark.createDataFrame(rows, "source string, target string, relationship string"), spark.createDataFrame([(s,) for s in seeds], "id string"), most)
    want = [_expanded(rows, s, most) for s in set(seeds)]
    assert {tuple(r) for r in nodes.select("seed", "id", "hop").collect()} == set().union(*(n for n, _ in want)) and nodes.count() == sum(len(n) for n, _ in want)
    assert sorted(tuple(r) for r in links.select("seed", "source", "target", "relationship").collect()) == sorted(set().union(*(x for _, x in want)))


def test_hub(spark):
    """A hub of a million edges, next to every seed: it passes on no more than the budget."""
    hub = spark.range(1_000_000).select(F.lit("hub").alias("source"), F.format_string("t%07d", "id").alias("target"), F.lit("R").alias("relationship"))
    to = spark.range(50).select(F.format_string("s%02d", "id").alias("source"), F.lit("hub").alias("target"), F.lit("R").alias("relationship"))
    seeds = spark.range(50).select(F.format_string("s%02d", "id").alias("id"))
    nodes, links = graph.neighbourhood(hub.unionByName(to), seeds, 20)
    assert nodes.count() == 50 * 20 and nodes.where("hop = 2").agg(F.max("id")).first()[0] == "t0000017"
    assert links.count() == 50 * 19


def test_path_checks(spark):
    edges = spark.createDataFrame([("a", "b", "R"), ("c", "b", "S")], "source string, target string, relationship string")
    steps = [("a", "c", 0, "a", "START"), ("a", "c", 1, "b", "R"), ("a", "c", 2, "c", "INVERSE_S"), ("a", "b", 0, "a", "START"), ("a", "b", 1, "b", "S"), ("b", "c", 0, "b", "START"), ("z", "z", 0, "z", "IDENTICAL")]
    told = graph.path_checks(spark.createDataFrame(steps, "source string, target string, step int, node string, relationship string"), edges)
    assert {tuple(r) for r in told.collect()} == {("a", "c", 3, 2, 0), ("a", "b", 2, 1, 1), ("b", "c", 1, 0, 1), ("z", "z", 1, 0, 0)}


def test_quarantine(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"id": 1, "name": "a"}\n{"id": \n\n{"id": "x", "name": "b"}\n{"name": "c", "more": 1}\n[1]\n')
    rows = readers.read_json_lines_checked(spark, str(tmp_path / "in.jsonl"), StructType().add("id", "long").add("name", "string"))
    assert {(r.id, r.name, r.rejected) for r in rows.collect()} == {(1, "a", None), (None, None, '{"id": '), (None, None, '{"id": "x", "name": "b"}'), (None, "c", None), (None, None, "[1]")}
    counts = readers.quarantined(rows, F.col("rejected").isNotNull(), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert counts == {"rows": 5, "valid": 2, "rejected": 3} == {"rows": back.count(), "valid": back.where("verdict = 'valid'").count(), "rejected": back.where("verdict = 'rejected'").count()}
    empty = readers.quarantined(rows.where("id > 5"), F.col("rejected").isNotNull(), str(tmp_path / "none"))
    assert empty == {"rows": 0, "valid": 0, "rejected": 0}


def test_type_counts(spark):
    nodes = spark.createDataFrame([("a", "standard", "ACTIVE"), ("b", None, "ACTIVE"), ("c", "order", None)], "id string, node_type string, status string")
    edges = spark.createDataFrame([("a", "b", "R")], "source string, target string, relationship string")
    assert json.loads(readers.summary(nodes, edges).first().report).keys() == {"nodes by type", "nodes by status", "edges by relationship"}
    assert {tuple(r) for r in readers.type_counts(nodes, edges).collect()} == {("nodes by type", "standard", 1), ("nodes by type", "unknown", 1), ("nodes by type", "order", 1), ("nodes by status", "ACTIVE", 2), ("nodes by status", "unknown", 1), ("edges by relationship", "R", 1)}


def test_milestones(spark):
    items = spark.createDataFrame([("a", "IS 12"), ("b", "IS 9"), ("c", "IS 5"), ("d", ""), ("e", None)], "item_id string, item_no string")
    marks = spark.createDataFrame([(2, "IS 1", 1960, "IS 1:1960", "x"), (1, "IS 12", 1970, "IS 12:1970", "y"), (1, "IS 12", 1950, "IS 12:1950", None)], "ord int, designator string, year int, revision string, event string")
    own = spark.createDataFrame([("r1", "IS 9:1980", "IS 9", 1980), ("r2", "IS 9:1975", "IS 9", 1975), ("r3", "IS 12:1900", "IS 12", 1900)], "rev_id string, rev_no string, base string, year int")
    told = {r.item_id: (r.designator, r.origin, [tuple(m) for m in r.milestones]) for r in revisions.milestones(items, marks, own).collect()}
    assert told["a"] == ("IS 12", "curated", [(1950, "IS 12:1950", None), (1970, "IS 12:1970", "y")]) and told["b"] == (None, "revisions", [(1975, "IS 9:1975", None), (1980, "IS 9:1980", None)])
    assert told["c"] == told["d"] == told["e"] == (None, "none", [])


def test_replacement_codes(spark):
    """All codes, both fall-backs, and what a citation may be replaced by."""
    items = [("IS_1", "IS 1", "ACTIVE"), ("IS_2", "IS 2", "SUPERSEDED"), ("IS_3", "IS 3", "WITHDRAWN"), ("IS_4", "IS 4", "WITHDRAWN"), ("IS_5", "IS 5", "SUPERSEDED"), ("IS_6", "IS 6", "SUPERSEDED"), ("IS_7", "IS 7", "ACTIVE"), ("IS_8", "IS 8", "ACTIVE")]
    catalog = spark.createDataFrame(items, "item_id string, item_no string, status string")
    edges = spark.createDataFrame([("IS_1", "IS_2", "SUPERSEDES", "IS 1 chronologically supersedes IS 2"), ("IS_7", "IS_5", "SUPERSEDES", "a"), ("IS_8", "IS_5", "SUPERSEDES", None)], "source string, target string, relationship string, description string")
    branches = spark.createDataFrame([("IS_6", "bars", "IS_7"), ("IS_6", "plates", "IS_8")], "item_id string, keyword string, replacement string")
    chain = graph.chain_ends(spark.createDataFrame([("IS_3", "IS_33"), ("IS_33", "IS_8")], "node string, next string")).select("node", "end")
    texts = {1: "IS 1", 2: "IS 2", 3: "to IS 3", 4: "IS 4", 5: "IS 5", 6: "IS 6 bars", 7: "IS 6", 8: "no number", 9: "IS 99"}
    queries = spark.createDataFrame(list(texts.items()), "qid int, text string")
    told = recommend.supersession(queries, catalog, graph.aliases(catalog), edges, branches, chain)
    assert {r.qid: (r.code, r.replacement) for r in told.collect()} == {
        1: ("ACTIVE_STANDARD", "IS_1"), 2: ("RESOLVED", "IS_1"), 3: ("RESOLVED", "IS_8"), 4: ("RESOLVED", None), 5: ("AMBIGUOUS_BRANCHING", None), 6: ("CONTEXTUAL_BRANCH_SELECTED", "IS_7"), 7: ("AMBIGUOUS_BRANCHING", None), 8: ("NO_CITATION", None), 9: ("UNINDEXED_CITATION", None),
    }
    options = {r.qid: [tuple(o)[:4] for o in r.options] for r in recommend.replacement_options(told, edges, branches, chain).collect()}
    both = [("IS_7", False, "CURATED", "bars"), ("IS_8", False, "CURATED", "plates")]
    assert options == {
        1: [], 2: [("IS_1", True, "CHRONOLOGICAL_INFERRED", None)], 3: [("IS_8", True, "CHAIN_END", None)], 4: [], 5: [("IS_7", False, "CURATED_UNVERIFIED", None), ("IS_8", False, "CURATED_UNVERIFIED", None)],
        6: [("IS_7", True, "CURATED", "bars"), both[1]], 7: both, 8: [], 9: [],
    }
