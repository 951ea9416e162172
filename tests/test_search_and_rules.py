"""The pruned search, constraint rules, matches of whole queries, the sweep over orders, and the entry's guard."""

from __future__ import annotations

import datetime
import random
import sys

import pytest
from pyspark.sql import functions as F

from sextant.operators import constraints, orders, ranking, retrieval, slots
from sextant.sources.scratch import written


@pytest.fixture(scope="module")
def searched(spark):
    """Few documents have a query's rare words, most have its common ones."""
    rng = random.Random(2)
    rare, common = [f"rare{i}" for i in range(300)], [f"common{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(rng.randint(0, 60)))) for i in range(2500)] + [(3000, None), (3001, "")]
    asked = [(q, " ".join([rng.choice(rare) for _ in range(3)] + rng.sample(common, 2))) for q in range(30)] + [(90, "common0"), (91, "nothing here"), (92, "")]
    return spark.createDataFrame(asked, "qid int, text string"), spark.createDataFrame(docs, "doc_id long, text string")


def all_rows(df):
    return sorted(tuple(r) for r in df.select("qid", "doc_id", "score", "rank").collect())


def test_pruning_loses_nothing(spark, searched, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    monkeypatch.setattr(retrieval, "SHARD_DOCUMENTS", 1000)
    q, c = searched
    found = retrieval.index(c)
    shares = []
    for weights, r in ((retrieval.bm25_weights(q, found.bm25), found.bm25), (retrieval.tfidf_weights(q, found.tfidf), found.tfidf)):
        assert r.lists.agg(F.max(F.size("docs"))).first()[0] <= 16
        for k in (3, 5000):
            assert all_rows(retrieval.pruned(weights, r, k)) == all_rows(retrieval.direct(weights, r, k))
        least = written(retrieval.thresholds(weights, r, 3))
        blocks, _ = retrieval.planned(weights, r, least)
        scored, every = blocks.agg(F.sum(F.when(F.col("read"), F.size("docs"))), F.sum(F.size("docs"))).first()
        heads = r.lists.where("block = 0").join(weights, "term").agg(F.sum(F.size("docs"))).first()[0]
        shares.append((scored + heads) / every)
    # A document of one common word is all of that word, so cosines leave out less.
    assert shares[0] < 0.5 and shares[1] < 0.8, shares


def test_weights_below_zero(spark):
    lists = spark.createDataFrame([("a", 0, 0, 3.0, [1, 2], [3.0, 2.0]), ("a", 0, 1, 1.0, [3], [1.0]), ("b", 0, 0, 2.0, [2, 3], [2.0, 1.5])], "term string, shard int, block int, top double, docs array<long>, impacts array<double>")
    asked = spark.createDataFrame([(1, "a", 1.0, 3.0, 3), (1, "b", -0.5, 2.0, 2)], "qid int, term string, weight double, top double, df long")
    r = retrieval.Ranking(lists, asked)
    for k in (1, 2, 3):
        assert all_rows(retrieval.pruned(asked, r, k)) == all_rows(retrieval.direct(asked, r, k)) == [(1, 1, 3.0, 1), (1, 2, 1.0, 2), (1, 3, 0.25, 3)][:k]


def test_whole_queries_match(spark):
    catalog = spark.createDataFrame(
        [(1, "IS_12", "IS 12", "opc 43 grade cement portland", ["opc 43"]), (2, "IS_269", "IS 269", "portland cement ordinary", ["cement"]), (3, "IS_1786", "IS 1786", "deformed steel bars", ["ab", "bars"])], "doc_id long, item_id string, item_no string, text string, keywords array<string>"
    ).withColumn("status", F.lit("ACTIVE"))
    q = spark.createDataFrame([(1, "IS 1786 bars"), (2, "opc 43 grade portland cement"), (3, "portland cement 12 mm"), (4, "269"), (5, "is 269:2015 or is 12 cement"), (6, "fab steel")], "qid int, text string")
    exact = ranking.named(q, catalog)
    assert dict(exact.collect()) == {1: "IS_1786", 2: None, 3: None, 4: "IS_269", 5: "IS_269", 6: None}
    found = q.select("qid").crossJoin(catalog.select("doc_id", "item_id", "item_no", "status", "keywords")).withColumns({"score": F.lit(0.0), "score_a": F.lit(0.0), "score_b": F.lit(0.0)})
    got = {(r.qid, r.doc_id): r.score for r in ranking.composite(found, q, exact).collect()}
    assert got[1, 3] == 0.43 and got[2, 1] == 0.08 and got[3, 1] == 0.01 and got[4, 2] == 0.35
    assert got[5, 2] == 0.43 and got[5, 1] == 0.25 and got[6, 3] == 0.01  # a keyword of two letters doesn't count


def test_all_of_a_long_ranking_stays(spark):
    ranked = spark.range(1500).select(F.lit(1).alias("qid"), F.col("id").alias("doc_id"), (1 / (F.col("id") + 2)).alias("score"), (F.col("id") + 1).alias("rank"))
    out = ranking.promoted(ranked, spark.createDataFrame([(7, 99_999)], "doc_id long, new_id long"))
    assert out.count() == 1500 and out.where("rank = 1").first().doc_id == 99_999


def test_constraint_rules(spark):
    texts = [(1, "bars for a coastal bridge in zone v"), (2, "pipes for drinking water"), (3, "pipes for a sewerage drainage network"), (4, "a severe exposure"), (5, "bars")]
    items = [(1, "IS_1786", "bars"), (2, "IS_13920", None), (3, "IS_456", "concrete"), (4, "IS_4984", "potable sewer"), (5, "IS_458", "pipes"), (6, "IS_2062", "steel"), (7, "X", "Potable things for sewers")]
    slotted = slots.slots(spark.createDataFrame(texts, "qid int, text string"))
    known = spark.createDataFrame(items, "doc_id int, item_id string, scope_text string")
    pairs = slotted.select("qid").crossJoin(known.select("doc_id"))
    got = {(r.qid, r.doc_id): (r.bonus, len(r.applied)) for r in constraints.evaluated(pairs, slotted, known).collect()}
    want = {(1, 1): (0.65, 2), (1, 2): (0.65, 2), (1, 3): (0.25, 1), (1, 6): (0.25, 1), (2, 4): (0.4, 1), (2, 5): (-0.5, 1), (2, 7): (-0.5, 1), (3, 5): (0.4, 1), (3, 4): (-0.3, 1), (3, 7): (-0.3, 1), (4, 1): (0.35, 1), (4, 3): (0.25, 1)}
    assert got == want
    clauses = constraints.evaluated(pairs, slotted, known).where("qid = 4 and doc_id = 3").first().applied
    assert [(r.rule_id, r.clause) for r in clauses] == [("durable_concrete", "IS 456:2000 Table 16")]
    plan = constraints.evaluated(pairs, slotted, known)._jdf.queryExecution().optimizedPlan().toString()
    assert "Explode" not in plan and "Generate" not in plan


def test_sweep_over_orders(spark):
    rng = random.Random(4)
    start = datetime.date(2020, 1, 1)
    day = lambda: (start + datetime.timedelta(days=rng.randrange(60))).isoformat()
    said = lambda: rng.choice([day, day, day, lambda: "d 04", lambda: f"rescinded on {day()}", lambda: f"superseded by order of {day()}"])()
    rows = [(f"o{i}", i, f"I{rng.randrange(25)}", f"Order {rng.randrange(6)}", said()) for i in range(120)]
    table = spark.createDataFrame(rows, "order_id string, order_no long, item_id string, order_name string, effective_raw string")
    dates = spark.createDataFrame([(start + datetime.timedelta(days=k),) for k in range(-2, 63)], "evaluation_date date")
    asked = table.select("item_id").distinct().crossJoin(dates)
    want = orders.governing(orders.status_asof(table, dates))
    got = orders.governing_asof(table, asked.unionByName(asked))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(got.columns).collect()), key=repr)
    many = spark.range(100_000).select(F.lit("I1").alias("item_id"), F.date_add(F.lit(start), F.col("id").cast("int")).alias("evaluation_date"))
    swept = orders.governing_asof(table, many)
    plan = swept._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and swept.count() == 100_000


def test_entry_without_what_a_query_needs(monkeypatch):
    import __spark_entry__ as entry

    from sextant.plans import every

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries() and set(every.QUERIES) <= set(entry.queries())
    monkeypatch.setitem(sys.modules, "sextant.llm", None)
    assert set(entry.queries()) == set(every.QUERIES)
