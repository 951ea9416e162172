"""Queries that ask for the same are searched once, those that no rule asks about not at all, and texts are read in pieces."""

from __future__ import annotations

import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from sextant.functions.text import first_class, tokens
from sextant.operators import constraints, retrieval, slots
from sextant.plans import every
from sextant.plans.fixtures import view


def test_few_searches(spark, monkeypatch):
    searched, whole = [], retrieval._asked
    monkeypatch.setattr(retrieval, "_asked", lambda q, terms: searched.append(q.select("qid").distinct().count()) or whole(q, terms))
    assert every.QUERIES["constraint_bonus"](spark, SF).count() > 0
    assert searched and 3 * max(searched) < view(spark, SF, "fx_tenders").count()


@pytest.mark.parametrize("unknown", [0, 3, 4096])
def test_alike_loses_nothing(spark, monkeypatch, unknown):
    monkeypatch.setattr(retrieval, "UNKNOWN_WORDS", unknown)
    rng = random.Random(7)
    words = ["hot", "red", "ring", "bolt", "gear", "nowhere", "elsewhere", "x9", "of"]
    c = spark.createDataFrame([(i, " ".join(rng.choices(words[:5], k=rng.randint(1, 4))) + f" IS {i}") for i in range(60)] + [(70, None)], "doc_id long, text string")
    asked = [(q, " ".join(rng.choices(words, k=rng.randint(1, 6))) + rng.choice(["", f" is {q % 50}", " ; IS 7"])) for q in range(200)] + [(900, None), (901, ""), (902, "nowhere of"), (None, "hot ring")]
    q = spark.createDataFrame(asked, "qid long, text string")
    found = retrieval.index(c, features=60)
    members = retrieval.alike(q.select("qid", tokens(F.col("text")).alias("words")), found)
    got = [tuple(r) for r in members.join(retrieval.searched_alike(members, found), "key").select("qid", "doc_id").collect()]
    want = {tuple(r) for r in retrieval.searched(q.where("qid is not null"), found).select("qid", "doc_id").collect()}
    assert len(got) == len(want) and set(got) == want


def test_pieces_and_keywords(spark):
    rng = random.Random(3)
    kinds = {"exposure": slots.EXPOSURE, "seismic": slots.SEISMIC, "corrosion": slots.CORROSION, "infrastructure": slots.INFRASTRUCTURE}
    some = [w for kind in kinds.values() for _, own in kind for w in own]
    some += [p for w in some for p in w.replace("-", " ").split()] + ["severely", "dams", "IS 12", "fe 500", "IS", "7", "क", "A"]
    texts = ["".join(y for _ in range(rng.randint(0, 7)) for y in (rng.choice(some), rng.choice([" ", " ", "-", " ; ", ";", "", "_"]))) for _ in range(1500)]
    q = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "qid long, text string")
    recurring = [p for t in texts[:300] for p in t.split(" ; ")]
    for given in ([], recurring):
        rows = slots.slots(slots.read_in_pieces(q, " ; ", given), "found")
        plain = slots.slots(q).select("qid", *(F.col(k).alias(f"own_{k}") for k in kinds))
        rows = rows.join(plain, "qid").withColumns({f"old_{k}": first_class(F.lower("text"), kind) for k, kind in kinds.items()})
        wrong = " or ".join(f"not ({k} <=> old_{k}) or not (own_{k} <=> old_{k})" for k in kinds)
        assert rows.count() == 1502 and rows.where(wrong).isEmpty() and rows.where(~F.col("words").eqNullSafe(tokens(F.col("text")))).isEmpty()
    needless = ["is_12", "coastal", "zone"]
    rows = slots.read_in_pieces(q, " ; ", recurring, lambda words: set(needless) & set(words)).withColumn("all", tokens(F.col("text")))
    kept = lambda c: F.transform(c, lambda w: F.when(~w.isin(needless), w))
    assert rows.where(~kept("words").eqNullSafe(kept("all"))).isEmpty() and not rows.where(F.exists("words", lambda w: w.isNull())).isEmpty()
    with pytest.raises(ValueError):
        slots.read_in_pieces(q, " ", [])


def test_rules_choose_queries(spark):
    q = spark.createDataFrame([(1, "pipes for drinking water"), (2, "sheets"), (3, None), (4, "a bridge in coastal area")], "qid long, text string")
    assert {r.qid for r in constraints.concerned(slots.slots(q), "qid").collect()} == {1, 4}
