"""Search by classes of queries and of texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sextant.operators import retrieval


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "doc_id", "score", "rank").collect())


@pytest.fixture(scope="module")
def items(spark):
    """Numbered items of few words; some queries name an item, some share no word with any."""
    rng = random.Random(5)
    names = [f"{a} {b} {a}" for a in ("hot", "cold", "red") for b in ("ring", "bolt", "gear")]
    docs = [(i, f"IS {i} {rng.choice(names)} {rng.choice(['steel', 'iron', 'steel iron'])}") for i in range(900)] + [(5000, None), (5001, "")]
    asked = [(q, f"IS {q * 7} {rng.choice(names)} 12 mm" + rng.choice(["", " steel"])) for q in range(120)] + [(900, "IS 3 IS 4 IS 4"), (901, "nothing"), (902, ""), (903, "hot hot hot")]
    return spark.createDataFrame(asked, "qid int, text string"), spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("rare", [1, 400])
def test_classes_lose_nothing(items, monkeypatch, rare):
    monkeypatch.setattr(retrieval, "RARE", rare)
    q, c = items
    found, used = retrieval.index(c, features=700), []
    whole = retrieval.grouped
    monkeypatch.setattr(retrieval, "grouped", lambda *a: used.append(a) or whole(*a))
    for weights, r in ((retrieval.bm25_weights(q, found.bm25), found.bm25), (retrieval.tfidf_weights(q, found.tfidf), found.tfidf)):
        for k in (3, 2000):
            want = rows(retrieval.direct(weights, r, k))
            monkeypatch.setattr(retrieval, "DIRECT_POSTINGS", 0)
            assert rows(retrieval.best(weights, r, k)) == want
    assert used


def test_classes_pair_once(items, monkeypatch):
    """A class of queries and one of documents meet once, however many rows they have."""
    q, c = items
    r = retrieval.bm25_index(retrieval.words_of(c))
    weights = retrieval.bm25_weights(q, r)
    monkeypatch.setattr(retrieval, "RARE", 3)
    terms = retrieval._frequent(weights)
    of_queries = retrieval.classes(weights.join(terms, "term", "left_semi"), "qid", "weight")
    posts = r.lists.join(terms, "term", "left_semi").select("term", F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), F.col("impacts").alias("impact"))))
    of_docs = retrieval.classes(posts, "doc_id", "impact")
    assert of_queries.profiles.count() <= 20 and of_docs.profiles.count() <= 27 and of_docs.members.count() == 900


def test_classes_by_what_they_cost(spark, monkeypatch):
    """Few classes of queries meet classes of texts, also where no two texts are of one class; then no lists are made."""
    c = spark.createDataFrame([(17 * i + j, f"word{i} item{j}") for i in range(17) for j in range(17)], "doc_id long, text string")
    q = spark.createDataFrame([(i, f"word{i % 3} item{i % 2}") for i in range(120)], "qid int, text string")
    r = retrieval.bm25_index(retrieval.words_of(c))
    weights = retrieval.bm25_weights(q, r)
    want = rows(retrieval.direct(weights, r, 5))
    monkeypatch.setattr(retrieval, "RARE", 3)
    monkeypatch.setattr(retrieval, "DIRECT_POSTINGS", 0)
    monkeypatch.setattr(retrieval, "pruned", None)
    assert rows(retrieval.best(weights, r, 5)) == want and len(want) == 600
    assert "lists" not in vars(r)
