"""A few queries against all texts, without an index."""

from __future__ import annotations

import random

import pytest

from sextant.operators import ranking, retrieval, rules


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "doc_id", "score", "rank").collect())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["is 12", "the", "steel"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 40])))) for i in range(300)] + [(900, None), (901, ""), (902, "w1 w1 w2"), (903, "w1 w1 w2")]
    asked = [(q, " ".join(rng.choices(words, k=5))) for q in range(12)] + [(50, ""), (51, "unknown"), (52, None)]
    return spark.createDataFrame(asked, "qid int, text string"), spark.createDataFrame(docs, "doc_id long, text string")


def test_scan_gives_the_rows_of_the_index(texts, monkeypatch):
    q, c = texts
    words = retrieval.words_of(c)
    bm25, tfidf = retrieval.bm25_index(words), retrieval.tfidf_index(words, 500)
    for k in (5, 1000):
        want = rows(retrieval.direct(retrieval.bm25_weights(q, bm25), bm25, k)), rows(retrieval.direct(retrieval.tfidf_weights(q, tfidf), tfidf, k))
        monkeypatch.setattr(retrieval, "_lists", lambda *a: pytest.fail("few queries need no index"))
        assert (rows(retrieval.bm25(q, c, k)), rows(retrieval.tfidf(q, c, k, 500))) == want
        monkeypatch.undo()
    fused = rows(retrieval.searched_once(q, c, 10, 500))
    assert fused == rows(retrieval.searched(q, retrieval.Index(bm25, tfidf), 10))
    monkeypatch.setattr(retrieval, "FEW_QUERIES", 3)
    assert rows(retrieval.searched_once(q, c, 10, 500)) == fused


def test_arrays_of_a_text_are_made_once(texts):
    """No filter below the generator works out a text's terms anew, and the length of a text stands below it."""
    _, c = texts
    words = retrieval.words_of(c)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    posts = plan(retrieval._bm25_posts(words, 3.0))
    assert "Filter (size(" not in posts and posts.count("sort_array") == 1
    vocabulary = retrieval._vocabulary(retrieval._grams(words), 4, 50)
    said = plan(retrieval._tfidf_posts(retrieval._grams(words), vocabulary))
    above = said[: said.index("Generate inline")]
    assert "aggregate(" not in above and "sqrt" not in above.lower()


def test_only_ranked_documents_are_tokenised(texts, spark):
    q, c = texts
    ranked = spark.createDataFrame([(0, 3), (1, 3)], "qid int, doc_id long")
    assert ranking.matched_terms(q, c, ranked).count() == 2
    plan = ranking.matched_terms(q, c, ranked)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_rules_move_a_ranking_that_is_worked_out_once(spark, monkeypatch):
    kept = []
    whole = rules.written
    monkeypatch.setattr(rules, "written", lambda df: kept.append(df) or whole(df))
    q = spark.createDataFrame([(1, "big bolt")], "qid int, text string")
    ranked = spark.createDataFrame([(1, 10, "IS 1", 0.5), (1, 11, "IS 2", 0.4)], "qid int, doc_id long, item_no string, score double")
    weights = spark.createDataFrame([("bolt", "IS 2", 0.3)], "word string, item_no string, weight double")
    assert [(r.doc_id, r.score, r.rank) for r in rules.reranked(ranked, q, weights).orderBy("rank").collect()] == [(11, 0.7, 1), (10, 0.5, 2)]
    assert len(kept) == 1
