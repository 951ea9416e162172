"""Keyed state over several batches, and audits that follow changed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import audit
from sextant.streaming import incremental


def test_keyed_ingest(spark, tmp_path):
    """Late and repeated keys, null ones too, over runs that resume; state is touched by new keys only."""
    schema = "event_id long, ts string, v int"
    batches = [[(1, "a", 1), (2, "b", 1), (None, "c", 1)], [(2, "0", 2), (3, "d", 2), (3, "d", 2)], [(None, "e", 3), (1, "z", 3), (4, "f", 3)], []]
    states = []
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{number}"))
        stream = incremental.arriving(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema)
        run = incremental.ingest_keyed(stream, "event_id", str(tmp_path / "out"), str(tmp_path / "c"))
        run.awaitTermination()
        steps = [p for p in run.recentProgress if p["numInputRows"] > 0]
        states.append([(p["numInputRows"], p["stateOperators"][0]["numRowsUpdated"], p["stateOperators"][0]["numRowsTotal"]) for p in steps])
    got = spark.read.parquet(str(tmp_path / "out")).select("event_id", "v").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 1), (2, 1), (None, 1), (3, 2), (4, 3)], key=repr)
    assert states == [[(3, 3, 3)], [(3, 1, 4)], [(3, 1, 5)], []]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False


def _docs(spark):
    rows = [(1, "bars to IS 432"), (2, "beams to IS 800:2007 and IS 432 (Part 2)"), (3, "nothing here"), (4, "pipes to IS 4984:2016"), (5, None), (6, "IS 800:1984, IS 4984"), (7, "IS 9000")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _all(df):
    return {tuple(r) for r in df.collect()}


def test_audits_follow_changes(spark):
    """Exactly the documents that cite a changed item are audited again; all scores are those of a whole audit."""
    docs = _docs(spark)
    tables = "citation string, replacement string"
    before, after = spark.createDataFrame([("IS 800", "IS 801"), ("IS 9000", None)], tables), spark.createDataFrame([("IS 4984", "IS 1"), ("IS 800", "IS 801"), ("IS 9000", None)], tables)
    scores = audit.scores(docs, audit.findings(docs, before))
    index = incremental.citation_index(docs)
    new, ids = incremental.audited_again(docs, index, scores, (before, after))
    assert {r.doc_id for r in ids.collect()} == {4, 6} and _all(new) == _all(audit.scores(docs, audit.findings(docs, after))) != _all(scores)
    same, none = incremental.audited_again(docs, index, scores, (before, before))
    assert none.isEmpty() and _all(same) == _all(scores)
    orders = spark.createDataFrame([("IS 800", "Order of steel")], "citation string, order_name string")
    more, ids = incremental.audited_again(docs, index, scores, (before, before), (None, orders))
    assert {r.doc_id for r in ids.collect()} == {2, 6} and _all(more) == _all(audit.scores(docs, audit.findings(docs, before, orders))) != _all(scores)
    gone, ids = incremental.audited_again(docs, index, more, (before, before.where("replacement is not null")), (orders, None))
    assert {r.doc_id for r in ids.collect()} == {2, 6, 7} and _all(gone) == _all(audit.scores(docs, audit.findings(docs, before.where("replacement is not null"))))


def test_arrivals_see_changes(spark, tmp_path):
    """A table that is read for every batch, orders, and the index that batches leave."""
    docs, versions = _docs(spark), [[], [("IS 4984", None)]]
    orders = spark.createDataFrame([("IS 800", "Order of steel")], "citation string, order_name string")
    for number, half in enumerate((docs.where("doc_id <= 4"), docs.where("doc_id > 4"))):
        half.coalesce(1).write.parquet(str(tmp_path / "in" / f"{number}"))
        stream = incremental.arriving(spark, str(tmp_path / "in" / "*"), docs.schema)
        now = lambda s, rows=versions[number]: s.createDataFrame(rows, "citation string, replacement string")
        incremental.audit_arrivals(stream, now, str(tmp_path / "scores"), str(tmp_path / "c"), orders, str(tmp_path / "index")).awaitTermination()
    got = {r.doc_id: r.score for r in spark.read.parquet(str(tmp_path / "scores")).collect()}
    old = {r.doc_id: r.score for r in audit.scores(docs, audit.findings(docs, versions and spark.createDataFrame([], "citation string"), orders)).collect()}
    new = {r.doc_id: r.score for r in audit.scores(docs, audit.findings(docs, spark.createDataFrame([("IS 4984",)], "citation string"), orders)).collect()}
    assert got == {d: (old if d <= 4 else new)[d] for d in old} and old[6] != new[6]
    assert _all(spark.read.parquet(str(tmp_path / "index")).select("base", "doc_id")) == _all(incremental.citation_index(docs).select("base", "doc_id"))
    assert incremental.changed(None, None) is None and incremental.changed(orders, orders.select(F.col("citation"), F.col("order_name"))).isEmpty()
