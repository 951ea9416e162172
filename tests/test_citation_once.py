"""What a citation says is worked out once: its patterns are few in the plan, and rows are as before."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import builders


def test_citation_key(spark):
    said = [("", ""), (None, ""), ("  ", ""), ("12", "IS 12"), ("IS 12.", "IS 12"), ("is 12", "IS is 12"), ("ISO 9 Part 2", "ISO 9 (Part 2)"), ("I", "IS I"), ("a\nb", "IS a b"), (" ", "IS  ")]
    rows = spark.createDataFrame(said, "raw string, want string").select("raw", "want", T.citation_key(F.col("raw")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_scope_edges(spark):
    docs = spark.createDataFrame([("a", "IS 1:1990", "IS 1:2000 IS 2 (Part 1) tensile IS 2 Part 1:1999"), ("b", None, "IS 1 and IS 3"), ("c", "IS 3", None)], "item_id string, item_no string, text string")
    catalog = spark.createDataFrame([("a", "IS 1:1990", 1990), ("d", "IS 2 (Part 1)", 2000), ("c", "IS 3", 5)], "item_id string, item_no string, year int")
    edges = builders.scope_edges(docs, catalog)
    assert sorted((r.source, r.target, r.relationship) for r in edges.collect()) == [("a", "d", "TESTED_BY"), ("b", "a", "NORMATIVE_REF"), ("b", "c", "NORMATIVE_REF")]
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 30
