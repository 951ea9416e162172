"""Numbers of any length in rows of tables."""

from __future__ import annotations

from sextant.operators import documents

TEXT = "1 SCOPE\nbolts\n2 NORMATIVE REFERENCES\nIS No. Title\n120007:2005 Tensile testing\n1234567 Terms\n1989\n3 TERMINOLOGY\nnone"


def test_long_numbers_make_edges(spark):
    docs = spark.createDataFrame([("IS 10", TEXT)], "item_no string, text string")
    edges = {(r.target, r.relationship, r.clause, r.description) for r in documents.line_edges(docs).collect()}
    assert edges == {("IS 120007", "TESTED_BY", "table of references", "Tensile testing"), ("IS 1234567", "NORMATIVE_REF", "table of references", "Terms")}


def test_long_numbers_are_references(spark):
    docs = spark.createDataFrame([("IS 10", TEXT)], "item_no string, text string")
    assert dict(documents.references(docs, "item_no").collect()) == {"IS 10": ["IS 120007:2005", "IS 1234567"]}
