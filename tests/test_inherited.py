"""Governing orders are worked out once, and bring their number along."""

from __future__ import annotations

import datetime

from sextant.operators import orders


def test_inherited(spark):
    rows = [(f"O{n}", n, item, f"n{n}", raw) for n, item, raw in ((1, "a", "1990-01-01"), (2, "a", "1995-01-01"), (3, "b", "rescinded"), (4, "b", "2005-01-01"))]
    table = spark.createDataFrame(rows, "order_id string, order_no int, item_id string, order_name string, effective_raw string")
    asked = spark.createDataFrame([(i, datetime.date(2000, 1, 1)) for i in "ab"], "item_id string, evaluation_date date")
    best = orders.governing_asof(table, asked, numbered=True)
    assert sorted((r.item_id, r.order_id, r.order_no) for r in best.collect()) == [("a", "O2", 2), ("b", "O4", 4)]
    assert "order_no" not in orders.governing_asof(table, asked).columns
    items, ends = spark.createDataFrame([("a",), ("c",)], "item_id string"), spark.createDataFrame([("c", "b")], "node string, end string")
    out = orders.inherited(items, best.select("item_id", "order_id"), ends)
    assert sorted((r.item_id, r.order_id, r.via) for r in out.collect()) == [("a", "O2", None), ("c", "O4", "b")]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
