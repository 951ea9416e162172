"""A few rules are tried in the row of a text: no shuffle, one pass over the texts."""

from __future__ import annotations

import pytest

from sextant.functions import text as T
from sextant.operators import matching, rules, slots

TEXTS = [(1, "TMT rebar and cement bags"), (2, "tmt rebars"), (3, None), (4, ""), (5, "a cement bag, tmt rebar")]
RATES = [("b", 2, "tmt rebar"), ("a", 1, "cement bag"), ("n", 0, None), ("c", 2, "tmt rebar"), ("x", 3, r"ba\w+"), ("e", 9, "")]


@pytest.mark.parametrize("few", [64, 0])
def test_few_rules(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW_RULES", few)
    texts, made = spark.createDataFrame(TEXTS, "id int, text string"), spark.createDataFrame(RATES, "rule_id string, ord int, keyword string").where("keyword is null or keyword != ''")
    whole = rules.first_match(texts, made, "id")
    assert dict(map(tuple, whole.collect())) == {1: "b", 2: None, 3: None, 4: None, 5: "a"}
    assert dict(map(tuple, rules.first_match(texts, made, "id", whole_word=False, default="z").collect())) == {1: "a", 2: "b", 3: "z", 4: "z", 5: "a"}
    words = spark.createDataFrame([(2, "cement", "two"), (1, "tmt", "one"), (3, None, "none")], "ord int, pattern string, addition string")
    more = slots.expanded(texts, words, "id")
    assert dict(map(tuple, more.collect())) == {1: "one two", 2: "one", 3: "", 4: "", 5: "one two"}
    for df in (whole, more):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert few == 0 or ("hashpartitioning" not in plan and "Generate" not in plan)


def test_classes_by_words(spark):
    rows = [("Zone V, sea water spray", "zone v"), ("zone vi", None), ("low seismic", "zone ii"), (None, None), ("severe", None)]
    got = spark.createDataFrame(rows, "text string, want string").selectExpr("lower(text) as low", "want")
    assert all(r.got == r.want for r in got.select(T.first_class(got.low, slots.SEISMIC).alias("got"), "want").collect())
