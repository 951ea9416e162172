"""Rules that weigh a candidate item by what a query's slots ask for.

A rule is a small tree: any of its slot conditions, and any of its parts of an item's
id or words of its text, and none of the id parts of `unless`.  Rules are compiled to
one array column and evaluated on (query, candidate) rows only, never on all pairs.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .retrieval import small


class Rule(NamedTuple):
    """when: pairs of a slot and its values; no values mean any (for a flag: that it is set)."""

    rule_id: str
    when: tuple[tuple[str, tuple[str, ...]], ...]
    items: tuple[str, ...]
    words: tuple[str, ...]
    unless: tuple[str, ...]
    weight: float
    clause: str
    reason: str


FLAGS = ("requires_crs", "requires_ductility")
_LARGE = ("infrastructure", ("bridge", "high_rise"))

# Parts of ids, slots, weights and clauses.
RULES = [
    Rule("corrosion_resistant_steel", (("requires_crs", ()),), ("IS_1786",), (), (), 0.35, "IS 1786:2008 Cl. 4.2 & IS 456:2000 Cl. 8.2.2", "coastal or severe exposure"),
    Rule("ductile_bars", (("requires_ductility", ()),), ("IS_1786",), (), (), 0.30, "IS 13920:2016 Cl. 5.1 & IS 1786:2008 Table 3", "high elongation where earthquakes or heights are"),
    Rule("ductile_detailing", (("requires_ductility", ()),), ("IS_13920",), (), (), 0.40, "IS 13920:2016 Cl. 1.1", "code that goes with earthquake resistance"),
    Rule("critical_structures", (("seismic", ("zone iv", "zone v")), _LARGE), ("IS_13920",), (), (), 0.25, "IS 13920:2016 Cl. 1.1.1 & IRC:112", "bridges, high-rises and high seismic zones"),
    Rule("durable_concrete", (("exposure", ()), _LARGE), ("IS_456",), (), (), 0.25, "IS 456:2000 Table 16", "cover and cement content by exposure"),
    Rule("drinking_water_pipe", (("infrastructure", ("water_supply",)),), ("IS_4984", "IS_8329"), (), (), 0.40, "IS 4984:2016 Cl. 4.1 / IS 8329:2000 Cl. 3.2", "pipes for drinking water"),
    Rule("not_for_drinking_water", (("infrastructure", ("water_supply",)),), ("IS_458",), ("sewer",), ("IS_4984", "IS_8329"), -0.50, "IS 458:2021 Scope", "sewer pipes aren't for drinking water"),
    Rule("sewer_pipe", (("infrastructure", ("sewerage_drainage",)),), ("IS_458", "IS_14333"), (), (), 0.40, "IS 458:2021 / IS 14333:1996", "pipes without pressure"),
    Rule("not_for_sewers", (("infrastructure", ("sewerage_drainage",)),), (), ("potable",), ("IS_458", "IS_14333"), -0.30, "", "drinking-water pipes aren't for sewers"),
    Rule("high_tensile_sections", (_LARGE,), ("IS_2062",), (), (), 0.25, "IS 2062:2011 Table 1 (Grade E350 / E410)", "bridges and high-rises"),
]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _asks(r: Rule) -> Column:
    """Whether the slots of a row ask for what the rule weighs."""
    asked = _any([F.col(s) if s in FLAGS else F.col(s).isin(*values) if values else F.col(s).isNotNull() for s, values in r.when])
    return F.coalesce(asked, F.lit(False))


def _meets(r: Rule, item_id: Column, text: Column) -> Column:
    up, low = F.upper(item_id), F.lower(F.coalesce(text, F.lit("")))
    met = _any([*(F.contains(up, F.lit(i)) for i in r.items), *(F.contains(low, F.lit(w)) for w in r.words)])
    return F.coalesce(met, F.lit(False)) & ~F.coalesce(_any([F.contains(up, F.lit(i)) for i in r.unless]), F.lit(False))


def applied(rules: list[Rule], item_id: Column, text: Column) -> Column:
    """array<struct<rule_id, weight, clause, reason>> of the rules that hold, in their order, on rows with slots."""
    one = lambda r: F.struct(*(F.lit(v).alias(k) for k, v in (("rule_id", r.rule_id), ("weight", float(r.weight)), ("clause", r.clause), ("reason", r.reason))))
    return F.array_compact(F.array(*(F.when(_asks(r) & _meets(r, item_id, text), one(r)) for r in rules)))


def _names(rules: list[Rule]) -> list[str]:
    return sorted({s for r in rules for s, _ in r.when})


def concerned(slotted: DataFrame, *kept: str, rules: list[Rule] = RULES) -> DataFrame:
    """What is kept, and the rules' slots, of the queries that ask for what any rule weighs; for the others none can hold.

    A filter isn't moved behind a generator, so a text's slots are worked out once.
    """
    rows = slotted.select(F.inline_outer(F.array(F.struct(*kept, *_names(rules)))))
    return rows.where(_any([_asks(r) for r in rules]))


def evaluated(pairs: DataFrame, slotted: DataFrame, items: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """qid, doc_id, bonus, applied of the pairs (qid, doc_id) that any rule holds for.

    slotted: qid and its slots; items: doc_id, item_id, scope_text.  Pairs of which
    either side isn't known are left out.
    """
    rows = pairs.select("qid", "doc_id").join(small(slotted.select("qid", *_names(rules))), "qid").join(small(items.select("doc_id", "item_id", "scope_text")), "doc_id")
    return _weighed(rows, rules)


def evaluated_alike(found: DataFrame, members: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The same from what queries that are alike have found: found (key, doc_id, item_id, scope_text), members (qid, key, slots).

    An item that meets no rule is left out before it is dealt to the queries.
    """
    rows = found.where(_any([_meets(r, F.col("item_id"), F.col("scope_text")) for r in rules]))
    return _weighed(members.select("qid", "key", *_names(rules)).join(small(written(rows)), "key"), rules)


def _weighed(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    rows = rows.select("qid", "doc_id", applied(rules, F.col("item_id"), F.col("scope_text")).alias("applied")).where(F.size("applied") > 0)
    total = F.round(F.aggregate("applied", F.lit(0.0), lambda s, r: s + r["weight"]), 6)
    return rows.select("qid", "doc_id", total.alias("bonus"), "applied")
