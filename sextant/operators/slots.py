"""Slots of a query, rule bonuses, expansion by vocabularies, ambiguity."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_class, first_found, keywords, tokens
from ..sources.scratch import small_side
from .matching import MOST_RULES, contained, held

# Keywords of each slot, in order of precedence.
EXPOSURE = [
    ("extreme", ["extreme", "tidal zone", "direct sea water spray", "abrasive chemical"]),
    ("very severe", ["very severe", "sea water spray", "corrosive fumes", "freezing saline"]),
    ("severe", ["severe", "coastal", "marine", "submerged in sea water", "aggressive soil"]),
    ("moderate", ["moderate", "sheltered from rain", "submerged in fresh water"]),
    ("mild", ["mild", "indoor", "non-aggressive", "normal atmosphere"]),
]
SEISMIC = [
    ("zone v", ["zone v", "zone 5", "high seismic", "highest earthquake", "severe seismic zone"]),
    ("zone iv", ["zone iv", "zone 4", "seismic zone 4", "earthquake prone"]),
    ("zone iii", ["zone iii", "zone 3", "moderate seismic"]),
    ("zone ii", ["zone ii", "zone 2", "low seismic"]),
]
CORROSION = [
    ("marine_coastal", ["coastal", "marine", "sea shore", "near ocean", "saline soil", "saline water", "creek"]),
    ("industrial_chemical", ["chemical plant", "acidic", "effluent", "corrosive fumes", "fertilizer plant"]),
    ("normal", ["inland", "dry", "normal atmosphere"]),
]
INFRASTRUCTURE = [
    ("bridge", ["bridge", "flyover", "viaduct", "metro pier", "culvert"]),
    ("marine_structure", ["jetty", "port", "harbour", "wharf", "quay"]),
    ("high_rise", ["high rise", "tall building", "multi-storey", "commercial tower"]),
    ("water_supply", ["potable water", "drinking water", "water transmission", "water mains", "water distribution"]),
    ("sewerage_drainage", ["sewer", "drainage", "storm water", "effluent drain", "sewage"]),
    ("electrical_substation", ["substation", "transmission line", "switchyard", "distribution grid"]),
    ("dam_hydraulic", ["dam", "barrage", "canal", "spillway", "hydroelectric"]),
]
GRADES = [("Fe 500D", ["500d"]), ("Fe 550D", ["550d"]), ("Fe 415D", ["fe 415d"]), ("E250", ["e250"]), ("E350", ["e350"]), ("PE 100", ["pe 100"]), ("PE 80", ["pe 80"])]
ENTROPY_LIMIT, ENTROPY_TOP = 2.1, 5


_KINDS = {"exposure": EXPOSURE, "seismic": SEISMIC, "corrosion": CORROSION, "infrastructure": INFRASTRUCTURE}
_KEYWORDS = list(dict.fromkeys(w for kind in _KINDS.values() for _, own in kind for w in own))


def read_in_pieces(texts: DataFrame, joint: str, recurring: list[str], needless: Callable[[list[str]], set[str]] | None = None) -> DataFrame:
    """texts with words (their search tokens) and found (the keywords of slots in them), read between joints, which hold a semicolon.

    No token and no keyword holds a semicolon or is another one beside it, so a
    text's are those of its pieces.  Pieces that recur are read once, others where
    they stand; which ones are given as recurring doesn't change a row.  `needless`
    tells of their words those that aren't needed; they are null there, in their place.
    """
    if ";" not in joint:
        raise ValueError("pieces must be joined by a semicolon")
    read = lambda t: F.struct(tokens(t).alias("words"), keywords(F.lower(t), _KEYWORDS).alias("found"))
    once = texts.sparkSession.createDataFrame([(p,) for p in recurring], "piece string").distinct().select("piece", read(F.col("piece")).alias("r")).collect() if recurring else []
    blank = needless(sorted({w for _, r in once for w in r.words})) if once and needless else set()
    strings = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    known = F.create_map(*(x for p, r in once for x in (F.lit(p), F.struct(strings(None if w in blank else w for w in r.words).alias("words"), strings(r.found).alias("found")))))
    pieces = F.split(F.coalesce("text", F.lit("")), re.escape(joint))
    each = F.transform(pieces, (lambda p: F.coalesce(F.element_at(known, p), read(p))) if once else read)
    rows = texts.withColumn("__read", each)
    return rows.withColumns({"words": F.flatten("__read.words"), "found": F.flatten("__read.found")}).drop("__read")


def slots(texts: DataFrame, found: str | None = None) -> DataFrame:
    """Adds exposure, seismic, corrosion, infrastructure, pressure, grade and what follows from them; found names a column as from `read_in_pieces`."""
    low = F.lower("text")
    pressure = F.upper(F.nullif(F.regexp_extract(low, r"\b(?:working pressure\s*)?(\d+\s*(?:bar|kg/cm2|mpa)|pn\s*\d+)\b", 1), F.lit("")))
    out = texts.withColumn("__found", F.col(found) if found else keywords(low, _KEYWORDS)).withColumns({
        **{c: F.when(F.size("__found") > 0, first_found(F.col("__found"), kind, _KEYWORDS)) for c, kind in _KINDS.items()},
        "pressure": F.coalesce(pressure, F.when(low.contains("gravity") | low.contains("non-pressure"), "NON-PRESSURE / GRAVITY")), "grade": first_class(low, GRADES, whole=False),
    }).drop("__found")
    true = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumn("requires_crs", true(F.col("corrosion") == "marine_coastal") | true(F.col("exposure").isin("severe", "very severe", "extreme")))
    out = out.withColumn("requires_ductility", true(F.col("seismic").isin("zone iv", "zone v")) | true(F.col("infrastructure").isin("bridge", "high_rise")))
    return out.withColumn("special", F.coalesce("exposure", "seismic", "corrosion", "infrastructure").isNotNull() | F.col("requires_crs") | F.col("requires_ductility"))


def rule_bonus(slotted: DataFrame, rules: DataFrame, id_col: str = "qid") -> DataFrame:
    """Bonus of each (query, item) under rules (rule_id, item, slot, value, weight): a rule holds when the query's slot has its value."""
    long = slotted.select(id_col, F.explode(F.create_map(*(x for s in ("exposure", "seismic", "corrosion", "infrastructure", "grade") for x in (F.lit(s), F.col(s))))).alias("slot", "value")).where("value is not null")
    return long.join(small_side(rules, MOST_RULES), ["slot", "value"]).groupBy(id_col, "item").agg(F.round(F.sum("weight"), 6).alias("bonus"), F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"))


def expanded(texts: DataFrame, vocabulary: DataFrame, id_col: str = "qid") -> DataFrame:
    """id_col, expansion: the additions of all vocabulary rows (ord, pattern, addition) whose pattern the text holds, in their order."""
    joined = lambda found: F.array_join(F.transform(F.sort_array(found), lambda h: h["addition"]), " ")
    rows = held(texts, vocabulary, F.lower("text"), lambda t, r: F.contains(t, r["pattern"]))
    if rows is not None:
        return rows.select(id_col, joined(F.transform("held", lambda r: F.struct(r["ord"].alias("ord"), r["addition"].alias("addition")))).alias("expansion"))
    hits = contained(texts, vocabulary, id_col, F.lower("text"), "pattern")
    hits = hits.groupBy(id_col).agg(joined(F.collect_list(F.struct("ord", "addition"))).alias("expansion"))
    return texts.select(id_col).join(hits, id_col, "left").select(id_col, F.coalesce("expansion", F.lit("")).alias("expansion"))


def ambiguity(ranked: DataFrame) -> DataFrame:
    """qid, candidates, entropy (bits) of the top scores' shares, and whether it is over the limit; from three candidates on."""
    top = ranked.where(F.col("rank") <= ENTROPY_TOP)
    sums = top.groupBy("qid").agg(F.collect_list("score").alias("s"), F.sum("score").alias("total"), F.count(F.lit(1)).alias("candidates")).where("candidates >= 3")
    bits = F.aggregate("s", F.lit(0.0), lambda acc, x: acc - (x / F.col("total")) * F.log2(x / F.col("total")))
    return sums.select("qid", "candidates", F.round(bits, 4).alias("entropy"), (F.round(bits, 4) > ENTROPY_LIMIT).alias("ambiguous"))
