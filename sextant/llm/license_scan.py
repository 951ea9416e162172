"""Licence scan by ordered signature rules, in Spark expressions only.

A text is normalised to words.  The keyword prefilter has two steps: texts without
any trigger (a few dozen short strings) get no further; in the others, every place
where a keyword's first word stands is a candidate, and the rules whose whole
keyword stands there are matched against the next LONGEST words.  Nothing is shuffled: each text
is scanned where it was read, and the rules are a literal of the plan.

Of the detections that begin at one word, the best stays: smallest rank, then
longest, then first in the order of the rules.  Of detections that overlap, one
goes if another has a smaller rank, or has the same rank and contains it.  Since
at most one begins at a word and none is longer than LONGEST words, only LONGEST
neighbours on either side are looked at.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import LONGEST, RULES, WEIGHTS, Rule, rules

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What parts words: every ASCII character but letters and digits (with A-Z already lower).
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_WEIGHT = 0.8


def normalised(text: Column) -> Column:
    """The words of a text, joined by one space; A-Z lower, no other character changed, null as empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), _BETWEEN, " "))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where a lambda inside uses it for each element and the optimizer moves the expression into a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _gate(norm: Column, triggers: set[str]) -> Column:
    """Whether a text holds any trigger; one that has another inside needn't be asked for."""
    least = sorted(t for t in triggers if not any(t != other and other in t for other in triggers))
    return reduce(lambda a, b: a | b, (F.contains(norm, F.lit(t)) for t in least))


def _by_word(signatures: list[Rule]) -> Column:
    """The rules as a map from a keyword's first word, a constant of the plan."""
    words: dict[str, list[dict]] = {}
    for r in signatures:
        words.setdefault(r.keyword.split(" ")[0], []).append({"rule": r.order, "rank": r.rank, "label": r.label, "keyword": f"{r.keyword} ", "regex": f"^(?:{r.regex})(?= |$)"})
    return F.from_json(F.lit(json.dumps(words)), "map<string,array<struct<rule:int,rank:int,label:string,keyword:string,regex:string>>>")


def scan(docs: DataFrame, base: dict[str, str], signatures: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base_places (start, label), detections (start, end, rank, label, rule); words count from 0, end is behind the last.

    base names phrases and their labels: all their places are given, none is
    suppressed.  No base phrase may begin with another's words.  Both arrays
    ascend by start.  A null text counts as empty and has no word; a row is a
    row, whatever its id (null ids and repeated rows too); an empty table gives
    an empty result; other columns aren't read.
    """
    plain = rules("\n".join(f"0 {label} {phrase}" for phrase, label in base.items())) if base else []
    both = [*plain, *signatures]
    first_words = sorted({r.keyword.split(" ")[0] for r in both})
    def read(n: Column) -> Column:
        count = F.when(n == "", F.lit(0)).otherwise(F.length(n) - F.length(F.replace(n, F.lit(" "))) + 1).cast("long")
        gated = F.when(_gate(n, {r.trigger for r in both}), F.split(n, " ")).otherwise(F.array().cast("array<string>"))
        return F.struct(count.alias("n_words"), gated.alias("words"))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _let(normalised(F.col(text_col)), read).alias("text"))

    def ahead(words: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.get(words, i).isin(first_words))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.get(words, i).alias("word"), F.array_join(F.slice(words, i + 1, LONGEST), " ").alias("ahead")))

    def matches(place: Column) -> Column:
        def one(r: Column) -> Column:
            found = F.when(F.startswith(F.concat(place["ahead"], F.lit(" ")), r["keyword"]), F.call_function("regexp_extract", place["ahead"], r["regex"], F.lit(0))).otherwise(F.lit(""))
            return F.struct(r["rank"].alias("rank"), (-F.length(found)).alias("short"), r["rule"].alias("rule"), r["label"].alias("label"), (F.size(F.split(found, " "))).alias("n"))

        return F.filter(F.transform(F.element_at(_by_word(both), place["word"]), one), lambda m: m["short"] < 0)

    found = F.filter(F.transform(_let(F.col("text.words"), ahead), lambda p: F.struct(p["at"].alias("start"), matches(p).alias("m"))), lambda x: F.size(x["m"]) > 0)
    rows = rows.select("doc_id", "text.n_words", found.alias("found"))
    places = F.flatten(F.transform("found", lambda x: F.transform(F.filter(x["m"], lambda m: m["rank"] == 0), lambda m: F.struct(x["start"].cast("long").alias("start"), m["label"].alias("label")))))
    best = F.filter(F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.array_min(F.filter(x["m"], lambda m: m["rank"] > 0)).alias("m"))), lambda x: x["m"].isNotNull())
    spans = F.transform(best, lambda x: F.struct(x["start"].cast("long").alias("start"), (x["start"] + x["m"]["n"]).cast("long").alias("end"), x["m"]["rank"].alias("rank"), x["m"]["label"].alias("label"), x["m"]["rule"].alias("rule")))
    rows = rows.select("doc_id", "n_words", places.alias("base_places"), spans.alias("spans"))

    def stays(spans: Column, d: Column, k: Column) -> Column:
        near = F.slice(spans, F.greatest(k + 1 - LONGEST, F.lit(1)), 2 * LONGEST)
        return ~F.exists(near, lambda e: (e["start"] < d["end"]) & (d["start"] < e["end"]) & ((e["rank"] < d["rank"]) | ((e["rank"] == d["rank"]) & (e["start"] != d["start"]) & (e["start"] <= d["start"]) & (e["end"] >= d["end"]))))

    kept = _let(F.col("spans"), lambda spans: F.filter(spans, lambda d, k: stays(spans, d, k)))
    return rows.select("doc_id", "n_words", "base_places", kept.alias("detections"))


def labels(scanned: DataFrame) -> DataFrame:
    """What `scan` found, as one row a document: n_base, first_word, last_word, base_labels, labels, score.

    base_labels and labels are distinct, sorted and joined by commas, empty where
    there are none; score is the weight of the surest detection, 0 without any.
    """
    start = F.transform("base_places", lambda p: p["start"])
    by_base, by_rule = (F.transform(c, lambda p: p["label"]) for c in ("base_places", "detections"))
    weights = F.transform("detections", lambda d: F.element_at(F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair)), d["rank"]))
    return scanned.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(by_base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(by_base, by_rule)), ",").alias("labels"),
        F.greatest(F.when(F.size("base_places") > 0, F.lit(BASE_WEIGHT)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(weights), F.lit(0.0))).alias("score"),
    )
