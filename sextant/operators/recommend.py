"""From queries to recommendations: what a query cites, what it is rewritten to, what rules add, and the verdict on every query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import band, bounded_score
from ..sources.scratch import small_side, written
from . import constraints, ranking, slots
from .graph import resolved
from .matching import MOST_RULES, literal, matched
from .ranking import CITED, OBSOLETE
from .retrieval import Index, index, small, top_k
from .rules import provenance

# Limits of a broad term, and what a replacement and a nudge score.
BROAD_TOKENS, PROMOTED, NUDGE, NUDGE_BELOW = 3, 0.99, 0.05, 0.25


def cited_items(queries: DataFrame, alias: DataFrame) -> DataFrame:
    """qid, raw (the first citation in the text; null without one), cited (its item; null where no item is known)."""
    raw = F.nullif(F.regexp_extract("text", CITED, 1), F.lit(""))
    rows = queries.select("qid", raw.alias("raw"))
    found = resolved(rows.where("raw is not null"), alias)
    return rows.where("raw is null").withColumn("item_id", F.lit(None).cast("string")).unionByName(found).withColumnRenamed("item_id", "cited")


def supersession(queries: DataFrame, catalog: DataFrame, alias: DataFrame, edges: DataFrame, branches: DataFrame, chain: DataFrame) -> DataFrame:
    """qid, raw, cited, code, replacement, alternatives (how many successors are left open) of every query.

    catalog: item_id, status.  edges: SUPERSEDES edges, from newer to older.
    branches (item_id, keyword, replacement): words of a query that choose one
    of several successors; they hold when they name one only.  chain: node, end.

    NO_CITATION, UNINDEXED_CITATION (no such item), ACTIVE_STANDARD, and for
    obsolete items or such that an edge leads to: CONTEXTUAL_BRANCH_SELECTED,
    AMBIGUOUS_BRANCHING, RESOLVED by the only edge, else by the chain's end, which
    may be missing.
    """
    told = cited_items(queries, alias)
    successors = edges.where("relationship = 'SUPERSEDES'").join(catalog.select(F.col("item_id").alias("source")), "source", "left_semi").groupBy(F.col("target").alias("cited")).agg(F.count_distinct("source").alias("ways"), F.min("source").alias("only"))
    open_items = branches.groupBy(F.col("item_id").alias("cited")).agg(F.count_distinct("replacement").alias("branches"))
    low = queries.select("qid", F.lower("text").alias("low"))
    chosen = told.join(low, "qid").join(small_side(branches.withColumnRenamed("item_id", "cited"), MOST_RULES), "cited").where(F.contains("low", F.col("keyword")))
    chosen = chosen.groupBy("qid").agg(F.count_distinct("replacement").alias("named"), F.min("replacement").alias("branch"))
    rows = told.join(catalog.select(F.col("item_id").alias("cited"), "status"), "cited", "left").join(successors, "cited", "left").join(small(open_items), "cited", "left").join(chosen, "qid", "left")
    rows = rows.join(chain.select(F.col("node").alias("cited"), F.col("end").alias("last")), "cited", "left")
    obsolete = F.coalesce(F.col("status").isin(*OBSOLETE), F.lit(False)) | F.col("ways").isNotNull()
    branching = F.col("branches").isNotNull()
    code = (
        F.when(F.col("raw").isNull(), "NO_CITATION").when(F.col("cited").isNull(), "UNINDEXED_CITATION").when(~obsolete, "ACTIVE_STANDARD")
        .when(branching & (F.col("named") == 1), "CONTEXTUAL_BRANCH_SELECTED").when(branching | (F.col("ways") > 1), "AMBIGUOUS_BRANCHING").otherwise("RESOLVED")
    )
    rows = rows.withColumn("code", code)
    to = F.when(F.col("code") == "ACTIVE_STANDARD", F.col("cited")).when(F.col("code") == "CONTEXTUAL_BRANCH_SELECTED", F.col("branch")).when(F.col("code") == "RESOLVED", F.coalesce("only", "last"))
    left = F.when(F.col("code") == "AMBIGUOUS_BRANCHING", F.coalesce("branches", "ways")).when(F.col("code") == "CONTEXTUAL_BRANCH_SELECTED", F.col("branches") - 1).otherwise(0)
    return rows.select("qid", "raw", "cited", "code", to.alias("replacement"), left.cast("long").alias("alternatives"))


def replacement_options(told: DataFrame, edges: DataFrame, branches: DataFrame, chain: DataFrame) -> DataFrame:
    """qid, code, options of every query of `supersession`: what its citation may be replaced by.

    An option is a struct: item_id, chosen (the replacement), level, keyword and
    description.  Options are the branches of an item (level CURATED, with the
    words that choose them), the sources of its SUPERSEDES edges (source, target,
    description: CHRONOLOGICAL_INFERRED or CURATED_UNVERIFIED by what the edge says
    of itself), and, where there are neither, the end of its chain (CHAIN_END); of
    one item, the first of these.  Options go by item; queries that ask for no
    replacement have an empty array.
    """
    none = F.lit(None).cast("string")
    option = lambda item, kind, level, keyword, text: F.struct(item.alias("item_id"), F.lit(kind).alias("kind"), level.alias("level"), keyword.alias("keyword"), text.alias("description")).alias("o")
    open_told = told.where(F.col("code").isin("RESOLVED", "AMBIGUOUS_BRANCHING", "CONTEXTUAL_BRANCH_SELECTED")).select("qid", "cited", "replacement")
    items = open_told.select("cited").distinct()
    by_branch = branches.select(F.col("item_id").alias("cited"), option(F.col("replacement"), 0, F.lit("CURATED"), F.col("keyword"), none))
    newer = edges.where("relationship = 'SUPERSEDES'").select(F.col("target").alias("cited"), option(F.col("source"), 1, provenance(F.coalesce("description", F.lit(""))), none, F.col("description")))
    known = written(by_branch.unionByName(newer).join(items, "cited", "left_semi"))
    ends = chain.join(items, F.col("node") == F.col("cited"), "left_semi").join(known, F.col("node") == F.col("cited"), "left_anti").where("end != node")
    last = ends.select(F.col("node").alias("cited"), option(F.col("end"), 2, F.lit("CHAIN_END"), none, none))
    each = known.unionByName(last).groupBy("cited", "o.item_id").agg(F.min("o").alias("o"))
    rows = open_told.join(each.select("cited", "o"), "cited")
    found = rows.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("o.item_id", F.coalesce(F.col("o.item_id") == F.col("replacement"), F.lit(False)).alias("chosen"), "o.level", "o.keyword", "o.description"))).alias("options"))
    out = told.select("qid", "code").join(found, "qid", "left")
    return out.select("qid", "code", F.coalesce("options", F.array().cast(found.schema["options"].dataType)).alias("options"))


def idioms(texts: DataFrame, rules: DataFrame, id_col: str = "qid") -> DataFrame:
    """id_col, expansion: additions of all rules (ord, pattern, addition) whose pattern the text matches, in their order; empty without one.

    Rules may have `needs`, a phrase in small letters that all matches of theirs
    hold; those that have it are looked at only where it stands.
    """
    needs = F.coalesce("needs", literal(F.col("pattern"))) if "needs" in rules.columns else literal(F.col("pattern"))
    hits = matched(texts, rules, id_col, F.lower("text"), needs, F.regexp_like("low", F.col("pattern")))
    hits = hits.groupBy(id_col).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "addition"))), lambda h: h["addition"]), " ").alias("expansion"))
    return texts.select(id_col).join(hits, id_col, "left").select(id_col, F.coalesce("expansion", F.lit("")).alias("expansion"))


def rewritten(queries: DataFrame, told: DataFrame, vocabulary: DataFrame, patterns: DataFrame, numbers: DataFrame) -> DataFrame:
    """qid, text, raw_text: each query with what vocabulary and idioms add, behind the number (item_id, item_no) of an obsolete citation's replacement.

    A query without any text keeps its own.
    """
    words, phrases = slots.expanded(queries, vocabulary).withColumnRenamed("expansion", "words"), idioms(queries, patterns).withColumnRenamed("expansion", "phrases")
    first = told.where(F.col("code").isin("RESOLVED", "CONTEXTUAL_BRANCH_SELECTED")).select("qid", F.col("replacement").alias("item_id")).join(numbers.select("item_id", "item_no"), "item_id").select("qid", F.col("item_no").alias("number"))
    rows = queries.select("qid", "text").join(words, "qid").join(phrases, "qid").join(first, "qid", "left")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select("qid", F.coalesce(blank(F.concat_ws(" ", *(blank(F.col(c)) for c in ("number", "text", "words", "phrases")))), F.lit("")).alias("text"), F.col("text").alias("raw_text"))


def broad(queries: DataFrame, domains: DataFrame) -> DataFrame:
    """qid, domain, options: for queries of three words at most, the first domain (ord, word, option_ord, option) that a word of theirs holds, and its options."""
    short = queries.withColumn("words", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).where((F.size("words") <= BROAD_TOKENS) & (F.size("words") > 0)).select("qid", "words")
    hits = short.join(small_side(domains.select("ord", "word").distinct(), MOST_RULES), F.expr("exists(words, w -> contains(w, word))")).groupBy("qid").agg(F.min_by("word", F.struct("ord", "word")).alias("domain"))
    options = domains.groupBy(F.col("word").alias("domain")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("option_ord", "option"))), lambda o: o["option"]), " | ").alias("options"))
    return hits.join(small(options), "domain").select("qid", "domain", "options")


def contrasted(ranked: DataFrame, queries: DataFrame, grades: DataFrame, negatives: DataFrame, slot_rules: DataFrame, slotted: DataFrame | None = None) -> DataFrame:
    """ranked (qid, doc_id, item_id, score, mandatory) with scores moved by rules, ranked anew, with label and sure.

    grades (grade, item, weight): a query that holds the grade, for each of its
    items once.  negatives (kind, ord, words array, item, weight): of each kind
    the first rule whose words a query holds any of, and whose item it is.
    slot_rules (slot, item, weight): flags of the query.  An item that an order
    makes mandatory is moved up where its score is low and the query holds a grade
    or has a slot.  Items are named by a part of their id.
    """
    low = queries.select("qid", F.lower("text").alias("low"))
    rows = ranked.join(small(low), "qid").withColumn("up", F.upper("item_id"))
    key = ["qid", "doc_id"]
    hit = F.contains("low", F.col("grade")) & F.contains("up", F.col("item"))
    by_grade = rows.join(small_side(grades, MOST_RULES), hit).groupBy(*key, "grade", "weight").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.sum("weight").alias("by_grade"))
    said = F.exists("words", lambda w: F.contains(F.col("low"), w)) & F.contains("up", F.col("item"))
    by_word = rows.join(small_side(negatives, MOST_RULES), said).groupBy(*key, "kind").agg(F.min_by("weight", "ord").alias("weight")).groupBy(*key).agg(F.sum("weight").alias("by_word"))
    out = rows.join(by_grade, key, "left").join(by_word, key, "left")
    graded = low.join(small_side(grades.select("grade").distinct(), MOST_RULES), F.contains("low", F.col("grade"))).select("qid").distinct().withColumn("graded", F.lit(True))
    out = out.join(graded, "qid", "left")
    if slotted is not None:
        flags = slotted.select("qid", F.col("special"), F.inline(F.array(*(F.struct(F.lit(c).alias("slot"), F.col(c).alias("on")) for c in ("requires_crs", "requires_ductility")))))
        by_slot = rows.join(flags.where("on").select("qid", "slot"), "qid").join(small_side(slot_rules, MOST_RULES), "slot").where(F.contains("up", F.col("item"))).groupBy(*key).agg(F.sum("weight").alias("by_slot"))
        out = out.join(by_slot, key, "left").join(slotted.select("qid", "special"), "qid", "left")
    else:
        out = out.withColumns({"by_slot": F.lit(0.0), "special": F.lit(False)})
    none = F.lit(0.0)
    moved = F.col("score") + F.coalesce("by_grade", none) + F.coalesce("by_word", none) + F.coalesce("by_slot", none)
    nudge = F.when(F.coalesce("mandatory", F.lit(False)) & (moved < NUDGE_BELOW) & (F.coalesce("special", F.lit(False)) | F.coalesce("graded", F.lit(False))), NUDGE).otherwise(0.0)
    scored = out.select("qid", "doc_id", "item_id", bounded_score(F.round(moved + nudge, 6)).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).withColumn("label", band(F.col("score"))).withColumn("sure", F.col("score") >= ranking.CONFIDENT)


def historical(queries: DataFrame, catalog: DataFrame, k: int = 10, found: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score, rank, warning: the obsolete ones among each query's 2k best, k at most; `found`: candidates with history, where they are there."""
    found = ranking.candidates(queries, catalog, keep_history=True) if found is None else found
    best = ranking.composite(found, queries, ranking.named(queries, catalog), k=2 * k)
    old = best.select("qid", "doc_id", "score").join(catalog.where(F.col("status").isin(*OBSOLETE)).select("doc_id", "status"), "doc_id")
    return top_k(old, k).select("qid", "doc_id", "score", "rank", F.concat(F.lit("for reference only: "), F.lower("status")).alias("warning"))


def filtered(found: DataFrame, catalog: DataFrame, department: Column | None = None, status: str | None = None) -> DataFrame:
    """Candidates (qid, doc_id) of items with a status, and whose department holds a text (both may be missing); applied behind the cut of candidates."""
    keep = F.lit(True)
    keep = keep if status is None else keep & (F.col("status") == status)
    keep = keep if department is None else keep & F.contains(F.lower("department"), F.lower(department))
    return found.join(catalog.where(keep).select("doc_id"), "doc_id", "left_semi")


def recommended(queries: DataFrame, catalog: DataFrame, told: DataFrame, rewriting: DataFrame, governed: DataFrame | None = None, rules: list[constraints.Rule] | None = None, found: Index | None = None, k: int = 10) -> DataFrame:
    """qid, status, doc_id, score, candidates, order_id, temporal_status, mandatory of every query.

    queries: qid, text and, where orders matter, evaluation_date.  catalog: doc_id,
    item_id, text, item_no, status, keywords, scope_text.  told: as from
    `supersession`; rewriting: as from `rewritten`.  governed: the order that
    governs an item at a date (item_id, evaluation_date, order_id,
    temporal_status, is_mandatory).  rules: weigh candidates by slots.

    Rewritten queries and, where they differ, queries as they were are searched
    together, once, on one index, with history; active, raw and obsolete answers
    are taken from those candidates.  A query whose rewriting finds nothing is
    answered by what it finds itself.  What an obsolete citation names is taken
    out, and its replacement put first.

    NEEDS_CONTEXT where a citation's successor is open; RECOMMENDED or
    NEEDS_CLARIFICATION by the best item's score and grounding; without any,
    NO_ACTIVE_STANDARD_FOUND where obsolete items match, else NO_MATCH.
    """
    # Two questions a query: 2 * number is the rewritten one, the next the one as it was, if it differs.
    plain = rewriting.select("qid", F.explode(F.array(F.struct(F.lit(0).alias("raw"), F.col("text")), F.struct(F.lit(1).alias("raw"), F.col("raw_text").alias("text")))).alias("q"), (F.col("raw_text") != F.col("text")).alias("differs"))
    asked = written(plain.where("q.raw = 0 or differs").select(F.struct("qid", "q.raw").alias("qid"), "q.text", "differs"))
    catalog = written(catalog)
    both = written(ranking.candidates(asked, catalog, keep_history=True, found=found or index(catalog.select("doc_id", "text"))))
    active = both.where(~F.col("status").isin(*OBSOLETE))
    bonus = constraints.evaluated(active, slots.slots(asked), catalog, rules).select("qid", "doc_id", "bonus") if rules else None
    dated = None
    if governed is not None:
        dates = asked.join(queries.select(F.col("qid").alias("own"), "evaluation_date"), F.col("qid.qid") == F.col("own")).select("qid", "evaluation_date")
        governed = written(governed.select("item_id", "evaluation_date", "order_id", "temporal_status", "is_mandatory"))
        dated = active.select("qid", "doc_id", "item_id").join(small(dates), "qid").join(small(governed.where("is_mandatory")), ["item_id", "evaluation_date"], "left_semi").select("qid", "doc_id")
    scored = written(ranking.composite(active, asked, ranking.named(asked, catalog), bonus, dated, k).select(F.col("qid.qid").alias("qid"), F.col("qid.raw").alias("raw"), "doc_id", "score", "grounded"))
    first = scored.join(scored.groupBy("qid").agg(F.min("raw").alias("raw")), ["qid", "raw"]).drop("raw")
    ids = catalog.select("doc_id", "item_id")
    replaced = told.where(F.col("code").isin("RESOLVED", "CONTEXTUAL_BRANCH_SELECTED") & F.col("cited").isNotNull())
    gone = replaced.select("qid", F.col("cited").alias("item_id")).join(ids, "item_id").select("qid", "doc_id")
    top = replaced.where("replacement is not null").select("qid", F.col("replacement").alias("item_id")).join(ids, "item_id").select("qid", "doc_id")
    rest = first.join(gone, ["qid", "doc_id"], "left_anti").join(top, ["qid", "doc_id"], "left_anti")
    rows = top.select("qid", "doc_id", F.lit(PROMOTED).alias("score"), F.lit(True).alias("grounded")).unionByName(rest)
    best = rows.groupBy("qid").agg(F.max_by(F.struct("doc_id", "score", "grounded"), F.struct("score", -F.col("doc_id"))).alias("b"), F.count(F.lit(1)).alias("candidates"))
    out = written(queries.select("qid").join(told.select("qid", "code"), "qid", "left").join(best, "qid", "left"))
    lost = out.where("b is null and code != 'AMBIGUOUS_BRANCHING'").select(F.col("qid").alias("own"))
    as_it_was = asked.where("qid.raw = 1 or not differs").join(small(lost), F.col("qid.qid") == F.col("own"), "left_semi")
    old = historical(as_it_was.select("qid", "text"), catalog, k, found=both.join(small(as_it_was.select("qid")), "qid", "left_semi"))
    out = out.join(old.select("qid.qid").distinct().withColumn("old", F.lit(True)), "qid", "left")
    context = F.col("code") == "AMBIGUOUS_BRANCHING"
    status = (
        F.when(context, "NEEDS_CONTEXT").when(F.col("b.doc_id").isNotNull(), F.when(F.col("b.grounded") & (F.col("b.score") >= ranking.CONFIDENT), "RECOMMENDED").otherwise("NEEDS_CLARIFICATION"))
        .when(F.col("old"), "NO_ACTIVE_STANDARD_FOUND").otherwise("NO_MATCH")
    )
    shown = lambda c: F.when(~F.coalesce(context, F.lit(False)), c)
    out = out.select("qid", status.alias("status"), shown(F.col("b.doc_id")).alias("doc_id"), shown(F.col("b.score")).alias("score"), F.when(context, 0).otherwise(F.coalesce("candidates", F.lit(0))).cast("long").alias("candidates"))
    if governed is None:
        none = F.lit(None).cast("string")
        return out.withColumns({"order_id": none, "temporal_status": none, "mandatory": F.lit(False)})
    out = out.join(ids, "doc_id", "left").join(queries.select("qid", "evaluation_date"), "qid", "left").join(governed, ["item_id", "evaluation_date"], "left")
    return out.select("qid", "status", "doc_id", "score", "candidates", "order_id", "temporal_status", F.coalesce("is_mandatory", F.lit(False)).alias("mandatory"))


def verdict_metrics(cases: DataFrame) -> DataFrame:
    """Shares of cases that pass, each among those it applies to; null where it applies to none.

    cases: status, doc_id and replacement as found; expected (item), expected_status,
    expected_replacement, obsolete_first (whether the best item is obsolete),
    expect_supersession, superseded (whether one was seen), expect_context,
    expect_abstention; nulls don't apply.
    """
    share = lambda ok, applies: F.round(F.count_if(applies & F.coalesce(ok, F.lit(False))) / F.nullif(F.count_if(applies), F.lit(0)), 6)
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    abstained = F.col("status").isin("NEEDS_CLARIFICATION", "NO_ACTIVE_STANDARD_FOUND", "NO_MATCH", "NEEDS_CONTEXT")
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), share(F.col("doc_id") == F.col("expected"), F.col("expected").isNotNull()).alias("retrieval_accuracy"), share(F.col("obsolete_first"), F.col("obsolete_first").isNotNull()).alias("obsolete_as_primary"),
        share(F.col("superseded"), on("expect_supersession")).alias("supersession_detection"), share(F.col("replacement") == F.col("expected_replacement"), F.col("expected_replacement").isNotNull()).alias("replacement_accuracy"),
        share(F.col("status") == "NEEDS_CONTEXT", on("expect_context")).alias("branching_safety"), share(F.col("temporal_status") == F.col("expected_temporal"), F.col("expected_temporal").isNotNull()).alias("temporal_accuracy"),
        share(abstained, on("expect_abstention")).alias("abstention"),
    )


def looked_up(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """rows with what the registry (unique by key) knows, and verified: whether it knows the key."""
    return rows.join(registry.withColumn("__known", F.lit(True)), key, "left").withColumn("verified", F.coalesce("__known", F.lit(False))).drop("__known")
