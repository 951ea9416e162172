"""Scores of search candidates, filters, and the recommendation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import band, bounded_score, canonical_key, tokens
from ..sources.scratch import written
from .graph import aliases
from .retrieval import Index, index, searched, searched_alike, small, top_k

# Weights and limits of the composite score.
CAP, SCALE, EXACT, MENTION, GRADE, SLOT_CAP, SLOT, IN_FORCE = 0.40, 12.0, 0.35, 0.25, 0.08, 0.20, 0.30, 0.08
COSINE_FULL, BM25_FULL, COSINE_SURE, BM25_SURE, LEAST_FACTOR, MOST_FACTOR = 0.30, 25.0, 0.20, 18.0, 0.10, 0.60
CONFIDENT = 0.40
# Fixed value: notation of a citation in a query.
CITED = r"(?i)\b((?:IS(?:/ISO)?(?:/IEC)?\s*)\d+(?:\s*(?:Part|\(Part\)|-|/)\s*\d+)?(?:\s*(?:Sec|Section)\s*\d+)?(?:\s*:\s*\d{4})?)\b"
OBSOLETE = ("SUPERSEDED", "WITHDRAWN")


def candidates(queries: DataFrame, catalog: DataFrame, keep_history: bool = False, found: Index | None = None) -> DataFrame:
    """qid, doc_id and both rankings' ranks and scores, with what of the catalogue scores need, for items that the lifecycle policy allows.

    catalog: doc_id, text, item_id, item_no, status, keywords; `found` is its
    index, where there is one.  The policy applies after each ranking's
    candidates are cut.
    """
    both = searched(queries, found or index(catalog.select("doc_id", "text")))
    out = both.join(small(catalog.select("doc_id", "item_id", "item_no", "status", "keywords")), "doc_id")
    return out if keep_history else out.where(~F.col("status").isin(*OBSOLETE))


def candidates_alike(members: DataFrame, catalog: DataFrame, found: Index) -> DataFrame:
    """key, doc_id, item_id, scope_text: the candidates that the lifecycle policy allows, of queries as from `retrieval.alike`."""
    rows = catalog.select("doc_id", "item_id", "scope_text", "status").where(~F.col("status").isin(*OBSOLETE)).drop("status")
    return searched_alike(members, found).join(small(rows), "doc_id")


def named(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """qid, exact_id: the item that a whole query names, else the item of the first citation in it, with or without its year; null where neither is known."""
    text = F.coalesce("text", F.lit(""))
    raw = F.regexp_extract(text, CITED, 0)
    plain = F.regexp_replace(raw, r":\s*\d{4}", "")
    keys = F.array(*(canonical_key(c) for c in (text, F.concat(F.lit("IS"), text), raw, F.concat(F.lit("IS"), raw), plain, F.concat(F.lit("IS"), plain))))
    tries = queries.select("qid", F.posexplode(keys).alias("stage", "key")).where("key not in ('', 'IS')")
    found = tries.join(aliases(catalog), "key").groupBy("qid").agg(F.min_by("item_id", "stage").alias("exact_id"))
    return queries.select("qid").join(found, "qid", "left")


def composite(found: DataFrame, queries: DataFrame, exact: DataFrame, bonus: DataFrame | None = None, in_force: DataFrame | None = None, k: int = 10) -> DataFrame:
    """qid, doc_id, score, label, grounded, mandatory, rank: fusion by rank, damped without technical grounding, plus additions, capped to 0.99.

    exact: as from `named`.  bonus: qid, doc_id, bonus.  in_force: doc_id, and qid
    where it depends on the query (its date).  An item is named exactly where the query is its
    number; it is mentioned where its number (not empty) or id stands in the
    query, in any case; a keyword of three letters at least counts where it
    stands anywhere in the query.
    """
    rows = found.withColumnRenamed("score", "rrf").join(small(queries.select("qid", "text").join(exact, "qid", "left")), "qid")
    up, number = F.upper("text"), F.upper("item_no")
    mention = ((number != "") & F.contains(up, number)) | F.contains(up, F.col("item_id"))
    grade = F.exists("keywords", lambda w: (F.length(w) >= 3) & F.contains(up, F.upper(w)))
    rows = rows.join(bonus, ["qid", "doc_id"], "left") if bonus is not None else rows.withColumn("bonus", F.lit(0.0))
    rows = rows.join(small(in_force.withColumn("mandatory", F.lit(True))), [c for c in ("qid", "doc_id") if c in in_force.columns], "left") if in_force is not None else rows.withColumn("mandatory", F.lit(False))
    extra, cosine, sparse = F.coalesce("bonus", F.lit(0.0)), F.coalesce("score_b", F.lit(0.0)), F.coalesce("score_a", F.lit(0.0))
    rows = rows.withColumns({"exact": F.coalesce(F.col("exact_id") == F.col("item_id"), F.lit(False)), "mention": F.coalesce(mention, F.lit(False)), "grade": F.coalesce(grade, F.lit(False))})
    exact, mention, grade = F.col("exact"), F.col("mention"), F.col("grade")
    grounded = exact | mention | grade | (extra > 0) | (cosine >= COSINE_SURE) | (sparse >= BM25_SURE)
    factor = F.when(grounded, 1.0).otherwise(F.least(F.lit(MOST_FACTOR), F.greatest(F.lit(LEAST_FACTOR), F.greatest(cosine / COSINE_FULL, sparse / BM25_FULL))))
    mandatory = F.coalesce("mandatory", F.lit(False))
    score = (
        F.least(F.lit(CAP), F.col("rrf") * SCALE * factor) + F.when(exact, EXACT).when(mention, MENTION).otherwise(0.0) + F.when(grade, GRADE).otherwise(0.0)
        + F.least(F.lit(SLOT_CAP), extra * SLOT) + F.when(grounded & mandatory, IN_FORCE).otherwise(0.0)
    )
    scored = rows.select("qid", "doc_id", bounded_score(score).alias("score"), grounded.alias("grounded"), mandatory.alias("mandatory"))
    return top_k(scored, k).withColumn("label", band(F.col("score")))


def matched_terms(queries: DataFrame, corpus: DataFrame, ranked: DataFrame) -> DataFrame:
    """ranked with the query's tokens that the document has, in the query's order; only ranked documents are tokenised."""
    ranked = written(ranked)
    corpus = corpus.join(small(ranked.select("doc_id").distinct()), "doc_id", "left_semi")
    q = queries.select("qid", tokens(F.col("text")).alias("q"))
    d = corpus.select("doc_id", tokens(F.col("text")).alias("d"))
    return ranked.join(q, "qid").join(d, "doc_id").select("qid", "doc_id", F.array_join(F.array_distinct(F.filter("q", lambda t: F.array_contains("d", t))), " ").alias("matched"))


def recommended(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """qid, doc_id, status of every query: its best item, with confidence, for clarification, or none."""
    best = ranked.where("rank = 1").select("qid", "doc_id", "score", "grounded")
    out = queries.select("qid").join(best, "qid", "left")
    sure = F.col("grounded") & (F.col("score") >= CONFIDENT)
    return out.select("qid", "doc_id", F.when(F.col("doc_id").isNull(), "NO_ACTIVE_STANDARD_FOUND").when(sure, "RECOMMENDED").otherwise("NEEDS_CLARIFICATION").alias("status"))


def promoted(ranked: DataFrame, replacements: DataFrame) -> DataFrame:
    """Rankings with obsolete items taken out and their replacement (doc_id -> new_id) put first with 0.99; all other rows stay."""
    rows = ranked.join(replacements, "doc_id", "left")
    new = rows.where("new_id is not null").groupBy("qid").agg(F.min_by("new_id", "rank").alias("doc_id")).withColumn("score", F.lit(0.99))
    rest = rows.where("new_id is null").select("qid", "doc_id", "score").join(new.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id")
    return new.select("qid", "doc_id", "score").unionByName(rest).withColumn("rank", F.row_number().over(order))
