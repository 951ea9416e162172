"""A corpus pipeline: documents in, packed sequences of tokens out.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before it kept, and gives them back with the columns of `documents`, and any more
that docs has, under any name; the last one gives the pieces of documents with
their places in sequences.

In every stage a null text counts as empty, rows are documents whatever their
ids, null ids included, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import exact_dedup, jaccard_join, packing, phrase_automata, quality_crf
from sextant.llm.tables import by_place, table, written

#: Documents whose quality is under this go.
LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier doesn't reject; it is fitted on labels outside the held-out quarter.

    Equal texts share a score, so rows that repeat stay or go together.  Without
    labels every score is one half, and all documents go.
    """
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels").where(~quality_crf.held_out()))
    kept = quality_crf.score(by_place(docs, "doc_id", "text"), model).where(F.col("score") >= LEAST_QUALITY).drop("score")
    return kept.toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; null ids are smaller than all, and of rows equal in both one stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar shingle sets join, the smallest doc_id stays, null ids last; texts without words all stay, once each."""
    return jaccard_join.keep_one(docs, shingle=5, at_least=75)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that recur are taken out of every text, all copies of them; n_chars follows, where it is there.

    Rows stay, also those that have no word left.
    """
    out = phrase_automata.cleaned(docs, window=35)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens; an empty text is one piece, its end id."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("substring_dedup", substrings),
    ("best_fit_packing", pack),
]

#: The classifier is fitted, and the tokenizer runs, outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
