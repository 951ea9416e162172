"""Batch text search: every row of a query table against every row of a corpus.

A corpus is indexed once, into written tables, and every search of it uses them.
Each of the two rankings (BM25 over words, TF-IDF cosine over words and pairs) is
a sum over a query's terms of weight times impact; its index has

* `posts`: a row for each document: its terms with their impacts;
* `lists`, made when they are first asked for: a row for each block of BLOCK postings of a term: postings go by falling
  impact, a row says its largest (`top`), and rows lie by term;
* `terms`: each term's largest impact and what its weight follows from.

A search that asks for many postings doesn't score them all.  The k documents that
do best in first blocks, scored exactly, give a score that k reach.  Then terms
whose largest contributions together stay below it are left out, of the others only
those blocks are scored that can still reach it; of the rest, only postings of
documents that may be among the k best are added.  The result is that of scoring
everything.

Where queries and texts are made of few words, as names of items are, most queries
ask for the same frequent terms with the same weights, and many texts have the same
impacts of them.  Then classes of queries meet classes of texts (`grouped`), and only
rare terms are scored by text.

A few queries that are asked once (`bm25`, `tfidf`, `searched_once`) need no index: their
weights are broadcast, and every text is scored where it lies (`scanned`).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, tokens
from ..sources.scratch import spread, written

#: Rows that are broadcast at most.
BROADCAST_ROWS = 200_000
#: Postings of a block, and documents of a shard: a term's postings are sorted by shard, so the commonest word is no single sort.
BLOCK, SHARD_DOCUMENTS = 128, 1 << 20
#: Asked postings up to which they are all scored in one job; beyond, the rounds of `pruned` cost less than the postings that they save.
DIRECT_POSTINGS = 1 << 24
#: Terms of at most so many documents are scored by document; more frequent ones make the classes of `grouped`.
RARE = 128
#: How many times fewer the terms that pairs of classes share must be than asked postings.
FEWER = 4
#: Queries that are broadcast to the texts at most, and texts of a partition then.
FEW_QUERIES, SCANNED_TEXTS = 1024, 4096
#: Words without a text that are left out of queries at most, the most asked ones.
UNKNOWN_WORDS = 4096
#: More than rounding to six places and the order of additions can move a score.
SLACK = 2e-6

# Constants of BM25 and of rank fusion.
K1, B, FLOOR, CANDIDATES, RRF_K, FEATURES = 1.5, 0.75, 0.25, 100, 60, 40_000


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast only when it has few rows; counting stops at the limit."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def top_k(scores: DataFrame, k: int, by: str = "qid", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank; ties go to the smaller id."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def counted(texts: DataFrame, id_col: str, terms: str) -> DataFrame:
    """id_col, size, terms, tfs: the different terms of an array in order and how often each is there, counted inside the row, over the sorted array."""
    rows = texts.select(id_col, F.size(terms).alias("size"), F.sort_array(terms).alias("s"))
    first = F.filter(F.when(F.col("size") > 0, F.sequence(F.lit(1), F.col("size"))).otherwise(F.array().cast("array<int>")), lambda i: (i == 1) | (F.get("s", i - 1) != F.get("s", F.greatest(i - 2, F.lit(0)))))
    rows = rows.withColumn("first", first)
    ends = F.concat(F.slice("first", F.lit(2), F.greatest(F.size("first"), F.lit(1))), F.array(F.col("size") + 1))
    tfs = F.transform(F.arrays_zip("first", ends.alias("ends")), lambda x: x["ends"] - x["first"])
    return rows.select(id_col, "size", F.transform("first", lambda i: F.get("s", i - 1)).alias("terms"), F.when(F.size("first") > 0, tfs).otherwise(F.array().cast("array<int>")).alias("tfs"))


def flat(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns, term and tf of rows as from `counted`, a row for each term.

    An outer generator, as of others the optimizer asks first whether the arrays
    are empty, and there works out the sorted array anew for every word of a text.
    """
    each = F.inline_outer(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))
    return rows.select(*columns, each).where("term is not null")


@dataclass(frozen=True)
class Ranking:
    """One ranking's tables; `terms` has term, top (largest impact), df (documents) and idf.

    `posts` has doc_id and entries (term, impact) of all `n` documents; `given` are lists that are there without it.
    """

    given: DataFrame | None
    terms: DataFrame | None
    posts: DataFrame | None = None
    n: int = 0

    @cached_property
    def lists(self) -> DataFrame:
        return _lists(self.each(), self.n) if self.given is None else self.given

    def each(self) -> DataFrame:
        """doc_id, term, impact of every posting."""
        if self.posts is None:
            return self.lists.select("term", F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), F.col("impacts").alias("impact")))).select("doc_id", "term", "impact")
        return self.posts.select("doc_id", F.inline_outer("entries")).where("term is not null")


@dataclass(frozen=True)
class Index:
    bm25: Ranking
    tfidf: Ranking


def _lists(posts: DataFrame, n: int) -> DataFrame:
    """term, shard, block, top, docs, impacts from doc_id, term, impact; blocks go by falling impact, ties by id."""
    shards = -(-max(n, 1) // SHARD_DOCUMENTS)
    posts = posts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    place = F.row_number().over(Window.partitionBy("term", "shard").orderBy(F.col("impact").desc(), "doc_id"))
    blocks = posts.withColumn("block", F.floor((place - 1) / BLOCK).cast("int")).groupBy("term", "shard", "block").agg(F.max("impact").alias("top"), F.collect_list(F.struct("doc_id", "impact")).alias("p"))
    return written(blocks.select("term", "shard", "block", "top", F.col("p.doc_id").alias("docs"), F.col("p.impact").alias("impacts")).sortWithinPartitions("term", "shard", "block"))


def words_of(corpus: DataFrame) -> DataFrame:
    """doc_id, words: the search tokens of a corpus (doc_id, text), written; both rankings are built from them."""
    return written(spread(corpus.select("doc_id", "text")).select("doc_id", tokens(F.col("text")).alias("words")))


def _bm25_part(tf: Column, size: Column, mean: float | None) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(float(mean or 1))))


def _bm25_posts(words: DataFrame, mean: float | None) -> DataFrame:
    """doc_id, term, impact of every text's different terms."""
    posts = flat(counted(words, "doc_id", "words"), "doc_id", "size")
    return posts.select("doc_id", "term", _bm25_part(F.col("tf"), F.col("size"), mean).alias("impact"))


def _bm25_terms(tops: DataFrame, n: int) -> DataFrame:
    """term, top, df, idf of all terms from their top and df."""
    df = F.col("df")
    terms = written(tops.withColumn("raw", F.ln(F.lit(n) - df + 0.5) - F.ln(df + 0.5)))
    floor = terms.agg(F.avg("raw")).first()[0]
    return terms.select("term", "top", "df", F.when(F.col("raw") < 0, F.lit(FLOOR * (floor or 0.0))).otherwise(F.col("raw")).alias("idf"))


def bm25_index(words: DataFrame) -> Ranking:
    """Okapi BM25; a term that is in more than half of the texts has FLOOR times the mean inverse document frequency."""
    n, mean = words.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    entry = lambda x: F.struct(x["term"].alias("term"), _bm25_part(x["tf"], F.col("size"), mean).alias("impact"))
    entries = F.transform(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")), entry)
    found = Ranking(None, None, written(counted(words, "doc_id", "words").select("doc_id", entries.alias("entries"))), n)
    tops = found.each().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("top"))
    return replace(found, terms=_bm25_terms(tops, n))


def _length(entries: str) -> Column:
    """The length of a vector of entries with `w`; squares are added by size, so that equal vectors have the very same."""
    return F.sqrt(F.aggregate(F.sort_array(F.transform(entries, lambda x: x["w"] * x["w"])), F.lit(0.0), lambda total, x: total + x))


def _vocabulary(grams: DataFrame, n: int, features: int) -> DataFrame:
    """term, df, idf of the `features` most frequent terms of texts as from `counted`, ties by term."""
    chosen = flat(grams).groupBy("term").agg(F.sum("tf").alias("freq"), F.count(F.lit(1)).alias("df")).orderBy(F.col("freq").desc(), "term").limit(features)
    return written(chosen.select("term", "df", (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")))


def _tfidf_rows(grams: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, norm, p: every text's terms in the vocabulary with their weights, and the length of these."""
    weighted = flat(grams, "doc_id").join(small(vocabulary), "term").select("doc_id", F.struct("term", ((1 + F.ln("tf")) * F.col("idf")).alias("w")).alias("p"))
    # The length is made below the generator, once for a text; beside it, it would be for every term.
    return weighted.groupBy("doc_id").agg(F.collect_list("p").alias("p")).select("doc_id", _length("p").alias("norm"), "p")


def _tfidf_posts(grams: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, term, impact of every text's terms in the vocabulary."""
    rows = _tfidf_rows(grams, vocabulary).select("doc_id", "norm", F.inline_outer("p"))
    return rows.select("doc_id", "term", (F.col("w") / F.col("norm")).alias("impact"))


def _grams(words: DataFrame) -> DataFrame:
    return counted(words.select("doc_id", bigrams(F.col("words")).alias("grams")), "doc_id", "grams").drop("size")


def tfidf_index(words: DataFrame, features: int = FEATURES) -> Ranking:
    """Cosine of sublinear TF-IDF over words and pairs of words; the vocabulary has the `features` most frequent of the corpus, ties by term."""
    n = words.count()
    vocabulary = _vocabulary(_grams(words), n, features)
    rows = _tfidf_rows(_grams(_dealt(words, n)), vocabulary)
    entries = F.transform("p", lambda x: F.struct(x["term"].alias("term"), (x["w"] / F.col("norm")).alias("impact")))
    found = Ranking(None, None, written(rows.select("doc_id", entries.alias("entries"))), n)
    tops = found.each().groupBy("term").agg(F.max("impact").alias("top"))
    return replace(found, terms=written(tops.join(small(vocabulary), "term")))


def index(corpus: DataFrame, features: int = FEATURES) -> Index:
    """Both rankings' tables of a corpus (doc_id, text), tokenised once."""
    words = words_of(corpus)
    return Index(bm25_index(words), tfidf_index(words, features))


def _asked(queries: DataFrame, terms: Column) -> DataFrame:
    """qid, term, tf: what queries (qid, text) ask for."""
    return flat(counted(queries.select("qid", terms.alias("t")), "qid", "t"), "qid")


def bm25_weights(queries: DataFrame, ranking: Ranking) -> DataFrame:
    """qid, term, weight, top, df of the terms that the corpus has."""
    return _bm25_weighted(_asked(queries, tokens(F.col("text"))), ranking)


def _bm25_weighted(asked: DataFrame, ranking: Ranking) -> DataFrame:
    return written(asked.join(ranking.terms, "term").select("qid", "term", (F.col("tf") * F.col("idf")).alias("weight"), "top", "df"))


def tfidf_weights(queries: DataFrame, ranking: Ranking) -> DataFrame:
    """The same for cosines: a query's weights have the length 1."""
    return _tfidf_weighted(_asked(queries, bigrams(tokens(F.col("text")))), ranking)


def _tfidf_weighted(asked: DataFrame, ranking: Ranking) -> DataFrame:
    asked = asked.join(ranking.terms, "term").select("qid", F.struct("term", ((1 + F.ln("tf")) * F.col("idf")).alias("w"), "top", "df").alias("p"))
    asked = asked.groupBy("qid").agg(F.collect_list("p").alias("p")).select("qid", _length("p").alias("length"), "p").select("qid", "length", F.inline_outer("p"))
    return written(asked.select("qid", "term", (F.col("w") / F.col("length")).alias("weight"), "top", "df"))


def _posted(blocks: DataFrame) -> DataFrame:
    return blocks.select("qid", "weight", F.inline(F.arrays_zip(F.col("docs").alias("doc_id"), F.col("impacts").alias("impact"))))


def thresholds(asked: DataFrame, ranking: Ranking, k: int) -> DataFrame:
    """qid, least: a score that k documents reach for certain; queries for which first blocks hold fewer have none.

    The k documents that do best in their terms' first blocks are scored exactly.
    """
    blocks = ranking.lists.join(small(asked.select("qid", "term", "weight")), "term")
    part = F.col("weight") * F.col("impact")
    partial = _posted(blocks.where("block = 0")).groupBy("qid", "doc_id").agg(F.sum(F.greatest(F.lit(0.0), part)).alias("score"))
    seeds = written(top_k(partial, k).select("qid", "doc_id"))
    exact = _posted(blocks).join(small(seeds), ["qid", "doc_id"]).groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))
    return exact.groupBy("qid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("qid", (F.col("least") - SLACK).alias("least"))


def planned(asked: DataFrame, ranking: Ranking, least: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All blocks of asked terms (qid, weight, docs, impacts, read), and by query `low`, what negative weights may take, and `rest`, what left-out terms may add.

    Terms go by their largest contribution; as many as together stay below the
    threshold are left out.  Of the others, a block is read only if its largest
    impact, with everything that the other terms may add, reaches it.
    """
    up = F.greatest(F.lit(0.0), F.col("weight") * F.col("top"))
    w = Window.partitionBy("qid")
    plan = asked.join(small(least), "qid", "left").withColumn("up", up).withColumn("total", F.sum("up").over(w)).withColumn("sofar", F.sum("up").over(w.orderBy("up", "term").rowsBetween(Window.unboundedPreceding, 0)))
    plan = written(plan.withColumn("kept", F.col("least").isNull() | (F.col("sofar") >= F.col("least"))))
    wanted = plan.select("qid", "term", "weight", "kept", (F.col("least") - F.col("total") + F.col("up")).alias("needs"))
    read = F.col("kept") & (F.col("needs").isNull() | (F.greatest(F.lit(0.0), F.col("weight") * F.col("top")) >= F.col("needs")))
    blocks = ranking.lists.join(small(wanted), "term").select("qid", "weight", "docs", "impacts", read.alias("read"))
    low = F.sum(F.least(F.lit(0.0), F.col("weight") * F.col("top")))
    return blocks, plan.groupBy("qid").agg(low.alias("low"), F.coalesce(F.sum(F.when(~F.col("kept"), F.col("up"))), F.lit(0.0)).alias("rest"))


def pruned(asked: DataFrame, ranking: Ranking, k: int) -> DataFrame:
    """qid, doc_id, score, rank: the k best sums of weight times impact above 0, rounded to 6 places; asked as from the `_weights` functions."""
    blocks, rest = planned(asked, ranking, written(thresholds(asked, ranking, k)))
    part = F.col("weight") * F.col("impact")
    partial = _posted(blocks.where("read")).groupBy("qid", "doc_id").agg(F.sum(part).alias("score"), F.sum(F.greatest(F.lit(0.0), part)).alias("high"))
    partial = written(partial)
    # What was read gives a better threshold than first blocks do.
    better = top_k(partial.select("qid", "doc_id", F.col("high").alias("score")), k).where(F.col("rank") == k).select("qid", F.col("score").alias("reached"))
    limits = written(rest.join(better, "qid", "left").select("qid", "rest", (F.col("reached") + F.col("low") - SLACK).alias("least")))
    may = written(partial.join(small(limits), "qid").where(F.col("least").isNull() | (F.col("high") + F.col("rest") >= F.col("least"))).select("qid", "doc_id", "score"))
    # Only candidates meet the postings that weren't read.
    more = _posted(blocks.where("not read")).join(small(may.select("qid", "doc_id")), ["qid", "doc_id"]).select("qid", "doc_id", part.alias("score"))
    scores = may.unionByName(more).groupBy("qid", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return top_k(scores.where("score > 0"), k)


def direct(asked: DataFrame, ranking: Ranking, k: int) -> DataFrame:
    """The same as `pruned`, from every posting of every asked term."""
    scores = ranking.each().join(small(asked.select("qid", "term", "weight")), "term").groupBy("qid", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("impact")), 6).alias("score"))
    return top_k(scores.where("score > 0"), k)


@dataclass(frozen=True)
class Classes:
    """`members`: an id and its class; `profiles`: class and entries, its terms in order with their values."""

    members: DataFrame
    profiles: DataFrame


def classes(rows: DataFrame, by: str, value: str) -> Classes:
    """Rows of equal values for equal terms are of one class; rows: by, term, value."""
    each = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("term", F.col(value).alias("value")))).alias("entries"))
    each = written(each.withColumn("key", F.unhex(F.sha2(F.to_json("entries"), 256))))
    profiles = written(each.groupBy("key").agg(F.first("entries").alias("entries")).withColumn("class", F.monotonically_increasing_id()))
    return Classes(written(each.select(by, "key").join(small(profiles.select("key", "class")), "key").select(by, "class")), profiles.select("class", "entries"))


def _frequent(asked: DataFrame) -> DataFrame:
    """The terms that make classes: frequent ones, and those that take something from a score."""
    return asked.groupBy("term").agg(F.max("df").alias("df"), F.min("weight").alias("least")).where((F.col("df") > RARE) | (F.col("least") < 0)).select("term")


def grouped(asked: DataFrame, ranking: Ranking, k: int, of_queries: Classes, of_docs: Classes) -> DataFrame:
    """The same as `direct`, by classes of queries and of documents over frequent terms.

    A class of queries meets each class of documents once.  Of the best k classes
    (ties to the one with the smallest document) the k smallest documents each hold
    the k best by frequent terms.  Rare terms only add, so the k best are among
    these and the documents that have a rare term, which are scored one by one.
    """
    own = of_docs.members.withColumn("none", F.lit(0))
    heads = top_k(own, k, by="class", score="none").groupBy("class").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    heads = written(heads.select(F.col("class").alias("doc_class"), "ids", F.col("ids")[0].alias("smallest"), F.size("ids").alias("n")))
    flat = lambda c, name, value: c.profiles.select(F.col("class").alias(name), F.inline("entries")).withColumnRenamed("value", value)
    cores = asked.sparkSession.sparkContext.defaultParallelism
    pairs = flat(of_queries, "query_class", "weight").repartition(4 * cores, "query_class").join(small(flat(of_docs, "doc_class", "impact")), "term")
    scores = pairs.groupBy("query_class", "doc_class").agg(F.round(F.sum(F.col("weight") * F.col("impact")), 6).alias("score")).where("score > 0")
    chosen = top_k(scores.join(small(heads.drop("ids")), "doc_class"), k, by="query_class", tie="smallest")
    w = Window.partitionBy("query_class")
    better = F.sum("n").over(w.orderBy(F.col("score").desc())) - F.sum("n").over(Window.partitionBy("query_class", "score"))
    chosen = written(chosen.withColumn("better", better).where(F.col("better") < k).select("query_class", "doc_class", "score"))
    frequent = top_k(chosen.join(small(heads.select("doc_class", "ids")), "doc_class").select("query_class", "score", F.explode("ids").alias("doc_id")), k, by="query_class")
    frequent = written(frequent.groupBy("query_class").agg(F.collect_list(F.struct("doc_id", "score")).alias("found")))
    frequent = of_queries.members.join(small(frequent), F.col("class") == F.col("query_class")).select("qid", F.inline("found"))
    # What has a rare term, with what its frequent ones give.
    rare = asked.join(small(_frequent(asked)), "term", "left_anti").select("qid", "term", "weight")
    posts = ranking.each()
    if ranking.posts is not None:
        posts = posts.join(small(ranking.terms.where(F.col("df") > RARE).select("term")), "term", "left_anti")
    added = posts.join(small(rare), "term").groupBy("qid", "doc_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("added"))
    named = lambda c, by, name: c.members.join(small(c.profiles), "class").select(by, F.col("entries").alias(name))
    added = added.join(named(of_queries, "qid", "weights"), "qid", "left").join(named(of_docs, "doc_id", "impacts"), "doc_id", "left")
    impacts = F.map_from_entries(F.coalesce("impacts", F.array().cast(added.schema["impacts"].dataType)))
    weights = F.coalesce("weights", F.array().cast(added.schema["weights"].dataType))
    both = F.aggregate(weights, F.col("added"), lambda total, x: total + x["value"] * F.coalesce(F.element_at(impacts, x["term"]), F.lit(0.0)))
    added = added.select("qid", "doc_id", F.round(both, 6).alias("score"))
    return top_k(frequent.unionByName(added).repartition("qid").groupBy("qid", "doc_id").agg(F.max("score").alias("score")).where("score > 0"), k)


def best(asked: DataFrame, ranking: Ranking, k: int) -> DataFrame:
    """The k best by whichever way is cheaper; rows are the same."""
    asked_posts = asked.agg(F.sum("df")).first()[0] or 0
    if asked_posts <= DIRECT_POSTINGS:
        return direct(asked, ranking, k)
    terms = written(_frequent(asked))
    of_queries = classes(asked.join(small(terms), "term", "left_semi"), "qid", "weight")
    if 2 * of_queries.profiles.count() > of_queries.members.count():
        return pruned(asked, ranking, k)
    of_docs = classes(ranking.each().join(small(terms), "term", "left_semi"), "doc_id", "impact")
    each = lambda c, n: c.profiles.select(F.explode("entries.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias(n))
    met = each(of_queries, "a").join(each(of_docs, "b"), "term").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
    return grouped(asked, ranking, k, of_queries, of_docs) if FEWER * met <= asked_posts else pruned(asked, ranking, k)


def few(queries: DataFrame) -> bool:
    """Whether queries, and what they ask for, are few enough to be sent to all texts."""
    return queries.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES and _asked(queries, bigrams(tokens(F.col("text")))).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _dealt(words: DataFrame, n: int) -> DataFrame:
    """words, a text's row and what is made of it in one partition: grouping by text then shuffles nothing."""
    return words.repartition(max(-(-n // SCANNED_TEXTS), words.sparkSession.sparkContext.defaultParallelism), "doc_id")


def scanned(asked: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """The same as `direct`, from postings (doc_id, term, impact) that lie by text; only the k best of a partition leave it."""
    scores = posts.join(F.broadcast(asked.select("qid", "term", "weight")), "term").groupBy("doc_id", "qid").agg(F.round(F.sum(F.col("weight") * F.col("impact")), 6).alias("score"))
    return top_k(scores.where("score > 0").select("qid", "doc_id", "score"), k)


def _bm25_scanned(queries: DataFrame, words: DataFrame, k: int) -> DataFrame:
    n, mean = words.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    tops = words.select(F.explode_outer(F.array_distinct("words")).alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.lit(None).cast("double").alias("top"))
    asked = bm25_weights(queries, Ranking(tops, _bm25_terms(tops, n)))
    return scanned(asked, _bm25_posts(_dealt(words, n), mean), k)


def _tfidf_scanned(queries: DataFrame, words: DataFrame, k: int, features: int) -> DataFrame:
    n = words.count()
    vocabulary = _vocabulary(_grams(words), n, features)
    asked = tfidf_weights(queries, Ranking(vocabulary, vocabulary.withColumn("top", F.lit(None).cast("double"))))
    return scanned(asked, _tfidf_posts(_grams(_dealt(words, n)), vocabulary), k)


def bm25(queries: DataFrame, corpus: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """qid, doc_id, score, rank by Okapi BM25; queries (qid, text), corpus (doc_id, text)."""
    words = words_of(corpus)
    if few(queries):
        return _bm25_scanned(queries, words, k)
    ranking = bm25_index(words)
    return best(bm25_weights(queries, ranking), ranking, k)


def tfidf(queries: DataFrame, corpus: DataFrame, k: int = CANDIDATES, features: int = FEATURES) -> DataFrame:
    """qid, doc_id, score, rank by cosine of sublinear TF-IDF over words and pairs of words."""
    words = words_of(corpus)
    if few(queries):
        return _tfidf_scanned(queries, words, k, features)
    ranking = tfidf_index(words, features)
    return best(tfidf_weights(queries, ranking), ranking, k)


def searched_once(queries: DataFrame, corpus: DataFrame, k: int | None = None, features: int = FEATURES) -> DataFrame:
    """The same as `searched` of a corpus that no other search asks."""
    if not few(queries):
        return searched(queries, index(corpus, features), k)
    words = words_of(corpus)
    return fused(_bm25_scanned(queries, words, CANDIDATES), _tfidf_scanned(queries, words, CANDIDATES, features), k)


def searched(queries: DataFrame, found: Index, k: int | None = None) -> DataFrame:
    """Both rankings of an indexed corpus, fused."""
    sparse = best(bm25_weights(queries, found.bm25), found.bm25, CANDIDATES)
    return fused(sparse, best(tfidf_weights(queries, found.tfidf), found.tfidf, CANDIDATES), k)


def without_text(words: list[str], found: Index) -> set[str]:
    """The words that no text has."""
    given = found.bm25.terms.sparkSession.createDataFrame([(w,) for w in words], "term string")
    return set(words) - {r.term for r in found.bm25.terms.select("term").join(F.broadcast(given), "term", "left_semi").collect()}


def alike(queries: DataFrame, found: Index) -> DataFrame:
    """queries (qid, words, ...), a written table with a row for each qid, with key and terms for words: the words and pairs that they ask for; those that ask for the same have one key.

    A word that no text has adds to no score, nor does a pair with it.  The most
    asked of them are left out first; the rest stays in terms, and meets no text.
    Queries without a term, or without an id, are left out; words may be null where
    one that no text has stood.
    """
    asked = queries.select(F.explode_outer("words").alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    unknown = asked.join(found.bm25.terms.select("term"), "term", "left_anti").orderBy(F.col("n").desc(), "term").limit(UNKNOWN_WORDS)
    unknown = [r.term for r in unknown.select("term").collect()]
    others = [c for c in queries.columns if c != "words"]
    rows = queries.where("qid is not null").select(*others, F.posexplode_outer("words").alias("place", "word")).where(F.col("word").isNotNull() & ~F.col("word").isin(unknown))
    rows = rows.groupBy(*others).agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w"))
    pair = lambda a, b: F.when(b["place"] == a["place"] + 1, F.concat(a["word"], F.lit(" "), b["word"]))
    pairs = F.when(F.size("w") > 1, F.array_compact(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), pair))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(*others, F.sort_array(F.concat(F.col("w.word"), pairs)).alias("terms"))
    return written(rows.withColumn("key", F.unhex(F.sha2(F.concat_ws("\n", "terms"), 256))))


def searched_alike(members: DataFrame, found: Index) -> DataFrame:
    """key, doc_id: the candidates of both rankings, of queries as from `alike`; those of one key are searched once."""
    once = written(members.groupBy(F.col("key").alias("qid")).agg(F.first("terms").alias("terms")))
    words, terms = F.filter("terms", lambda t: ~F.contains(t, F.lit(" "))), F.col("terms")
    sparse = best(_bm25_weighted(_asked(once, words), found.bm25), found.bm25, CANDIDATES)
    cosine = best(_tfidf_weighted(_asked(once, terms), found.tfidf), found.tfidf, CANDIDATES)
    return sparse.select(F.col("qid").alias("key"), "doc_id").unionByName(cosine.select(F.col("qid").alias("key"), "doc_id")).distinct()


def fused(first: DataFrame, second: DataFrame, k: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two rankings: qid, doc_id, score, with ranks and scores of each (null where missing)."""
    a = first.select("qid", "doc_id", F.col("rank").alias("rank_a"), F.col("score").alias("score_a"))
    b = second.select("qid", "doc_id", F.col("rank").alias("rank_b"), F.col("score").alias("score_b"))
    each = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    both = a.join(b, ["qid", "doc_id"], "full").withColumn("score", F.round(each("rank_a") + each("rank_b"), 6))
    return top_k(both, k) if k else both
