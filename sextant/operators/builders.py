"""Building the citation graph from documents, catalogues and regulations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, base_designator, citation_key, context, node_id
from ..sources.scratch import spread
from .graph import keep_first

# Words near a citation that make it one of a test, notations, and how far each source is trusted.
CONTEXT_WORDS = [
    "test", "testing", "sampling", "method", "determination", "analysis", "tolerance", "tolerances", "measurement", "apparatus",
    "tensile", "bend", "impact", "compressive", "flexural", "sieve", "vicat", "hardness",
]
SCOPE_CITATION = r"(?i)\b(?:IS(?:/ISO)?(?:/IEC)?\s+\d+(?:\s*(?:Part|\(Part\))\s*\d+)?(?:\s*:\s*\d{4})?)\b"
SUPERSEDES_NOTE = r"(?i)(?:superced(?:ing|ed\s+by)|supersed(?:ing|ed\s+by)|replaces?|withdrawn\s+in\s+favour\s+of)\s*:?\s*(IS\s*[\d\w:\-().]+)"
TEST_CONFIDENCE, CITATION_CONFIDENCE, NOTE_CONFIDENCE, CURATED_CONFIDENCE, PAIR_CONFIDENCE, YEARS_CONFIDENCE = 0.90, 0.85, 0.88, 0.99, 1.0, 0.95
EDGE = ["source", "target", "relationship", "confidence", "description", "method"]


def number_index(catalog: DataFrame) -> DataFrame:
    """key, target: items by their full number and by what stands before the year; of several items that share a key, the latest year, then the largest id."""
    full = F.transform(F.array("item_no"), lambda x: F.upper(citation_key(x)))
    keys = F.flatten(F.transform(full, lambda x: F.array_distinct(F.array(x, base_designator(x)))))
    rows = catalog.select("item_id", "year", F.explode_outer(keys).alias("key"))
    return rows.groupBy("key").agg(F.max_by("item_id", F.struct("year", "item_id")).alias("target"))


def located(citations: DataFrame, index: DataFrame, raw: str = "raw") -> DataFrame:
    """citations with target: the item of the full number, else of what stands before the year; rows without either are left out."""
    return _located(citations.withColumn("full", F.upper(citation_key(F.col(raw)))), index)


def _located(citations: DataFrame, index: DataFrame) -> DataFrame:
    """citations without their column `full`, the key of the full number, with target."""
    by_full, by_base = index.withColumnsRenamed({"key": "full", "target": "by_full"}), index.withColumnsRenamed({"key": "base", "target": "by_base"})
    rows = citations.withColumn("base", base_designator(F.col("full"))).join(by_full, "full", "left").join(by_base, "base", "left")
    return rows.withColumn("target", F.coalesce("by_full", "by_base")).where("target is not null").drop("full", "base", "by_full", "by_base")


def scope_edges(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Citation edges from free text: docs (item_id, item_no, text) to items of the catalogue (item_id, item_no, year).

    A citation is of a test where words near its first place say so.  A document
    doesn't cite its own number, in any edition.  Each edge comes once, with the
    text around the citation that comes first.  What a citation says is worked
    out once, in the row of its text, and texts aren't joined.
    """
    raws = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SCOPE_CITATION), 0)
    told = F.transform(raws, lambda raw, i: F.struct(i.alias("place"), F.upper(citation_key(raw)).alias("full"), context(F.col("text"), raw).alias("near")))
    # An outer generator, as of others the optimizer asks first whether the array is empty, and works it out anew for that.
    found = spread(docs.select("item_id", "item_no", "text")).select("item_id", base_designator(F.upper(citation_key(F.col("item_no")))).alias("own"), F.inline_outer(told))
    found = found.where(F.col("full").isNotNull() & (base_designator(F.col("full")) != F.col("own")))
    rows = found.select("item_id", "place", "full", any_of(F.col("near"), CONTEXT_WORDS).alias("tested"), F.substring("near", 1, 150).alias("description"))
    rows = _located(rows, number_index(spread(catalog.select("item_id", "item_no", "year")))).select(
        F.col("item_id").alias("source"), "target", F.when(F.col("tested"), "TESTED_BY").otherwise("NORMATIVE_REF").alias("relationship"),
        F.when(F.col("tested"), TEST_CONFIDENCE).otherwise(CITATION_CONFIDENCE).alias("confidence"), "description", "place",
    )
    first = rows.groupBy("source", "target", "relationship").agg(F.min_by(F.struct("confidence", "description"), "place").alias("first"))
    return first.select("source", "target", "relationship", "first.*", F.lit("scope").alias("method"))


def _superseding(rows: DataFrame, confidence: float, description: Column, method: str) -> DataFrame:
    ends = rows.where("source != '' and target != '' and source != target")
    return ends.select("source", "target", F.lit("SUPERSEDES").alias("relationship"), F.lit(confidence).alias("confidence"), description.alias("description"), F.lit(method).alias("method"))


def noted_supersession(docs: DataFrame) -> DataFrame:
    """Edges from notes in texts (item_no, text) that one number takes another's place."""
    rows = docs.select(node_id(F.col("item_no")).alias("source"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SUPERSEDES_NOTE), 1)).alias("raw"))
    rows = rows.withColumn("target", node_id(citation_key(F.col("raw"))))
    return _superseding(rows, NOTE_CONFIDENCE, F.lit("named in the text"), "noted").distinct()


def curated_supersession(items: DataFrame) -> DataFrame:
    """Edges from each item (item_no, history: array of numbers) to its former revisions."""
    rows = items.select("item_no", node_id(F.col("item_no")).alias("source"), F.explode("history").alias("raw")).withColumn("former", citation_key(F.col("raw"))).withColumn("target", node_id(F.col("former")))
    return _superseding(rows, CURATED_CONFIDENCE, F.concat("item_no", F.lit(" supersedes "), "former"), "curated").distinct()


def paired_supersession(pairs: DataFrame) -> DataFrame:
    """Edges from a table of pairs (newer, older, reason)."""
    rows = pairs.select(node_id(F.col("newer")).alias("source"), node_id(F.col("older")).alias("target"), "reason")
    return _superseding(rows, PAIR_CONFIDENCE, F.col("reason"), "paired").distinct()


def by_precedence(sources: list[DataFrame], keys: list[str], tie: list[str]) -> DataFrame:
    """Rows of all sources; of those that share a key, the one of the first source, then by `tie`."""
    rows = reduce(DataFrame.unionByName, (s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)))
    return keep_first(rows, keys, [F.col("__source"), *map(F.col, tie)]).drop("__source")


def supersession(years: DataFrame, items: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The four sources of supersession edges in order of precedence: years of a designator, curated history, pairs, notes."""
    chronological = years.select("source", "target", "relationship", "confidence", "description", F.lit("years").alias("method"))
    return by_precedence([chronological, curated_supersession(items), paired_supersession(pairs), noted_supersession(docs)], ["source", "target", "relationship"], ["description"])


def provenance_counts(edges: DataFrame) -> DataFrame:
    """How many edges each method gave, and of how many sources."""
    return edges.groupBy("method", "relationship").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("source").alias("sources"), F.round(F.avg("confidence"), 6).alias("confidence"))


def regulations(specialised: DataFrame, registered: DataFrame, licensed: DataFrame) -> DataFrame:
    """Regulation records of three sources in order of precedence; one for each number and product, whatever the case of its letters."""
    records = by_precedence([s.withColumn("__product", F.lower("product")) for s in (specialised, registered, licensed)], ["item_no", "__product"], ["order_name", "product"])
    return records.drop("__product")


def regulation_nodes(records: DataFrame, default_ministry: str) -> tuple[DataFrame, DataFrame]:
    """Order nodes (order_id, order_name, scheme, ministry_id) and ministry nodes (ministry_id, name) of regulation records.

    Records that name an order in the same way are one order: the smallest scheme
    and ministry of theirs counts.
    """
    ministry = F.coalesce(F.nullif(F.trim("ministry"), F.lit("")), F.lit(default_ministry))
    rows = records.withColumns({"order_id": node_id(F.col("order_name")), "name": ministry, "ministry_id": node_id(ministry)}).where("order_id != ''")
    orders = rows.groupBy("order_id").agg(F.min(F.struct("order_name", "scheme", "ministry_id")).alias("o")).select("order_id", "o.*")
    return orders, rows.select("ministry_id", "name").distinct()


def mandate_edges(records: DataFrame) -> DataFrame:
    """MANDATED_BY edges from each number that a record lists, or its single number where it lists none."""
    numbers = F.when(F.size(F.coalesce("numbers", F.array())) > 0, F.col("numbers")).otherwise(F.array("item_no"))
    rows = records.select(F.explode(numbers).alias("number"), node_id(F.col("order_name")).alias("target"), "order_name", "scheme")
    rows = rows.select(node_id(F.col("number")).alias("source"), "target", F.lit("MANDATED_BY").alias("relationship"), F.concat(F.lit("Mandated under "), "order_name", F.lit(" ("), "scheme", F.lit(")")).alias("description"))
    return keep_first(rows.where("source != '' and target != ''"), ["source", "target"], [F.col("description")])


def typed_edges(records: DataFrame) -> DataFrame:
    """ISSUED_BY edges from orders to ministries and REQUIRES_SCHEME edges from orders to schemes."""
    order = node_id(F.col("order_name"))
    ends = F.array(F.struct(F.lit("ISSUED_BY").alias("relationship"), node_id(F.col("ministry")).alias("target")), F.struct(F.lit("REQUIRES_SCHEME").alias("relationship"), node_id(F.col("scheme")).alias("target")))
    return records.select(order.alias("source"), F.inline(ends)).where("source != '' and target != ''").distinct()


def coverage(records: DataFrame) -> DataFrame:
    """One row: records, and how many ministries and schemes they name."""
    return records.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("ministry").alias("ministries"), F.count_distinct("scheme").alias("schemes"), F.array_join(F.sort_array(F.collect_set("scheme")), ", ").alias("named"))


def cited_subgraph(cited: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, source, target, relationship: the out-edges of what each document (doc_id, item_id) cites."""
    return cited.select("doc_id", F.col("item_id").alias("source")).distinct().join(edges.select("source", "target", "relationship").distinct(), "source").select("doc_id", "source", "target", "relationship")


def overlaid(seed: DataFrame, bulk: DataFrame) -> DataFrame:
    """Seed items, and bulk items whose id no seed has; a seed's status is that of the bulk where it knows the id."""
    status = bulk.groupBy("item_id").agg(F.min("status").alias("known"))
    mine = seed.join(status, "item_id", "left").withColumn("status", F.coalesce("known", "status")).drop("known")
    return mine.unionByName(bulk.join(seed.select("item_id"), "item_id", "left_anti").select(*mine.columns))


def bill_of_items(edges: DataFrame, catalog: DataFrame, most: int = 3) -> DataFrame:
    """item_id, tests, codes: up to `most` tests of each item, and references that are codes of practice by title, or where none is, its first reference."""
    refs = edges.where("relationship in ('TESTED_BY', 'NORMATIVE_REF')").select(F.col("source").alias("item_id"), F.col("target"), "relationship").distinct()
    named = refs.join(catalog.select(F.col("item_id").alias("target"), "title"), "target")
    entry = F.struct("target", "title")
    kinds = named.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("relationship") == "TESTED_BY", entry))).alias("t"), F.sort_array(F.collect_list(F.when(F.col("relationship") == "NORMATIVE_REF", entry))).alias("r")
    )
    codes = F.filter("r", lambda x: F.lower(x["title"]).contains("code of practice"))
    ids = lambda c: F.array_join(F.transform(F.slice(c, 1, most), lambda x: x["target"]), ",")
    return kinds.select("item_id", ids(F.col("t")).alias("tests"), F.when(F.size(codes) > 0, ids(codes)).otherwise(F.array_join(F.transform(F.slice("r", 1, 1), lambda x: x["target"]), ",")).alias("codes"))
