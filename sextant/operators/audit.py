"""Audits of whole tables of documents: citations, findings, scores, amendments.

Every rule looks at one document; penalties add up, so the order of rules
doesn't matter for the score.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, normalise_citations
from ..sources.scratch import written

# The notation of citations, penalties, bands, and words that the rules look for.
CITATION = r"(?i)\b(?:IS(?:/ISO)?(?:/IEC)?\s+\d+(?:\s*(?:\(Part\s*[0-9IVXLCDM]+\)|Part\s*[0-9IVXLCDM]+))?(?:\s*(?:[-:]|\bPart\b)?\s*(?:19\d{2}|20\d{2}))?)(?!\w)|\b(?:ASTM\s+[A-Z0-9-]+|EN\s+\d+|DIN\s+\d+|BS\s+\d+)(?!\w)"
FOREIGN = r"(?i)\b(?:ASTM\s+[A-Z0-9-]+|EN\s+\d+|DIN\s+\d+|BS\s+\d+)"
PENALTIES = {"SUPERSEDED_STANDARD": 22, "ILLEGAL_QCO_EXEMPTION": 35, "MISSING_QCO_MANDATE": 25, "MISSING_TEST_STANDARDS": 10, "FOREIGN_STANDARD_DISCRIMINATION": 15, "VAGUE_SPECIFICATION": 15}
EXEMPTION_WORDS = ["without bis", "without isi", "secondary re-rollers without", "bis certification not required"]
MANDATE_WORDS = ["bis standard mark", "isi mark", "bis license", "bis licence", "compulsory registration", "crs", "r-number", "qco", "scheme-i", "scheme-ii", "गुणवत्ता नियंत्रण आदेश", "बीआईएस"]
PRODUCT_RULES = [("steel", [["steel"], ["rebar"], ["tmt"]]), ("electronics", [["laptop"], ["computer"], ["battery"]]), ("solar", [["solar", "module"], ["solar", "pv"]]), ("footwear", [["safety shoe"], ["safety footwear"]]), ("polyethylene", [["hdpe", "pipe"]])]
# Editions that are known to be obsolete (part of the citation, any of these too, what replaces it), and tests that an item needs (code, words that do as well, only where the text has any of these).
KNOWN_OLD = [("2062:2006", [], "IS 2062:2011"), ("432", ["part 1", "1982"], "IS 1786 / IS 2062")]
TEST_RULES = {"IS 2062": [("1608", ["tensile test"], []), ("1599", ["bend test"], []), ("1757", ["charpy", "impact"], ["bridge", "joist", "truss"])]}
RISK_PENALTIES = {"COMPETITION_RESTRICTION": 25, "PUBLIC_PROCUREMENT_MII_VIOLATION": 20, "OBSOLETE_SPECIFICATION": 20, "CRIMINAL_STATUTORY_NON_COMPLIANCE": 25}
RISK_PATTERNS = {
    "producers": r"\b(blast furnace|primary producers?|integrated steel plant|integrated producers?)\b",
    "only": r"\b(only primary|primary.*only|only.*blast furnace|blast furnace.*only|without technical justification|all bidders must be primary|only sail|tata/jsw)\b",
    "foreign": r"\b(astm\s+[a-z]?\s*\d+|din\s+\d+|en\s+\d+|bs\s+\d+|iso\s+\d+)\b",
    "equivalent": r"\b(or equivalent is|or equivalent indian standard|conforming to is)\b",
    "obsolete": r"\bis\s+2062\s*:\s*(?:1999|2006)\b",
    "licence": r"\b(isi mark|bis certification mark|cm/l|license)\b",
}
LICENSED_GOODS = ["tmt", "rebar", "structural steel", "hdpe pipe", "distribution transformer", "safety helmet"]


def citations(documents: DataFrame) -> DataFrame:
    """doc_id, text, cited: citations in one notation, in order of appearance, once; those that a part of theirs repeats are left out."""
    found = F.array_distinct(F.filter(normalise_citations(F.regexp_extract_all("text", F.lit(CITATION), 0)), lambda c: c != ""))
    rows = documents.withColumn("all", found)
    return rows.withColumn("cited", F.expr("filter(all, x -> not exists(all, y -> y != x and startswith(y, x) and contains(y, '(Part')))")).drop("all")


def _finding(issue: str, snippet: Column, remedy: Column | None = None) -> Column:
    return F.struct(F.lit(issue).alias("issue_type"), F.lit(PENALTIES[issue]).alias("penalty"), snippet.alias("snippet"), (F.lit(None).cast("string") if remedy is None else remedy).alias("remedy"))


def _old_citations(cited: DataFrame, superseded: DataFrame) -> DataFrame:
    """doc_id, citation, remedy of citations of known obsolete editions, and of items that are no longer active."""
    low = F.lower("citation")
    known = F.coalesce(*(F.when(F.contains(low, F.lit(part)) & (any_of(low, also) if also else F.lit(True)), new) for part, also, new in KNOWN_OLD))
    superseded = superseded if "replacement" in superseded.columns else superseded.withColumn("replacement", F.lit(None).cast("string"))
    out = superseded.groupBy(F.col("citation").alias("base")).agg(F.min("replacement").alias("replacement"), F.lit(True).alias("old"))
    rows = cited.withColumn("base", F.trim(F.substring_index("citation", ":", 1))).withColumn("known", known).join(out, "base", "left")
    return rows.where(F.col("known").isNotNull() | F.col("old")).select("doc_id", "citation", F.coalesce("known", "replacement", F.lit("current edition")).alias("remedy"))


def findings(documents: DataFrame, superseded: DataFrame, mandated: DataFrame | None = None, products: list = PRODUCT_RULES, tests: dict = TEST_RULES) -> DataFrame:
    """doc_id, issue_type, penalty, snippet, remedy: one row a finding.

    superseded: citation (base designators that are no longer active), replacement
    (the end of their chain, or null).  mandated: citation (base designators that
    an order governs), order_name; the first citation of a document that has one
    counts, else its kind of product by keywords.
    """
    docs = written(citations(documents)).withColumn("low", F.lower("text"))  # three branches read them
    cited = docs.select("doc_id", F.posexplode("cited").alias("place", "citation"))
    old = _old_citations(cited, superseded).select("doc_id", F.lit("SUPERSEDED_STANDARD").alias("issue_type"), F.lit(PENALTIES["SUPERSEDED_STANDARD"]).alias("penalty"), F.col("citation").alias("snippet"), "remedy")
    low = F.col("low")
    every = lambda words: reduce(and_, (F.contains(low, F.lit(w)) for w in words))
    group = F.coalesce(*(F.when(reduce(or_, map(every, ways)), name) for name, ways in products))
    if mandated is not None:
        laws = mandated.groupBy(F.col("citation").alias("base")).agg(F.min("order_name").alias("order_name"))
        first = cited.withColumn("base", F.trim(F.substring_index("citation", ":", 1))).join(laws, "base").groupBy("doc_id").agg(F.min_by("order_name", "place").alias("order_name"))
        docs = docs.join(first, "doc_id", "left")
        group = F.coalesce(F.col("order_name"), group)
    missing = lambda needs: F.array_compact(F.array(*(
        F.when(~(F.contains("text", F.lit(code)) | any_of(low, words)) & (any_of(low, only) if only else F.lit(True)), f"IS {code}") for code, words, only in needs
    )))
    cites = lambda item: F.exists("cited", lambda c: F.contains(c, F.lit(item)))
    untested = [F.when(cites(item) & (F.size(missing(needs)) > 0), _finding("MISSING_TEST_STANDARDS", F.array_join(missing(needs), ", "))) for item, needs in tests.items()]
    foreign = F.regexp_extract_all("text", F.lit(FOREIGN), 0)
    domestic = F.exists("cited", lambda c: c.rlike("^IS[ /]"))
    recycled = F.contains(low, F.lit("recycled")) & any_of(low, ["hdpe", "water", "drinking"])
    exempt = any_of(low, EXEMPTION_WORDS)
    each = F.array(
        F.when(group.isNotNull() & exempt, _finding("ILLEGAL_QCO_EXEMPTION", group)),
        F.when(group.isNotNull() & ~exempt & ~any_of(low, MANDATE_WORDS), _finding("MISSING_QCO_MANDATE", group)),
        *untested,
        F.when((F.size(foreign) > 0) & ~domestic, _finding("FOREIGN_STANDARD_DISCRIMINATION", F.array_join(foreign, ", "))),
        F.when(recycled, _finding("VAGUE_SPECIFICATION", F.lit("recycled polymer"))),
        F.when(recycled & ~F.contains("text", F.lit("7328")), _finding("VAGUE_SPECIFICATION", F.lit("no virgin polyethylene"))),
        F.when(any_of(low, ["commercial quality", "ordinary quality"]), _finding("VAGUE_SPECIFICATION", F.lit("commercial quality"))),
    )
    return docs.select("doc_id", F.inline(F.array_compact(each))).unionByName(old)


def report(documents: DataFrame, found: DataFrame) -> DataFrame:
    """`scores` with the findings themselves: an array of structs by issue and snippet, empty where there are none."""
    rows = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("issue_type", "snippet", "penalty", "remedy"))).alias("details"))
    return scores(documents, found).join(rows, "doc_id", "left").withColumn("details", F.coalesce("details", F.array()))


def scores(documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, findings, score (0 to 100) and band of every document."""
    sums = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("findings"), F.sum("penalty").alias("penalty"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce("penalty", F.lit(0))))
    out = documents.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("findings", F.lit(0)).alias("findings"), score.cast("int").alias("score"))
    return out.withColumn("band", F.when(F.col("score") >= 85, "COMPLIANT").when(F.col("score") >= 60, "MINOR_RISKS").otherwise("NON_COMPLIANT"))


def amendments(documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, sl_no, existing, amended: the schedule of each document; a default row for documents without findings."""
    order = Window.partitionBy("doc_id").orderBy("issue_type", "snippet")
    text = (
        F.when(F.col("issue_type") == "SUPERSEDED_STANDARD", F.concat(F.lit("Replace "), F.col("snippet"), F.lit(" by "), F.coalesce("remedy", F.lit("current edition"))))
        .when(F.col("issue_type").isin("ILLEGAL_QCO_EXEMPTION", "MISSING_QCO_MANDATE"), F.lit("Require the standard mark under a valid licence"))
        .when(F.col("issue_type") == "MISSING_TEST_STANDARDS", F.concat(F.lit("Prescribe tests by "), F.col("snippet")))
        .when(F.col("issue_type") == "FOREIGN_STANDARD_DISCRIMINATION", F.concat(F.lit("Add an equivalent domestic standard to "), F.col("snippet")))
        .otherwise(F.concat(F.lit("Delete: "), F.col("snippet")))
    )
    rows = found.select("doc_id", F.row_number().over(order).alias("sl_no"), F.col("snippet").alias("existing"), text.alias("amended"))
    none = documents.select("doc_id").join(found.select("doc_id"), "doc_id", "left_anti")
    return rows.unionByName(none.select("doc_id", F.lit(1).alias("sl_no"), F.lit("").alias("existing"), F.lit("No amendment").alias("amended")))


def risks(documents: DataFrame) -> DataFrame:
    """doc_id, risks, score (10 to 100) and rating from four patterns of clauses."""
    low, p = F.lower("text"), RISK_PATTERNS
    rules = {
        "COMPETITION_RESTRICTION": low.rlike(p["producers"]) & low.rlike(p["only"]), "PUBLIC_PROCUREMENT_MII_VIOLATION": low.rlike(p["foreign"]) & ~low.rlike(p["equivalent"]),
        "OBSOLETE_SPECIFICATION": low.rlike(p["obsolete"]), "CRIMINAL_STATUTORY_NON_COMPLIANCE": any_of(low, LICENSED_GOODS) & ~low.rlike(p["licence"]),
    }
    hits = F.filter(F.array(*(F.when(c, name) for name, c in rules.items())), lambda x: x.isNotNull())
    penalty = sum((F.when(c, RISK_PENALTIES[name]).otherwise(0) for name, c in rules.items()), F.lit(0))
    out = documents.select("doc_id", F.array_join(hits, ",").alias("risks"), F.greatest(F.lit(10), F.lit(100) - penalty).alias("score"))
    return out.withColumn("rating", F.when(F.col("score") >= 90, "WATERTIGHT").when(F.col("score") >= 70, "MODERATE").otherwise("HIGH"))
