"""Every query by name, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, documents, graph, markup, orders, ranking, recommend, retrieval, revisions, rules, slots
from ..sources.scratch import written
from ..streaming import incremental
from . import oracle as O
from .fixtures import table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DATES = ["1996-06-30", "1998-01-01", "2024-01-01"]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_queries")


# Retrieval


@query(O.BM25 + "SELECT qid, doc_id, score, rank FROM bm25")
def bm25_topk(spark, d):
    return retrieval.bm25(_asked(spark, d), _corpus(spark, d))


@query(O.BM25 + O.TFIDF + "SELECT qid, doc_id, score, rank FROM tfidf")
def tfidf_topk(spark, d):
    return retrieval.tfidf(_asked(spark, d), _corpus(spark, d))


@query(O.BM25 + O.TFIDF + O.FUSED + "SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 10")
def rrf_fusion(spark, d):
    return retrieval.searched_once(_asked(spark, d), _corpus(spark, d), k=10).select("qid", "doc_id", "score", "rank")


@query(O.TOKENS + "SELECT doc_id, len(words) AS tokens, len(list_distinct(words)) AS different, array_to_string(words[1:5], ' ') AS head FROM docs")
def tokenise(spark, d):
    words = _corpus(spark, d).select("doc_id", T.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("tokens"), F.size(F.array_distinct("w")).cast("long").alias("different"), F.array_join(F.slice("w", 1, 5), " ").alias("head"))


# Citations and dates


@query(with_views("fx_citations") + r""" SELECT cite_id, regexp_replace(upper(trim(raw)), '[\s()/:\-_]+', '', 'g') AS lookup, regexp_replace(regexp_replace(raw, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS node,
    regexp_replace(raw, '(?i)^IS(/ISO|/IEC)?\s*', '') AS bare, trim(split_part(raw, ':', 1)) AS base, CAST(coalesce(nullif(regexp_extract(raw, ':\s*(\d{4})', 1), ''), nullif(regexp_extract(raw, '\b((?:19|20)\d{2})\b', 1), '')) AS INT) AS year FROM fx_citations""")
def canonical_key(spark, d):
    raw = F.col("raw")
    return view(spark, d, "fx_citations").select("cite_id", T.canonical_key(raw).alias("lookup"), T.node_id(raw).alias("node"), T.bare_number(raw).alias("bare"), T.base_designator(raw).alias("base"), T.year_of(raw).alias("year"))


@query(O.CITATION_FORMS)
def normalise_citation(spark, d):
    return view(spark, d, "fx_citations").select("cite_id", T.normalise_citation(F.col("raw")).alias("citation"))


@query(with_views("fx_orders") + " SELECT order_id, CASE WHEN order_no % 6 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS effective FROM fx_orders")
def date_parse(spark, d):
    return view(spark, d, "fx_orders").select("order_id", T.parse_date(F.col("effective_raw")).alias("effective"))


@query("""SELECT c_custkey, CASE WHEN length(regexp_replace(c_name, '[^0-9]', '', 'g')) >= 7 THEN substr(regexp_replace(c_name, '[^0-9]', '', 'g'), 1, 7) END AS licence,
    CASE WHEN length(regexp_replace(c_name, '[^0-9]', '', 'g')) >= 7 THEN CAST(list_sum([CAST(substr(regexp_replace(c_name, '[^0-9]', '', 'g'), CAST(i AS INT), 1) AS INT) * i FOR i IN range(1, 8)]) % 7 AS INT) END AS checksum FROM customer""")
def licence_lookup(spark, d):
    key = T.licence_key(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", key.alias("licence"), F.when(key.isNotNull(), T.weighted_checksum(key)).cast("int").alias("checksum"))


@query("SELECT doc_id, lower(text) LIKE '%the%' AS has_keyword, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / greatest(1, length(text)) < 0.05 AS mostly_ascii, 'en' AS script, 'en-IN' AS locale FROM documents")
def script_lang(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.any_of(F.lower(t), ["the"]).alias("has_keyword"), T.mostly_ascii(t).alias("mostly_ascii"), T.script(t).alias("script"), T.script(t, T.LOCALES, "en-IN").alias("locale"))


@query(with_views("fx_catalog") + " SELECT item_id, array_to_string(list_distinct_ordered, ' ') AS words FROM (SELECT item_id, list_filter(keywords, lambda x, i: x <> '' AND list_position(keywords, x) = i) AS list_distinct_ordered FROM fx_catalog)")
def clean_list(spark, d):
    return view(spark, d, "fx_catalog").select("item_id", F.array_join(T.clean_list(F.col("keywords")), " ").alias("words"))


# Orders


_STATUS = f"""dates AS (SELECT unnest([DATE '{"', DATE '".join(DATES)}']) AS evaluation_date),
status AS (SELECT *, CASE WHEN order_no % 6 = 5 THEN 'RESCINDED' WHEN effective_date IS NULL THEN 'UNVERIFIED_EFFECTIVE_DATE' WHEN effective_date <= evaluation_date THEN 'MANDATORY_IN_FORCE' ELSE 'PENDING_FUTURE_DATE' END AS temporal_status
  FROM (SELECT *, CASE WHEN order_no % 6 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS effective_date FROM fx_orders) CROSS JOIN dates)"""
_GOVERNING = _STATUS + """, placed AS (SELECT *, row_number() OVER (PARTITION BY item_id, evaluation_date ORDER BY CASE temporal_status WHEN 'MANDATORY_IN_FORCE' THEN 4 WHEN 'PENDING_FUTURE_DATE' THEN 3 WHEN 'UNVERIFIED_EFFECTIVE_DATE' THEN 2 ELSE 0 END DESC,
  effective_date DESC NULLS LAST, order_no) AS place, count(*) OVER (PARTITION BY item_id, evaluation_date) AS orders FROM status),
names AS (SELECT p.item_id, p.evaluation_date, count(DISTINCT s.order_name) - 1 AS competing, coalesce(string_agg(DISTINCT s.order_name, '; ' ORDER BY s.order_name) FILTER (s.order_name <> p.order_name), '') AS others
  FROM (SELECT * FROM placed WHERE place = 1) p JOIN status s USING (item_id, evaluation_date) GROUP BY ALL)"""


def _status(spark, d):
    dates = spark.createDataFrame([(x,) for x in DATES], "d string").select(F.to_date("d").alias("evaluation_date"))
    return orders.status_asof(view(spark, d, "fx_orders"), dates)


def _governed(spark, d, dates=DATES, numbered=False):
    """The governing order of every item that has orders, at the three dates or those that are given."""
    rows = view(spark, d, "fx_orders")
    asked = rows.select("item_id").distinct().select("item_id", F.explode(F.array(*(F.to_date(F.lit(x)) for x in dates))).alias("evaluation_date"))
    return orders.governing_asof(rows, asked, numbered)


@query(with_views("fx_orders") + "," + _STATUS + " SELECT order_id, evaluation_date, effective_date, temporal_status FROM status")
def order_status_asof(spark, d):
    return _status(spark, d).select("order_id", "evaluation_date", "effective_date", "temporal_status")


@query(with_views("fx_orders") + "," + _GOVERNING + " SELECT item_id, evaluation_date, order_id, temporal_status, effective_date, orders, competing, others, temporal_status = 'MANDATORY_IN_FORCE' AS is_mandatory FROM placed JOIN names USING (item_id, evaluation_date) WHERE place = 1")
def governing_order(spark, d):
    return _governed(spark, d)


# Revisions


_YEARS = "years AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base, year ORDER BY rev_no, rev_id) AS k FROM fx_revisions) WHERE k = 1)"


@query(with_views("fx_revisions") + "," + _YEARS + """ SELECT newer AS source, rev_id AS target, 'SUPERSEDES' AS relationship, 0.95::DOUBLE AS confidence, concat(newer_no, ' chronologically supersedes ', rev_no) AS description
    FROM (SELECT *, lead(rev_id) OVER w AS newer, lead(rev_no) OVER w AS newer_no FROM years WINDOW w AS (PARTITION BY base ORDER BY year, rev_no, rev_id)) WHERE newer IS NOT NULL""")
def revision_successors(spark, d):
    return revisions.successors(view(spark, d, "fx_revisions"))


@query(with_views("fx_revisions") + "," + _YEARS + """ SELECT rev_id AS node, last_value(rev_id) OVER w AS "end", count(*) OVER w2 - row_number() OVER w3 AS steps FROM years
    WINDOW w AS (PARTITION BY base ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), w2 AS (PARTITION BY base), w3 AS (PARTITION BY base ORDER BY year) QUALIFY steps > 0""")
def chain_end(spark, d):
    links = revisions.successors(view(spark, d, "fx_revisions")).select(F.col("target").alias("node"), F.col("source").alias("next"))
    return graph.chain_ends(links)


@query(with_views("fx_edges") + """ SELECT target AS node, count(DISTINCT source) AS successors, min(source) AS first_successor, CASE WHEN count(DISTINCT source) = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS_BRANCHING' END AS resolution
    FROM fx_edges WHERE relationship = 'TESTED_BY' GROUP BY target""")
def ambiguous_successors(spark, d):
    return revisions.resolution(view(spark, d, "fx_edges").where("relationship = 'TESTED_BY'"))


@query(with_views("fx_revisions") + "," + _YEARS + " SELECT base, min(year) AS first_year, max(year) AS last_year, string_agg(CAST(year AS VARCHAR), '>' ORDER BY year) AS milestones FROM years GROUP BY base")
def timeline(spark, d):
    return revisions.timeline(view(spark, d, "fx_revisions"))


_MARKS = [(1, "IS 12", 1966, "IS 12:1966", "first edition"), (1, "IS 12", 1950, "IS 1:1950", "draft"), (2, "IS 1", 1971, "IS 1:1971", "metric units"), (3, "IS 77", 2001, "IS 77:2001", "merged")]
_FIRST_MARK = "(SELECT min_by(designator, ord) FROM (SELECT DISTINCT ord, designator FROM marks) WHERE contains(item_no, designator) OR contains(designator, item_no))"


@query(with_views("fx_catalog", "fx_revisions") + f", marks(ord, designator, year, revision, event) AS (VALUES {', '.join(map(str, _MARKS))})" + f""", years AS (SELECT base, year, min(rev_no) AS revision FROM fx_revisions GROUP BY base, year), told AS (SELECT item_id, item_no, {_FIRST_MARK} AS designator FROM fx_catalog),
    curated AS (SELECT designator, string_agg(concat(year, ' ', revision, ' ', event), '; ' ORDER BY year) AS said FROM marks GROUP BY designator), own AS (SELECT base, string_agg(concat(year, ' ', revision), '; ' ORDER BY year) AS said FROM years GROUP BY base)
    SELECT item_id, t.designator, CASE WHEN t.designator IS NOT NULL THEN 'curated' WHEN o.said IS NOT NULL THEN 'revisions' ELSE 'none' END AS origin, coalesce(c.said, CASE WHEN t.designator IS NULL THEN o.said END, '') AS milestones
    FROM told t LEFT JOIN curated c USING (designator) LEFT JOIN own o ON o.base = item_no""")
def milestones(spark, d):
    marks = spark.createDataFrame(_MARKS, "ord int, designator string, year int, revision string, event string")
    out = revisions.milestones(view(spark, d, "fx_catalog"), marks, view(spark, d, "fx_revisions"))
    said = F.transform("milestones", lambda m: F.concat_ws(" ", m["year"].cast("string"), m["revision"], m["event"]))
    return out.select("item_id", "designator", "origin", F.array_join(said, "; ").alias("milestones"))


_SERIES = "items AS (SELECT item_id, department AS base, year AS part, title FROM fx_catalog), firsts AS (SELECT base, item_id AS target FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY part, item_id) AS k, count(*) OVER (PARTITION BY base) AS n FROM items) WHERE k = 1 AND n > 1)"


@query(with_views("fx_catalog") + "," + _SERIES + " SELECT item_id AS source, target, CASE WHEN regexp_matches(lower(title), 'test|method|sampling|analysis') THEN 'TESTED_BY' ELSE 'NORMATIVE_REF' END AS relationship, 0.96::DOUBLE AS confidence FROM items JOIN firsts USING (base) WHERE item_id <> target")
def series_edges(spark, d):
    return revisions.series_edges(view(spark, d, "fx_catalog").select("item_id", F.col("department").alias("base"), F.col("year").alias("part"), "title"))


# Graph


@query(with_views("fx_edges") + " SELECT relationship, count(*) AS edges FROM fx_edges GROUP BY relationship")
def edge_counts(spark, d):
    return graph.relation_counts(view(spark, d, "fx_edges"))


_CLEAN = "clean AS (SELECT * FROM fx_edges WHERE NOT (relationship IN ('NORMATIVE_REF', 'TESTED_BY', 'SUPERSEDES') AND source = target))"


@query(with_views("fx_edges") + "," + _CLEAN + " SELECT source, target, relationship, description, priority FROM (SELECT *, row_number() OVER (PARTITION BY source, target, relationship ORDER BY priority, description) AS k FROM clean) WHERE k = 1")
def consolidate_edges(spark, d):
    return graph.consolidated(view(spark, d, "fx_edges")).select("source", "target", "relationship", "description", "priority")


@query(with_views("fx_catalog", "fx_edges") + """ SELECT item_id AS id, 'standard' AS node_type, status FROM fx_catalog UNION ALL
    SELECT id, min(node_type), 'ACTIVE' FROM (SELECT source AS id, source_type AS node_type FROM fx_edges UNION ALL SELECT target, target_type FROM fx_edges) WHERE id NOT IN (SELECT item_id FROM fx_catalog) GROUP BY id""")
def node_completion(spark, d):
    nodes = view(spark, d, "fx_catalog").select(F.col("item_id").alias("id"), F.lit("standard").alias("node_type"), "status")
    return graph.completed_nodes(nodes, view(spark, d, "fx_edges"))


@query(with_views("fx_catalog") + " SELECT department, count(*) AS items, count(*) FILTER (status = 'ACTIVE') AS active FROM fx_catalog GROUP BY department ORDER BY items DESC, department LIMIT 8")
def dept_clusters(spark, d):
    return view(spark, d, "fx_catalog").groupBy("department").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "ACTIVE").alias("active")).orderBy(F.col("items").desc(), "department").limit(8)


@query(with_views("fx_edges") + """ SELECT DISTINCT source AS node, target AS neighbour, CASE relationship WHEN 'NORMATIVE_REF' THEN 'normative_references' WHEN 'TESTED_BY' THEN 'test_methods' ELSE 'orders' END AS category FROM fx_edges
    UNION ALL SELECT DISTINCT target, source, 'cited_by' FROM fx_edges WHERE relationship = 'NORMATIVE_REF'""")
def one_hop(spark, d):
    return graph.one_hop(view(spark, d, "fx_edges"))


_SEEDS = "seeds AS (SELECT item_id AS seed FROM fx_catalog WHERE status = 'WITHDRAWN')"


@query(with_views("fx_catalog", "fx_edges") + "," + _SEEDS + """, part_edges AS (SELECT DISTINCT source, target FROM fx_edges WHERE relationship <> 'MANDATED_BY'),
    first_hop AS (SELECT seed, target AS id FROM seeds JOIN part_edges ON source = seed UNION SELECT seed, source FROM seeds JOIN part_edges ON target = seed),
    found AS (SELECT seed, seed AS id, 0 AS hop FROM seeds UNION ALL SELECT seed, id, 1 FROM first_hop UNION ALL SELECT DISTINCT seed, target, 2 FROM first_hop JOIN part_edges ON source = id)
    SELECT seed, id, min(hop) AS hop FROM found GROUP BY seed, id""")
def two_hop(spark, d):
    """A slice: without MANDATED_BY edges, as its SQL has it; `two_hop_all` follows every relationship."""
    seeds = view(spark, d, "fx_catalog").where("status = 'WITHDRAWN'").select(F.col("item_id").alias("id"))
    return graph.two_hop(view(spark, d, "fx_edges").where("relationship != 'MANDATED_BY'"), seeds)


@query(with_views("fx_catalog", "fx_edges") + "," + _SEEDS + """, all_edges AS (SELECT DISTINCT source, target FROM fx_edges),
    first_hop AS (SELECT seed, target AS id FROM seeds JOIN all_edges ON source = seed UNION SELECT seed, source FROM seeds JOIN all_edges ON target = seed),
    found AS (SELECT seed, seed AS id, 0 AS hop FROM seeds UNION ALL SELECT seed, id, 1 FROM first_hop UNION ALL SELECT DISTINCT seed, target, 2 FROM first_hop JOIN all_edges ON source = id)
    SELECT seed, id, min(hop) AS hop FROM found GROUP BY seed, id""")
def two_hop_all(spark, d):
    """Over every relationship, orders too."""
    seeds = view(spark, d, "fx_catalog").where("status = 'WITHDRAWN'").select(F.col("item_id").alias("id"))
    return graph.two_hop(view(spark, d, "fx_edges"), seeds)


_KEPT = with_views("fx_catalog", "fx_edges") + "," + _SEEDS + """, all_edges AS (SELECT DISTINCT source, target, relationship FROM fx_edges),
    first_hop AS (SELECT seed, target AS id FROM seeds JOIN all_edges ON source = seed UNION SELECT seed, source FROM seeds JOIN all_edges ON target = seed),
    found AS (SELECT seed, seed AS id, 0 AS hop FROM seeds UNION ALL SELECT seed, id, 1 FROM first_hop UNION ALL SELECT DISTINCT seed, target, 2 FROM first_hop JOIN all_edges ON source = id),
    kept AS MATERIALIZED (SELECT seed, id, hop FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, id) AS place FROM (SELECT seed, id, min(hop) AS hop FROM found GROUP BY seed, id)) WHERE place <= 50)"""


def _kept(spark, d):
    seeds = view(spark, d, "fx_catalog").where("status = 'WITHDRAWN'").select(F.col("item_id").alias("id"))
    return graph.neighbourhood(written(view(spark, d, "fx_edges").select("source", "target", "relationship")), seeds, most=50)


@query(_KEPT + " SELECT seed, id, hop FROM kept")
def neighbourhood_nodes(spark, d):
    return _kept(spark, d)[0]


@query(_KEPT + """ SELECT a.seed, e.source, e.target, e.relationship FROM kept a JOIN all_edges e ON e.source = a.id JOIN kept b ON b.seed = a.seed AND b.id = e.target WHERE a.hop < 2
    UNION SELECT a.seed, e.source, e.target, e.relationship FROM kept a JOIN all_edges e ON e.target = a.id JOIN kept b ON b.seed = a.seed AND b.id = e.source WHERE a.hop = 0""")
def neighbourhood_links(spark, d):
    return _kept(spark, d)[1]


@query(with_views("fx_catalog", "fx_edges") + "," + _SEEDS + " SELECT DISTINCT source, target, relationship FROM fx_edges WHERE source IN (SELECT seed FROM seeds)")
def seed_subgraph(spark, d):
    seeds = view(spark, d, "fx_catalog").where("status = 'WITHDRAWN'").select(F.col("item_id").alias("id"))
    return graph.subgraph(view(spark, d, "fx_edges"), seeds)


_NEAR = "near AS (SELECT source AS a, target AS b FROM fx_edges WHERE relationship = 'TESTED_BY' UNION SELECT target, source FROM fx_edges WHERE relationship = 'TESTED_BY')"
_PAIRS = "pairs AS (SELECT concat('IS_', CAST(n_nationkey * 7 + 3 AS STRING)) AS source, concat('IS_', CAST(n_regionkey * 11 + 5 AS STRING)) AS target FROM nation)"


def _pairs(spark, d):
    return table(spark, d, "nation").select(F.concat(F.lit("IS_"), (F.col("n_nationkey") * 7 + 3).cast("string")).alias("source"), F.concat(F.lit("IS_"), (F.col("n_regionkey") * 11 + 5).cast("string")).alias("target"))


@query(with_views("fx_edges") + "," + _NEAR + "," + _PAIRS + """, walk AS (SELECT DISTINCT source, target, source AS here, 0 AS length FROM pairs UNION SELECT source, target, b, length + 1 FROM walk JOIN near ON a = here WHERE length < 4),
    ends AS (SELECT source, target, min(length) AS length FROM walk WHERE here = target GROUP BY ALL) SELECT DISTINCT p.source, p.target, e.length FROM pairs p LEFT JOIN ends e USING (source, target)""")
def shortest_path(spark, d):
    """A slice: TESTED_BY edges and paths of up to 4 steps, as its SQL has them; `shortest_path_all` is the whole graph."""
    return graph.shortest_paths(view(spark, d, "fx_edges").where("relationship = 'TESTED_BY'"), _pairs(spark, d), most=4)


@query(with_views("fx_edges") + """, near AS MATERIALIZED (SELECT source AS a, target AS b FROM fx_edges UNION SELECT target, source FROM fx_edges),""" + _PAIRS + """,
    walk(source, target, here, length) USING KEY (source, target, here) AS (SELECT DISTINCT source, target, source, 0 FROM pairs
        UNION SELECT DISTINCT w.source, w.target, b, w.length + 1 FROM walk w JOIN near ON a = w.here LEFT JOIN recurring.walk r ON r.source = w.source AND r.target = w.target AND r.here = b WHERE r.here IS NULL)
    SELECT DISTINCT p.source, p.target, w.length FROM pairs p LEFT JOIN walk w ON w.source = p.source AND w.target = p.target AND w.here = p.target""")
def shortest_path_all(spark, d):
    """All edges, taken either way, and paths of any length."""
    return graph.shortest_paths(view(spark, d, "fx_edges"), _pairs(spark, d))


@query(with_views("fx_edges") + """, near AS MATERIALIZED (SELECT source AS a, target AS b FROM fx_edges UNION SELECT target, source FROM fx_edges),""" + _PAIRS + """,
    walk(source, target, here, length) USING KEY (source, target, here) AS (SELECT DISTINCT source, target, source, 0 FROM pairs
        UNION SELECT DISTINCT w.source, w.target, b, w.length + 1 FROM walk w JOIN near ON a = w.here LEFT JOIN recurring.walk r ON r.source = w.source AND r.target = w.target AND r.here = b WHERE r.here IS NULL)
    SELECT DISTINCT source, target, CAST(length + 1 AS BIGINT) AS nodes, CAST(length AS BIGINT) AS "last", CAST(0 AS BIGINT) AS broken FROM walk WHERE here = target""")
def shortest_path_steps(spark, d):
    """One shortest path of every connected pair, its steps checked against the edges; ties are free, so that the length and the steps' being edges is what counts."""
    edges = written(view(spark, d, "fx_edges").select("source", "target", "relationship"))
    return graph.path_checks(written(graph.path_steps(edges, _pairs(spark, d))), edges)


_KEY = r"regexp_replace(upper(trim({})), '[\s()/:\-_]+', '', 'g')"
_PLAIN = r"regexp_replace(raw, '\s*:\s*\d{4}\s*$', '')"


@query(with_views("fx_catalog", "fx_citations") + f""", alias AS (SELECT key, min_by(item_id, (kind, item_id)) AS item_id FROM (SELECT item_id, 0 AS kind, {_KEY.format('item_id')} AS key FROM fx_catalog UNION ALL SELECT item_id, 1, {_KEY.format('item_no')} FROM fx_catalog
    UNION ALL SELECT item_id, 2, CAST(item_key AS VARCHAR) FROM fx_catalog) GROUP BY key),
    tries AS (SELECT cite_id, raw, 0 AS stage, {_KEY.format('raw')} AS key FROM fx_citations UNION ALL SELECT cite_id, raw, 1, {_KEY.format("concat('IS', raw)")} FROM fx_citations
    UNION ALL SELECT cite_id, raw, 2, {_KEY.format(_PLAIN)} FROM fx_citations UNION ALL SELECT cite_id, raw, 3, {_KEY.format("concat('IS', " + _PLAIN + ")")} FROM fx_citations)
    SELECT cite_id, raw, min_by(item_id, stage) FILTER (item_id IS NOT NULL) AS item_id FROM tries LEFT JOIN alias USING (key) GROUP BY cite_id, raw""")
def alias_resolve(spark, d):
    return graph.resolved(view(spark, d, "fx_citations"), graph.aliases(view(spark, d, "fx_catalog")))


# Slots, rules, expansion


def _slot_queries(spark, d):
    return view(spark, d, "fx_tenders").select(F.col("doc_id").alias("qid"), "text")


@query(with_views("fx_lines", "fx_tenders") + f", s AS ({O.slots_sql('SELECT doc_id AS qid, text FROM fx_tenders')}) SELECT qid, exposure, seismic, corrosion, infrastructure, pressure, grade, requires_crs, requires_ductility, special FROM s")
def slot_extract(spark, d):
    return slots.slots(_slot_queries(spark, d)).drop("text")


@query(with_views("fx_lines", "fx_tenders") + f", s AS ({O.slots_sql('SELECT doc_id AS qid, text FROM fx_tenders')}), rules(rule_id, item, slot, value, weight) AS (VALUES {O.RULE_ROWS})," + """
    long AS (SELECT qid, 'exposure' AS slot, exposure AS value FROM s UNION ALL SELECT qid, 'seismic', seismic FROM s UNION ALL SELECT qid, 'corrosion', corrosion FROM s UNION ALL SELECT qid, 'infrastructure', infrastructure FROM s UNION ALL SELECT qid, 'grade', grade FROM s)
    SELECT qid, item, round(sum(weight::DOUBLE), 6) AS bonus, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM long JOIN rules USING (slot, value) GROUP BY qid, item""")
def rule_bonus(spark, d):
    return slots.rule_bonus(slots.slots(_slot_queries(spark, d)), spark.createDataFrame(O.RULES, "rule_id string, item string, slot string, value string, weight double"))


@query(with_views("fx_lines", "fx_tenders") + f", vocabulary(ord, pattern, addition) AS (VALUES {O.VOCABULARY_ROWS})" + """
    SELECT doc_id AS qid, coalesce(string_agg(addition, ' ' ORDER BY ord), '') AS expansion FROM fx_tenders LEFT JOIN vocabulary ON contains(lower(text), pattern) GROUP BY doc_id""")
def vocab_expand(spark, d):
    return slots.expanded(_slot_queries(spark, d), spark.createDataFrame(O.VOCABULARY, "ord int, pattern string, addition string"))


@query(O.BM25 + """top AS (SELECT * FROM bm25 WHERE rank <= 5), sums AS (SELECT qid, sum(score) AS total, count(*) AS candidates FROM top GROUP BY qid HAVING count(*) >= 3)
    SELECT qid, candidates, entropy, entropy > 2.1 AS ambiguous FROM (SELECT qid, any_value(candidates) AS candidates, round(-sum((score / total) * log2(score / total)), 4) AS entropy FROM top JOIN sums USING (qid) GROUP BY qid)""")
def score_entropy(spark, d):
    return slots.ambiguity(retrieval.bm25(_asked(spark, d), _corpus(spark, d)))


# Ranking


def _catalog(spark, d):
    """Items with a keyword of several words, their whole name, behind their single ones; the searched text has only those."""
    name = F.array_join("keywords", " ")
    return view(spark, d, "fx_catalog").select(
        F.col("item_key").alias("doc_id"), F.concat_ws(" ", "item_no", "title", "department", name).alias("text"), "item_no", "status", F.array_append("keywords", name).alias("keywords"), "item_id", "department", F.col("title").alias("scope_text"),
    )


def _wanted(spark, d):
    """A number, a title, a size that is no number of an item, and for some a place that asks for more."""
    place = F.when(F.col("s_suppkey") % 4 == 1, "coastal").when(F.col("s_suppkey") % 4 == 2, "zone iv")
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.concat(F.lit("IS "), (F.col("s_suppkey") * 3).cast("string")).alias("no"), place.alias("place"))
    return asked.join(view(spark, d, "fx_catalog").select(F.col("item_key").alias("qid"), "title"), "qid").select("qid", F.concat_ws(" ", "no", "title", F.lit("12 mm"), "place").alias("text"))


def composed(q, c, **more):
    """The composite ranking of queries against a catalogue."""
    return ranking.composite(ranking.candidates(q, c), q, ranking.named(q, c), **more)


@query(O.COMPOSITE + "SELECT qid, doc_id, score, grounded, rank, label FROM composite")
def composite_rank(spark, d):
    q, c = _wanted(spark, d), _catalog(spark, d)
    return composed(q, c).drop("mandatory")


@query(O.COMPOSITE_HISTORY + """SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, concat('for reference only: ', lower(status)) AS warning
    FROM composite JOIN cat USING (doc_id) WHERE status IN ('SUPERSEDED', 'WITHDRAWN')) WHERE rank <= 10""")
def historical_search(spark, d):
    return recommend.historical(_wanted(spark, d), _catalog(spark, d))


@query(O.COMPOSITE + """SELECT q.qid, c.doc_id, CASE WHEN c.doc_id IS NULL THEN 'NO_ACTIVE_STANDARD_FOUND' WHEN grounded AND score >= 0.40 THEN 'RECOMMENDED' ELSE 'NEEDS_CLARIFICATION' END AS status
    FROM asked q LEFT JOIN (SELECT * FROM composite WHERE rank = 1) c USING (qid)""")
def recommend_batch(spark, d):
    q, c = _wanted(spark, d), _catalog(spark, d)
    return ranking.recommended(q, composed(q, c))


# Audits


def _dimensions(spark, d):
    """Superseded items and orders, as audits look them up."""
    items = view(spark, d, "fx_catalog")
    old = items.where("status != 'ACTIVE'").select(F.col("item_no").alias("citation"), "item_key")
    ends = graph.chain_ends(items.where("item_key % 10 = 1").select(F.col("item_key").alias("node"), (F.col("item_key") + 1).alias("next"))).select(F.col("node").alias("item_key"), F.concat(F.lit("IS "), F.col("end").cast("string")).alias("replacement"))
    laws = items.where("item_key % 6 = 5").select(F.col("item_no").alias("citation"), F.concat(F.lit("Order of "), "department").alias("order_name"))
    return old.join(ends, "item_key", "left").select("citation", "replacement"), laws


def _found(spark, d):
    tenders = view(spark, d, "fx_tenders")
    return tenders, audit.findings(tenders, *_dimensions(spark, d))


@query(with_views("fx_catalog", "fx_lines", "fx_tenders") + "," + O.FINDINGS + " SELECT doc_id, issue_type, penalty, snippet, remedy FROM findings")
def audit_findings(spark, d):
    return _found(spark, d)[1]


_SCORES = """, sums AS (SELECT doc_id, count(f.penalty) AS findings, CAST(greatest(0, least(100, 100 - coalesce(sum(f.penalty), 0))) AS INT) AS score, coalesce(string_agg(concat(issue_type, ': ', snippet, coalesce(' -> ' || remedy, '')), ' | ' ORDER BY issue_type, snippet, penalty, remedy) FILTER (issue_type IS NOT NULL), '') AS details
    FROM fx_tenders LEFT JOIN findings f USING (doc_id) GROUP BY doc_id), banded AS (SELECT *, CASE WHEN score >= 85 THEN 'COMPLIANT' WHEN score >= 60 THEN 'MINOR_RISKS' ELSE 'NON_COMPLIANT' END AS band FROM sums) """


@query(with_views("fx_catalog", "fx_lines", "fx_tenders") + "," + O.FINDINGS + _SCORES + "SELECT doc_id, findings, score, band FROM banded")
def audit_score(spark, d):
    return audit.scores(*_found(spark, d))


@query(ORACLE_SQL["audit_score"])
def audit_follow_up(spark, d):
    """Scores of an earlier version of the tables (fewer superseded items and orders, other replacements), then those of the documents that cite what has changed."""
    tenders, (old, laws) = written(view(spark, d, "fx_tenders")), map(written, _dimensions(spark, d))
    key = F.replace("citation", F.lit("IS "), F.lit("")).try_cast("long")
    was, had = old.where(key % 3 > 0).withColumn("replacement", F.when(key % 20 == 1, F.lit("IS 0")).otherwise(F.col("replacement"))), laws.where(key % 7 > 0)
    before = written(audit.scores(tenders, audit.findings(tenders, was, had)))
    return incremental.audited_again(tenders, incremental.citation_index(tenders), before, (was, old), (had, laws))[0]


@query(with_views("fx_catalog", "fx_lines", "fx_tenders") + "," + O.FINDINGS + _SCORES + "SELECT doc_id, findings, score, band, details FROM banded")
def audit_report(spark, d):
    said = F.transform("details", lambda f: F.concat(f["issue_type"], F.lit(": "), f["snippet"], F.coalesce(F.concat(F.lit(" -> "), f["remedy"]), F.lit(""))))
    return audit.report(*_found(spark, d)).withColumn("details", F.array_join(said, " | "))


_SCHEDULE = """, schedule AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY issue_type, snippet) AS INT) AS sl_no, snippet AS existing, CASE WHEN issue_type = 'SUPERSEDED_STANDARD' THEN concat('Replace ', snippet, ' by ', remedy)
    WHEN issue_type IN ('ILLEGAL_QCO_EXEMPTION', 'MISSING_QCO_MANDATE') THEN 'Require the standard mark under a valid licence' WHEN issue_type = 'MISSING_TEST_STANDARDS' THEN concat('Prescribe tests by ', snippet)
    WHEN issue_type = 'FOREIGN_STANDARD_DISCRIMINATION' THEN concat('Add an equivalent domestic standard to ', snippet) ELSE concat('Delete: ', snippet) END AS amended FROM findings
    UNION ALL SELECT doc_id, 1, '', 'No amendment' FROM fx_tenders WHERE doc_id NOT IN (SELECT doc_id FROM findings)) """


@query(with_views("fx_catalog", "fx_lines", "fx_tenders") + "," + O.FINDINGS + _SCHEDULE + "SELECT doc_id, sl_no, existing, amended FROM schedule")
def amendments(spark, d):
    return audit.amendments(*_found(spark, d))


@query(with_views("fx_catalog", "fx_lines", "fx_tenders") + "," + O.FINDINGS + _SCHEDULE + "SELECT doc_id, concat('CORRIGENDUM', chr(10), string_agg(concat(sl_no, '. ', existing, ' -> ', amended), chr(10) ORDER BY sl_no)) AS notice FROM schedule GROUP BY doc_id")
def amendment_notices(spark, d):
    return documents.amendment_notices(audit.amendments(*_found(spark, d)))


@query(with_views("fx_lines", "fx_tenders") + "," + O.RISKS + " SELECT doc_id, risks, score, rating FROM risks")
def risk_score(spark, d):
    return audit.risks(view(spark, d, "fx_tenders"))


@query(with_views("fx_lines", "fx_tenders") + "," + O.CITED + " SELECT doc_id, len(cited) AS citations, array_to_string(cited, ' | ') AS cited FROM cited")
def citation_edges(spark, d):
    return audit.citations(view(spark, d, "fx_tenders")).select("doc_id", F.size("cited").cast("long").alias("citations"), F.array_join("cited", " | ").alias("cited"))


# Pages, gates, metrics


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages")
def html_clean(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_html(F.col("html")).alias("text"))


_ITEMS = r"""items AS (SELECT page_id, unnest(range(len(raw))) AS place, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(unnest(raw), '(?i)<br\s*/?>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1) AS raw FROM pages))"""


@query("WITH " + _ITEMS + " SELECT page_id, place, text FROM items")
def html_rows(spark, d):
    return markup.html_items(table(spark, d, "pages"))


@query("WITH " + _ITEMS + """ SELECT page_id, place, last_value(CASE WHEN length(text) % 3 = 0 THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM items""")
def forward_fill(spark, d):
    rows = markup.html_items(table(spark, d, "pages"))
    return markup.carried_down(rows, F.when(F.length("text") % 3 == 0, F.col("text")), ["page_id"], ["place"], "header").select("page_id", "place", "header")


@query(with_views("fx_catalog") + """ SELECT item_id, concat_ws(',', CASE WHEN NOT coalesce(year BETWEEN 1960 AND 1990, false) THEN 'year' END, CASE WHEN NOT length(title) >= 30 THEN 'title' END, CASE WHEN NOT status IN ('ACTIVE', 'SUPERSEDED') THEN 'status' END) AS failed FROM fx_catalog""")
def quality_gate(spark, d):
    rules = {"year": F.col("year").between(1960, 1990), "title": F.length("title") >= 30, "status": F.col("status").isin("ACTIVE", "SUPERSEDED")}
    return markup.gate(view(spark, d, "fx_catalog"), rules).select("item_id", F.array_join("failed", ",").alias("failed"))


@query("""SELECT source, count(*) AS cases, round(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (toxic = 0), 0), 6) AS clean_quality, round(count(*) FILTER (toxic = 1) / nullif(count(*), 0), 6) AS toxic_rate
    FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def eval_metrics(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    quality, calm = F.col("quality") == 1, F.col("toxic") == 0
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("cases"), markup.ratio(quality, calm).alias("clean_quality"), markup.ratio(~calm, F.lit(True)).alias("toxic_rate"))


@query(with_views("fx_orders") + " SELECT order_id, order_name FROM fx_orders WHERE contains(lower(order_name), 'order 2') AND (contains(lower(order_id), '7') OR contains(lower(effective_raw), 'feb'))")
def order_directory(spark, d):
    low = lambda c: F.lower(F.col(c))
    rows = view(spark, d, "fx_orders").where(F.contains(low("order_name"), F.lit("order 2")) & (F.contains(low("order_id"), F.lit("7")) | F.contains(low("effective_raw"), F.lit("feb"))))
    return rows.select("order_id", "order_name")


# Rules tables


@query(with_views("fx_lines", "fx_tenders") + f", rates(rule_id, ord, keyword) AS (VALUES {O.RATE_ROWS})" + r"""
    SELECT doc_id, min_by(rule_id, (ord, rule_id)) FILTER (rule_id IS NOT NULL) AS rule_id FROM fx_tenders LEFT JOIN rates ON regexp_matches(lower(text), concat('\b', keyword, '\b')) GROUP BY doc_id""")
def rate_grounding(spark, d):
    return rules.first_match(view(spark, d, "fx_tenders"), spark.createDataFrame(O.RATES, "rule_id string, ord int, keyword string"), "doc_id")


@query(with_views("fx_catalog") + f", rates(rule_id, ord, keyword) AS (VALUES {O.FAMILY_ROWS})" + """
    SELECT item_id, min_by(rule_id, (ord, rule_id)) FILTER (rule_id IS NOT NULL) AS rule_id FROM fx_catalog LEFT JOIN rates ON contains(item_no, keyword) OR contains(keyword, item_no) GROUP BY item_id""")
def family_lookup(spark, d):
    return rules.either_contains(view(spark, d, "fx_catalog"), spark.createDataFrame(O.FAMILIES, "rule_id string, ord int, keyword string"), "item_id", "item_no")


@query(O.COMPOSITE + f""", weights(ord, word, item_no, weight) AS (VALUES {O.WEIGHT_ROWS}), extra AS (SELECT c.qid, c.doc_id, sum(w.weight::DOUBLE) AS extra FROM composite c JOIN cat k USING (doc_id) JOIN asked a USING (qid) JOIN weights w ON w.item_no = k.item_no AND contains(lower(a.text), w.word) GROUP BY ALL),
    moved AS (SELECT qid, doc_id, round(least(0.99::DOUBLE, greatest(0.01::DOUBLE, score + coalesce(extra, 0.0::DOUBLE))), 4) AS score FROM composite LEFT JOIN extra USING (qid, doc_id))
    SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, CASE WHEN score >= 0.65 THEN 'STRONG' WHEN score >= 0.40 THEN 'MODERATE' WHEN score >= 0.25 THEN 'LOW' ELSE 'INSUFFICIENT' END AS label FROM moved""")
def rule_rerank(spark, d):
    q, c = _wanted(spark, d), _catalog(spark, d)
    ranked = composed(q, c).select("qid", "doc_id", "score").join(c.select("doc_id", "item_no"), "doc_id")
    return rules.reranked(ranked, q, spark.createDataFrame(O.WEIGHTS, "ord int, word string, item_no string, weight double"))


@query(with_views("fx_revisions") + "," + _YEARS + """ SELECT rev_id, coalesce(newer_no, rev_id) AS label, CASE WHEN newer_no IS NULL THEN 'CURATED_UNVERIFIED' ELSE 'CHRONOLOGICAL_INFERRED' END AS provenance, 'standard' AS category
    FROM (SELECT *, lead(rev_no) OVER (PARTITION BY base ORDER BY year, rev_no, rev_id) AS newer_no FROM years)""")
def node_display(spark, d):
    years = revisions.distinct_years(view(spark, d, "fx_revisions"))
    edges = revisions.successors(view(spark, d, "fx_revisions")).select(F.col("target").alias("rev_id"), "description")
    rows = years.join(edges, "rev_id", "left").withColumn("newer_no", F.substring_index("description", " chronologically", 1))
    label = rules.display_label(F.col("newer_no"), F.lit(""), F.lit(None).cast("string"), F.col("rev_id"))
    return rows.select("rev_id", label.alias("label"), rules.provenance(F.coalesce("description", F.lit(""))).alias("provenance"), rules.category(F.lit("standard"), label).alias("category"))


@query("WITH " + _ITEMS + """, flagged AS (SELECT *, length(text) % 5 = 0 AS mark FROM items), ahead AS (SELECT page_id, place, text, coalesce(max(mark) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_table,
    coalesce(lead(mark, 1) OVER w, true) AS s1, coalesce(lead(mark, 2) OVER w, true) AS s2, lead(text, 1) OVER w AS t1, lead(text, 2) OVER w AS t2 FROM flagged WINDOW w AS (PARTITION BY page_id ORDER BY place))
    SELECT page_id, place, in_table, concat_ws(' ', text, CASE WHEN NOT s1 THEN t1 END, CASE WHEN NOT s1 AND NOT s2 THEN t2 END) AS context FROM ahead""")
def line_citations(spark, d):
    mark = F.length("text") % 5 == 0
    rows = rules.rows_after_header(markup.html_items(table(spark, d, "pages")), mark, "page_id", "place")
    return rules.with_following(rows, mark, "page_id", "place", most=2).select("page_id", "place", "in_table", "context")
