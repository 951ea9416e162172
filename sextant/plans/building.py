"""Queries that build the graph, read documents and give recommendations, with SQL for the same rows.

Most of their inputs are documents made of catalogue rows (see `fixtures`): what
they say follows from the row's key, and the SQL writes that down instead of
reading the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import builders, constraints, documents, graph, markup, orders, ranking, recommend, retrieval, revisions, rules, slots
from ..sources import readers
from ..sources.scratch import fresh_path, written
from . import oracle as O
from .fixtures import table, view, with_views
from .registry import _GOVERNING, DATES, _catalog, _governed, _wanted, query

# Documents

_DIVIDED = "CASE WHEN item_key % 2 = 0 THEN concat(p_type, ' (CED ', item_key % 60, ')') ELSE p_type END"


@query(with_views("fx_records") + f""" SELECT item_key, p_brand AS division, {_DIVIDED} AS section, CASE WHEN item_key % 2 = 0 THEN concat('CED ', item_key % 60) ELSE p_type END AS committee, concat('IS ', item_key) AS designator, CAST(item_key % 5 AS INT) AS amendments,
    CASE WHEN item_key % 4 = 0 THEN concat('IS ', item_key + 1) END AS superseded_by, concat('77.', item_key % 90) AS ics_code, CASE item_key % 4 WHEN 2 THEN 'WITHDRAWN' WHEN 3 THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status FROM fx_records JOIN part ON p_partkey = item_key""")
def labelled_fields(spark, d):
    return documents.labelled_fields(view(spark, d, "fx_records")).drop("description")


_SECTION = """CASE item_key % 4 WHEN 0 THEN concat('2 REFERENCES', chr(10), 'IS ', item_key + 2, ' (Part 1):1998 Methods of test', chr(10), 'IS ', item_key + 3, ' Code of practice', chr(10), 'IS ', item_key, ' itself')
    WHEN 1 THEN concat('2 NORMATIVE REFERENCES', chr(10), 'IS No. Title', chr(10), item_key + 1000, ':2005 Tensile testing', chr(10), item_key + 2000, ' Terms', chr(10), '1989 ')"""


@query(with_views("fx_reports") + f""" SELECT item_id, {_SECTION} WHEN 2 THEN concat('Clause 2 REFERENCES', chr(10), 'see IS ', item_key + 4, ':2011 for sieve analysis') ELSE trim(text, chr(10)) END AS loose,
    trim(CASE item_key % 4 WHEN 3 THEN substr(text, 1, 20) WHEN 2 THEN concat('2 REFERENCES', chr(10), 'see IS ', item_key + 4, ':2011 for sieve analysis') ELSE {_SECTION} END END, concat(chr(10), ' ')) AS strict FROM fx_reports""")
def document_sections(spark, d):
    t = F.col("text")
    return view(spark, d, "fx_reports").select("item_id", F.trim(documents.section(t), F.lit("\n")).alias("loose"), F.trim(documents.strict_section(t, 20), F.lit("\n ")).alias("strict"))


@query(with_views("fx_reports") + """ SELECT item_id, concat('IS ', item_key, ':', year) AS own_number, CAST(year AS INT) AS own_year, concat('This standard covers ', p_name, chr(10), 'of the kind ', p_type) AS scope,
    array_to_string(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 4), ' ') AS keywords FROM fx_reports JOIN part ON p_partkey = item_key""")
def document_metadata(spark, d):
    out = documents.metadata(view(spark, d, "fx_reports"), title_col="title")
    return out.select("item_id", "own_number", "own_year", "scope", F.array_join("keywords", " ").alias("keywords"))


@query(with_views("fx_reports") + """ SELECT item_id, CASE item_key % 4 WHEN 0 THEN concat('IS ', item_key + 2, ' (Part 1):1998|IS ', item_key + 3, '|IS ', item_key) WHEN 1 THEN concat('IS ', item_key + 1000, ':2005', CASE WHEN item_key + 2000 > 2099 THEN concat('|IS ', item_key + 2000) ELSE '' END)
    WHEN 2 THEN concat('IS ', item_key + 4, ':2011') ELSE concat('IS ', item_key, ':', year, '|IS ', item_key + 9, '|IS ', item_key + 6) END AS cited FROM fx_reports""")
def section_references(spark, d):
    return documents.references(view(spark, d, "fx_reports")).select("item_id", F.array_join("cited", "|").alias("cited"))


@query(with_views("fx_reports") + """, told(item_key, item_no, number, relationship, clause, description) AS (
    SELECT item_key, item_no, concat('IS ', item_key + 2, ' (Part 1)'), 'TESTED_BY', 'references', '1998 Methods of test' FROM fx_reports WHERE item_key % 4 = 0 UNION ALL SELECT item_key, item_no, concat('IS ', item_key + 3), 'NORMATIVE_REF', 'references', 'Code of practice' FROM fx_reports WHERE item_key % 4 = 0
    UNION ALL SELECT item_key, item_no, concat('IS ', item_key + 1000), 'TESTED_BY', 'table of references', 'Tensile testing' FROM fx_reports WHERE item_key % 4 = 1 UNION ALL SELECT item_key, item_no, concat('IS ', item_key + 2000), 'NORMATIVE_REF', 'table of references', 'Terms' FROM fx_reports WHERE item_key % 4 = 1
    UNION ALL SELECT item_key, item_no, concat('IS ', item_key + 4), 'TESTED_BY', 'references', 'see :2011 for sieve analysis' FROM fx_reports WHERE item_key % 4 = 2
    UNION ALL SELECT item_key, item_no, concat('IS ', item_key + 9), 'NORMATIVE_REF', 'references', 'Free of references, superseding' FROM fx_reports WHERE item_key % 4 = 3 UNION ALL SELECT item_key, item_no, concat('IS ', item_key + 6), 'NORMATIVE_REF', 'references', 'is outside' FROM fx_reports WHERE item_key % 4 = 3)
    SELECT item_no AS source, number AS target, relationship, clause, description FROM told""")
def document_edges(spark, d):
    return documents.line_edges(view(spark, d, "fx_reports"))


@query(with_views("fx_citations") + """ SELECT o_orderkey AS cite_id, CASE k WHEN 0 THEN concat('IS ', c) WHEN 1 THEN concat('IS ', c, ' : ', y) WHEN 2 THEN concat('IS ', c, ' (Part ', o_orderkey % 5 + 1, '):', y) WHEN 3 THEN concat('IS ', c, ' Part II') WHEN 4 THEN concat('IS ', c + 10) WHEN 5 THEN concat('IS ', c, ' ', y)
    WHEN 6 THEN concat('IS lEC ', c, ':', y) ELSE concat('IS ', c, ' (all parts)') END AS with_year, CASE k WHEN 2 THEN concat('IS ', c, ' (Part ', o_orderkey % 5 + 1, ')') WHEN 3 THEN concat('IS ', c, ' Part II') WHEN 4 THEN CAST(c + 10 AS VARCHAR) WHEN 5 THEN concat('IS ', c, ' ', y) WHEN 6 THEN concat('lEC ', c)
    WHEN 7 THEN concat('IS ', c, ' (all parts)') ELSE concat('IS ', c) END AS without_year, CASE WHEN k = 4 THEN concat('IS ', c + 10) WHEN k = 6 THEN concat('IS lEC ', c, ':', y, '.') WHEN k = 0 THEN concat('IS ', c) ELSE raw END AS completed
    FROM (SELECT o_orderkey, o_orderkey % 8 AS k, o_custkey AS c, year(o_orderdate) AS y FROM orders) JOIN fx_citations ON cite_id = o_orderkey""")
def light_citation(spark, d):
    raw = F.col("raw")
    return view(spark, d, "fx_citations").select("cite_id", T.citation_key(raw).alias("with_year"), T.citation_key(raw, year=False, prefix=False).alias("without_year"), documents.completed_number(raw).alias("completed"))


@query(with_views("fx_letters") + """ SELECT c_custkey, CASE c_custkey % 11 WHEN 1 THEN 'hi' WHEN 2 THEN 'bn' WHEN 3 THEN 'gu' WHEN 4 THEN 'ta' WHEN 5 THEN 'te' ELSE 'en' END AS script,
    CASE c_custkey % 11 WHEN 1 THEN 'hi-IN' WHEN 2 THEN 'bn-IN' WHEN 3 THEN 'gu-IN' WHEN 4 THEN 'ta-IN' WHEN 5 THEN 'te-IN' WHEN 6 THEN 'kn-IN' WHEN 7 THEN 'ml-IN' WHEN 8 THEN 'pa-IN' WHEN 9 THEN 'od-IN' ELSE 'en-IN' END AS locale FROM fx_letters""")
def indic_scripts(spark, d):
    t = F.col("text")
    return view(spark, d, "fx_letters").select("c_custkey", T.script(t).alias("script"), T.script(t, T.LOCALES, "en-IN").alias("locale"))


@query(with_views("fx_orders") + "," + _GOVERNING + """ SELECT item_id, evaluation_date, concat('Supplies shall conform to ', replace(item_id, '_', ' '), CASE temporal_status WHEN 'MANDATORY_IN_FORCE' THEN concat(' and bear the standard mark, under ', order_name, ' in force since ', CAST(effective_date AS VARCHAR), '.')
    WHEN 'PENDING_FUTURE_DATE' THEN concat('; the standard mark becomes mandatory on ', CAST(effective_date AS VARCHAR), ' under ', order_name, '.') WHEN 'RESCINDED' THEN concat('; ', order_name, ' is rescinded, the mark is voluntary.') ELSE concat('; the date of ', order_name, ' is not verified.') END) AS clause FROM placed WHERE place = 1""")
def order_clauses(spark, d):
    own = _governed(spark, d).join(view(spark, d, "fx_orders").select("order_id", "order_name"), "order_id")
    text = documents.clause_text(F.replace("item_id", F.lit("_"), F.lit(" ")), F.col("temporal_status"), F.col("order_name"), F.col("effective_date"))
    return own.select("item_id", "evaluation_date", text.alias("clause"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN concat('IS/IEC ', p_partkey) ELSE concat('IS ', p_partkey) END AS item_no, array_to_string(list_distinct(list_filter(CASE WHEN p_partkey % 5 = 0 THEN [] ELSE [concat('IS ', p_partkey)] END, lambda x: x <> '')), '|') AS refs,
    nullif(concat_ws(',', CASE WHEN p_partkey % 11 = 0 THEN 'item_no' END, CASE WHEN p_partkey % 7 = 0 THEN 'year' END, CASE WHEN length(p_name) < 8 THEN 'title' END, CASE WHEN p_type NOT IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'kind' END, CASE WHEN p_partkey % 5 = 0 THEN 'refs' END), '') AS failed FROM part""")
def validated_records(spark, d):
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(key % 11 == 0, " ").when(key % 3 == 0, F.concat(F.lit(" IS/IEC  "), key.cast("string"))).otherwise(key.cast("string")).alias("item_no"), F.when(key % 7 == 0, 1899).when(key % 7 == 1, None).otherwise(2050).alias("year"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"),
        F.when(key % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.concat(F.lit("IS  "), key.cast("string")), F.concat(F.lit(" IS "), key.cast("string")))).alias("refs"),
    )
    out = markup.validated(rows, ["item_no"], ["refs"], {"title": 8}, {"kind": ["SMALL", "MEDIUM", "LARGE"]})
    return out.select("p_partkey", "item_no", F.array_join("refs", "|").alias("refs"), F.array_join("failed", ",").alias("failed"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Ministry of Steel' WHEN 1 THEN 'Ministry of Heavy Industries' WHEN 2 THEN 'Ministry of Textiles' ELSE 'Department for Promotion of Industry and Internal Trade (DPIIT)' END AS ministry FROM part""")
def order_ministry(spark, d):
    turn = F.col("p_partkey") % 4
    order = F.when(turn == 0, "Steel and cable Order").when(turn == 1, "CABLE Order").when(turn == 2, "Order on cloth").otherwise("Order on toys")
    return table(spark, d, "part").select("p_partkey", T.ministry(order, F.lit(None).cast("string")).alias("ministry"))


@query(with_views("fx_orders") + " SELECT order_id, order_name, order_no % 5 AS issuer_no FROM fx_orders WHERE order_no % 5 = 3 AND (contains(lower(order_name), '17') OR contains(lower(order_id), '17') OR contains(lower(effective_raw), '17'))")
def order_search(spark, d):
    rows = view(spark, d, "fx_orders").withColumn("issuer_no", F.col("order_no") % 5).withColumn("issuer", F.concat(F.lit("Ministry No "), F.col("issuer_no").cast("string")))
    return orders.directory(rows, "ministry no 3", "17").select("order_id", "order_name", "issuer_no")


# Tables in pages


@query(with_views("fx_tables") + """ SELECT page_id, CAST(unnest([2, 3, 5]) AS BIGINT) AS place, unnest([concat('1|IS ', page_id, '|', p_name, '|Order dated 1.2.20', 10 + p_size % 50), concat('2|', page_id + 1, '*|second thing'), concat('3|IS ', page_id + 2, '|third')]) AS cells,
    unnest([concat('IS ', page_id), concat('IS ', page_id + 1), concat('IS ', page_id + 2)]) AS number FROM fx_tables JOIN part ON p_partkey = page_id""")
def table_rows(spark, d):
    rows = markup.html_rows(view(spark, d, "fx_tables"))
    return rows.select("page_id", F.col("place").cast("long").alias("place"), F.array_join("cells", "|").alias("cells"), documents.completed_number(F.get("cells", F.lit(1))).alias("number"))


@query(with_views("fx_tables") + """ SELECT page_id, CAST(unnest([2, 3, 5]) AS BIGINT) AS place, unnest([concat('Group ', p_brand), concat('Group ', p_brand), 'Group B']) AS category, concat('Order dated 1.2.20', 10 + p_size % 50) AS notification,
    unnest([p_name, 'second thing', 'third']) AS product FROM fx_tables JOIN part ON p_partkey = page_id""")
def grouped_table(spark, d):
    return markup.grouped_rows(view(spark, d, "fx_tables")).select("page_id", "place", "category", "notification", F.get("cells", F.lit(2)).alias("product"))


# Edges

_SCOPE_WORDS = "test|sampling|method|determination|analysis|tolerance|measurement|apparatus|tensile|bend|impact|compressive|flexural|sieve|vicat|hardness"


@query(with_views("fx_reports", "fx_catalog") + rf""", found AS (SELECT item_id, item_key, text, unnest(cites) AS raw, unnest(range(len(cites))) AS place FROM (SELECT *, regexp_extract_all(text, '\bIS\s+\d+(?:\s*:\s*\d{{4}})?\b') AS cites FROM fx_reports)),
    keyed AS (SELECT *, CAST(regexp_extract(raw, 'IS (\d+)', 1) AS BIGINT) AS key, strpos(text, raw) AS spot FROM found), near AS (SELECT *, lower(substr(text, greatest(1, spot - 75), spot - greatest(1, spot - 75) + length(raw) + 75)) AS near FROM keyed WHERE key <> item_key),
    edges AS (SELECT n.item_id AS source, c.item_id AS target, CASE WHEN regexp_matches(near, '{_SCOPE_WORDS}') THEN 'TESTED_BY' ELSE 'NORMATIVE_REF' END AS relationship, near, place FROM near n JOIN fx_catalog c ON c.item_key = key)
    SELECT source, target, relationship, CASE relationship WHEN 'TESTED_BY' THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END AS confidence, substr(min_by(near, place), 1, 150) AS description, 'scope' AS method FROM edges GROUP BY ALL""")
def scope_edges(spark, d):
    return builders.scope_edges(view(spark, d, "fx_reports"), view(spark, d, "fx_catalog"))


_PAIRS = [("IS 1786", "IS 432 (Part 1)", "bars"), ("IS 2062", "IS 226", "sections"), ("IS 18", "IS 9", "a pair that a note names too")]
_FOUR = with_views("fx_revisions", "fx_reports", "fx_catalog") + f""", pairs(newer, older, reason) AS (VALUES {', '.join(map(str, _PAIRS))}), years AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY base, year ORDER BY rev_no, rev_id) AS k FROM fx_revisions) WHERE k = 1),
    every AS (SELECT newer AS source, rev_id AS target, 0.95::DOUBLE AS confidence, concat(newer_no, ' chronologically supersedes ', rev_no) AS description, 'years' AS method, 0 AS kind
        FROM (SELECT *, lead(rev_id) OVER w AS newer, lead(rev_no) OVER w AS newer_no FROM years WINDOW w AS (PARTITION BY base ORDER BY year, rev_no, rev_id)) WHERE newer IS NOT NULL
    UNION ALL SELECT item_id, concat('IS_', item_key, '_1971'), 0.99::DOUBLE, concat(item_no, ' supersedes ', item_no, ':1971'), 'curated', 1 FROM fx_catalog WHERE item_key % 3 = 0
    UNION ALL SELECT replace(newer, ' ', '_'), regexp_replace(replace(replace(older, ' (', '_'), ')', ''), ' ', '_', 'g'), 1.0::DOUBLE, reason, 'paired', 2 FROM pairs
    UNION ALL SELECT item_id, concat('IS_', item_key + 9), 0.88::DOUBLE, 'named in the text', 'noted', 3 FROM fx_reports WHERE item_key % 4 = 3),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY kind, description) AS place FROM every) WHERE place = 1) """


def _four_sources(spark, d):
    items = view(spark, d, "fx_catalog").where("item_key % 3 = 0").select("item_no", F.array(F.concat("item_no", F.lit(" : 1971"))).alias("history"))
    items = items.select("item_no", F.transform("history", lambda h: F.replace(h, F.lit(" : "), F.lit(":"))).alias("history"))
    pairs = spark.createDataFrame(_PAIRS, "newer string, older string, reason string")
    return builders.supersession(revisions.successors(view(spark, d, "fx_revisions")), items, pairs, view(spark, d, "fx_reports"))


@query(_FOUR + "SELECT source, target, 'SUPERSEDES' AS relationship, confidence, description, method FROM best")
def supersession_edges(spark, d):
    return _four_sources(spark, d)


@query(_FOUR + "SELECT method, 'SUPERSEDES' AS relationship, count(*) AS edges, count(DISTINCT source) AS sources, round(avg(confidence), 6) AS confidence FROM best GROUP BY method")
def edge_provenance(spark, d):
    return builders.provenance_counts(_four_sources(spark, d))


_MERGED = "merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_no, lower(product) ORDER BY source, order_name, product) AS place FROM fx_regulations) WHERE place = 1)"


def _merged(spark, d):
    rows = view(spark, d, "fx_regulations")
    return builders.regulations(*(rows.where(F.col("source") == k) for k in range(3)))


@query(with_views("fx_regulations") + "," + _MERGED + " SELECT item_no, product, order_name, scheme FROM merged")
def regulation_union(spark, d):
    return _merged(spark, d).select("item_no", "product", "order_name", "scheme")


_ORDER_ID = "replace(replace(order_name, ' ', '_'), '#', '_')"
_MINISTRY = "CASE WHEN ministry = '' THEN 'Department of Trade' ELSE ministry END"


@query(with_views("fx_regulations") + "," + _MERGED + f""" SELECT order_id AS id, 'order' AS kind, order_name AS name, min(scheme) AS scheme FROM (SELECT *, {_ORDER_ID} AS order_id FROM merged) GROUP BY ALL
    UNION ALL SELECT DISTINCT replace({_MINISTRY}, ' ', '_'), 'ministry', {_MINISTRY}, NULL FROM merged""")
def regulation_nodes(spark, d):
    made, ministries = builders.regulation_nodes(_merged(spark, d), "Department of Trade")
    return made.select(F.col("order_id").alias("id"), F.lit("order").alias("kind"), F.col("order_name").alias("name"), "scheme").unionByName(
        ministries.select(F.col("ministry_id").alias("id"), F.lit("ministry").alias("kind"), "name", F.lit(None).cast("string").alias("scheme")))


@query(with_views("fx_regulations") + "," + _MERGED + f""", numbers AS (SELECT concat('IS_', item_key) AS source, {_ORDER_ID} AS target, order_name, scheme FROM merged UNION ALL SELECT concat('IS_', item_key + 1), {_ORDER_ID}, order_name, scheme FROM merged WHERE item_key % 3 = 0)
    SELECT source, target, 'MANDATED_BY' AS relationship, min(concat('Mandated under ', order_name, ' (', scheme, ')')) AS description FROM numbers GROUP BY source, target""")
def mandate_edges(spark, d):
    listed = F.when(F.col("item_key") % 3 == 0, F.array("item_no", F.concat(F.lit("IS "), (F.col("item_key") + 1).cast("string"))))
    return builders.mandate_edges(_merged(spark, d).withColumn("numbers", listed))


@query(with_views("fx_regulations") + f""" SELECT DISTINCT {_ORDER_ID} AS source, 'ISSUED_BY' AS relationship, replace(ministry, ' ', '_') AS target FROM fx_regulations WHERE ministry <> ''
    UNION ALL SELECT DISTINCT {_ORDER_ID}, 'REQUIRES_SCHEME', CASE source WHEN 0 THEN 'Scheme_X' WHEN 1 THEN 'Scheme_II_CRS' ELSE 'Scheme_I' END FROM fx_regulations""")
def typed_edges(spark, d):
    return builders.typed_edges(view(spark, d, "fx_regulations"))


@query(with_views("fx_regulations") + " SELECT count(*) AS records, count(DISTINCT ministry) AS ministries, count(DISTINCT scheme) AS schemes, string_agg(DISTINCT scheme, ', ' ORDER BY scheme) AS named FROM fx_regulations")
def regulation_coverage(spark, d):
    return builders.coverage(view(spark, d, "fx_regulations"))


@query(with_views("fx_lines", "fx_edges") + """, cited AS (SELECT DISTINCT doc_id, concat('IS_', l_partkey) AS source FROM fx_lines WHERE (l_partkey + line) % 13 = 12)
    SELECT DISTINCT doc_id, source, target, relationship FROM cited JOIN fx_edges USING (source)""")
def cited_subgraph(spark, d):
    cited = view(spark, d, "fx_lines").select("doc_id", F.explode(F.regexp_extract_all("phrase", F.lit(r"^parts to (IS \d+)$"), 1)).alias("no")).select("doc_id", T.node_id(F.col("no")).alias("item_id"))
    return builders.cited_subgraph(cited, view(spark, d, "fx_edges"))


@query(with_views("fx_catalog") + """ SELECT item_id, title, CASE WHEN item_key % 4 = 0 THEN 'seed' ELSE 'bulk' END AS origin, status FROM fx_catalog WHERE item_key % 4 < 3 UNION ALL SELECT concat('NEW_', item_key), title, 'seed', 'DRAFT' FROM fx_catalog WHERE item_key % 4 = 3""")
def catalogue_overlay(spark, d):
    rows = view(spark, d, "fx_catalog")
    some = lambda when, item, origin, status: rows.where(when).select(item.alias("item_id"), "title", F.lit(origin).alias("origin"), status.alias("status"))
    seed = some("item_key % 4 = 0", F.col("item_id"), "seed", F.lit("DRAFT")).unionByName(some("item_key % 4 = 3", F.concat(F.lit("NEW_"), F.col("item_key").cast("string")), "seed", F.lit("DRAFT")))
    return builders.overlaid(seed, some("item_key % 4 < 3", F.col("item_id"), "bulk", F.col("status")))


@query(with_views("fx_edges", "fx_catalog") + """, refs AS (SELECT DISTINCT source, target, relationship, title FROM fx_edges JOIN (SELECT item_id AS target, concat(title, CASE WHEN item_key % 7 = 0 THEN ' - code of practice' ELSE '' END) AS title FROM fx_catalog) USING (target) WHERE relationship <> 'MANDATED_BY'),
    lists AS (SELECT source AS item_id, list(target ORDER BY target) FILTER (relationship = 'TESTED_BY') AS t, list(target ORDER BY target) FILTER (relationship = 'NORMATIVE_REF') AS r, list(target ORDER BY target) FILTER (relationship = 'NORMATIVE_REF' AND contains(title, 'code of practice')) AS c FROM refs GROUP BY source)
    SELECT item_id, coalesce(array_to_string(t[1:3], ','), '') AS tests, coalesce(array_to_string(c[1:3], ','), array_to_string(r[1:1], ','), '') AS codes FROM lists""")
def bill_of_items(spark, d):
    titled = view(spark, d, "fx_catalog").withColumn("title", F.when(F.col("item_key") % 7 == 0, F.concat("title", F.lit(" - code of practice"))).otherwise(F.col("title")))
    return builders.bill_of_items(view(spark, d, "fx_edges"), titled)


@query(with_views("fx_catalog", "fx_edges") + """ SELECT source, target, relationship FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY relationship, target) AS place FROM (SELECT DISTINCT source, target, relationship FROM fx_edges WHERE relationship <> 'MANDATED_BY' AND source IN (SELECT item_id FROM fx_catalog WHERE status = 'WITHDRAWN'))) WHERE place <= 4""")
def capped_subgraph(spark, d):
    roots = view(spark, d, "fx_catalog").where("status = 'WITHDRAWN'").select(F.col("item_id").alias("id"))
    return graph.subgraph(view(spark, d, "fx_edges"), roots, with_orders=False, most=4)


_LOADS = """loads AS (SELECT item_id AS id, 0 AS load, title, '' AS department, status FROM fx_catalog UNION ALL SELECT item_id, 1, concat('new ', title), department, '' FROM fx_catalog WHERE item_key % 3 = 0 UNION ALL SELECT '', 2, title, department, status FROM fx_catalog)"""


@query(with_views("fx_catalog") + "," + _LOADS + """, one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY load DESC, title) AS l, row_number() OVER (PARTITION BY id ORDER BY load, title) AS f FROM loads WHERE id <> '')
    SELECT 'last' AS kept, id, CAST(load AS INT) AS load, title, coalesce(nullif(department, ''), 'General') AS department, coalesce(nullif(status, ''), 'ACTIVE') AS status FROM one WHERE l = 1 UNION ALL SELECT 'first', id, CAST(load AS INT), title, coalesce(nullif(department, ''), 'General'), coalesce(nullif(status, ''), 'ACTIVE') FROM one WHERE f = 1""")
def merged_nodes(spark, d):
    items = view(spark, d, "fx_catalog")
    one = lambda rows, key, load, title, department, status: rows.select(key.alias("id"), F.lit(load).alias("load"), title.alias("title"), department.alias("department"), status.alias("status"))
    blank = F.lit("")
    loads = one(items, F.col("item_id"), 0, F.col("title"), blank, F.col("status")).unionByName(one(items.where("item_key % 3 = 0"), F.col("item_id"), 1, F.concat(F.lit("new "), "title"), F.col("department"), blank)).unionByName(one(items, blank, 2, F.col("title"), F.col("department"), F.col("status")))
    return graph.merged_nodes(loads).withColumn("kept", F.lit("last")).unionByName(graph.merged_nodes(loads, "first").withColumn("kept", F.lit("first")))


@query(with_views("fx_edges") + """ SELECT target AS node, count(DISTINCT source) AS successors, min_by(source, (description, source)) AS first_successor, CASE WHEN count(DISTINCT source) = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS_BRANCHING' END AS resolution FROM fx_edges WHERE relationship = 'TESTED_BY' GROUP BY target""")
def first_loaded_successor(spark, d):
    return revisions.resolution(view(spark, d, "fx_edges").where("relationship = 'TESTED_BY'"), loaded="description")


@query(with_views("fx_catalog", "fx_edges") + " SELECT (SELECT count(*) FROM fx_catalog) AS nodes, (SELECT count(*) FROM fx_catalog WHERE status = 'ACTIVE') AS active, (SELECT count(*) FROM fx_edges) AS edges, (SELECT count(DISTINCT relationship) FROM fx_edges) AS relationships")
def graph_topology(spark, d):
    return readers.topology(view(spark, d, "fx_catalog"), view(spark, d, "fx_edges"))


@query(with_views("fx_catalog", "fx_edges") + """ SELECT 'nodes by type' AS what, CASE WHEN item_key % 9 = 0 THEN 'unknown' ELSE department END AS label, count(*) AS rows FROM fx_catalog GROUP BY ALL UNION ALL SELECT 'nodes by status', status, count(*) FROM fx_catalog GROUP BY ALL
    UNION ALL SELECT 'edges by relationship', relationship, count(*) FROM fx_edges GROUP BY ALL""")
def type_counts(spark, d):
    nodes = view(spark, d, "fx_catalog").withColumn("node_type", F.when(F.col("item_key") % 9 > 0, F.col("department")))
    return readers.type_counts(nodes, view(spark, d, "fx_edges"))


@query("""SELECT p_partkey AS row, CASE WHEN p_partkey % 7 > 1 THEN p_partkey END AS id, CASE WHEN p_partkey % 7 > 1 THEN p_name END AS name, p_partkey % 7 <= 1 AS malformed FROM part WHERE p_partkey % 11 > 0""")
def checked_lines(spark, d):
    """JSON lines of the catalogue: every seventh is cut off, the next has a text for a number, and every eleventh is blank."""
    key = F.col("p_partkey")
    said = F.to_json(F.struct(key.alias("id"), F.col("p_name").alias("name")))
    line = F.when(key % 11 == 0, " ").when(key % 7 == 0, F.substring(said, 1, 9)).when(key % 7 == 1, '{"id": "one", "name": "x"}').otherwise(said)
    rows = readers.parsed_lines(table(spark, d, "part").select(key.alias("row"), line.alias("value")), StructType().add("id", "long").add("name", "string"))
    return rows.select("row", "id", "name", F.col("rejected").isNotNull().alias("malformed"))


@query("""SELECT reason, count(*) AS rows FROM (SELECT unnest(list_filter([CASE WHEN p_partkey % 11 = 0 THEN 'item_no' END, CASE WHEN p_partkey % 7 = 0 THEN 'year' END, CASE WHEN length(p_name) < 8 THEN 'title' END], lambda x: x IS NOT NULL)) AS reason FROM part) GROUP BY reason
    UNION ALL SELECT 'valid', count(*) FROM part WHERE p_partkey % 11 > 0 AND p_partkey % 7 > 0 AND length(p_name) >= 8""")
def quarantine_reasons(spark, d):
    """Records split into two sinks, and read back from them: rejected ones by reason, and how many are valid."""
    key = F.col("p_partkey")
    records = table(spark, d, "part").select(F.when(key % 11 == 0, " ").otherwise(F.concat(F.lit("IS "), key.cast("string"))).alias("item_no"), F.when(key % 7 == 0, 1899).otherwise(2000).alias("year"), F.col("p_name").alias("title"))
    path = fresh_path(spark)
    readers.quarantined(markup.validated(records, ["item_no"], [], {"title": 8}, {}), F.col("failed").isNotNull(), path)
    back = spark.read.parquet(path)
    reasons = back.where("verdict = 'rejected'").select(F.explode("failed").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
    return reasons.unionByName(back.where("verdict = 'valid'").agg(F.lit("valid").alias("reason"), F.count(F.lit(1)).alias("rows")))


@query(with_views("fx_catalog") + """ SELECT cluster, count(*) AS items, any_value(clusters) AS clusters FROM (SELECT CASE WHEN item_key % 9 = 0 THEN 'General' ELSE department END AS cluster FROM fx_catalog),
    (SELECT count(DISTINCT CASE WHEN item_key % 9 = 0 THEN 'General' ELSE department END) AS clusters FROM fx_catalog) GROUP BY cluster ORDER BY items DESC, cluster LIMIT 8""")
def department_clusters(spark, d):
    named = F.when(F.col("item_key") % 9 == 0, F.lit(" ")).otherwise(F.concat("department", F.lit(" (division)")))
    return graph.clusters(view(spark, d, "fx_catalog").withColumn("department", named), "department")


@query(with_views("fx_orders", "fx_supersedes") + "," + _GOVERNING + """, own AS (SELECT item_id, order_id FROM placed WHERE place = 1 AND evaluation_date = DATE '1998-01-01' AND order_no % 3 > 0 AND item_id NOT LIKE '%1')
    SELECT concat('IS_', p_partkey) AS item_id, coalesce(o.order_id, n.order_id) AS order_id, CASE WHEN o.order_id IS NULL THEN s.source END AS via FROM part LEFT JOIN own o ON o.item_id = concat('IS_', p_partkey)
    LEFT JOIN (SELECT * FROM fx_supersedes WHERE target LIKE '%1') s ON s.target = concat('IS_', p_partkey) LEFT JOIN own n ON n.item_id = s.source WHERE o.order_id IS NOT NULL OR n.order_id IS NOT NULL""")
def inherited_orders(spark, d):
    best = _governed(spark, d, ["1998-01-01"], numbered=True)
    own = best.where("order_no % 3 > 0 and item_id not like '%1'").select("item_id", "order_id")
    ends = graph.chain_ends(view(spark, d, "fx_supersedes").where("target like '%1'").select(F.col("target").alias("node"), F.col("source").alias("next")))
    items = view(spark, d, "fx_catalog").select("item_id")
    return orders.inherited(items, own, ends).select("item_id", "order_id", "via")


@query(with_views("fx_catalog", "fx_edges", "fx_orders") + "," + _GOVERNING + """, own AS (SELECT item_id, temporal_status FROM placed WHERE place = 1 AND evaluation_date = DATE '1998-01-01'),
    refs AS (SELECT source AS item_id, count(DISTINCT target) FILTER (relationship = 'NORMATIVE_REF') AS normative_references, count(DISTINCT target) FILTER (relationship = 'TESTED_BY') AS test_methods FROM fx_edges GROUP BY source),
    cites AS (SELECT target AS item_id, count(DISTINCT source) AS cited_by FROM fx_edges WHERE relationship = 'NORMATIVE_REF' GROUP BY target)
    SELECT item_id, coalesce(normative_references, 0) AS normative_references, coalesce(test_methods, 0) AS test_methods, coalesce(cited_by, 0) AS cited_by, temporal_status, coalesce(temporal_status = 'MANDATORY_IN_FORCE', false) AS is_mandatory
    FROM fx_catalog LEFT JOIN refs USING (item_id) LEFT JOIN cites USING (item_id) LEFT JOIN own USING (item_id)""")
def one_hop_mandate(spark, d):
    near = graph.neighbour_counts(view(spark, d, "fx_edges")).withColumnRenamed("node", "item_id")
    own = _governed(spark, d).where("evaluation_date = '1998-01-01'").select("item_id", "temporal_status", "is_mandatory")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = view(spark, d, "fx_catalog").select("item_id").join(near, "item_id", "left").join(own, "item_id", "left")
    return rows.select("item_id", *map(none, ("normative_references", "test_methods", "cited_by")), "temporal_status", F.coalesce("is_mandatory", F.lit(False)).alias("is_mandatory"))


@query(with_views("fx_edges", "fx_orders") + """, linked AS (SELECT DISTINCT source AS item_id, target AS order_id FROM fx_edges WHERE relationship = 'MANDATED_BY')
    SELECT l.item_id, l.order_id, o.order_name FROM linked l JOIN (SELECT replace(order_id, 'ORD_', 'SUP_') AS order_id, order_name FROM fx_orders) o USING (order_id)""")
def mandated_orders(spark, d):
    named = view(spark, d, "fx_orders").withColumn("order_id", F.replace("order_id", F.lit("ORD_"), F.lit("SUP_")))
    return orders.mandated(named, view(spark, d, "fx_edges")).select("item_id", "order_id", "order_name")


@query("""SELECT c_custkey, licence, s_name AS holder, s_name IS NOT NULL AS verified FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS licence FROM customer) LEFT JOIN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS licence, s_name FROM supplier) USING (licence)""")
def licence_registry(spark, d):
    said = lambda key: T.licence_key(F.concat(F.lit("CM/L-"), F.lpad(F.col(key).cast("string"), 7, "0")))
    asked = table(spark, d, "customer").select("c_custkey", said("c_custkey").alias("licence"))
    registry = table(spark, d, "supplier").select(said("s_suppkey").alias("licence"), F.col("s_name").alias("holder"))
    return recommend.looked_up(asked, registry, "licence").select("c_custkey", "licence", "holder", "verified")


@query(with_views("fx_lines", "fx_tenders") + f", rates(rule_id, ord, keyword) AS (VALUES {O.RATE_ROWS})" + """
    SELECT doc_id, coalesce(min_by(rule_id, (ord, rule_id)) FILTER (rule_id IS NOT NULL), 'general') AS rule_id FROM fx_tenders LEFT JOIN rates ON contains(lower(text), keyword) GROUP BY doc_id""")
def default_tier(spark, d):
    return rules.first_match(view(spark, d, "fx_tenders"), spark.createDataFrame(O.RATES, "rule_id string, ord int, keyword string"), "doc_id", whole_word=False, default="general")


# Rankings with additions

#: Rules that the made-up numbers meet, behind the real ones.
_RULES = constraints.RULES + [
    constraints.Rule("b1", (("requires_crs", ()),), ("IS_17", "IS_3"), (), (), 0.35, "clause 4.2", "coast"), constraints.Rule("b2", (("infrastructure", ("bridge",)), ("exposure", ())), ("IS_20",), (), (), 0.25, "table 1", "bridge"),
    constraints.Rule("b3", (("infrastructure", ("water_supply",)),), ("IS_45",), ("ring",), ("IS_458",), -0.5, "scope", "water"), constraints.Rule("b4", (("requires_ductility", ()), ("seismic", ("zone v",))), ("IS_1",), ("gear",), ("IS_12",), 0.4, "clause 1.1", "quakes"),
    constraints.Rule("b5", (("corrosion", ("marine_coastal",)),), (), ("bolt",), (), -0.25, "clause 9", "bolts rust"),
]
_FORCED = "mandatory AS (SELECT DISTINCT item_id FROM placed WHERE place = 1 AND temporal_status = 'MANDATORY_IN_FORCE' AND evaluation_date = DATE '1998-01-01')"
_WITH_EXTRA = O.composite_sql(views=with_views("fx_catalog", "fx_orders") + "," + _GOVERNING + ", " + _FORCED, rules=_RULES, mandated="m.item_id IS NOT NULL", joins="LEFT JOIN mandatory m ON m.item_id = c.item_id")


def _in_force(spark, d):
    own = _governed(spark, d).where("is_mandatory and evaluation_date = '1998-01-01'").select("item_id")
    return own.join(view(spark, d, "fx_catalog"), "item_id").select(F.col("item_key").alias("doc_id")).distinct()


def _with_extra(spark, d):
    q, c = _wanted(spark, d), _catalog(spark, d)
    found = written(ranking.candidates(q, c))
    return ranking.composite(found, q, ranking.named(q, c), constraints.evaluated(found, slots.slots(q), c, _RULES).select("qid", "doc_id", "bonus"), _in_force(spark, d))


@query(O.BM25 + "SELECT qid, doc_id, array_to_string(list_filter(a.words, lambda x, i: list_contains(d.words, x) AND list_position(a.words, x) = i), ' ') AS matched FROM bm25 JOIN asked_words a USING (qid) JOIN docs d USING (doc_id)")
def matched_terms(spark, d):
    q, c = view(spark, d, "fx_queries"), table(spark, d, "documents").select("doc_id", "text")
    return ranking.matched_terms(q, c, retrieval.bm25(q, c).select("qid", "doc_id"))


@query(_WITH_EXTRA + "SELECT qid, doc_id, score, grounded, rank, label FROM composite")
def composite_with_rules(spark, d):
    return _with_extra(spark, d).drop("mandatory")


_SLOT_RULES = [("requires_crs", "IS_1", 0.15), ("requires_ductility", "IS_2", 0.10), ("requires_ductility", "IS_3", -0.15)]
_GRADES = [("hot", "IS_1", 0.35), ("hot", "IS_2", -0.5), ("ring", "IS_4", 0.35)]
_NEGATIVES = [("metal", 1, ["red", "blue"], "IS_3", 0.3), ("metal", 2, ["red"], "IS_30", -0.2), ("water", 1, ["bolt"], "IS_5", -0.6)]
_NEGATIVE_ROWS = ", ".join(f"('{k}', {o}, {w}, '{i}', {x})" for k, o, w, i, x in _NEGATIVES)


@query(_WITH_EXTRA + f""", grades(grade, item, weight) AS (VALUES {', '.join(map(str, _GRADES))}), negatives(kind, ord, words, item, weight) AS (VALUES {_NEGATIVE_ROWS}),
    cand2 AS (SELECT c.qid, c.doc_id, c.score, c.mandated, k.item_no, concat('IS_', c.doc_id) AS item_id, lower(a.text) AS low FROM composite c JOIN cat k USING (doc_id) JOIN asked a USING (qid)),
    by_grade AS (SELECT qid, doc_id, sum(weight) AS g FROM (SELECT DISTINCT qid, doc_id, grade, weight::DOUBLE AS weight FROM cand2 JOIN grades ON contains(low, grade) AND contains(item_id, item)) GROUP BY ALL),
    by_word AS (SELECT qid, doc_id, sum(weight) AS w FROM (SELECT qid, doc_id, kind, min_by(weight::DOUBLE, ord) AS weight FROM cand2 JOIN negatives ON contains(item_id, item) AND len(list_filter(words, lambda x: contains(low, x))) > 0 GROUP BY ALL) GROUP BY ALL),
    slot_rules(slot, item, weight) AS (VALUES {', '.join(map(str, _SLOT_RULES))}), by_slot AS (SELECT qid, doc_id, sum(weight::DOUBLE) AS t FROM cand2 JOIN slotted s USING (qid) JOIN slot_rules r ON contains(item_id, r.item) AND CASE r.slot WHEN 'requires_crs' THEN s.requires_crs ELSE s.requires_ductility END GROUP BY ALL),
    moved AS (SELECT *, score + coalesce(g, 0.0::DOUBLE) + coalesce(w, 0.0::DOUBLE) + coalesce(t, 0.0::DOUBLE) AS m FROM cand2 LEFT JOIN by_grade USING (qid, doc_id) LEFT JOIN by_word USING (qid, doc_id) LEFT JOIN by_slot USING (qid, doc_id) JOIN (SELECT qid, special FROM slotted) USING (qid)),
    ended AS (SELECT qid, doc_id, item_id, round(least(0.99::DOUBLE, greatest(0.01::DOUBLE, round(m + CASE WHEN mandated AND m < 0.25 AND (special OR contains(low, 'hot') OR contains(low, 'ring')) THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 6))), 4) AS score FROM moved)
    SELECT qid, doc_id, item_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, CASE WHEN score >= 0.65 THEN 'STRONG' WHEN score >= 0.40 THEN 'MODERATE' WHEN score >= 0.25 THEN 'LOW' ELSE 'INSUFFICIENT' END AS label, score >= 0.40 AS sure FROM ended""")
def contrast_rerank(spark, d):
    found = written(_with_extra(spark, d).join(_catalog(spark, d).select("doc_id", "item_id"), "doc_id"))  # moved by three kinds of rules
    grades, by_slot = spark.createDataFrame(_GRADES, "grade string, item string, weight double"), spark.createDataFrame(_SLOT_RULES, "slot string, item string, weight double")
    negatives = spark.createDataFrame(_NEGATIVES, "kind string, ord int, words array<string>, item string, weight double")
    q = _wanted(spark, d)
    return recommend.contrasted(found, q, grades, negatives, by_slot, slots.slots(q))


@query(O.composite_sql("WHERE c.status = 'ACTIVE' AND contains(lower(c.department), 'brand#1')") + "SELECT qid, doc_id, score, rank FROM composite")
def filtered_search(spark, d):
    q, c = _wanted(spark, d), _catalog(spark, d)
    return ranking.composite(recommend.filtered(ranking.candidates(q, c, keep_history=True), c, F.lit("Brand#1"), "ACTIVE"), q, ranking.named(q, c)).select("qid", "doc_id", "score", "rank")


# Recommendations

_BRANCHES = [("IS_40", "ring", "IS_42"), ("IS_40", "bolt", "IS_43"), ("IS_80", "widget", "IS_82"), ("IS_80", "gear", "IS_83"), ("IS_120", "offer", "IS_122")]
_BRANCH_ROWS = ", ".join(map(str, _BRANCHES))
_TOLD = f"""branches(item_id, keyword, replacement) AS (VALUES {_BRANCH_ROWS}),
    cites AS (SELECT qid, text, CASE WHEN qid % 20 = 6 THEN NULL WHEN qid % 20 = 7 THEN qid + 3 ELSE CASE qid % 5 WHEN 3 THEN NULL WHEN 2 THEN qid + 1000000 WHEN 4 THEN qid - 4 ELSE qid END END AS key FROM fx_asked),
    named AS (SELECT c.*, i.item_id AS cited, i.status FROM cites c LEFT JOIN fx_catalog i ON i.item_key = c.key),
    ways AS (SELECT target AS cited, count(DISTINCT source) AS ways, min(source) AS only_one FROM fx_supersedes WHERE source IN (SELECT item_id FROM fx_catalog) GROUP BY target),
    opened AS (SELECT item_id AS cited, count(DISTINCT replacement) AS branches FROM branches GROUP BY item_id),
    chosen AS (SELECT qid, count(DISTINCT replacement) AS n, min(replacement) AS branch FROM named JOIN branches b ON b.item_id = cited AND contains(lower(text), keyword) GROUP BY qid),
    coded AS (SELECT *, CASE WHEN key IS NULL THEN 'NO_CITATION' WHEN cited IS NULL THEN 'UNINDEXED_CITATION' WHEN NOT (status IN ('SUPERSEDED', 'WITHDRAWN') OR ways IS NOT NULL) THEN 'ACTIVE_STANDARD' WHEN branches IS NOT NULL AND n = 1 THEN 'CONTEXTUAL_BRANCH_SELECTED'
        WHEN branches IS NOT NULL OR ways > 1 THEN 'AMBIGUOUS_BRANCHING' ELSE 'RESOLVED' END AS code FROM named LEFT JOIN ways USING (cited) LEFT JOIN opened USING (cited) LEFT JOIN chosen USING (qid)),
    told AS MATERIALIZED (SELECT qid, text, CASE WHEN key IS NOT NULL THEN concat('IS ', key) END AS raw, cited, code, CASE code WHEN 'ACTIVE_STANDARD' THEN cited WHEN 'CONTEXTUAL_BRANCH_SELECTED' THEN branch WHEN 'RESOLVED' THEN only_one END AS replacement,
        CASE code WHEN 'AMBIGUOUS_BRANCHING' THEN coalesce(branches, ways) WHEN 'CONTEXTUAL_BRANCH_SELECTED' THEN branches - 1 ELSE 0 END AS alternatives FROM coded)"""


def _told(spark, d):
    items = view(spark, d, "fx_catalog")
    chain = spark.createDataFrame([], "node string, end string")
    return recommend.supersession(view(spark, d, "fx_asked"), items, graph.aliases(items), view(spark, d, "fx_supersedes"), spark.createDataFrame(_BRANCHES, "item_id string, keyword string, replacement string"), chain)


@query(with_views("fx_asked", "fx_catalog", "fx_supersedes") + ", " + _TOLD + " SELECT qid, raw, cited, code, replacement, CAST(alternatives AS BIGINT) AS alternatives FROM told")
def supersession_resolution(spark, d):
    return _told(spark, d)


@query(with_views("fx_asked", "fx_catalog", "fx_supersedes") + ", " + _TOLD + """, newer AS (SELECT target, source AS item_id, CASE WHEN source = concat('IS_', replace(target, 'IS_', '')::BIGINT + 2) THEN 'CHRONOLOGICAL_INFERRED' ELSE 'CURATED_UNVERIFIED' END AS level FROM fx_supersedes),
    options AS (SELECT qid, b.replacement AS item_id, t.replacement, 'CURATED' AS level, keyword FROM told t JOIN branches b ON b.item_id = cited WHERE code IN ('RESOLVED', 'AMBIGUOUS_BRANCHING', 'CONTEXTUAL_BRANCH_SELECTED')
        UNION ALL SELECT qid, n.item_id, t.replacement, level, NULL FROM told t JOIN newer n ON n.target = cited WHERE code IN ('RESOLVED', 'AMBIGUOUS_BRANCHING', 'CONTEXTUAL_BRANCH_SELECTED') AND NOT EXISTS (SELECT 1 FROM branches b WHERE b.item_id = cited AND b.replacement = n.item_id)
        UNION ALL SELECT qid, concat('IS_', replace(cited, 'IS_', '')::BIGINT + 5), concat('IS_', replace(cited, 'IS_', '')::BIGINT + 5), 'CHAIN_END', NULL FROM told WHERE code = 'RESOLVED' AND replace(cited, 'IS_', '')::BIGINT % 20 = 10)
    SELECT t.qid, t.code, coalesce(string_agg(concat_ws(' ', o.item_id, CASE WHEN o.item_id = o.replacement THEN 'chosen' END, level, keyword), '; ' ORDER BY o.item_id), '') AS options FROM told t LEFT JOIN options o USING (qid) GROUP BY t.qid, t.code""")
def replacement_options(spark, d):
    """Branches, edges and, for every second withdrawn item, the end of a chain of two links."""
    items, edges = view(spark, d, "fx_catalog"), view(spark, d, "fx_supersedes")
    name = lambda by: F.concat(F.lit("IS_"), (F.col("item_key") + by).cast("string"))
    links = items.where("item_key % 20 = 10").select(F.explode(F.array(F.struct(name(0).alias("node"), name(4).alias("next")), F.struct(name(4).alias("node"), name(5).alias("next")))).alias("l")).select("l.*")
    chain = written(graph.chain_ends(links).select("node", "end"))
    branches = spark.createDataFrame(_BRANCHES, "item_id string, keyword string, replacement string")
    told = written(recommend.supersession(view(spark, d, "fx_asked"), items, graph.aliases(items), edges, branches, chain))
    second = F.col("source") == F.concat(F.lit("IS_"), (F.replace("target", F.lit("IS_"), F.lit("")).cast("long") + 2).cast("string"))
    edges = edges.withColumn("description", F.when(second, "Chronologically supersedes").otherwise("named in a note"))
    said = F.transform("options", lambda o: F.concat_ws(" ", o["item_id"], F.when(o["chosen"], F.lit("chosen")), o["level"], o["keyword"]))
    return recommend.replacement_options(told, edges, branches, chain).select("qid", "code", F.array_join(said, "; ").alias("options"))


_WORDS = [(1, "hot", "heated goods"), (2, "small", "minor")]
_IDIOMS = [(1, r"\b(?:ring|washer)\b", "annular part"), (2, r"\bbeam.*is\b", "beam section"), (3, r"\bred (?:gear|bolt)\b", "red fastener")]
_REWRITTEN = f"""words(ord, pattern, addition) AS (VALUES {', '.join(map(str, _WORDS))}), idioms(ord, pattern, addition) AS (VALUES {', '.join(f"({o}, '{p}', '{a}')" for o, p, a in _IDIOMS)}),
    more AS (SELECT qid, string_agg(w.addition, ' ' ORDER BY w.ord) AS added FROM told JOIN words w ON contains(lower(text), pattern) GROUP BY qid), phrases AS (SELECT qid, string_agg(i.addition, ' ' ORDER BY i.ord) AS added FROM told JOIN idioms i ON regexp_matches(lower(text), pattern) GROUP BY qid),
    rewritten AS MATERIALIZED (SELECT t.qid, concat_ws(' ', CASE WHEN code IN ('RESOLVED', 'CONTEXTUAL_BRANCH_SELECTED') THEN r.item_no END, t.text, m.added, p.added) AS text, t.text AS raw_text FROM told t LEFT JOIN fx_catalog r ON r.item_id = replacement LEFT JOIN more m USING (qid) LEFT JOIN phrases p USING (qid))"""


def _rewritten(spark, d, told):
    words, idioms = spark.createDataFrame(_WORDS, "ord int, pattern string, addition string"), spark.createDataFrame(_IDIOMS, "ord int, pattern string, addition string")
    return recommend.rewritten(view(spark, d, "fx_asked"), told, words, idioms, view(spark, d, "fx_catalog"))


@query(with_views("fx_asked", "fx_catalog", "fx_supersedes") + ", " + _TOLD + ", " + _REWRITTEN + " SELECT qid, text, raw_text FROM rewritten")
def query_rewriting(spark, d):
    return _rewritten(spark, d, _told(spark, d))


_DOMAINS = [(1, "ring", 1, "sealing"), (1, "ring", 2, "retaining"), (2, "bolt", 1, "structural"), (2, "bolt", 2, "machine"), (3, "hot", 1, "heat")]


@query(with_views("fx_asked") + f""", domains(ord, word, option_ord, option) AS (VALUES {', '.join(map(str, _DOMAINS))}), short AS (SELECT qid, lower(text) AS low FROM fx_asked WHERE len(string_split(trim(text), ' ')) <= 3),
    hits AS (SELECT qid, min_by(word, ord) AS domain FROM short JOIN domains ON contains(low, word) GROUP BY qid) SELECT qid, domain, (SELECT string_agg(option, ' | ' ORDER BY option_ord) FROM domains WHERE word = domain) AS options FROM hits""")
def broad_terms(spark, d):
    return recommend.broad(view(spark, d, "fx_asked"), spark.createDataFrame(_DOMAINS, "ord int, word string, option_ord int, option string"))


_TENDER_ITEMS = """asked AS (SELECT doc_id AS qid, text FROM fx_tenders)"""
_APPLIED = ", ".join(f"CASE WHEN {c} THEN '{r.rule_id}' END" for r, c in zip(_RULES, O.rule_sql(_RULES)))
_CLAUSES = ", ".join(f"CASE WHEN {c} THEN '{r.clause}' END" for r, c in zip(_RULES, O.rule_sql(_RULES)))


@query(O.composite_sql(views=with_views("fx_lines", "fx_tenders", "fx_catalog"), asked=_TENDER_ITEMS, rules=_RULES) + f""", met AS (SELECT qid, doc_id, {O.bonus_sql(_RULES)} AS bonus, concat_ws('; ', {_APPLIED}) AS rules, concat_ws('; ', {_CLAUSES}) AS clauses
    FROM fused JOIN cat c USING (doc_id) JOIN slotted s USING (qid) WHERE c.status NOT IN ('SUPERSEDED', 'WITHDRAWN')) SELECT * FROM met WHERE rules <> ''""")
def constraint_bonus(spark, d):
    """Every rule on the candidates of every tender; tenders that no rule asks about aren't searched, and those that ask for the same are searched once."""
    tenders, items = view(spark, d, "fx_tenders").select(F.col("doc_id").alias("qid"), "text"), _catalog(spark, d)
    recurring = view(spark, d, "fx_lines").select("phrase").limit(1000).groupBy("phrase").count().where("phrase is not null and count > 1")
    found = retrieval.index(items.select("doc_id", "text"))
    tenders = slots.read_in_pieces(tenders, " ; ", [r.phrase for r in recurring.collect()], lambda words: retrieval.without_text(words, found))
    asked = constraints.concerned(slots.slots(tenders, "found"), "qid", "words", rules=_RULES)
    members = retrieval.alike(written(asked), found)
    out = constraints.evaluated_alike(ranking.candidates_alike(members, items, found), members, _RULES)
    said = lambda k: F.array_join(F.transform("applied", lambda r: r[k]), "; ")
    return out.select("qid", "doc_id", "bonus", said("rule_id").alias("rules"), said("clause").alias("clauses"))


_AT = "CASE qid % 3 WHEN 0 THEN DATE '1996-06-30' WHEN 1 THEN DATE '1998-01-01' ELSE DATE '2024-01-01' END"
_VERDICTS = O.composite_sql(
    views=with_views("fx_asked", "fx_catalog", "fx_supersedes", "fx_orders") + ", " + _GOVERNING + ", own AS (SELECT item_id, evaluation_date, order_id, temporal_status FROM placed WHERE place = 1), " + _TOLD + ", " + _REWRITTEN, asked="asked AS (SELECT qid, text FROM rewritten)", rules=_RULES,
    mandated="o.temporal_status = 'MANDATORY_IN_FORCE'", joins=f"LEFT JOIN own o ON o.item_id = c.item_id AND o.evaluation_date = {_AT}",
) + """, replaced AS (SELECT * FROM told WHERE code IN ('RESOLVED', 'CONTEXTUAL_BRANCH_SELECTED') AND cited IS NOT NULL),
    gone AS (SELECT qid, item_key AS doc_id FROM replaced JOIN fx_catalog ON item_id = cited UNION SELECT qid, item_key FROM replaced JOIN fx_catalog ON item_id = replacement),
    every AS (SELECT qid, item_key AS doc_id, 0.99::DOUBLE AS score, true AS grounded FROM replaced JOIN fx_catalog ON item_id = replacement UNION ALL SELECT qid, doc_id, score, grounded FROM composite ANTI JOIN gone USING (qid, doc_id)),
    best AS (SELECT qid, count(*) AS n, min_by(doc_id, (-score, doc_id)) AS doc_id, max(score) AS score, min_by(grounded, (-score, doc_id)) AS grounded FROM every GROUP BY qid),
    verdicts AS (SELECT qid, t.code, t.cited, t.replacement, CASE WHEN code = 'AMBIGUOUS_BRANCHING' THEN 'NEEDS_CONTEXT' WHEN b.doc_id IS NOT NULL THEN CASE WHEN grounded AND score >= 0.40 THEN 'RECOMMENDED' ELSE 'NEEDS_CLARIFICATION' END WHEN cited IS NOT NULL THEN 'NO_ACTIVE_STANDARD_FOUND' ELSE 'NO_MATCH' END AS status,
        CASE WHEN code <> 'AMBIGUOUS_BRANCHING' THEN b.doc_id END AS doc_id, CASE WHEN code <> 'AMBIGUOUS_BRANCHING' THEN b.score END AS score, CASE WHEN code <> 'AMBIGUOUS_BRANCHING' THEN coalesce(n, 0) ELSE 0 END AS candidates FROM told t LEFT JOIN best b USING (qid)),
    answers AS (SELECT v.*, o.order_id, o.temporal_status, coalesce(o.temporal_status = 'MANDATORY_IN_FORCE', false) AS mandatory FROM verdicts v LEFT JOIN own o ON o.item_id = concat('IS_', v.doc_id) AND o.evaluation_date = """ + _AT + ") "


def _verdicts(spark, d, told, governed):
    turn = F.col("qid") % 3
    asked = view(spark, d, "fx_asked").withColumn("evaluation_date", F.to_date(F.when(turn == 0, DATES[0]).when(turn == 1, DATES[1]).otherwise(DATES[2])))
    return recommend.recommended(asked, _catalog(spark, d), told, _rewritten(spark, d, told), governed, _RULES)


@query(_VERDICTS + "SELECT qid, status, doc_id, score, candidates, order_id, temporal_status, mandatory FROM answers")
def recommendations(spark, d):
    return _verdicts(spark, d, written(_told(spark, d)), _governed(spark, d))


@query(_VERDICTS + """SELECT count(*) AS cases, round(count(*) FILTER (code = 'ACTIVE_STANDARD' AND doc_id = replace(answers.cited, 'IS_', '')::BIGINT) / nullif(count(*) FILTER (code = 'ACTIVE_STANDARD'), 0), 6) AS retrieval_accuracy,
    round(count(*) FILTER (doc_id % 10 < 2) / nullif(count(*) FILTER (doc_id IS NOT NULL), 0), 6) AS obsolete_as_primary, round(count(*) FILTER (qid % 20 = 1 AND code = 'RESOLVED') / nullif(count(*) FILTER (qid % 20 = 1), 0), 6) AS supersession_detection,
    round(count(*) FILTER (qid % 20 = 1 AND replacement = concat('IS_', qid + 1)) / nullif(count(*) FILTER (qid % 20 = 1), 0), 6) AS replacement_accuracy, round(count(*) FILTER (qid % 20 IN (0, 4) AND status = 'NEEDS_CONTEXT') / nullif(count(*) FILTER (qid % 20 IN (0, 4)), 0), 6) AS branching_safety,
    round(count(*) FILTER (code = 'ACTIVE_STANDARD' AND temporal_status = named_status) / nullif(count(*) FILTER (code = 'ACTIVE_STANDARD' AND named_status IS NOT NULL), 0), 6) AS temporal_accuracy, round(count(*) FILTER (qid % 20 IN (6, 7) AND status <> 'RECOMMENDED') / nullif(count(*) FILTER (qid % 20 IN (6, 7)), 0), 6) AS abstention FROM answers LEFT JOIN (SELECT item_id AS cited, evaluation_date, temporal_status AS named_status FROM own) n ON n.cited = answers.cited AND n.evaluation_date = """ + _AT)
def verdict_metrics(spark, d):
    told, governed = written(_told(spark, d)), written(_governed(spark, d))
    last, turn = F.col("qid") % 20, F.col("doc_id") % 10
    date = F.to_date(F.when(F.col("qid") % 3 == 0, DATES[0]).when(F.col("qid") % 3 == 1, DATES[1]).otherwise(DATES[2]))
    said = told.select("qid", "code", "cited", "replacement", date.alias("evaluation_date")).join(governed.select(F.col("item_id").alias("cited"), "evaluation_date", F.col("temporal_status").alias("named_status")), ["cited", "evaluation_date"], "left")
    cases = _verdicts(spark, d, told, governed).join(said, "qid").select(
        "status", "doc_id", "replacement", F.when(F.col("code") == "ACTIVE_STANDARD", F.replace("cited", F.lit("IS_"), F.lit("")).cast("long")).alias("expected"), (turn < 2).alias("obsolete_first"),
        (last == 1).alias("expect_supersession"), (F.col("code") == "RESOLVED").alias("superseded"), F.when(last == 1, F.concat(F.lit("IS_"), (F.col("qid") + 1).cast("string"))).alias("expected_replacement"),
        last.isin(0, 4).alias("expect_context"), last.isin(6, 7).alias("expect_abstention"), "temporal_status", F.when(F.col("code") == "ACTIVE_STANDARD", F.col("named_status")).alias("expected_temporal"),
    )
    return recommend.verdict_metrics(cases)
