"""Catalogue-like views of the star-schema tables: the same SQL for Spark and for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_DAY, _MONTH, _YEAR = "CAST(day(o_orderdate) AS STRING)", "CAST(month(o_orderdate) AS STRING)", "CAST(year(o_orderdate) AS STRING)"
_WORD = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST((month(o_orderdate) - 1) * 3 + 1 AS INT), 3)"
_PHRASES = [
    "supply of tmt rebar conforming to IS 2062:2006 grade", "structural steel as per IS 2062 : 2011 with tensile test and bend test", "pipes of recycled hdpe for drinking water", "material to ASTM A36 or similar is accepted",
    "castings to DIN 1629 or IS 432 Part 1 bars", "only primary producers with blast furnace route", "supplies without BIS certification are allowed", "all goods bear the ISI mark under a valid license", "sampling as per IS 1608 (Part 1):2018",
    "commercial quality sheet", "cement bag to IS 269-2013 for a bridge in coastal area", "transformer near zone iv",
]
_PHRASE = "CASE (l_partkey + l_linenumber) % 13 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " ELSE concat('parts to IS ', CAST(l_partkey AS STRING)) END"

# Documents made of catalogue rows; what they say follows from the key, so an oracle needn't read them.
_REFERENCES = """CASE p_partkey % 4 WHEN 0 THEN concat('2 REFERENCES', chr(10), 'IS ', p_partkey + 2, ' (Part 1):1998 Methods of test', chr(10), 'IS ', p_partkey + 3, ' Code of practice', chr(10), 'IS ', p_partkey, ' itself', chr(10))
        WHEN 1 THEN concat('2 NORMATIVE REFERENCES', chr(10), 'IS No. Title', chr(10), p_partkey + 1000, ':2005 Tensile testing', chr(10), p_partkey + 2000, ' Terms', chr(10), '1989 ', chr(10))
        WHEN 2 THEN concat('Clause 2 REFERENCES', chr(10), 'see IS ', p_partkey + 4, ':2011 for sieve analysis', chr(10)) ELSE concat('Free of references, superseding IS ', p_partkey + 9, chr(10)) END"""
_LETTERS = "CASE c_custkey % 11 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(["\u0915\u0916", "\u0995", "\u0a95", "\u0b95", "\u0c15", "\u0c95", "\u0d15", "\u0a15", "\u0b15"], 1)) + " ELSE '' END"

SQL: dict[str, str] = {
    "fx_catalog": """SELECT concat('IS_', CAST(p_partkey AS STRING)) AS item_id, concat('IS ', CAST(p_partkey AS STRING)) AS item_no, concat(p_name, ' ', p_type) AS title, p_brand AS department,
        CAST(1950 + p_size AS INT) AS year, CASE WHEN p_partkey % 10 = 0 THEN 'WITHDRAWN' WHEN p_partkey % 10 = 1 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status, split(p_name, ' ') AS keywords, p_partkey AS item_key FROM part""",
    "fx_revisions": f"""SELECT concat('IS_', CAST(o_custkey AS STRING), '_', {_YEAR}, '_', CAST(o_orderkey AS STRING)) AS rev_id, concat('IS ', CAST(o_custkey AS STRING), ':', {_YEAR}) AS rev_no,
        concat('IS ', CAST(o_custkey AS STRING)) AS base, CAST(year(o_orderdate) AS INT) AS year FROM orders""",
    "fx_orders": f"""SELECT concat('ORD_', CAST(o_orderkey AS STRING)) AS order_id, o_orderkey AS order_no, concat('IS_', CAST(o_custkey AS STRING)) AS item_id,
        concat('Quality Order ', CAST(o_orderkey % 4 AS STRING)) AS order_name, CASE o_orderkey % 6
        WHEN 0 THEN concat({_YEAR}, '-', lpad({_MONTH}, 2, '0'), '-', lpad({_DAY}, 2, '0')) WHEN 1 THEN concat({_DAY}, '-', {_MONTH}, '-', {_YEAR}) WHEN 2 THEN concat({_DAY}, '/', {_MONTH}, '/', {_YEAR})
        WHEN 3 THEN concat({_DAY}, 'th ', {_WORD}, ' ', {_YEAR}) WHEN 4 THEN 'd 04' ELSE concat('rescinded on ', {_DAY}, '.', {_MONTH}, '.', {_YEAR}) END AS effective_raw, o_orderdate FROM orders""",
    "fx_citations": f"""SELECT o_orderkey AS cite_id, CASE o_orderkey % 8 WHEN 0 THEN concat('IS  ', CAST(o_custkey AS STRING)) WHEN 1 THEN concat('IS ', CAST(o_custkey AS STRING), ' : ', {_YEAR})
        WHEN 2 THEN concat('IS ', CAST(o_custkey AS STRING), ' (Part ', CAST(o_orderkey % 5 + 1 AS STRING), '):', {_YEAR}) WHEN 3 THEN concat('IS ', CAST(o_custkey AS STRING), ' Part II')
        WHEN 4 THEN CAST(o_custkey + 10 AS STRING) WHEN 5 THEN concat('IS ', CAST(o_custkey AS STRING), ' ', {_YEAR}) WHEN 6 THEN concat('lEC ', CAST(o_custkey AS STRING), ':', {_YEAR}, '.')
        ELSE concat('IS ', CAST(o_custkey AS STRING), ' (all parts)') END AS raw FROM orders""",
    "fx_lines": f"""SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey, l_suppkey, {_PHRASE} AS phrase FROM lineitem""",
    "fx_edges": """SELECT source, target, relationship, source_type, target_type, description, priority FROM (
        SELECT concat('IS_', CAST(l_partkey AS STRING)) AS source, concat('SUP_', CAST(l_suppkey AS STRING)) AS target, 'MANDATED_BY' AS relationship, 'standard' AS source_type, 'order' AS target_type,
            concat('order ', CAST(l_orderkey AS STRING)) AS description, 0 AS priority FROM lineitem
        UNION ALL SELECT concat('IS_', CAST(l_partkey AS STRING)), concat('IS_', CAST(following AS STRING)), CASE WHEN l_quantity > 40 THEN 'TESTED_BY' ELSE 'NORMATIVE_REF' END, 'standard', 'standard', concat('line ', CAST(l_linenumber AS STRING)), 1
            FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS following FROM lineitem) x WHERE following IS NOT NULL) e""",
    "fx_reports": f"""SELECT concat('IS_', p_partkey) AS item_id, concat('IS ', p_partkey) AS item_no, p_partkey AS item_key, p_name AS title, concat('IS ', p_partkey, ':', 1950 + p_size, chr(10), '1 SCOPE', chr(10), 'This standard covers ', p_name, chr(10), 'of the kind ', p_type, chr(10), chr(10),
        {_REFERENCES}, '3 TERMINOLOGY', chr(10), 'IS ', p_partkey + 6, ' is outside', chr(10)) AS text, 1950 + p_size AS year FROM part""",
    "fx_records": """SELECT p_partkey AS item_key, concat('Division Name: ', p_brand, ' Section Name: ', p_type, CASE WHEN p_partkey % 2 = 0 THEN concat(' (CED ', p_partkey % 60, ')') ELSE '' END, ' Designator of Legally Binding Document: ', CASE WHEN p_partkey % 3 = 0 THEN 'IS ' ELSE '' END,
        p_partkey, ' Title of Legally Binding Document: ', p_name, chr(10), CASE WHEN p_partkey % 5 > 0 THEN concat('Number of Amendments: ', p_partkey % 5, chr(10)) ELSE '' END,
        CASE p_partkey % 4 WHEN 0 THEN concat('Superceded by: IS ', p_partkey + 1, '.') WHEN 1 THEN 'Superceded by: None' WHEN 2 THEN 'now withdrawn' ELSE '' END, chr(10), 'ICS Code: 77.', p_partkey % 90) AS description FROM part""",
    "fx_regulations": """SELECT concat('IS ', p_partkey) AS item_no, CASE source WHEN 1 THEN upper(p_name) ELSE p_name END AS product, concat('Order ', source, ' of ', p_brand) AS order_name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('Ministry ', p_partkey % 13) END AS ministry,
        CASE source WHEN 0 THEN 'Scheme-X' WHEN 1 THEN 'Scheme-II (CRS)' ELSE 'Scheme-I' END AS scheme, source, p_partkey AS item_key FROM (SELECT *, 0 AS source FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT *, 1 FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT *, 2 FROM part WHERE p_partkey % 2 = 0) x""",
    "fx_tables": """SELECT p_partkey AS page_id, concat('<table class="a"><tr><th>Sr</th><th>No</th></tr><tr><td>Group ', p_brand, '</td></tr><tr><td>1</td><td>IS ', p_partkey, '</td><td><b>', p_name, '</b></td><td>Order dated 1.2.20', 10 + p_size % 50, '</td></tr><tr><td>2</td><td>',
        p_partkey + 1, '*</td><td>second&nbsp;thing</td></tr><tr><td>Group B</td></tr><TR><td>3</td><td>IS ', p_partkey + 2, '</td><td>third</td></TR></table>') AS html FROM part""",
    "fx_letters": f"SELECT c_custkey, concat(c_name, {_LETTERS}) AS text FROM customer",
    "fx_supersedes": """SELECT concat('IS_', p_partkey + 1) AS source, concat('IS_', p_partkey) AS target, 'SUPERSEDES' AS relationship FROM part WHERE p_partkey % 10 = 1
        UNION ALL SELECT concat('IS_', p_partkey + 2), concat('IS_', p_partkey), 'SUPERSEDES' FROM part WHERE p_partkey % 20 = 0 UNION ALL SELECT concat('IS_', p_partkey + 3), concat('IS_', p_partkey), 'SUPERSEDES' FROM part WHERE p_partkey % 20 = 0""",
    "fx_asked": """SELECT p_partkey AS qid, CASE WHEN p_partkey % 20 = 6 THEN concat('zzqx', p_partkey) WHEN p_partkey % 20 = 7 THEN concat('IS ', p_partkey + 3) ELSE CASE p_partkey % 5 WHEN 0 THEN concat('offer IS ', p_partkey, ' ', p_name) WHEN 1 THEN concat('IS ', p_partkey, ' for ', p_name) WHEN 2 THEN concat('IS ', p_partkey + 1000000, ' unknown') WHEN 3 THEN p_name ELSE concat(p_name, ' beam IS ', p_partkey - 4) END END AS text FROM part WHERE p_partkey % 20 < 8""",
    "fx_queries": "SELECT item_id AS qid, text FROM benchmark",
    "fx_turns": "SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE role = 'user'",
}

TENDERS_SQL = "fx_tenders AS (SELECT doc_id, string_agg(phrase, ' ; ' ORDER BY line, l_partkey, l_suppkey) AS text FROM fx_lines GROUP BY doc_id)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, from the tables that its SQL names."""
    if name == "fx_tenders":
        # Phrases follow from keys, so only keys travel.
        phrase = _PHRASE.replace("l_partkey", "x.l_partkey").replace("l_linenumber", "x.l_linenumber")
        return spark.sql(f"SELECT l_orderkey AS doc_id, array_join(transform(sort_array(collect_list(struct(l_linenumber, l_partkey, l_suppkey))), x -> {phrase}), ' ; ') AS text FROM {{fx}} GROUP BY l_orderkey", fx=table(spark, sf_dir, "lineitem"))
    sql = SQL[name]
    for base in ("part", "orders", "lineitem", "benchmark", "conversations", "customer"):
        if re.search(rf"FROM {base}\b", sql):
            return spark.sql(re.sub(rf"FROM {base}\b", "FROM {base}", sql), base=table(spark, sf_dir, base))
    raise KeyError(name)


def with_views(*names: str) -> str:
    """The views as the start of an oracle's WITH clause."""
    parts = [f"{n} AS ({SQL[n]})" if n in SQL else TENDERS_SQL for n in names]
    return "WITH RECURSIVE " + ",\n".join(parts)
