"""Parts of oracle SQL (DuckDB) that several queries share, and rules tables for both sides."""

from __future__ import annotations

from ..functions.text import STOPWORDS
from ..operators.slots import CORROSION, EXPOSURE, GRADES, INFRASTRUCTURE, SEISMIC
from .fixtures import with_views

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens_sql(text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    for pattern, put in ((r"\bis\s+(\d+)\b", r"is_\1"), (r"\bis/iso\s+(\d+)\b", r"is_iso_\1"), (r"\bis/iec\s+(\d+)\b", r"is_iec_\1"), (r"\bfe\s+(\d+[a-z]?)\b", r"fe_\1")):
        t = f"regexp_replace({t}, '{pattern}', '{put}', 'g')"
    return rf"list_filter(regexp_split_to_array({t}, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z0-9_]{{2,}}') AND w NOT IN ({_STOP}))"


TOKENS = f"WITH docs AS (SELECT doc_id, {tokens_sql('text')} AS words FROM documents) "


def bm25_sql(corpus: str, queries: str, start: str) -> str:
    """CTEs docs, asked_words, bm25; ends with a comma-less CTE list."""
    return start + f"""docs AS (SELECT doc_id, {tokens_sql('text')} AS words FROM ({corpus})), asked_words AS (SELECT qid, {tokens_sql('text')} AS words FROM ({queries})),
size AS (SELECT count(*) AS n, avg(len(words)) AS mean_len FROM docs),
posts AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM docs) GROUP BY doc_id, term),
raw_idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM posts GROUP BY term) CROSS JOIN size),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf FROM raw_idf),
terms AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(words) AS term FROM asked_words) GROUP BY qid, term),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean_len))), 6) AS score
  FROM terms JOIN posts USING (term) JOIN idf USING (term) CROSS JOIN size GROUP BY qid, doc_id) WHERE score > 0) WHERE rank <= 100)"""


_DOCS, _ASKED = "SELECT doc_id, text FROM documents", "SELECT item_id AS qid, text FROM benchmark"

def _grams(words: str, key: str) -> str:
    """Words and pairs of neighbours as rows."""
    flat = f"SELECT {key}, unnest(words) AS w, unnest(range(len(words))) AS i FROM {words}"
    return f"(SELECT {key}, w AS term FROM ({flat}) UNION ALL SELECT {key}, concat(w, ' ', nw) FROM (SELECT {key}, w, lead(w) OVER (PARTITION BY {key} ORDER BY i) AS nw FROM ({flat})) WHERE nw IS NOT NULL)"


TFIDF = f"""posts2 AS (SELECT doc_id, term, count(*) AS tf FROM {_grams('docs', 'doc_id')} GROUP BY ALL),
vocabulary AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS freq FROM posts2 GROUP BY term ORDER BY freq DESC, term LIMIT 40000) CROSS JOIN size),
dw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM posts2 JOIN vocabulary USING (term))),
qw AS (SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM (SELECT qid, term, (1 + ln(count(*))) * any_value(idf) AS w FROM {_grams('asked_words', 'qid')} JOIN vocabulary USING (term) GROUP BY qid, term)),
tfidf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round(sum(dw.w * qw.w), 6) AS score FROM qw JOIN dw USING (term) GROUP BY qid, doc_id) WHERE score > 0) WHERE rank <= 100) """
FUSED = """, fused AS (SELECT qid, doc_id, a.rank AS rank_a, b.rank AS rank_b, a.score AS score_a, b.score AS score_b, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 6) AS score FROM bm25 a FULL JOIN tfidf b USING (qid, doc_id)) """


class _Bm25(str):
    """Joins with a following SELECT or with further CTEs."""

    def __add__(self, more: str) -> str:
        return str(self) + (", " + more if more.lstrip().split(" ", 1)[0].lower() != "select" else " " + more)


BM25 = _Bm25(bm25_sql(_DOCS, _ASKED, "WITH "))

# Citations

#: The notations are known by their number, so the oracle writes the result down instead of parsing.
CITATION_FORMS = with_views("fx_citations") + """ SELECT o_orderkey AS cite_id, CASE o_orderkey % 8 WHEN 0 THEN concat('IS ', o_custkey) WHEN 1 THEN concat('IS ', o_custkey, ':', year(o_orderdate)) WHEN 2 THEN concat('IS ', o_custkey, ' (Part ', o_orderkey % 5 + 1, '):', year(o_orderdate))
    WHEN 3 THEN concat('IS ', o_custkey, ' (Part 2)') WHEN 4 THEN concat('IS ', o_custkey + 10) WHEN 5 THEN concat('IS ', o_custkey, ':', year(o_orderdate)) WHEN 6 THEN concat('IEC ', o_custkey, ':', year(o_orderdate)) ELSE concat('IS ', o_custkey) END AS citation FROM orders"""

#: Citations in tenders, in one way; all numbers stand alone in these texts, so no look-ahead is needed.
_RAW = r"(?i)\b(?:IS\s+\d+(?:\s*\(Part\s*\d+\)|\s*Part\s*\d+)?(?:\s*[-:]?\s*(?:19|20)\d\d)?|ASTM\s+[A-Z0-9-]+|DIN\s+\d+)"
_ONE_WAY = r"regexp_replace(regexp_replace(unnest(found), '(\d)\s*[-:]\s*(\d{4})$', '\1:\2'), '\s*\(?Part\s*(\d+)\)?', ' (Part \1)')"
CITED = rf"""single AS MATERIALIZED (SELECT doc_id, c, min(i) AS i FROM (SELECT doc_id, {_ONE_WAY} AS c, unnest(range(len(found))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_RAW}', 0) AS found FROM fx_tenders)) GROUP BY doc_id, c),
part_of AS (SELECT DISTINCT a.doc_id, a.c FROM single a JOIN single b ON a.doc_id = b.doc_id AND b.c <> a.c AND starts_with(b.c, a.c) AND contains(b.c, '(Part')),
lists AS (SELECT doc_id, list(c ORDER BY i) AS cited FROM single ANTI JOIN part_of USING (doc_id, c) GROUP BY doc_id),
cited AS MATERIALIZED (SELECT t.doc_id, t.text, coalesce(l.cited, []) AS cited FROM fx_tenders t LEFT JOIN lists l USING (doc_id))"""

_has = lambda words: "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"
_GROUP = """CASE WHEN contains(low, 'steel') OR contains(low, 'rebar') OR contains(low, 'tmt') THEN 'steel' WHEN contains(low, 'laptop') OR contains(low, 'computer') OR contains(low, 'battery') THEN 'electronics'
  WHEN contains(low, 'solar') AND (contains(low, 'module') OR contains(low, 'pv')) THEN 'solar' WHEN contains(low, 'safety shoe') OR contains(low, 'safety footwear') THEN 'footwear' WHEN contains(low, 'hdpe') AND contains(low, 'pipe') THEN 'polyethylene' END"""
_EXEMPT = ["without bis", "without isi", "secondary re-rollers without", "bis certification not required"]
_MANDATED = ["bis standard mark", "isi mark", "bis license", "bis licence", "compulsory registration", "crs", "r-number", "qco", "scheme-i", "scheme-ii"]
#: Findings; laws (base, order_name) and old (item_no, replacement) are CTEs of the query.
FINDINGS = f"""old AS (SELECT item_no, CASE WHEN item_key % 10 = 1 THEN concat('IS ', item_key + 1) END AS replacement FROM fx_catalog WHERE status <> 'ACTIVE'),
laws AS (SELECT item_no AS base, concat('Order of ', department) AS order_name FROM fx_catalog WHERE item_key % 6 = 5),""" + CITED + f""", flat AS (SELECT doc_id, unnest(cited) AS c, unnest(range(len(cited))) AS i FROM cited),
law AS (SELECT doc_id, min_by(order_name, i) AS order_name FROM flat JOIN laws ON base = trim(split_part(c, ':', 1)) GROUP BY doc_id),
base AS (SELECT c.*, order_name, lower(text) AS low FROM cited c LEFT JOIN law USING (doc_id)), ruled AS MATERIALIZED (SELECT *, coalesce(order_name, {_GROUP}) AS grp, {_has(_EXEMPT)} AS exempt,
  concat_ws(', ', CASE WHEN NOT (contains(text, '1608') OR contains(low, 'tensile test')) THEN 'IS 1608' END, CASE WHEN NOT (contains(text, '1599') OR contains(low, 'bend test')) THEN 'IS 1599' END,
    CASE WHEN NOT (contains(text, '1757') OR {_has(['charpy', 'impact'])}) AND {_has(['bridge', 'joist', 'truss'])} THEN 'IS 1757' END) AS missing,
  regexp_extract_all(text, '(?i)\\b(?:ASTM\\s+[A-Z0-9-]+|DIN\\s+\\d+)', 0) AS foreigners, contains(low, 'recycled') AND {_has(['hdpe', 'water', 'drinking'])} AS recycled FROM base),
findings AS (SELECT doc_id, 'ILLEGAL_QCO_EXEMPTION' AS issue_type, 35 AS penalty, grp AS snippet, NULL::VARCHAR AS remedy FROM ruled WHERE grp IS NOT NULL AND exempt
  UNION ALL SELECT doc_id, 'MISSING_QCO_MANDATE', 25, grp, NULL FROM ruled WHERE grp IS NOT NULL AND NOT exempt AND NOT {_has(_MANDATED)}
  UNION ALL SELECT doc_id, 'MISSING_TEST_STANDARDS', 10, missing, NULL FROM ruled WHERE missing <> '' AND len(list_filter(cited, lambda c: contains(c, 'IS 2062'))) > 0
  UNION ALL SELECT doc_id, 'FOREIGN_STANDARD_DISCRIMINATION', 15, array_to_string(foreigners, ', '), NULL FROM ruled WHERE len(foreigners) > 0 AND len(list_filter(cited, lambda c: regexp_matches(c, '^IS[ /]'))) = 0
  UNION ALL SELECT doc_id, 'VAGUE_SPECIFICATION', 15, 'recycled polymer', NULL FROM ruled WHERE recycled
  UNION ALL SELECT doc_id, 'VAGUE_SPECIFICATION', 15, 'no virgin polyethylene', NULL FROM ruled WHERE recycled AND NOT contains(text, '7328')
  UNION ALL SELECT doc_id, 'VAGUE_SPECIFICATION', 15, 'commercial quality', NULL FROM ruled WHERE {_has(['commercial quality', 'ordinary quality'])}
  UNION ALL SELECT doc_id, 'SUPERSEDED_STANDARD', 22, c, coalesce(CASE WHEN contains(c, '2062:2006') THEN 'IS 2062:2011' WHEN contains(c, '432') AND (contains(lower(c), 'part 1') OR contains(c, '1982')) THEN 'IS 1786 / IS 2062' END, replacement, 'current edition')
    FROM flat LEFT JOIN old ON item_no = trim(split_part(c, ':', 1)) WHERE contains(c, '2062:2006') OR (contains(c, '432') AND (contains(lower(c), 'part 1') OR contains(c, '1982'))) OR item_no IS NOT NULL)"""

RISKS = f"""flags AS (SELECT doc_id, regexp_matches(low, '\\b(blast furnace|primary producers?|integrated steel plant|integrated producers?)\\b')
    AND regexp_matches(low, '\\b(only primary|primary.*only|only.*blast furnace|blast furnace.*only|without technical justification|all bidders must be primary|only sail|tata/jsw)\\b') AS a,
  regexp_matches(low, '\\b(astm\\s+[a-z]?\\s*\\d+|din\\s+\\d+|en\\s+\\d+|bs\\s+\\d+|iso\\s+\\d+)\\b') AND NOT regexp_matches(low, '\\b(or equivalent is|or equivalent indian standard|conforming to is)\\b') AS b, regexp_matches(low, '\\bis\\s+2062\\s*:\\s*(?:1999|2006)\\b') AS c,
  {_has(["tmt", "rebar", "structural steel", "hdpe pipe", "distribution transformer", "safety helmet"])} AND NOT regexp_matches(low, '\\b(isi mark|bis certification mark|cm/l|license)\\b') AS d FROM (SELECT doc_id, lower(text) AS low FROM fx_tenders)),
risks AS (SELECT doc_id, concat_ws(',', CASE WHEN a THEN 'COMPETITION_RESTRICTION' END, CASE WHEN b THEN 'PUBLIC_PROCUREMENT_MII_VIOLATION' END, CASE WHEN c THEN 'OBSOLETE_SPECIFICATION' END, CASE WHEN d THEN 'CRIMINAL_STATUTORY_NON_COMPLIANCE' END) AS risks, score,
  CASE WHEN score >= 90 THEN 'WATERTIGHT' WHEN score >= 70 THEN 'MODERATE' ELSE 'HIGH' END AS rating FROM (SELECT *, greatest(10, 100 - 25 * a::INT - 20 * b::INT - 20 * c::INT - 25 * d::INT) AS score FROM flags))"""

# Slots

RULES = [("r1", "1786", "exposure", "severe", 0.35), ("r2", "1786", "corrosion", "marine_coastal", 0.35), ("r3", "13920", "seismic", "zone iv", 0.65), ("r4", "456", "infrastructure", "bridge", 0.25), ("r5", "2062", "infrastructure", "bridge", 0.25), ("r6", "4984", "infrastructure", "water_supply", 0.40), ("r7", "458", "infrastructure", "water_supply", -0.50)]
RULE_ROWS = ", ".join(map(str, RULES))
VOCABULARY = [(1, "tmt rebar", "high strength deformed bars IS 1786"), (2, "structural steel", "rolled structural steel IS 2062"), (3, "cement bag", "portland cement IS 269"), (4, "hdpe", "polyethylene pipes IS 4984"), (5, "transformer", "distribution transformers IS 1180")]
VOCABULARY_ROWS = ", ".join(map(str, VOCABULARY))


RATES = [("steel", 1, "tmt rebar"), ("section", 2, "structural steel"), ("cement", 3, "cement bag"), ("power", 4, "transformer")]
RATE_ROWS = ", ".join(map(str, RATES))
FAMILIES = [("hundreds", 1, "IS 10"), ("twenties", 2, "IS 2"), ("long", 3, "IS 77 and more")]
FAMILY_ROWS = ", ".join(map(str, FAMILIES))
WEIGHTS = [(1, "is 3", "IS 3", 0.35), (2, "is 30", "IS 30", -0.5), (3, "is 6", "IS 6", 0.3), (4, "is 12", "IS 12", -0.2)]
WEIGHT_ROWS = ", ".join(map(str, WEIGHTS))


def _classes(classes: list[tuple[str, list[str]]]) -> str:
    return "CASE " + " ".join(rf"WHEN regexp_matches(low, '\b(?:{'|'.join(words)})\b') THEN '{name}'" for name, words in classes) + " END"


def slots_sql(source: str) -> str:
    grades = "CASE " + " ".join(f"WHEN contains(low, '{words[0]}') THEN '{name}'" for name, words in GRADES) + " END"
    return rf"""SELECT *, exposure IS NOT NULL OR seismic IS NOT NULL OR corrosion IS NOT NULL OR infrastructure IS NOT NULL OR requires_crs OR requires_ductility AS special FROM
    (SELECT *, coalesce(corrosion = 'marine_coastal', false) OR coalesce(exposure IN ('severe', 'very severe', 'extreme'), false) AS requires_crs, coalesce(seismic IN ('zone iv', 'zone v'), false) OR coalesce(infrastructure IN ('bridge', 'high_rise'), false) AS requires_ductility FROM
    (SELECT qid, {_classes(EXPOSURE)} AS exposure, {_classes(SEISMIC)} AS seismic, {_classes(CORROSION)} AS corrosion, {_classes(INFRASTRUCTURE)} AS infrastructure,
      coalesce(upper(nullif(regexp_extract(low, '\b(?:working pressure\s*)?(\d+\s*(?:bar|kg/cm2|mpa)|pn\s*\d+)\b', 1), '')), CASE WHEN contains(low, 'gravity') OR contains(low, 'non-pressure') THEN 'NON-PRESSURE / GRAVITY' END) AS pressure, {grades} AS grade
      FROM (SELECT qid, lower(text) AS low FROM ({source}))))"""


# Composite ranking on the derived catalogue

_CAT = """cat AS (SELECT item_key AS doc_id, concat_ws(' ', item_no, title, department, array_to_string(keywords, ' ')) AS text, item_no, item_id, title, department, status, list_append(keywords, array_to_string(keywords, ' ')) AS keywords FROM fx_catalog)"""
_ASKED_CAT = """asked AS (SELECT s_suppkey AS qid, concat_ws(' ', concat('IS ', s_suppkey * 3), title, '12 mm', CASE s_suppkey % 4 WHEN 1 THEN 'coastal' WHEN 2 THEN 'zone iv' END) AS text FROM supplier JOIN fx_catalog ON item_key = s_suppkey)"""
ACTIVE_ONLY = "WHERE c.status NOT IN ('SUPERSEDED', 'WITHDRAWN')"


def rule_sql(rules) -> list[str]:
    """For each constraint rule a condition on slots s and on an item c."""
    out = []
    for r in rules:
        when = [f"s.{slot}" if slot.startswith("requires") else f"s.{slot} IN ({', '.join(repr(v) for v in values)})" if values else f"s.{slot} IS NOT NULL" for slot, values in r.when]
        met = [f"contains(c.item_id, '{i}')" for i in r.items] + [f"contains(lower(c.title), '{w}')" for w in r.words]
        spared = [f"contains(c.item_id, '{i}')" for i in r.unless]
        out.append(f"coalesce({' OR '.join(when)}, false) AND coalesce({' OR '.join(met)}, false)" + (f" AND NOT ({' OR '.join(spared)})" if spared else ""))
    return out


def bonus_sql(rules) -> str:
    return "round(" + " + ".join(["0.0::DOUBLE", *(f"CASE WHEN {c} THEN {r.weight}::DOUBLE ELSE 0.0::DOUBLE END" for r, c in zip(rules, rule_sql(rules)))]) + ", 6)"


def composite_sql(policy: str = ACTIVE_ONLY, views: str = "", asked: str = _ASKED_CAT, rules=(), mandated: str = "false", joins: str = "", k: int = 10) -> str:
    """CTEs up to `composite`: the k best of each query; `rules` weigh by slots, `mandated` is a condition over `joins`.

    In these texts a citation is IS and a number, and no whole text is a number
    without IS, so the first such pair names the item.
    """
    slotted = f", slotted AS ({slots_sql('SELECT qid, text FROM asked')})" if rules else ""
    return (
        (views or with_views("fx_catalog")) + ", " + _CAT + ", " + asked + slotted + ", " + bm25_sql("SELECT doc_id, text FROM cat", "SELECT qid, text FROM asked", "") + ", " + TFIDF + FUSED
        + rf""", cand AS (SELECT f.*, c.item_no, c.item_id, c.keywords, a.text, {bonus_sql(rules) if rules else '0.0::DOUBLE'} AS bonus, coalesce({mandated}, false) AS mandated FROM fused f JOIN cat c USING (doc_id) JOIN asked a USING (qid) {'JOIN slotted s USING (qid)' if rules else ''} {joins} {policy}),
flagged AS (SELECT *, regexp_extract(text, '\bIS ([0-9]+)\b', 1) = CAST(doc_id AS VARCHAR) AS exact, contains(upper(text), upper(item_no)) OR contains(upper(text), item_id) AS mention, len(list_filter(keywords, lambda w: length(w) >= 3 AND contains(upper(text), upper(w)))) > 0 AS gradehit, coalesce(score_b, 0) AS cosine, coalesce(score_a, 0) AS sparse FROM cand),
grounded AS (SELECT *, exact OR mention OR gradehit OR bonus > 0 OR cosine >= 0.20 OR sparse >= 18 AS grounded FROM flagged),
scored AS (SELECT qid, doc_id, grounded, mandated, round(least(0.99::DOUBLE, greatest(0.01::DOUBLE, least(0.40::DOUBLE, score * 12.0::DOUBLE * CASE WHEN grounded THEN 1.0::DOUBLE ELSE least(0.60::DOUBLE, greatest(0.10::DOUBLE, greatest(cosine / 0.30::DOUBLE, sparse / 25.0::DOUBLE))) END)
  + CASE WHEN exact THEN 0.35::DOUBLE WHEN mention THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN gradehit THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + least(0.20::DOUBLE, bonus * 0.30::DOUBLE) + CASE WHEN grounded AND mandated THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END)), 4) AS score FROM grounded),
composite AS (SELECT *, CASE WHEN score >= 0.65 THEN 'STRONG' WHEN score >= 0.40 THEN 'MODERATE' WHEN score >= 0.25 THEN 'LOW' ELSE 'INSUFFICIENT' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {k}) """
    )


COMPOSITE = composite_sql()
COMPOSITE_HISTORY = composite_sql("", k=20)
