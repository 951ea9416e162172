"""Functions on inline rows, sources and streams on a temporary folder, queries beside their SQL."""

from __future__ import annotations

import datetime
import random
import time

import duckdb
import pytest
from compare import connect, differences
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sextant.functions import text as T
from sextant.operators import audit, builders, documents, graph, markup, orders, ranking, recommend, retrieval, rules, slots
from sextant.plans import every as registry
from sextant.plans import fixtures
from sextant.sources import readers
from sextant.streaming import incremental


def one(spark, column_of, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column_of(F.col("v")).alias("x")).collect()]


def test_tokens(spark):
    assert one(spark, T.tokens, ["The IS 2062 steel, Fe 500D of grade", None, ""]) == [["is_2062", "steel", "fe_500d", "grade"], [], []]


def test_citations(spark):
    given = ["IS 1608 : Part 1 : 2018", "IS  2062 : 2011", "1608:2005", "228 (Parts 1 to 24)", "IS/ISO 9001:2015", "lEC 60065:2001", "IS 456 2000", "IS 1904", "IS 302 (Part II)", None]
    want = ["IS 1608 (Part 1):2018", "IS 2062:2011", "IS 1608:2005", "IS 228", "IS/ISO 9001:2015", "IEC 60065:2001", "IS 456:2000", "IS 1904", "IS 302 (Part 2)", ""]
    assert one(spark, T.normalise_citation, given) == want


def test_dates(spark):
    day = datetime.date
    given = ["2024-02-29", "17-2-2003", "03/07/2013", "29th August 2023", "17 Feb 2003", "d 04", "31-02-2020", "2023-13-01 or 5.6.2023", None]
    assert one(spark, T.parse_date, given) == [day(2024, 2, 29), day(2003, 2, 17), day(2013, 7, 3), day(2023, 8, 29), day(2003, 2, 17), None, None, day(2023, 6, 5), None]


def test_small_functions(spark):
    assert one(spark, T.canonical_key, [" IS 1-2/(a):b_c "]) == ["IS12ABC"]
    assert one(spark, T.lifecycle, ["now withdrawn", "superceded", "x", None]) == ["WITHDRAWN", "SUPERSEDED", "ACTIVE", "ACTIVE"]
    assert one(spark, lambda c: T.script(c, T.LOCALES, "en-IN"), ["abc", "सरिया", "தமிழ்"]) == ["en-IN", "hi-IN", "ta-IN"]
    assert one(spark, lambda c: T.weighted_checksum(T.licence_key(c)), ["CM/L-1234567", "12"]) == [(1 + 4 + 9 + 16 + 25 + 36 + 49) % 7, None]
    assert one(spark, T.scheme_label, ["CRS", "ISI mark", "BIS Hallmark", "Scheme-X", "own"]) == ["Scheme-II (CRS)", "Scheme-I", "Hallmarking", "Scheme-X", "own"]
    assert [tuple(x) for x in one(spark, T.series, ["IS 302 (Part II):2008", "IS 456:2000"])] == [("IS 302", 2), ("IS 456", None)]
    assert [tuple(x) for x in one(spark, T.gazette, ["S.O. 1203(E) dated 03-04-2019", "none"])] == [("S.O. 1203(E)", datetime.date(2019, 4, 3)), (None, None)]
    assert one(spark, T.clean_html, ["<p>a&nbsp;<br/>b &amp; c</p>"]) == ["a b & c"]
    assert one(spark, lambda c: T.context(c, F.lit("needle"), 3), ["see the NEEDLE or needle here", "none"]) == ["or needle he", ""]


def test_slots(spark):
    rows = spark.createDataFrame([(1, "Bridge in a marine area of Zone V, PN 10, Fe 500D"), (2, "plain"), (3, "gravity sewer")], "qid int, text string")
    got = {r.qid: r for r in slots.slots(rows).collect()}
    assert (got[1].exposure, got[1].seismic, got[1].corrosion, got[1].infrastructure, got[1].pressure, got[1].grade, got[1].requires_crs, got[1].requires_ductility) == ("severe", "zone v", "marine_coastal", "bridge", "PN 10", "Fe 500D", True, True)
    assert not got[2].special and got[3].pressure == "NON-PRESSURE / GRAVITY" and got[3].infrastructure == "sewerage_drainage"


def test_order_status(spark):
    rows = [(1, "Order rescinded", "2020-01-01"), (2, "Order", "superseded by another"), (3, "Order", "d 04"), (4, "Order", "2020-01-01"), (5, "Order", "1 Jan 2030")]
    df = spark.createDataFrame(rows, "i int, name string, raw string")
    dates = spark.createDataFrame([(datetime.date(2024, 1, 1),)], "evaluation_date date")
    got = [r.temporal_status for r in orders.status_asof(df.withColumnsRenamed({"name": "order_name", "raw": "effective_raw"}), dates).orderBy("i").collect()]
    assert got == ["RESCINDED", "SUPERSEDED_BY_SUBSEQUENT_ORDER", "UNVERIFIED_EFFECTIVE_DATE", "MANDATORY_IN_FORCE", "PENDING_FUTURE_DATE"]


def test_chain_with_cycle(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "node string, next string")
    assert {(r.node, r.end, r.steps) for r in graph.chain_ends(links).collect()} == {("a", "d", 3), ("b", "d", 2), ("c", "d", 1), ("x", "y", 1)}


def test_two_hop_orders(spark):
    seeds = {r.item_id for r in fixtures.view(spark, SF, "fx_catalog").where("status = 'WITHDRAWN'").collect()}
    edges = {(r.source, r.target) for r in fixtures.view(spark, SF, "fx_edges").collect()}
    out, both = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    want = set()
    for s in seeds:
        first = both.get(s, set()) - {s}
        second = {y for x in both.get(s, ()) for y in out.get(x, ())} - first - {s}
        want |= {(s, s, 0)} | {(s, x, 1) for x in first} | {(s, x, 2) for x in second}
    got = {(r.seed, r.id, r.hop) for r in registry.QUERIES["two_hop_all"](spark, SF).collect()}
    assert got == want and any(x.startswith("SUP_") for _, x, _ in got)


def test_chain_with_real_cycles(spark):
    """A ring with two tails, a loop of one node, a ring of two, and chains without a ring."""
    rows = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("t1", "t2"), ("t2", "r3"), ("u", "r0"), ("s", "s"), ("v", "s"), ("q", "p"), ("p", "q"), ("a", "b"), ("b", "c")] + [(f"k{i:02}", f"k{i + 1:02}") for i in range(17)]
    after, want = dict(rows), set()
    for node in after:
        walk = [node]
        while walk[-1] in after and after[walk[-1]] not in walk:
            walk.append(after[walk[-1]])
        end = min(walk[walk.index(after[walk[-1]]):]) if walk[-1] in after else walk[-1]
        want.add((node, end, walk.index(end)))
    links = spark.createDataFrame(rows, "node string, next string")
    assert ("t1", "r0", 4) in want and ("r0", "r0", 0) in want and ("k00", "k17", 17) in want
    assert {(r.node, r.end, r.steps) for r in graph.chain_ends(links).collect()} == want


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", "R"), ("c", "b", "R"), ("c", "d", "R"), ("z", "z", "R")], "source string, target string, relationship string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "z"), ("a", "b")], "source string, target string")
    assert {tuple(r) for r in graph.shortest_paths(edges, pairs).collect()} == {("a", "d", 3), ("a", "a", 0), ("a", "z", None), ("a", "b", 1)}


def _distances(edges, start):
    """Plain breadth-first search, edges taken either way."""
    near = {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, rim, hop = {start: 0}, [start], 0
    while rim:
        rim = list(dict.fromkeys(n for x in rim for n in near.get(x, ()) if n not in seen))
        hop += 1
        seen.update(dict.fromkeys(rim, hop))
    return seen


def test_paths_whole_graph(spark):
    dice = random.Random(3)
    rows = [(f"n{i:02}", f"n{i + 1:02}", "R") for i in range(9)] + [(f"m{dice.randrange(30):02}", f"m{dice.randrange(30):02}", dice.choice("RST")) for _ in range(35)] + [("y", "z", "R")]
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    asked = [("n00", "n09"), ("n00", "n08"), ("n00", "y"), ("y", "gone"), ("gone", "gone"), ("n03", "n03")] + [(dice.choice(names), dice.choice(names)) for _ in range(30)]
    edges, pairs = spark.createDataFrame(rows, "source string, target string, relationship string"), spark.createDataFrame(asked, "source string, target string")
    want = {(a, b, _distances(rows, a).get(b)) for a, b in asked}
    assert ("n00", "n09", 9) in want and {tuple(r) for r in graph.shortest_paths(edges, pairs).collect()} == want
    steps = {}
    for r in graph.path_steps(edges, pairs).orderBy("step").collect():
        steps.setdefault((r.source, r.target), []).append((r.step, r.node, r.relationship))
    assert {(a, b, len(s) - 1) for (a, b), s in steps.items()} == {w for w in want if w[2] is not None}
    for (a, b), s in steps.items():
        assert [x[0] for x in s] == list(range(len(s))) and (s[0][1], s[-1][1]) == (a, b) and s[0][2] == ("IDENTICAL" if a == b else "START")
        for (_, before, _), (_, node, said) in zip(s, s[1:]):
            forth, back = (sorted(k for x, y, k in rows if (x, y) == way) for way in ((before, node), (node, before)))
            assert said == (forth[0] if forth else f"INVERSE_{back[0]}")


def test_audit(spark):
    docs = spark.createDataFrame([(1, "TMT rebar to IS 2062:2006 without BIS marks"), (2, "Pipes to ASTM A36"), (3, "Nothing here"), (4, "recycled hdpe pipe with ISI mark")], "doc_id long, text string")
    none = spark.createDataFrame([], "citation string")
    found = audit.findings(docs, none)
    kinds = {(r.doc_id, r.issue_type) for r in found.collect()}
    assert kinds == {(1, "SUPERSEDED_STANDARD"), (1, "ILLEGAL_QCO_EXEMPTION"), (1, "MISSING_TEST_STANDARDS"), (2, "FOREIGN_STANDARD_DISCRIMINATION"), (4, "VAGUE_SPECIFICATION")}
    assert {(r.doc_id, r.score, r.band) for r in audit.scores(docs, found).collect()} == {(1, 33, "NON_COMPLIANT"), (2, 85, "COMPLIANT"), (3, 100, "COMPLIANT"), (4, 70, "MINOR_RISKS")}
    assert audit.amendments(docs, found).where("doc_id = 3").first().amended == "No amendment"


def test_large_rule_tables(spark):
    """One row more than is broadcast, and some: every row counts, the first rule being the last row."""
    n = rules.MOST_RULES + 50
    ids = spark.range(n).select(F.col("id").cast("int").alias("i"))
    table = ids.select(F.format_string("r%05d", "i").alias("rule_id"), (n - F.col("i")).alias("ord"), F.lit("steel").alias("keyword"))
    texts = spark.createDataFrame([(1, "steel")], "qid int, text string")
    assert [tuple(r) for r in rules.first_match(texts, table, "qid").collect()] == [(1, f"r{n - 1:05}")]
    assert [tuple(r) for r in rules.either_contains(texts, table, "qid", "text").collect()] == [(1, f"r{n - 1:05}")]
    weights = ids.select(F.col("i").alias("ord"), F.lit("steel").alias("word"), F.lit("IS 1").alias("item_no"), F.lit(2.0**-16).alias("weight"))
    ranked = spark.createDataFrame([(1, 7, "IS 1", 0.25)], "qid int, doc_id int, item_no string, score double")
    few = rules.reranked(ranked, texts, weights.limit(rules.MOST_RULES)).first().score
    assert rules.reranked(ranked, texts, weights).first().score > few
    slotted = slots.slots(texts).withColumn("grade", F.lit("E250"))
    bonus = ids.select(F.format_string("r%05d", "i").alias("rule_id"), F.lit("IS 1").alias("item"), F.lit("grade").alias("slot"), F.lit("E250").alias("value"), F.lit(1.0).alias("weight"))
    assert slots.rule_bonus(slotted, bonus).first().bonus == n
    words = ids.select(F.col("i").alias("ord"), F.lit("steel").alias("pattern"), F.col("i").cast("string").alias("addition"))
    assert slots.expanded(texts, words).first().expansion == " ".join(map(str, range(n)))
    dates = spark.range(orders.MOST_DATES + 50).select(F.date_add(F.lit(datetime.date(2020, 1, 1)), F.col("id").cast("int")).alias("evaluation_date"))
    order = spark.createDataFrame([("Order", "2020-01-01")], "order_name string, effective_raw string")
    assert orders.status_asof(order, dates).count() == orders.MOST_DATES + 50


def test_promotion(spark):
    ranked = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.4, 2)], "qid int, doc_id int, score double, rank int")
    new = spark.createDataFrame([(10, 99)], "doc_id int, new_id int")
    assert [(r.doc_id, r.score) for r in ranking.promoted(ranked, new).orderBy("rank").collect()] == [(99, 0.99), (11, 0.4)]


def test_blank_queries(spark):
    q = spark.createDataFrame([(1, ""), (2, "zzzz")], "qid int, text string")
    c = spark.createDataFrame([(1, "abc def"), (2, "abc")], "doc_id int, text string")
    assert retrieval.bm25(q, c).count() == 0 and retrieval.tfidf(q, c).count() == 0


def test_markup(spark):
    page = spark.createDataFrame([(1, "<tr><th>No</th></tr><tr><td>1</td><td>a<br>b</td></tr><tr><td>x</td></tr>")], "page_id int, html string")
    assert [r.cells for r in markup.html_rows(page).collect()] == [["1", "a b"]]
    text = spark.createDataFrame([("1 SCOPE\nx\n2 REFERENCES\nIS 1\nIS 2\n3 TERMS\ny",)], "t string")
    assert text.select(markup.section(F.col("t"))).first()[0] == "2 REFERENCES\nIS 1\nIS 2"


def test_sources(spark, tmp_path):
    schema = StructType().add("id", "string").add("year", "integer")
    (tmp_path / "a.csv").write_text("id,year\n x ,2001\n,5\ny,old\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), schema, "id").collect()] == [("x", 2001), ("y", None)]
    (tmp_path / "a.jsonl").write_text('{"id":"x","year":1}\nbroken\n{"id":"y","year":2}\n')
    assert readers.read_json_lines(spark, str(tmp_path / "a.jsonl"), schema).select("id", "year").collect().__len__() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t/u.txt").write_bytes("é".encode())
    (tmp_path / "t/l.txt").write_bytes("é".encode("latin-1"))
    assert {r.text for r in readers.read_texts(spark, str(tmp_path / "t")).collect()} == {"é"}
    rows = spark.createDataFrame([("x", 1)], schema)
    readers.write_csv(rows, str(tmp_path / "out"), ["year", "id"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["year", "id"]
    rows.write.parquet(str(tmp_path / "p"))
    assert readers.inventory(spark, str(tmp_path / "p")).agg(F.sum("rows")).first()[0] == 1


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts")
    events.unionByName(events.limit(50)).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = incremental.arriving(spark, str(tmp_path / "in"), events.schema)
        incremental.ingest(stream, "event_id", "ts", str(tmp_path / "out"), str(tmp_path / "c"), "3650 days").awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    docs = spark.createDataFrame([(1, "Pipes to ASTM A36")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = incremental.arriving(spark, str(tmp_path / "docs"), docs.schema)
    incremental.audit_arrivals(stream, spark.createDataFrame([], "citation string"), str(tmp_path / "scores"), str(tmp_path / "c2")).awaitTermination()
    assert [r.score for r in spark.read.parquet(str(tmp_path / "scores")).collect()] == [85]


def test_ingest_in_batches(spark, tmp_path):
    """At defaults: rows that are days late, keys that come again in later files, a batch run again, a new checkpoint."""
    schema = "event_id long, ts string"
    files = [[(1, "2024-01-09 00:00:00"), (2, "2024-01-09 00:00:00")], [(3, "2024-01-01 00:00:00"), (1, "2024-01-20 00:00:00")], [(4, "2024-03-01 00:00:00"), (4, "2024-02-01 00:00:00"), (None, None)], [(1, "2024-03-02 00:00:00"), (5, "2020-01-01 00:00:00"), (None, None)]]

    def run(checkpoint):
        stream = incremental.arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_at_once=1)
        incremental.ingest(stream, "event_id", "ts", str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r.event_id or 0, str(r.ts)) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    want = [(0, "None"), (1, "2024-01-09 00:00:00"), (2, "2024-01-09 00:00:00"), (3, "2024-01-01 00:00:00"), (4, "2024-02-01 00:00:00"), (5, "2020-01-01 00:00:00")]
    assert run("c") == want
    last = max((tmp_path / "c/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert int(last.name) == 3
    last.unlink()
    (tmp_path / f"c/commits/.{last.name}.crc").unlink(missing_ok=True)
    assert run("c") == want
    assert run("c2") == want


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    assert differences(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name]) == ""


def test_documents(spark):
    text = "IS 10:1999\n1 SCOPE\nThis covers bolts\nand nuts\n\n2 NORMATIVE REFERENCES\nIS 20 (Part II):2001 Test of bolts\nIS No. Title\n1608:2005 Tensile testing\n1989\n456 Concrete\n3 TERMINOLOGY\nIS 99 is outside"
    docs = spark.createDataFrame([("IS 10", text), ("IS 11", None), ("IS 12", ""), ("IS 13", "see IS 14 only")], "item_no string, text string")
    cited = dict(documents.references(docs, "item_no").collect())
    assert cited == {"IS 10": ["IS 20 (Part 2):2001", "IS 1608:2005", "IS 456"], "IS 11": [], "IS 12": [], "IS 13": ["IS 14"]}
    edges = {(r.source, r.target, r.relationship) for r in documents.line_edges(docs).collect()}
    assert edges == {("IS 10", "IS 20 (Part II)", "TESTED_BY"), ("IS 10", "IS 1608", "TESTED_BY"), ("IS 10", "IS 456", "NORMATIVE_REF"), ("IS 13", "IS 14", "NORMATIVE_REF")}
    about = {r.item_no: (r.own_number, r.own_year, r.scope) for r in documents.metadata(docs).collect()}
    assert about["IS 10"] == ("IS 10:1999", 1999, "This covers bolts\nand nuts") and about["IS 11"][:2] == ("IS Unknown", None)
    assert one(spark, documents.completed_number, ["13252*", "IS  14286 ", "", None]) == ["IS 13252", "IS 14286", None, None]
    blob = spark.createDataFrame([(1, "Division Name: Steel Section Name: Bars (MTD 4) Designator of Legally Binding Document: IS 1786 Title of Legally Binding Document: x\nNumber of Amendments: 2\nSuperceded by: Decided by Council\nICS Code: 77.140"), (2, None)], "i int, description string")
    got = {r.i: r for r in documents.labelled_fields(blob).collect()}
    assert (got[1].division, got[1].committee, got[1].designator, got[1].amendments, got[1].superseded_by, got[1].ics_code) == ("Steel", "MTD 4", "IS 1786", 2, None, "77.140")
    assert (got[2].division, got[2].section, got[2].designator, got[2].amendments, got[2].status) == ("General", "", None, 0, "ACTIVE")


def test_builders_on_odd_rows(spark):
    catalog = spark.createDataFrame([("IS_1", "IS 1:2000", 2000), ("IS_1b", "IS 1:2010", 2010), ("IS_2", "IS 2 (Part 1)", 1990)], "item_id string, item_no string, year int")
    docs = spark.createDataFrame([("IS_2", "IS 2 (Part 1)", "by IS 1 and IS 1:2000, IS 77, IS 2:1999"), ("IS_9", "IS 9", None), ("IS_9", "IS 9", "IS 1 is a method")], "item_id string, item_no string, text string")
    got = {(r.source, r.target, r.relationship) for r in builders.scope_edges(docs, catalog).collect()}
    assert got == {("IS_2", "IS_1b", "NORMATIVE_REF"), ("IS_2", "IS_1", "NORMATIVE_REF"), ("IS_9", "IS_1b", "TESTED_BY")}
    notes = spark.createDataFrame([("IS 5", "superseding IS 4:1990. It replaces: IS 5"), ("IS 6", None)], "item_no string, text string")
    assert {(r.source, r.target) for r in builders.noted_supersession(notes).collect()} == {("IS_5", "IS_4_1990")}
    none = catalog.limit(0)
    assert builders.scope_edges(docs, none).count() == 0 and builders.scope_edges(docs.limit(0), catalog).count() == 0
    records = spark.createDataFrame([("IS 1", "Lamp", "Order A", None, "S1", None), ("IS 2", "lamp", "", "M", "S1", ["IS 3", "IS 3"])], "item_no string, product string, order_name string, ministry string, scheme string, numbers array<string>")
    made, ministries = builders.regulation_nodes(records, "Default")
    assert [r.order_id for r in made.collect()] == ["Order_A"] and [r.name for r in ministries.collect()] == ["Default"]
    assert {(r.source, r.target) for r in builders.mandate_edges(records).collect()} == {("IS_1", "Order_A")}
    assert {(r.item_no, r.product) for r in builders.regulations(records, records.withColumn("product", F.upper("product")), records.limit(0)).collect()} == {("IS 1", "Lamp"), ("IS 2", "lamp")}


def test_resolved_keeps_repeats(spark):
    catalog = spark.createDataFrame([("IS_1", "IS 1")], "item_id string, item_no string")
    rows = spark.createDataFrame([(1, "IS 1:2000"), (1, "IS 1:2000"), (2, None), (3, "nothing")], "cite_id int, raw string")
    assert sorted(map(tuple, graph.resolved(rows, graph.aliases(catalog)).collect()), key=str) == sorted([(1, "IS 1:2000", "IS_1"), (1, "IS 1:2000", "IS_1"), (2, None, None), (3, "nothing", None)], key=str)


def test_broad_and_metrics(spark):
    queries = spark.createDataFrame([(1, "steel pipes"), (2, "a long text about pipes"), (3, ""), (4, None)], "qid int, text string")
    domains = spark.createDataFrame([(1, "pipe", 2, "sewer"), (1, "pipe", 1, "water"), (2, "steel", 1, "bars")], "ord int, word string, option_ord int, option string")
    assert [tuple(r) for r in recommend.broad(queries, domains).collect()] == [(1, "pipe", "water | sewer")]
    case = "status string, doc_id long, replacement string, expected long, obsolete_first boolean, expect_supersession boolean, superseded boolean, expected_replacement string, expect_context boolean, expect_abstention boolean, temporal_status string, expected_temporal string"
    rows = spark.createDataFrame([("RECOMMENDED", 1, None, 1, False, None, None, None, None, False, "A", "B"), ("NEEDS_CONTEXT", None, None, 2, None, True, True, "x", True, True, None, None)], case)
    got = recommend.verdict_metrics(rows).first()
    assert (got.cases, got.retrieval_accuracy, got.obsolete_as_primary, got.supersession_detection, got.replacement_accuracy, got.branching_safety, got.temporal_accuracy, got.abstention) == (2, 0.5, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)
    assert recommend.verdict_metrics(rows.limit(0)).first().retrieval_accuracy is None


def test_readers_and_sinks(spark, tmp_path):
    schema = StructType.fromDDL("id string, names array<string>")
    (tmp_path / "a.json").write_text('[{"id": "x", "names": ["p", "q"]}, {"id": "y"}]')
    assert {(r.id, tuple(r.names or ())) for r in readers.read_json(spark, str(tmp_path / "a.json"), schema).collect()} == {("x", ("p", "q")), ("y", ())}
    rows = spark.createDataFrame([("x", ["p"]), ("y", None)], schema)
    readers.write_json_lines(rows, str(tmp_path / "lines"))
    assert readers.read_json_lines(spark, str(tmp_path / "lines"), schema).count() == 2
    edges = spark.createDataFrame([("a", "b", "R"), ("b", "c", "S")], "source string, target string, relationship string")
    readers.write_graph(edges, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph")).where("relationship = 'S'").select("source").first()[0] == "b"
    last = readers.latest(spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, None)], "k int, t int, v string"), ["k"], F.col("t"))
    assert {(r.k, r.v) for r in last.collect()} == {(1, "new"), (2, None)}
