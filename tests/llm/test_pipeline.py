"""The pipeline, stage by stage, against brute force on the smallest tables."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from test_llm_operators import WORDS, shingles, windows_expected

from sextant.llm import queries
from sextant.llm.tables import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, kept = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        kept.append(docs)
        if name != "best_fit_packing":
            assert docs.columns == table(spark, SF, "documents").columns
    start = dict(table(spark, SF, "documents").select("doc_id", "text").collect())
    good, exact, near, cut = (dict(d.select("doc_id", "text").collect()) for d in kept[:4])
    verdict = {r.doc_id: r.predicted for r in queries.QUERIES["op2_quality_classifier"](spark, SF).collect()}
    assert good == {i: t for i, t in start.items() if verdict[i]}
    last = {}
    for i, t in good.items():
        last[t or ""] = max(i, last.get(t or "", i))
    assert exact == {i: good[i] for i in last.values()}
    sets, group = {i: shingles(t) for i, t in exact.items()}, {i: {i} for i in exact}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] is not group[b]:
                group[a] |= group[b]
                for i in group[b]:
                    group[i] = group[a]
    assert near == {i: t for i, t in exact.items() if i == min(group[i])}
    units = {i: WORDS.findall(t or "") for i, t in near.items()}
    for (i, words), gone in zip(units.items(), windows_expected(list(units.values()), 35)):
        assert cut[i] == (" ".join(w for w, g in zip(words, gone) if not g) if any(gone) else near[i] or "")
    ends = defaultdict(int)
    for r in kept[4].orderBy("doc_id", "piece").collect():
        assert r.start == ends[r.doc_id]
        ends[r.doc_id] += r.length
    assert set(ends) == set(cut)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    room = out.groupBy("sequence_id").sum("length").collect()
    assert room and all(r[1] <= 1024 for r in room)


def test_odd_documents(spark):
    """Extra columns under names that operators use, null and repeated rows, and no rows at all, through every stage."""
    words = [f"w{k}" for k in range(200)]
    rows = [(None, None), (None, ""), (1, " ".join(words)), (1, " ".join(words)), (2, " ".join(words[:100] + ["x"] + words[100:])), (None, " ".join(words)), (3, "short"), (-(2**63), "short"), (None, "other text")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "b", "c", 0.5, "h", 4) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rd long, rt string, spans string, score double, h string, n_words int")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0
        out = stage(spark, docs, SF).collect()
        if name == "best_fit_packing":
            assert len({(r.doc_id, r.sequence_id, r.offset) for r in out}) == len(rows)
            continue
        assert none.columns == docs.columns and all(r.rd == 7 and r.rt == "b" and r.spans == "c" and r.score == 0.5 and r.h == "h" and r.n_words == 4 for r in out)
        if name == "exact_dedup":
            assert sorted(((r.doc_id, r.text or "") for r in out), key=str) == sorted([(None, ""), (1, rows[2][1]), (2, rows[4][1]), (3, "short"), (None, "other text")], key=str)
        if name == "ngram_jaccard_join":
            assert Counter((r.doc_id, (r.text or "")[:5]) for r in out) == Counter([(None, ""), (1, "w0 w1"), (-(2**63), "short"), (None, "other")])
        if name == "substring_dedup":
            assert Counter((r.doc_id, r.text, r.n_chars) for r in out) == Counter([(None, "", 0), (None, "", 0), (1, "", 0), (1, "", 0), (2, "x", 1), (None, "", 0), (3, "short", 5), (-(2**63), "short", 5), (None, "other text", 10)])
