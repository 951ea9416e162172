"""License scan, fill-in-middle and Merkle manifest on odd tables, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import SCHEMA, rows_of, texts

from sextant.llm import fill_in_middle, license_scan, merkle
from sextant.llm.license_rules import LONGEST, RULES, WEIGHTS, rules

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
LICENSES = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "cc by cc by, cc by-sa 4.0 CC0 1.0",
    "SPDX-License-Identifier: GPL-2.0-or-later", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1",
    "mıt lıcense MIT LICENCE mit licensed", "Copyright (c) 2019 X. All rights reserved. BSD 3-Clause License; new bsd license", "K" + "İ" + " the mit", "this program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    mixed = [(100 + i, " ".join(rng.choice(LICENSES) if rng.random() < 0.4 else rng.choice(["word", "the", "license", "gnu", "ÉTÉ", "漢字", "x-1"]) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    return texts() + [(60 + i, x) for i, x in enumerate(LICENSES)] + mixed + [(None, LICENSES[0]), (90, "the " * 30_000 + LICENSES[1]), (91, "mit license " * 3000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", 2.0, 3, 4, 5, "s", 6, "k") for i, t in rows], SCHEMA).repartition(5).cache()


def scanned(text: str | None) -> tuple:
    """Every rule at every word, without keywords or triggers; who suppresses whom by looking at all pairs of places near each other."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base, best = [], []
    compiled = [(r, re.compile(f"(?:{r.regex})(?= |$)")) for r in RULES]
    for i in range(len(words)):
        ahead = " ".join(words[i : i + LONGEST + 8])
        base += [(i, label) for phrase, label in BASE.items() if f"{ahead} ".startswith(f"{phrase} ")]
        hits = [(r.rank, -len(m.group()), r.order, r.label, len(m.group().split(" "))) for r, c in compiled if (m := c.match(ahead))]
        if hits:
            top = min(hits)
            best.append((i, i + top[4], top[0], top[3]))
    kept = []
    for a, d in enumerate(best):
        near = best[max(0, a - LONGEST) : a + LONGEST + 1]
        if not any(e[0] < d[1] and d[0] < e[1] and (e[2] < d[2] or (e[2] == d[2] and e != d and e[0] <= d[0] and e[1] >= d[1])) for e in near):
            kept.append(d)
    by_base = {x for _, x in base}
    score = max([WEIGHTS[d[2]] for d in kept] + [license_scan.BASE_WEIGHT] * bool(base) + [0.0])
    starts = [i for i, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(by_base)), ",".join(sorted(by_base | {d[3] for d in kept})), score


def test_license_scan(docs, rows):
    remembered: dict[str | None, tuple] = {}
    want = Counter((i, *remembered.setdefault(t, scanned(t))) for i, t in rows if (t or "").count("the the") < 100)
    got = rows_of(license_scan.labels(license_scan.scan(docs.where("doc_id is null or doc_id != 90"), BASE)))
    assert got == want
    long = license_scan.labels(license_scan.scan(docs.where("doc_id = 90"), BASE)).first()
    assert (long.n_words, long.n_base, long.first_word, long.labels) == (30_005, 1, 30_003, "mit")


def test_license_scan_is_expressions_only(docs, spark):
    out = license_scan.labels(license_scan.scan(docs, BASE))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("InMemoryRelation")[0]
    assert license_scan.labels(license_scan.scan(spark.createDataFrame([], SCHEMA), BASE)).count() == 0
    assert license_scan.scan(docs, {}).where(F.size("base_places") > 0).isEmpty()


def test_license_rules():
    assert len(RULES) > 250
    for r in RULES:
        assert r.regex.startswith(r.keyword) or r.keyword in r.regex
    with pytest.raises(ValueError):
        rules("3 x [a-z]+ thing")
    with pytest.raises(ValueError):
        rules("3 x neverheard (?:of|it) 4")


def units_of(text: str) -> list[str]:
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)


def middle_of(i: int | None, t: str | None) -> tuple:
    t = t or ""
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = units_of(t)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
    out = t if form == "plain" else f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return i, n, form, None if form == "plain" else len(pre), None if form == "plain" else len(mid), out


@pytest.mark.parametrize("batch", [1 << 22, 64])
def test_fill_in_middle(spark, rows, batch):
    rng = random.Random(5)
    more = [(1000 + i, "".join(rng.choice(" \t\n\x0b\x0c\r\x08\x0e\x1f\x21aé漢😀\x80\xa0<S") for _ in range(rng.randint(0, 40)))) for i in range(300)]
    more += [(2000, "a<P>b"), (2001, "x <M>"), (2002, "<S <P <<M"), (None, " "), (None, "  a")]
    docs = spark.createDataFrame([(i, t, 1, "r", 2.0, 3, 4, 5, "s", 6, "k") for i, t in rows + more], SCHEMA)
    out = fill_in_middle.transform(docs, batch_bytes=batch).withColumn("again", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in out) == Counter(middle_of(i, t) for i, t in rows + more)
    assert Counter((r.doc_id, r.again) for r in out) == Counter((i, t or "") for i, t in rows + more)
    assert fill_in_middle.transform(docs.limit(0)).count() == 0


def test_words_of_eight_bytes():
    every = np.arange(256, dtype=np.uint8).view("<u8")
    space = fill_in_middle.spaces(every).astype("<u8").view(np.uint8)
    assert {i for i in range(256) if space[i] & 0x80} == {0x20, *range(0x09, 0x0E)}
    begin = fill_in_middle.starts_of_characters(every).astype("<u8").view(np.uint8)
    assert {i for i in range(256) if not begin[i] & 0x80} == set(range(0x80, 0xC0))
    texts = [t.encode() for t in ("", "a", "a ", " a", "12345678", "1234567 ", "1234567 9", "é" * 9, " " * 17)]
    n, units, at, chars = fill_in_middle.cuts(texts, np.full(9, 1), np.full(9, 10**9))
    assert n.tolist() == [len(units_of(t.decode())) for t in texts]
    for k, t in enumerate(texts):
        for row in (0, 1):
            part = "".join(units_of(t.decode())[: units[row][k]])
            assert (at[row][k], chars[row][k]) == (len(part.encode()), len(part))


def tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([hashlib.sha256("".join(levels[-1][k : k + 2]).encode()).hexdigest() for k in range(0, len(levels[-1]), 2)])
    return levels


def folded(levels: list[list[str]], i: int, leaf: str) -> tuple[str, list[str]]:
    path = []
    for nodes in levels[:-1]:
        pair = list(nodes[i & ~1 : (i & ~1) + 2])
        pair[i & 1] = leaf
        path += [x for k, x in enumerate(pair) if k != (i & 1)]
        leaf, i = hashlib.sha256("".join(pair).encode()).hexdigest(), i >> 1
    return leaf, path


def test_positions_are_those_of_the_log():
    for n in range(1, 70):
        levels = tree([f"{k}" for k in range(n)])
        log = merkle.log_of(levels[0], merkle.levels(n))
        assert len(log) == sum(map(len, levels)) and log[-1] == levels[-1][0]
        for h, nodes in enumerate(levels):
            for j, node in enumerate(nodes):
                assert log[merkle.position(h, j, n)] == node
        for i in range(n):
            assert [log[p] for p in merkle.siblings(i, n)] == folded(levels, i, levels[0][i])[1]


@pytest.mark.parametrize("high", [1, 3, 10])
def test_merkle_manifest(spark, high):
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "s", "web"]), rng.choice([None, "en", "en", "en", "de", "é", "z"]), rng.choice([None, 5, 2**63 - 1]), t, 1) for _ in range(4) for t in [x for _, x in texts()[:33]]]
    rows += [(7, "a", "solo", 3, "x", 1), (7, "a", "en", 3, "x", 1), (7, "a", "en", 3, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, grp int").repartition(6)
    leaf = lambda *v: hashlib.sha256("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v).encode()).hexdigest()
    groups = defaultdict(list)
    for i, source, lang, n, text, _ in rows:
        own = leaf(i, source, lang, n, text)
        changed = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        groups[lang].append(((i is not None, i or 0, own), own, leaf(i, source, lang, n + 1, text) if changed else own, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[1] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    want = Counter()
    for k, g in enumerate(names):
        for at, (_, own, start, i) in enumerate(sorted(groups[g])):
            path = folded(trees[g], at, own)[1] + folded(top, k, trees[g][-1][0])[1]
            end = folded(top, k, folded(trees[g], at, start)[0])[0]
            want[(i, own, trees[g][-1][0], top[-1][0], hashlib.sha256("".join(path).encode()).hexdigest(), end, end == top[-1][0])] += 1
    got = merkle.verified(merkle.document_leaves(docs), high).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert rows_of(got) == want
    assert merkle.verified(merkle.document_leaves(docs.limit(0))).count() == 0


def test_exact_dedup_query_on_null_ids(spark, tmp_path):
    from sextant.llm import queries

    rows = [(1, "a"), (4, "a"), (None, "a"), (None, "c"), (None, "c"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.QUERIES["op5_exact_dedup"](spark, str(tmp_path)).select("doc_id", "keep_id", "group_size", "kept").collect())
    assert {k[1:3] for k in got if k[0] is None} == {(4, 3), (None, 2)} and sum(got.values()) == 7
    assert got[(1, 4, 3, False)] == got[(4, 4, 3, True)] == got[(2, 3, 2, False)] == got[(3, 3, 2, True)] == 1


def test_columns_of_any_name_stay(spark):
    from sextant.llm import exact_dedup, jaccard_join

    names = ["doc_id", "Score", "_score", "__rd", "rd_", "extra_1", "a.b", "text"]
    docs = spark.createDataFrame([(1, 1, 2, 3, 4, 5, 6, "x y"), (2, 1, 2, 3, 4, 5, 6, "x y"), (3, 7, 7, 7, 7, 7, 7, "z")], names)
    for kept, ids in ((exact_dedup.keep_one(docs), [2, 3]), (jaccard_join.keep_one(docs, shingle=5, at_least=75), [1, 3])):
        assert kept.columns == names and sorted(r[0] for r in kept.collect()) == ids
