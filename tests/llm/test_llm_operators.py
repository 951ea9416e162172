"""Each operator on odd tables, against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import resource
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sextant.llm import chat, exact_dedup, jaccard_join, packing, phrase_automata, quality_crf, queries, repeats, sentencepiece_backend, tables, token_store, topk, units
from sextant.llm.bucket_refinement import drop_repeated_bytes
from sextant.llm.tables import scratch_dir

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, h long, rd string, rt double, label int, node int, n int, spans string, salt int, key string"


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(120)]
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, ""), (4, "  \n\t "), (5, "one two"), (6, "ONE  two"), (None, "lost id"), (None, None), (7, "x" * 500), (8, "y " * 900), (9, "y " * 900)]
    for i in range(10, 22):
        rows.append((i, " ".join(word() for _ in range(rng.randint(5, 80))) + (" " + passage + "\n" if i % 2 else " ") + " ".join(word() for _ in range(30))))
    for i in range(22, 34):
        copy = list(base)
        for _ in range(i - 22):
            copy[rng.randrange(120)] = word()
        rows.append((i, " ".join(copy)))
    rows += [(40, " ".join(word() for _ in range(20_000))), (41, rows[20][1]), (42, rows[20][1]), rows[25], rows[25], (43, "<|im_end|> <|endoftext|> \\ <\\| ';   \x1c! don't")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "r", 2.0, 3, 4, 5, "s", 6, "k") for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def windows_expected(units: list, size: int) -> list[list[bool]]:
    seen = Counter(tuple(u[i : i + size]) for u in units for i in range(len(u) - size + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - size + 1):
            if seen[tuple(u[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out.append(gone)
    return out


@pytest.mark.parametrize("limit", [1 << 17, 1])
def test_repeated_bytes(docs, limit):
    data = [(i, (t or "").encode()) for i, t in texts()]
    want = Counter()
    for (i, b), gone in zip(data, windows_expected([list(b) for _, b in data], 200)):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[(i, len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())] += 1
    assert rows_of(drop_repeated_bytes(docs, 200, group_limit=limit).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == want


@pytest.mark.parametrize("limit", [1 << 16, 1])
def test_repeated_words(docs, limit):
    data = [(i, WORDS.findall(t or "")) for i, t in texts()]
    want = Counter()
    for (i, w), gone in zip(data, windows_expected([w for _, w in data], 35)):
        want[(i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())] += 1
    out = phrase_automata.drop_repeated_words(docs, 35, group_limit=limit, carry=["h", "label"])
    assert out.columns[:4] == ["doc_id", "h", "label", "text"]
    assert rows_of(out.select("doc_id", "n_words", "n_removed", "kept_sha256")) == want


def shingles(t: str | None) -> frozenset:
    w = WORDS.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs):
    data = [(i, shingles(t)) for i, t in texts()]
    up = list(range(len(data)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            x, y = data[a][1], data[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    for k, (i, s) in enumerate(data):
        least[root(k)].append(i)
    want = Counter((i, len(s), min((x for x in least[root(k)] if x is not None), default=None) if s else i) for k, (i, s) in enumerate(data))
    assert rows_of(jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")) == want
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r[0] for r in kept.select("doc_id").collect()) == Counter({i: 1 for i, _, c in want if i == c and i is not None}) + Counter([None] * sum(v for (i, _, c), v in want.items() if i is None and c is None))


def test_keep_one_of_shared_ids(spark):
    """Linked texts that differ, without ids or with the same smallest one; components that share an id; texts without words."""
    base = [[f"{c}{k}" for k in range(60)] for c in "abcd"]
    near = lambda c, word: " ".join([*base[c], word])
    rows = [(None, near(0, "x")), (None, near(0, "y")), (None, near(0, "z")), (None, near(1, "x")), (5, near(2, "x")), (5, near(2, "y")), (9, near(2, "z")), (5, near(3, "x")), (None, near(3, "y")), (None, ""), (None, " "), (5, "")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, (r.text.split() or [""])[0]) for r in kept) == Counter([(None, "a0"), (None, "b0"), (5, "c0"), (5, "d0"), (None, ""), (None, ""), (5, "")])


def test_segments_of_long_texts():
    """The windows of anchors don't depend on segments, and 2**26 units are not too many."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (3000, 0, 150, 4000, 199, 201, 900)]
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) for t in texts])])
    data = np.concatenate(texts)

    def windows(limit):
        out = Counter()
        for h, _, doc, place in repeats.anchored(units.byte_values(data), data, bounds, 200, 32, limit):
            for g, d, pos, left, right in zip(h.tolist(), doc.tolist(), *(x.tolist() for x in repeats.unpack_place(place))):
                out.update((d, k, pos, g) for k in range(pos - left, pos + right - 199))
        return out

    whole = windows(1 << 20)
    assert Counter((d, k) for d, k, *_ in whole) == Counter((d, k) for d, t in enumerate(texts) for k in range(len(t) - 199))
    for limit in (200, 333, 1000, 4096):
        assert windows(limit) == whole
    words = np.where(data == 97, 32, data).astype(np.uint8)
    ids, ends = units.Texts(words, np.array([0, len(words)]), 0).word_ids()
    one = units.Texts(words, np.array([0, len(words)]), 0).words()
    assert ends[-1] == len(one.start) and all(ids[k].tobytes() == hashlib.sha256(words[one.start[k] : one.end[k]].tobytes()).digest()[:16] for k in (0, 7, 50))
    assert list(units.pieces(np.array([3, 3, 9, 1]), 4)) == [(0, 1), (1, 2), (2, 3), (3, 4)]
    size = (1 << 26) + 1000
    long = np.resize(rng.integers(0, 256, 1 << 20).astype(np.uint8), size)
    places = [place >> 24 for _, _, _, place in repeats.anchored(units.byte_values(long), long, np.array([0, size]), 200, 32)]
    assert max(int(p.max()) for p in places) >= size - 200


def thue_morse(n: int) -> tuple[str, str]:
    """A word of 2**n letters and its complement: equal under any polynomial modulo 2**64 from n = 10."""
    w = "a"
    for _ in range(n):
        w += w.translate({97: 98, 98: 97})
    return w, w.translate({97: 98, 98: 97})


def test_structured_words_stay_apart(spark):
    """Contents that weak fingerprints confuse, and rows without ids, in the operators that compare contents."""
    one, other = thue_morse(11)
    rest = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, one), (4, other), (None, one + "x"), (None, other + "x")], "doc_id long, text string")
    assert {r.n_removed for r in phrase_automata.drop_repeated_words(docs, 35).collect()} == {0}
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).where("doc_id > 2").collect()} == {3: 3, 4: 4}
    assert jaccard_join.keep_one(docs).count() == 5 and exact_dedup.keep_one(docs).count() == 6  # 1 and 2 do share most of their shingles
    many = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    assert many.select(*(c.alias(n) for c, n in zip(tables.row_key(), "ab"))).distinct().count() == 200_000
    lowest = spark.createDataFrame([(None, "t"), (-(2**63), "t"), (None, "u")], "doc_id long, text string")
    assert sorted(((r.keep_id, r.group_size, r.kept) for r in exact_dedup.drop_copies(lowest)[0].collect()), key=str) == sorted([(-(2**63), 2, False), (-(2**63), 2, True), (None, 1, True)], key=str)


def test_refine_and_confirm():
    """Buckets against comparison of all pairs, and passages that stand for every window that recurs."""
    rng = np.random.default_rng(2)
    for trial in range(30):
        base = rng.integers(0, 3, 60)
        rows, at, group = [], [], []
        for _ in range(8):
            left, right = int(rng.integers(0, 20)), int(rng.integers(21, 40))
            row = base[20 - left : 20 + right].copy()
            row[rng.integers(0, len(row), 2)] = rng.integers(0, 3, 2)
            rows.append(row)
            at.append(left)
            group.append(trial % 2 * int(rng.integers(0, 2)))
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(r) for r in rows])])
        windows = Counter((g, k - a, tuple(r[k : k + 20])) for r, a, g in zip(rows, at, group) for k in range(len(r) - 19))
        want = [int(b) + k for r, a, g, b in zip(rows, at, group, bounds) for k in range(len(r) - 19) if windows[g, k - a, tuple(r[k : k + 20])] > 1]
        start, bucket = repeats.refine(np.concatenate(rows), 2, bounds, np.array(at), np.array(group), 20)
        assert sorted(start.tolist()) == want
        n = rng.integers(1, 3, 8)
        passages = phrase_automata.confirmed(np.concatenate(rows), bounds, np.array(at), np.array(group), n, 20)
        covered = {(i, k) for i, r in enumerate(rows) for p in passages for k in range(len(r) - len(p) + 1) if tuple(r[k : k + len(p)].tolist()) == p for k in range(k, k + len(p) - 19)}
        ours = {(int(np.searchsorted(bounds, s, "right")) - 1, int(s - bounds[np.searchsorted(bounds, s, "right") - 1])) for s in want} | {(i, k) for i, r in enumerate(rows) if n[i] > 1 for k in range(len(r) - 19)}
        assert ours <= covered and len(set(passages)) == len(passages)


def test_products_beyond_a_long():
    a = np.array([[8e6 * 256] * 4, [1e300, 0, 0, 0], [-1e300, 0, 0, 0], [1, 2, 3, 4]])
    got = topk._products(a, np.abs(a).max(axis=1), a[0])
    assert got.tolist() == [min(4 * (8_000_000 * 256) ** 2, 2**63 - 1), 2**63 - 1, -(2**63), 10 * 8_000_000 * 256]
    assert topk._best(got, np.arange(4), 4).tolist() == [0, 1, 3, 2]


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for i, t in texts():
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, top, len(ids), i == top, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert rows_of(exact_dedup.drop_copies(docs)[0]) == want
    old, new = docs.where("doc_id <= 15"), docs.where("doc_id > 15 or doc_id is null")
    _, history = exact_dedup.drop_copies(old)
    _, history = exact_dedup.drop_copies(new, history)
    assert rows_of(history.verdicts(exact_dedup.digests(docs))) == want
    stranger = docs.sparkSession.createDataFrame([(99, bytearray(32))], "rid long, digest binary")
    assert [tuple(r)[2:] for r in history.look_up(stranger).collect()] == [(False, None, None)]
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_perfect_hash():
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    levels, slot = exact_dedup.build_hash(digests)
    assert sorted(slot) == list(range(5000)) and (exact_dedup.find_slots(levels, digests) == slot).all()


def test_token_store(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    order = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = Counter(), 0
    for i, t in order:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want[(i, start, len(ids) // 4, zlib.crc32(ids))] += 1
        start += len(ids) // 4
    store = scratch_dir(spark)
    token_store.write_store(docs, store, path, end_id=1)
    out = token_store.read_store(spark, store)
    assert rows_of(out.select("doc_id", "start", "n_tokens", "ids_crc32")) == want
    some = token_store.read_documents(spark, store, [12, 40])
    assert sorted((r.doc_id, zlib.crc32(r.ids)) for r in some.collect()) == sorted((i, c) for i, _, _, c in want if i in (12, 40))
    store = scratch_dir(spark)
    token_store.write_store(none, store, path, end_id=1)
    assert token_store.read_store(spark, store).count() == 0


def test_packing(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    out = packing.pack_documents(docs, path, end_id=2, capacity=256, keep_ids=True).collect()
    sequences, pieces = defaultdict(list), Counter()
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and (r.piece == 0 or r.length == 256)
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[(r.doc_id, r.piece, r.start, bytes(r.ids))] += 1
    for members in sequences.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= 256
    want, sizes = Counter(), []
    for i, t in texts():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cut = (len(ids) - 1) % 256 + 1
        for k, a in enumerate([0, *range(cut, len(ids), 256)]):
            part = ids[a : cut if k == 0 else a + 256]
            want[(i, k, a, np.array(part, "<u4").tobytes())] += 1
            sizes.append(len(part))
    assert pieces == want
    assert len(sequences) <= packing.lower_bound(np.bincount(sizes, minlength=257), 256) + 1
    assert packing.pack_documents(none, path, end_id=2).count() == 0


def test_packing_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "PARTITION_DOCUMENTS", 40)
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1000, 400).tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size int")
    bins, proof = packing.pack(items, 1000)
    got = bins.join(items, "item").groupBy("sequence_id").agg(F.sum("size").alias("s"), F.max(F.col("offset") + F.col("size")).alias("e")).collect()
    assert sum(r.s for r in got) == sum(sizes) and all(r.s == r.e <= 1000 for r in got)
    assert bins.count() == 400 and proof.where("bins < bound").count() == 0
    whole = packing.best_fit(np.array(sizes), 1000)[2]
    assert len(got) <= len(whole) + 12


def test_packing_repair(spark):
    """A single partition with a gap exchanges documents too, and no round makes it worse."""
    sizes = np.random.default_rng(8).integers(200, 500, 300).tolist()
    bins, proof = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "item long, size int"), 1000)
    assert bins.select("item").distinct().count() == bins.count() == 300 and proof.where("round > 0").count() >= 1
    assert bins.select("sequence_id").distinct().count() <= len(packing.best_fit(np.array(sizes), 1000)[2])


def test_lower_bound():
    counts = np.zeros(101, int)
    counts[51], counts[34] = 7, 9
    assert packing.lower_bound(counts, 100) == 8  # seven over a half, each with room for one of the nine thirds; the two that are left share one
    assert packing.lower_bound(np.zeros(101, int), 100) == 0


def test_sentencepiece(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepiece_backend.encode(docs, path)
    want = Counter((i, np.array(own.encode(t or ""), "<u4").tobytes()) for i, t in texts())
    assert Counter((r.doc_id, bytes(r.ids)) for r in out.collect()) == want
    assert out.where("not parity or not round_trip").count() == 0
    back = sentencepiece_backend.decode(out, path)
    assert Counter((r[0], r[1]) for r in back.collect()) == Counter((i, t or "") for i, t in texts())
    assert sentencepiece_backend.encode(none, path).count() == 0


def test_sentencepiece_unigram():
    number = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)
    field = lambda k, data: number(k << 3 | 2) + number(len(data)) + data
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), ("▁", -3.0, 1), ("▁ab", -1.5, 1), ("a", -4.0, 1), ("b", -4.0, 1), ("abc", -2.0, 1), ("c", -3.5, 1), ("bc", -2.5, 1)]
    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + b"\x18" + number(k)) for p, s, k in pieces)
    data += field(2, b"\x18\x01" + number(35 << 3) + b"\x01") + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")
    model = sentencepiece_backend.Model(data)
    own, tokenizer = sentencepiece.SentencePieceProcessor(model_proto=data), model.tokenizer()
    for text in ("ab abc", "cab", "aé b", "abcabc bc", ""):
        assert tokenizer.encode(model.normalised(text)).ids == own.encode(text)


def test_quality(spark, docs, none):
    good = [f"The {a} sees a {b}.\nThen all goes on, as it {a} did.\n" for a in ("cat", "dog", "owl", "fox") for b in ("hill", "tree", "lake", "road")]
    bad = [f"BUY!! {a}### {b}%%% NOW!!\n{a}$$$ {a}$$$ {a}$$$\n" for a in ("CAT", "DOG", "OWL", "FOX") for b in ("x", "y", "z", "w")]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < len(good))) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    train = marks.where("doc_id % 4 != 2 or doc_id is null")
    model = quality_crf.fit(table, train)
    got = dict(quality_crf.score(table, model).select("doc_id", "score").collect())
    assert all((got[i] >= 0.7) == (i < len(good)) for i, _ in rows if i % 4 == 2)
    odd = quality_crf.score(docs.withColumn("score", F.lit("x")), model)
    assert odd.columns == [*docs.columns, "score"] and odd.where("score between 0 and 1").count() == len(texts())
    assert quality_crf.score(none, model).count() == 0
    blank = quality_crf.fit(table, marks.limit(0))
    assert {r.score for r in quality_crf.score(table, blank).collect()} == {0.5}
    mixed = next(quality_crf.slices(pa.array(["The cat sees a hill.\nBUY!! X### NOW!!"])))
    p, size, bounds = model.line_marginals(mixed)
    assert bounds.tolist() == [0, 2] and size.tolist() == [20, 16] and ((0 <= p) & (p <= 1)).all()


def test_quality_held_out(spark):
    """Documents that the model hasn't seen: how well the score orders them, and how often the verdict is right."""
    out = queries.QUERIES["op2_quality_classifier"](spark, "/root/testdata/sf0.01").where("held_out")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = [(r.score, r.predicted, r.quality) for r in out.join(marks, "doc_id").where("quality is not null").collect()]
    good, bad = [s for s, _, q in rows if q == 1], [s for s, _, q in rows if q == 0]
    area = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert area >= 0.95 and sum(p == q for _, p, q in rows) / len(rows) >= 0.9, (area, rows)


def test_many_lines():
    """A text of line feeds only is worked through in little memory, and chains don't change the marginals."""
    rng = np.random.default_rng(3)
    model = quality_crf.Crf(rng.normal(size=quality_crf.FEATURES), rng.normal(size=(2, 2)))
    began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert 0 <= model.quality(units.Texts(np.full(1 << 21, 10, np.uint8), np.array([0, 1 << 21]), 0))[0] <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - began < 1 << 20


def test_forward_backward(monkeypatch, chain=2):
    monkeypatch.setattr(quality_crf, "CHAIN", chain)
    rng = np.random.default_rng(5)
    emission, transition, bounds = rng.normal(size=(7, 2)), rng.normal(size=(2, 2)), np.array([0, 3, 4, 7])
    p, pairs, log_z = quality_crf._marginals(emission, transition, bounds)
    total = np.zeros((2, 2))
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        weight, mass, links = 0.0, np.zeros((b - a, 2)), np.zeros((2, 2))
        for code in range(2 ** (b - a)):
            y = [code >> j & 1 for j in range(b - a)]
            w = np.exp(sum(emission[a + j, y[j]] for j in range(b - a)) + sum(transition[y[j], y[j + 1]] for j in range(b - a - 1)))
            weight += w
            for j in range(b - a):
                mass[j, y[j]] += w
            for j in range(b - a - 1):
                links[y[j], y[j + 1]] += w
        assert np.allclose(p[a:b], mass / weight) and np.isclose(log_z[k], np.log(weight))
        total += links / weight
    assert np.allclose(pairs, total)


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 40)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(5, 8))
    data = [(i, (centres[i % 5] * rng.uniform(0.1, 3) + rng.normal(size=8) * 0.2).tolist()) for i in range(300)]
    data += [(300, data[7][1]), (350, data[7][1]), (351, [0.0] * 8), (352, [1.0] * 3), (400, [0.5] * 3), (353, None), (354, [None] * 8), (355, [float("nan")] * 8), (None, [1.0] * 8), data[9]]
    vectors = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in data], "vec_id long, embedding array<double>, norm int, v string, bucket int")
    got = Counter(tuple(r) for r in topk.search(vectors, "vec_id % 50 = 0", k=5).collect())
    valid = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in data if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = Counter()
    for q, x in dict(valid).items():
        if q % 50 == 0:
            near = sorted(((-int(v @ x), i) for i, v in valid if i != q and len(v) == len(x)))[:5]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(near))
    assert got == want
    assert topk.search(vectors.limit(0), "vec_id % 50 = 0").count() == 0


def test_chat(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "\\<\\|", "a<", "|b\\", "", None, "<|im_sep|>\n", "漢👍🏽"]
    rows = [(c, t, ["user", "assistant", "assistant", None, "sys\ntem\\l"][(c + t) % 5], hard[(3 * c + t) % 8], "x", 1) for c in range(6) for t in range(9)]
    rows += [(7, None, "assistant", "t", "x", 1), (7, 1, "user", "same", "x", 1), (7, 1, "user", "same", "x", 1), (None, 1, "assistant", "n", "x", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, lead string, end int")
    out = chat.format_conversations(turns).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()
    want = defaultdict(list)
    for c, t, r, x, *_ in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    assert len(out) == len(want)
    for r in out:
        own = sorted(want[r.conv_id])
        assert [(t.role, t.text) for t in r.turns] == [(a, b) for _, _, a, b in own] and r.n_turns == len(own)
        assert r.loss == "".join(b for _, _, a, b in own if a == "assistant")
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_empty_tables(none):
    assert drop_repeated_bytes(none).count() == 0
    assert phrase_automata.drop_repeated_words(none).count() == 0
    assert jaccard_join.near_duplicates(none).count() == 0
    assert exact_dedup.drop_copies(none)[0].count() == 0
    assert exact_dedup.keep_one(none).count() == 0


def test_long_texts(spark):
    """Texts over a slice, alone and repeated, through every operator on texts."""
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(180_000))
    dense = "z" * 1_200_000
    docs = spark.createDataFrame([(1, long), (2, "head " + long + " tail"), (3, dense), (4, "short")], "doc_id long, text string")
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in drop_repeated_bytes(docs).collect()}
    assert cut[1] == (len(long), len(long), 1) and cut[2] == (len(long) + 10, len(long) + 2, 1) or cut[2][1] >= len(long)
    assert cut[3] == (1_200_000, 1_200_000, 1) and cut[4][1] == 0
    kept = {r.doc_id: (r.n_words, r.n_removed) for r in phrase_automata.drop_repeated_words(docs).collect()}
    assert kept == {1: (180_000, 180_000), 2: (180_002, 180_000), 3: (1, 0), 4: (1, 0)}
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, keep_ids=True).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("piece").alias("p")).collect()
    assert all(-(-r.n // 1024) == r.p + 1 for r in packed)
    store = scratch_dir(spark)
    token_store.write_store(docs, store, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    assert token_store.read_store(spark, store).where("n_tokens * 4 != octet_length(ids)").count() == 0
    coded = sentencepiece_backend.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert coded.where("parity and round_trip").count() == 4


def test_queries_read_whole_tables(spark):
    """Each query has a row for every row that it is about."""
    size = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for name in ("op1_sentencepiece", "op2_quality_classifier", "op4_token_binary_output", "op5_exact_dedup", "op7_substring_dedup", "op8_ngram_jaccard_join", "op10_suffix_array_dedup"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == size, name
    packed = queries.QUERIES["op6_best_fit_packing"](spark, "/root/testdata/sf0.001")
    assert packed.where("piece = 0").count() == size and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
