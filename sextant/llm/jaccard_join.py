"""N-gram Jaccard join: size-aware heavy-light join on sets of word shingles.

Texts become sets of 64-bit fingerprints of their shingles (chained from the
SHA-256 of their words); equal sets, by 128 bits, count once.  Two sets of m and n shingles link when their intersection is at least
`at_least` hundredths of their union, hence at least that share of either.

1. Sift.  In any order of all shingles, linked sets share some of their first
   ones: with l(n) = n // 10 + 1, at least l of the smaller set among the first
   n - ceil(share * n) + l(n) of each.  In fingerprint order this needs a third
   of the shingles only, sent in packed buckets; sets with too few shared ones
   are linked with nothing.
2. Order what is left by frequency, rarest first, and keep each set's prefix.
3. Light sets, those for which it costs less, enumerate all pairs of shingles
   of a prefix longer by one, for linked sets share two of them; heavy sets, and
   light ones that can link with a heavy one, go to the inverted lists of single
   shingles.  The boundary is the largest size at which the rows that are
   enumerated don't exceed the rows that scanning would take.
4. Scan: every set of a list is compared with the list's most central set
   (fewest rare shingles), links are merged into components, and then only pairs
   of different components that share a list, and that sizes and positions
   allow, are compared.  So copies of one text, near or exact, are never expanded
   into all pairs, and yet any two sets that may link are either compared or
   already in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .tables import keyed_texts, small_side, without, written
from .units import Texts, mix, slices

#: Documents of one packed bucket, roughly; the number of buckets grows with the table.
DOCS_PER_BUCKET = 2000
_SET_1, _SET_2 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_LOCAL = 0xFFFF


def _sets(part: Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each text's distinct shingles, ascending, and their bounds."""
    ids, bounds = part.word_ids(lower=True)
    word, count = ids[:, 0] ^ mix(ids[:, 1].copy()), np.diff(bounds)
    doc_of_word = np.repeat(np.arange(len(part)), count)
    doc, token = [], []
    for size in range(1, shingle + 1):  # whole sequences of fewer words, and then shingles
        if size < shingle:
            docs = np.flatnonzero(count == size)
            at = bounds[docs]
        else:
            at = np.flatnonzero(np.arange(len(word)) + size <= bounds[1:][doc_of_word]) if len(word) else np.zeros(0, np.int64)
            docs = doc_of_word[at]
        chain = np.full(len(at), size, np.uint64)
        for k in range(size):
            chain = mix(chain ^ word[at + k])
        token.append(chain)
        doc.append(docs)
    token, doc = np.concatenate(token), np.concatenate(doc)
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(part) + 1))


def _ceil_share(n: np.ndarray, at_least: int) -> np.ndarray:
    return -(-at_least * n // 100)


def _pack(tokens: np.ndarray) -> bytes:
    """The low five bytes of each; with the bucket's bits they are as good as unique."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


_SENT = "bucket int, batch long, doc_id long, rd long, rt long, n int, s1 long, s2 long, idx int, shared int, tokens binary, owners binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("doc_id", pa.int64()), ("rd", pa.int64()), ("rt", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("idx", pa.int32()), ("shared", pa.int32()), ("tokens", pa.binary()), ("owners", pa.binary())])


def _rows(count: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in _SENT_ARROW], schema=_SENT_ARROW)


def _send(shingle: int, at_least: int, bits: int):
    """Texts -> a row for each text, and packed rows of the first shingles for each bucket."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        batch_id = (context.partitionId() if context else 0) << 32
        for whole in batches:
            for begin in range(0, whole.num_rows, 4096):
                batch = whole.slice(begin, 4096)
                batch_id += 1
                sizes, one, two, first, owner = [], [], [], [], []
                for part in slices(batch.column("text")):
                    token, bounds = _sets(part, shingle)
                    n = np.diff(bounds)
                    sums = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token ^ salt))]) for salt in (_SET_1, _SET_2))
                    for out, total in zip((one, two), sums):
                        out.append(total[bounds[1:]] - total[bounds[:-1]])
                    rank = np.arange(len(token)) - np.repeat(bounds[:-1], n)
                    take = rank < np.repeat(n - _ceil_share(n, at_least) + n // 10 + 1, n)
                    sizes.append(n)
                    first.append(token[take])
                    owner.append(np.repeat(np.arange(len(part)) + part.first, n)[take])
                n, s1, s2 = np.concatenate(sizes), np.concatenate(one), np.concatenate(two)
                token, owner = np.concatenate(first), np.concatenate(owner)
                order = np.argsort(token, kind="stable")
                token, owner = token[order], owner[order]
                head = np.ones(len(token), bool)
                head[1:] = token[1:] != token[:-1]
                run = np.cumsum(head) - 1
                often = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
                shared = np.bincount(owner[often], minlength=batch.num_rows)
                owner = np.where(often, _LOCAL, owner)[head].astype("<u2")
                token = token[head]
                bucket = (token >> np.uint64(64 - bits)).astype(np.int64)
                edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                full = np.flatnonzero(np.diff(edges))
                yield _rows(
                    batch.num_rows, bucket=np.full(batch.num_rows, (batch_id ^ batch_id >> 32) % (1 << bits)), batch=np.full(batch.num_rows, batch_id), doc_id=batch.column("doc_id"), rd=batch.column("rd"), rt=batch.column("rt"),
                    n=n, s1=s1.view(np.int64), s2=s2.view(np.int64), idx=np.arange(batch.num_rows), shared=shared,
                )
                yield _rows(
                    len(full), bucket=full, batch=np.full(len(full), batch_id),
                    tokens=[_pack(token[edges[b] : edges[b + 1]]) for b in full], owners=[owner[edges[b] : edges[b + 1]].tobytes() for b in full],
                )

    return emit


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets, one behind the other -> the rows of texts as they are, and a row for each batch in a bucket with how many shingles which texts share."""
    held: list[tuple[int, bytes, bytes]] = []
    now = None

    def count() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        tokens = np.concatenate([_unpack(t) for _, t, _ in held])
        owner = np.concatenate([np.frombuffer(o, "<u2") for _, _, o in held]).astype(np.int64)
        which = np.repeat(np.arange(len(held)), [len(o) // 2 for _, _, o in held])
        order = np.argsort(tokens, kind="stable")
        tokens, owner, which = tokens[order], owner[order], which[order]
        head = np.ones(len(tokens), bool)
        head[1:] = tokens[1:] != tokens[:-1]
        run = np.cumsum(head) - 1
        hit = (np.bincount(run)[run] > 1) & (owner != _LOCAL)
        key, n = np.unique(which[hit] << 16 | owner[hit], return_counts=True)
        edges = np.searchsorted(key >> 16, np.arange(len(held) + 1))
        full = np.flatnonzero(np.diff(edges))
        if len(full):
            yield _rows(
                len(full), batch=[held[i][0] for i in full], tokens=[n[edges[i] : edges[i + 1]].astype("<u4").tobytes() for i in full],
                owners=[(key[edges[i] : edges[i + 1]] & 0xFFFF).astype("<u2").tobytes() for i in full],
            )

    for batch in batches:
        texts = batch.filter(batch.column("tokens").is_null())
        if texts.num_rows:
            yield texts
        for bucket, b, t, o in zip(*(batch.column(k).to_pylist() for k in ("bucket", "batch", "tokens", "owners"))):
            if t is None:
                continue
            if bucket != now:
                yield from count()
                held, now = [], bucket
            held.append((b, t, o))
    yield from count()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's rows of texts and its counts from all buckets, one batch behind the other -> the rows of texts with their sums."""
    held: list[pa.RecordBatch] = []

    def total() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        counts = rows.filter(rows.column("tokens").is_valid())
        texts = rows.filter(rows.column("tokens").is_null())
        shared = np.zeros(1 << 16, np.int64)
        for n, who in zip(counts.column("tokens").to_pylist(), counts.column("owners").to_pylist()):
            shared[np.frombuffer(who, "<u2")] += np.frombuffer(n, "<u4")
        own = texts.column("shared").to_numpy() + shared[texts.column("idx").to_numpy()]
        names = ["doc_id", "rd", "rt", "n", "s1", "s2"]
        return pa.RecordBatch.from_arrays([*(texts.column(c).combine_chunks() for c in names), pa.array(own, pa.int64())], names=[*names, "shared"])

    for batch in batches:
        key = batch.column("batch").to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and held[-1].column("batch")[0].as_py() != key[a]:
                yield total()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield total()


def shingle_sets(texts: DataFrame, shingle: int, at_least: int, bits: int) -> DataFrame:
    """A row for each row of texts: doc_id, rd, rt, n (set size), s1, s2 (the set's fingerprint), shared (first shingles that others share)."""
    sent = texts.select("doc_id", "rd", "rt", "text").mapInArrow(_send(shingle, at_least, bits), _SENT)
    counted = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted, _SENT)
    return counted.repartition("batch").sortWithinPartitions("batch").mapInArrow(_summed, "doc_id long, rd long, rt long, n int, s1 long, s2 long, shared long")


def _tokens(shingle: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                token, bounds = _sets(part, shingle)
                own = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(token.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(part.first, len(part)), batch.column("n").slice(part.first, len(part)), own], names=["node", "n", "tokens"])

    return emit


def _least(n: Column, at_least: int) -> Column:
    """The least overlap with which a set of n shingles can link at all."""
    return F.ceil(F.lit(at_least) * n / F.lit(100)).cast("long")


def _overlap(m: Column, n: Column, at_least: int) -> Column:
    """The least overlap with which sets of m and n shingles link."""
    return F.ceil(F.lit(at_least) * (m + n) / F.lit(100 + at_least)).cast("long")


def _linked(pairs: DataFrame, sets: DataFrame, at_least: int) -> DataFrame:
    """The pairs (a, b) of sets that link."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(a, "a").join(b, "b").where(F.lit(100) * both >= F.lit(at_least) * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _lists(sets: DataFrame, at_least: int) -> DataFrame:
    """kind, key, node, n, pos: the lists in which any two sets that link, and that aren't equal, meet.

    pos is how many shingles of the set come before the key's first one in the common order.
    """
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    kept = tokens.join(shared, "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
    prefix = F.col("n") - _least(F.col("n"), at_least) + 1
    rare = F.col("n") - F.size("own")
    kept = (
        kept.withColumn("p", prefix).withColumn("rare", rare).where("rare < p")
        .select("node", "n", "p", "rare", F.transform(F.slice("own", F.lit(1), (F.col("p") + 1 - F.col("rare")).cast("int")), lambda x: x["token"]).alias("own"))
    )
    kept = written(kept)
    single = kept.select("node", "n", F.explode(F.slice("own", F.lit(1), (F.col("p") - F.col("rare")).cast("int"))).alias("token"))
    scan = single.groupBy("token").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("rows"), F.sum(F.col("c") - 1).alias("pairs")).first()
    cost = 1 + (scan["pairs"] / scan["rows"] if scan["rows"] else 0)  # rows that an entry of a list takes: itself and its comparison
    light = int(max((n for n in range(3, 1000) if (p := n - -(-at_least * n // 100) + 1) * (p + 1) / 2 <= p * cost), default=0))
    subsets = kept.where(F.col("n") <= light).select(
        F.lit(0).alias("kind"), "node", "n", "rare", F.posexplode("own").alias("i", "one"), "own"
    ).select("kind", "node", "n", (F.col("rare") + F.col("i")).alias("pos"), "one", F.explode(F.slice("own", F.col("i") + 2, F.size("own"))).alias("two"))
    heavy = kept.where(F.col("n") >= F.ceil(F.lit(at_least) * F.lit(light + 1) / 100)).select(
        F.lit(1).alias("kind"), "node", "n", "rare", F.posexplode(F.slice("own", F.lit(1), (F.col("p") - F.col("rare")).cast("int"))).alias("i", "one")
    ).select("kind", "node", "n", (F.col("rare") + F.col("i")).alias("pos"), "one", F.lit(None).cast("long").alias("two"))
    key = F.struct("kind", "one", "two")
    return subsets.unionByName(heavy).select(key.alias("key"), "node", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"))


def linked_sets(sets: DataFrame, at_least: int) -> DataFrame:
    """node, label: components of sets (node, n, tokens; no two equal) by links; only of sets that have one."""
    sets = written(sets)
    lists = written(_lists(sets, at_least))
    left = F.col("n") - F.col("pos")
    fits = lambda r, s, m, n: F.least(r, s) >= _overlap(m, n, at_least)
    centre = lists.groupBy("key").agg(F.max(F.struct((left / F.col("n")).alias("part"), "n", "pos", "node")).alias("centre"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    star = lists.join(centre, "key").where(F.col("node") != F.col("centre.node")).where(
        fits(left, F.col("centre.n") - F.col("centre.pos"), F.col("n"), F.col("centre.n"))
    ).select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")).distinct()
    links = written(_linked(star, sets, at_least))
    labels = components(links, "a", "b")
    marked = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_keys = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    marked = written(marked.join(open_keys, "key"))
    x = marked.select("key", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "pos", "label")))
    y = marked.select("key", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "pos", "label")))
    # sizes of sets that link are in one class or in neighbouring ones, so that long lists fall apart before any pair is made
    size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(100 / at_least))) if at_least < 100 else n
    x = x.withColumn("class", size_class(F.col("n_a")))
    y = y.withColumn("class", F.explode(F.array(size_class(F.col("n_b")), size_class(F.col("n_b")) - 1)))
    cross = x.join(y, ["key", "class"]).where("(n_a, node_a) < (n_b, node_b) and label_a != label_b").where(
        fits(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"), F.col("n_a"), F.col("n_b"))
    ).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    more = written(_linked(cross, sets, at_least))
    return components(links.unionByName(more), "a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, at_least: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The component of every document under links of similar shingle sets.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a set holds all
    distinct runs of `shingle` words, or the whole sequence where a text has
    fewer.  Documents link when 100 * intersection >= at_least * union.  Returns
    doc_id, rd, rt (see `keyed_texts`), n_shingles and component_id, the smallest
    doc_id of all that links reach.

    Null text counts as empty; texts without words have no shingles and link
    with nothing.  Rows are documents, rows that repeat link with each other;
    null ids never name a component that has others, and one with null ids only
    has a null component_id.  An empty table gives an empty result; other
    columns aren't read.
    """
    return _labelled(docs, shingle, at_least, id_col, text_col).drop("stays")


def _labelled(docs: DataFrame, shingle: int, at_least: int, id_col: str, text_col: str) -> DataFrame:
    """`near_duplicates` with stays: whether (rd, rt) is its component's first by id (null last), then text hash; always where there are no shingles."""
    texts = keyed_texts(docs, id_col, text_col)
    bits = max(4, int(max(1, texts.count() // DOCS_PER_BUCKET) - 1).bit_length())
    rows = written(shingle_sets(texts, shingle, at_least, bits))
    classes = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("rd", "rt")).alias("one"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "rd", "rt")).alias("stays"), F.max("shared").alias("shared"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))  # a number of each different set, fixed in the table
    enough = F.floor(_least(F.col("n"), at_least) / 10) + 1
    wanted = written(classes.where(F.col("shared") >= enough).select("one.rd", "one.rt", F.col("node"), "n"))
    sets = texts.join(small_side(wanted), ["rd", "rt"]).select("node", "n", "text").mapInArrow(_tokens(shingle), "node long, n int, tokens array<long>").dropDuplicates(["node"])
    labels = linked_sets(sets, at_least)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("least_id").alias("component_id"), F.min("stays").alias("stays"))
    named = named.drop("stays").join(names, "label").select("n", "s1", "s2", "component_id", "stays")
    return rows.join(named, ["n", "s1", "s2"], "left").select(
        "doc_id", "rd", "rt", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n") == 0) | ((F.col("rd") == F.col("stays.rd")) & (F.col("rt") == F.col("stays.rt")))).alias("stays"),
    )


def keep_one(docs: DataFrame, shingle: int = 5, at_least: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each component of `near_duplicates`: the smallest id, of rows that share it or have none the smallest text hash.

    Texts without words have no component and stay; of rows that repeat id and text one stays.
    """
    found = _labelled(docs, shingle, at_least, id_col, text_col)
    gone = found.groupBy("rd", "rt").agg(F.max("stays").alias("stays")).where("not stays")
    return without(docs, gone, id_col, text_col)
