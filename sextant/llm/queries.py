"""The queries of this subpackage: thin callers of its operators, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bucket_refinement import drop_repeated_bytes

    out = drop_repeated_bytes(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrase_automata import drop_repeated_words

    return drop_repeated_words(table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=5, at_least=75).select("doc_id", "n_shingles", "component_id")


@query
def op4_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tables import scratch_dir
    from .token_store import read_store, write_store

    store = scratch_dir(spark)
    write_store(table(spark, sf_dir, "documents"), store, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_store(spark, store, keep_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_backend import encode

    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_crc32", "parity", "round_trip")


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .quality_crf import fit, held_out, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import search

    return search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5, scale=256)


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .exact_dedup import History, add, digests
    from .tables import written

    # The older half of the ids, null ids with it, is the history, the newer half comes to it; then every row is looked up.
    rows = written(digests(table(spark, sf_dir, "documents")))
    older = F.coalesce(F.col("rid") <= F.lit(rows.agg(F.percentile_approx("rid", 0.5)).first()[0]), F.lit(True))
    history = History.build(add(None, rows.where(older)))
    history = History.build(add(history, rows.where(~older)))
    return history.verdicts(rows)


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .chat import format_conversations, read_loss, read_turns

    hard = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    out = format_conversations(turns).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import labels, scan

    return labels(scan(table(spark, sf_dir, "documents"), base={"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .fill_in_middle import restore, transform

    out = transform(table(spark, sf_dir, "documents"), seed=42, rate=50, spm_rate=80)
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import document_leaves, verified

    return verified(document_leaves(table(spark, sf_dir, "documents"))).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# SQL for the same rows, where SQL can say it.

ORACLE_SQL["op3_exact_topk"] = """WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5"""

ORACLE_SQL["op5_exact_dedup"] = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL["op7_substring_dedup"] = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
flat AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
starts AS (SELECT doc_id, i, string_agg(word, ' ') OVER ahead AS win, count(*) OVER ahead AS n FROM flat WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
hit AS (SELECT doc_id, i, count(*) OVER (PARTITION BY win) > 1 AS again FROM starts WHERE n = 35),
marked AS (SELECT f.doc_id, f.i, f.word, coalesce(max(again::INT) OVER (PARTITION BY f.doc_id ORDER BY f.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone FROM flat f LEFT JOIN hit USING (doc_id, i)),
sums AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN sums USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op8_ngram_jaccard_join"] = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS words FROM documents),
flat AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i, len(words) AS total FROM w),
starts AS (SELECT doc_id, total, string_agg(word, ' ') OVER ahead AS s, count(*) OVER ahead AS n, i FROM flat WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
sets AS (SELECT DISTINCT doc_id, s FROM starts WHERE n = 5 OR (total < 5 AND i = 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id"""

ORACLE_SQL["op9_chat_formatting"] = r"""WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY k)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n + CASE WHEN before IS NULL THEN 12 + length(role) + 1 WHEN before <> role THEN 11 + 12 + length(role) + 1 ELSE 10 END) + 11 AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

ORACLE_SQL["op12_fill_in_middle"] = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS e FROM t),
p AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 50 THEN 'plain' WHEN e < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(list_slice(units, 1, least(a, b)), '') AS pre, array_to_string(list_slice(units, least(a, b) + 1, greatest(a, b)), '') AS mid, array_to_string(list_slice(units, greatest(a, b) + 1, n), '') AS suf FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

#: The CRC-32 of a decimal id, bit by bit: each character is taken in, then eight shifts.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END))"""
_TREE = "SELECT {0}h + 1, j // 2, sha256(string_agg(d, '' ORDER BY j)), (any_value(n) + 1) // 2 FROM {1} WHERE n > 1 GROUP BY {0}h, j // 2"

ORACLE_SQL["op13_merkle_manifest"] = f"""WITH RECURSIVE f AS (SELECT doc_id, lang, text, n_chars, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS before,
    coalesce(strlen(text) || ':' || text, '-') AS behind, coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS own, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more FROM documents),
l AS (SELECT doc_id, lang, sha256(before || own || behind) AS leaf, sha256(before || more || behind) AS other FROM f),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM l),
nodes(lang, h, j, d, n) AS (SELECT lang, 0, i, leaf, n FROM leaves UNION ALL {_TREE.format("lang, ", "nodes")}),
roots AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM nodes WHERE n = 1),
top(h, j, d, n) AS (SELECT 0, g, d, n FROM roots UNION ALL {_TREE.format("", "top")}),
places AS (SELECT a.*, r.g, r.d AS subroot FROM leaves a JOIN roots r ON a.lang IS NOT DISTINCT FROM r.lang),
steps AS (SELECT p.g, p.i, k.h, CASE WHEN s.d IS NULL THEN '-' WHEN (p.i >> k.h) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.d, '') AS step FROM places p JOIN nodes k ON k.lang IS NOT DISTINCT FROM p.lang AND k.j = 0 AND k.n > 1
        LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.h = k.h AND s.j = xor(p.i >> k.h, 1)
    UNION ALL SELECT p.g, p.i, 1000 + k.h, CASE WHEN s.d IS NULL THEN '-' WHEN (p.g >> k.h) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.d, '') FROM places p JOIN top k ON k.j = 0 AND k.n > 1 LEFT JOIN top s ON s.h = k.h AND s.j = xor(p.g >> k.h, 1)),
proof AS (SELECT g, i, string_agg(step[2:], '' ORDER BY h) AS joined, list(step ORDER BY h) AS steps FROM steps GROUP BY g, i),
given AS (SELECT p.doc_id, p.leaf, p.subroot, (SELECT d FROM top WHERE n = 1) AS root, coalesce(q.joined, '') AS joined, coalesce(q.steps, []) AS steps, CASE WHEN {_CRC} % 7 = 0 THEN p.other ELSE p.leaf END AS start FROM places p LEFT JOIN proof q ON p.g = q.g AND p.i = q.i),
folded AS (SELECT *, list_reduce(list_prepend(start, steps), lambda node, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || node WHEN 'R' THEN node || s[2:] ELSE node END)) AS folded_root FROM given)
SELECT doc_id, leaf, subroot, root, sha256(joined) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""
