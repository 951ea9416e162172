"""Document quality from a linear-chain conditional random field over lines.

Each line of a text is labelled good or bad.  Its features are those of the line
itself and of the lines before and after it; a transition weight for each pair of
labels joins neighbours.  The model is fitted by the conditional likelihood of
lines that carry their document's label.  A document's quality is the mean of the
lines' marginal probability of being good, weighted by their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from .tables import written
from .units import Texts, slices

#: Labelled documents that the model is fitted on, at most, and lines of all of them together; a document is taken as a whole or not.
TRAINING_DOCUMENTS, TRAINING_LINES = 4000, 100_000
#: Lines whose features are held at once, and lines of a text that are chained one behind the other.
LINES, CHAIN = 1 << 16, 256
STEPS, RATE, PENALTY = 300, 0.05, 1e-3

_CUTS = np.array([0.02, 0.06, 0.15, 0.3, 0.6])
_LENGTHS = np.array([1, 20, 80, 300, 1000])
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 upper case, 2 lower case or beyond ASCII, 3 digit, 4 space, 5 sentence marks, 6 symbols
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[list(b".,;:'\"()-?")] = 5
_CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 6
_RATES = 9
LINE_FEATURES = _RATES * len(_CUTS) + len(_LENGTHS)
FEATURES = 1 + 3 * LINE_FEATURES + 2


def line_rates(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates of every line, its length in bytes, and the bounds of each text's lines.

    Lines end at line feeds; a text always has at least one.
    """
    data = part.data
    feeds = np.flatnonzero(data == 10)
    doc = np.searchsorted(part.bounds, feeds, "right") - 1
    count = np.bincount(doc, minlength=len(part)) + 1
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    start, end = np.zeros(bounds[-1], np.int64), np.zeros(bounds[-1], np.int64)
    start[bounds[:-1]], end[bounds[1:] - 1] = part.bounds[:-1], part.bounds[1:]
    place = np.arange(len(feeds)) + doc
    end[place], start[place + 1] = feeds, feeds + 1
    kind = _CLASS[data]
    size = (end - start).astype(np.float64)
    at_least_1 = np.maximum(size, 1)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])
        return (sums[end] - sums[start]).astype(np.float32)

    letters = total(kind == 1) + total(kind == 2)
    words = part.words()
    first, last = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    n_words = np.maximum(last - first, 1)
    value = words.hashes()
    same = np.zeros(len(value) + 1, np.int64)
    if len(value) > 1:
        same[2:] = np.cumsum(value[1:] == value[:-1])
    repeats = np.maximum(0, same[last] - same[np.minimum(first + 1, last)])
    marked = np.concatenate([np.zeros(1, np.int64), np.cumsum(kind[words.end - 1] == 6)]) if len(words.end) else np.zeros(1, np.int64)
    lone = np.concatenate([np.zeros(1, np.int64), np.cumsum((words.end - words.start == 1) & (kind[words.start] >= 5))]) if len(words.start) else np.zeros(1, np.int64)
    rates = np.stack(
        [
            total(kind == 1) / np.maximum(letters, 1), letters / at_least_1, total(kind == 3) / at_least_1, total(kind == 4) / at_least_1, total(kind == 5) / at_least_1, total(kind == 6) / at_least_1,
            repeats / n_words, (marked[last] - marked[first]) / n_words, (lone[last] - lone[first]) / n_words,
        ],
        axis=1,
        dtype=np.float32,
    )
    return rates, size, bounds


def line_features(rates: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What of its rates and its length a line's own features say."""
    return np.concatenate([(rates[:, :, None] > _CUTS).reshape(len(rates), -1), size[:, None] >= _LENGTHS], axis=1)


def with_neighbours(lines: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Constant, own features, those of the line before and after, and whether there is one."""
    n = len(lines)
    before, after = np.zeros_like(lines), np.zeros_like(lines)
    before[1:], after[:-1] = lines[:-1], lines[1:]
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[bounds[:-1]], last[bounds[1:] - 1] = True, True
    before[first], after[last] = False, False
    return np.concatenate([np.ones((n, 1), bool), lines, before, after, first[:, None], last[:, None]], axis=1).astype(np.float32)


def _marginals(emission: np.ndarray, transition: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for all texts at once: P(label) of each line, sums of P(pairs of labels), log normalisers.

    A text's lines are cut into chains; what a chain does to the message that
    enters it is a matrix, so that chains of a long text run side by side.
    """
    count = np.diff(bounds)
    chains = -(-count // CHAIN)
    text = np.repeat(np.arange(len(count)), chains)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(chains) - chains, chains)
    start = bounds[:-1][text] + nth * CHAIN
    size = np.minimum(CHAIN, bounds[1:][text] - start)
    order = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[order], -np.arange(1, CHAIN + 1), "right")
    alive = alive[alive > 0]
    scale = emission.max(axis=1)
    e, t = np.exp(emission - scale[:, None]), np.exp(transition - transition.max())
    step = lambda m, at: (m @ t) * e[at][:, None, :]

    # messages into every chain, forward and backward
    into, back = np.tile(np.array([1.0, 0.0]), (len(text), 1)), np.ones((len(text), 2))
    longest = int(chains.max(initial=1))
    if longest > 1:
        does = np.tile(np.eye(2), (len(text), 1, 1))
        for k, n in enumerate(alive):
            who = order[:n]
            does[who] = step(does[who], start[who] + k) if k else np.where((nth[who] == 0)[:, None, None], e[start[who]][:, None, :] + np.zeros((1, 2, 1)), step(does[who], start[who]))
            does[who] /= does[who].max(axis=(1, 2), keepdims=True)
        for k in range(1, longest):
            who = np.flatnonzero(nth == k)
            v = np.einsum("ni,nij->nj", into[who - 1], does[who - 1])
            into[who] = v / v.sum(axis=1, keepdims=True)
        for k in range(longest - 1, 0, -1):
            who = np.flatnonzero(nth == k)
            v = np.einsum("nij,nj->ni", does[who], back[who])
            back[who - 1] = v / v.sum(axis=1, keepdims=True)

    alpha, beta, norm = np.empty_like(e), np.ones_like(e), np.zeros(len(emission))
    for k, n in enumerate(alive):
        who = order[:n]
        at = start[who] + k
        a = (alpha[at - 1] @ t) * e[at] if k else np.where((nth[who] == 0)[:, None], e[at], (into[who] @ t) * e[at])
        norm[at] = a.sum(axis=1)
        alpha[at] = a / norm[at][:, None]
    beta[start + size - 1] = back
    for k in range(len(alive) - 1, 0, -1):
        at = start[order[: alive[k]]] + k
        b = (e[at] * beta[at]) @ t.T
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    inner = np.ones(len(e), bool)
    inner[bounds[:-1]] = False
    at, pairs = np.flatnonzero(inner), np.zeros((2, 2))
    for a in range(0, len(at), LINES):
        part = at[a : a + LINES]
        both = alpha[part - 1][:, :, None] * t * (e[part] * beta[part])[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    log_z = np.add.reduceat(np.log(norm) + scale, bounds[:-1]) + (count - 1) * transition.max()
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True), pairs, log_z


@dataclass(frozen=True)
class Crf:
    """Weights of the label `good` over `bad` for each feature, and of each pair of neighbouring labels."""

    weights: np.ndarray
    transition: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> Crf:
        """Maximum conditional likelihood by Adam; labels: one for each text, 0 or 1, that all of its lines carry."""
        y = np.repeat(labels, np.diff(bounds))
        w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
        state = [np.zeros(w.size + 4), np.zeros(w.size + 4)]
        inside = np.diff(bounds) - 1
        seen = np.array([[inside[labels == 0].sum(), 0], [0, inside[labels == 1].sum()]], float)
        for step in range(1, STEPS + 1):
            score = x @ w
            p, pairs, _ = _marginals(np.stack([np.zeros_like(score), score], axis=1), t, bounds)
            grad = np.concatenate([x.T @ (y - p[:, 1]), (seen - pairs).ravel()]) / len(labels) - PENALTY * np.concatenate([w, t.ravel()])
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad**2
            move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            w, t = w + move[:-4], t + move[-4:].reshape(2, 2)
        return cls(w, t)

    def line_marginals(self, part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) and length of every line, and the bounds of each text's lines."""
        rates, size, bounds = line_rates(part)
        w = self.weights
        own, flags = w[1 : 1 + 3 * LINE_FEATURES].reshape(3, LINE_FEATURES).T.astype(np.float32), w[1 + 3 * LINE_FEATURES :]
        by = np.concatenate([line_features(rates[a : a + LINES], size[a : a + LINES]).astype(np.float32) @ own for a in range(0, len(size), LINES)]).astype(np.float64)
        first, last = bounds[:-1], bounds[1:] - 1
        before, after = np.concatenate([[0.0], by[:-1, 1]]), np.concatenate([by[1:, 2], [0.0]])
        before[first], after[last] = flags[0], flags[1]
        score = w[0] + by[:, 0] + before + after
        p, _, _ = _marginals(np.stack([np.zeros_like(score), score], axis=1), self.transition, bounds)
        return p[:, 1], size, bounds

    def quality(self, part: Texts) -> np.ndarray:
        good, size, bounds = self.line_marginals(part)
        weight = size + 1
        return np.clip(np.add.reduceat(good * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1]), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Crf:
    """The model from at most TRAINING_DOCUMENTS labelled documents, in the order of a hash of the id, as long as they have at most TRAINING_LINES lines together.

    labels: id_col and label_col (0 or 1; others and null ids are left out).  A
    document is used as a whole; one that is longer than what is left of the
    lines is passed over.  Of documents that share an id one is used, by a hash
    of the text.  The sample, and what is collected of it, is bounded; without
    any label the model gives one half to every line.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("chosen_id"), F.col(label_col).cast("int").alias("label"))
    chosen = written(chosen.groupBy("chosen_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(TRAINING_DOCUMENTS))
    texts = docs.select(F.col(id_col).alias("chosen_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "chosen_id")
    texts = texts.withColumn("lines", F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).withColumn("sha", F.sha2("text", 256))
    about = texts.groupBy("chosen_id", "label").agg(F.min(F.struct("sha", "lines")).alias("one")).select("chosen_id", "label", "one.*", F.xxhash64("chosen_id").alias("turn")).collect()
    room, taken = TRAINING_LINES, []
    for r in sorted(about, key=lambda r: (r.turn, str(r.chosen_id))):
        if r.lines <= room:
            room -= r.lines
            taken.append((r.chosen_id, r.sha))
    if not taken:
        return Crf(np.zeros(FEATURES), np.zeros((2, 2)))
    wanted = docs.sparkSession.createDataFrame(taken, texts.select("chosen_id", "sha").schema)
    sample = texts.join(F.broadcast(wanted), ["chosen_id", "sha"]).select("chosen_id", "label", "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                rates, size, bounds = line_rates(part)
                lines = np.packbits(line_features(rates, size), axis=1)
                rows = [lines[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(part.first, len(part)) for c in ("chosen_id", "label")] + [pa.array(rows, pa.binary())], names=["chosen_id", "label", "lines"])

    schema = StructType([*sample.select("chosen_id", "label").schema, StructField("lines", BinaryType())])
    rows = sample.mapInArrow(emit, schema).dropDuplicates(["chosen_id"]).collect()
    rows.sort(key=lambda r: str(r.chosen_id))
    width = -(-LINE_FEATURES // 8)
    packed = [np.frombuffer(bytes(r.lines), np.uint8).reshape(-1, width) for r in rows]
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in packed])])
    lines = np.unpackbits(np.concatenate(packed), axis=1)[:, :LINE_FEATURES].astype(bool)
    return Crf.fit(with_neighbours(lines, bounds), bounds, np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and `score`, the quality (0 to 1) of each whole text.

    Null text counts as empty; an empty text is one empty line.  Repeated rows
    and null ids are kept, an empty table gives an empty result.  A column named
    `score` is replaced.
    """
    kept = [f for f in docs.schema.fields if f.name != "score"]
    schema = StructType([*kept, StructField("score", DoubleType())])
    names = [f.name for f in kept]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [model.quality(part) for part in slices(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate(values) if values else [], pa.float64())], names=[*names, "score"])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(emit, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
