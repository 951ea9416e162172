"""Fill-in-middle transformation: two cuts between units of a text, found on 64-bit words.

A unit is white space and the run behind it, or white space at the end of a text.
The UTF-8 bytes of a batch of texts lie behind each other, each text padded with
spaces to whole 64-bit words.  Arithmetic on all eight bytes of a word at once
marks those that end a unit; `bitwise_count` counts marks a word, and a cumulative
sum makes the k-th unit's end a binary search for its word and a selection of one
of at most eight marks inside.  Code points are counted the same way, as bytes
that don't continue another.

What is drawn (cuts, form) comes from a SHA-256 of a seed and the id, by Spark
expressions, so a task that is run again cuts alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of texts that are looked at together; a longer text is a batch of its own.
BATCH_BYTES = 1 << 22

_U = np.uint64


def _all(byte: int) -> np.uint64:
    """A word of eight such bytes."""
    return _U(byte * 0x0101010101010101)


_HIGH, _LOW = _all(0x80), _all(0x7F)


def spaces(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is 0x20 or 0x09 to 0x0D; carries never leave a byte, as high bits are cleared before sums."""
    other = words ^ _all(0x20)
    blank = ~(((other & _LOW) + _LOW) | other | _LOW)
    low = words & _LOW
    control = (low + _all(0x80 - 0x09)) & ~(low + _all(0x80 - 0x0E)) & ~words & _HIGH
    return blank | control


def unit_ends(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The high bit of each byte that ends a unit: one that isn't white space with white space behind it, or a text's last byte.

    `last` holds the places of last bytes.  Behind every text is padding, or
    another text's word, whose first byte is looked at only by the last byte,
    and that is marked anyway.
    """
    space = spaces(words)
    behind = space >> _U(8)
    behind[:-1] |= space[1:] << _U(56)
    ends = ~space & _HIGH & behind
    np.bitwise_or.at(ends, last >> 3, _U(0x80) << ((last & 7) << 3).astype(np.uint64))
    return ends


def starts_of_characters(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that doesn't continue a character (isn't 10xxxxxx)."""
    return ~(words & ~(words << _U(1))) & _HIGH


def select(marks: np.ndarray, total: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The byte behind the rank-th mark (from 1) of all words; total has the cumulative marks of words."""
    word = np.minimum(np.searchsorted(total, rank), len(total) - 1)
    bits = marks[word]
    inside = rank - (total[word] - np.bitwise_count(bits))
    for _ in range(7):
        bits = np.where(inside > 1, bits & (bits - _U(1)), bits)
        inside = inside - (inside > 1)
    lowest = bits & (~bits + _U(1))
    return word * 8 + (np.bitwise_count(lowest - _U(1)) >> 3).astype(np.int64) + 1


def cuts(texts: list[bytes], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its units n; the bytes, then the code points, before the smaller and the larger of first % (n + 1) and second % (n + 1) units; two rows each."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([np.zeros(1, np.int64), np.cumsum((size + 7) // 8)])
    words = np.frombuffer(b"".join(t + b" " * (-len(t) % 8) for t in texts) + b" " * 8, "<u8").astype(np.uint64)
    full = size > 0
    ends = unit_ends(words, (begin[:-1] * 8 + size - 1)[full])
    total = np.cumsum(np.bitwise_count(ends), dtype=np.int64)
    before = np.concatenate([np.zeros(1, np.int64), total])
    n = before[begin[1:]] - before[begin[:-1]]
    drawn = np.stack([first % (n + 1), second % (n + 1)])
    units = np.sort(drawn, axis=0)
    at = np.where(units > 0, select(ends, total, np.maximum(before[begin[:-1]] + units, 1)), begin[:-1] * 8)
    chars = starts_of_characters(words)
    heads = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(chars), dtype=np.int64)])
    until = lambda place: heads[place >> 3] + np.bitwise_count(chars[place >> 3] & ((_U(1) << ((place & 7) << 3).astype(np.uint64)) - _U(1)))
    return n, units, at - begin[:-1] * 8, until(at) - until(begin[:-1] * 8)


_CUT = "n long, first_bytes long, second_bytes long, first_chars long, second_chars long"
_NAMES = [x.split()[0] for x in _CUT.split(", ")]


def _cut(most: int):
    """Batches of rows with the cuts of their texts, worked on in groups of about `most` bytes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False).astype(np.int64)
            group = (np.cumsum(sizes) - sizes) // most
            for g in np.unique(group):
                here = np.flatnonzero(group == g)
                rows = batch.slice(int(here[0]), len(here))
                texts = rows.column("bytes").to_pylist()
                n, _, at, chars = cuts(texts, *(rows.column(h).to_numpy(zero_copy_only=False).astype(np.int64) for h in ("h1", "h2")))
                new = dict(zip(_NAMES, (n, at[0], at[1], chars[0], chars[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, pa.int64()) for x in new.values())], names=[*rows.schema.names, *new])

    return emit


def draw(seed: int, id_col: str, k: int) -> Column:
    """The k-th (from 1) unsigned 32-bit number of a row: digits of the SHA-256 of `seed:id`; nothing stands for a null id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output, for every whole text.

    rate percent of texts are cut, and of those spm_rate percent are written
    suffix first.  Empty and null texts, and texts that hold a marker, stay plain
    (null as an empty text), with null prefix_chars and middle_chars.  Rows are
    independent of each other: null ids (all drawn alike), ids that repeat and
    equal rows are transformed each for itself; an empty table gives an empty
    result; other columns aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (draw(seed, id_col, 3) % 100 >= rate), "plain").when(draw(seed, id_col, 4) % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), form.alias("form"), draw(seed, id_col, 1).alias("h1"), draw(seed, id_col, 2).alias("h2"), text.cast("binary").alias("bytes"))
    schema = f"doc_id long, form string, h1 long, h2 long, bytes binary, {_CUT}"
    found = rows.mapInArrow(_cut(batch_bytes), schema)
    piece = lambda begin, end: F.substring("bytes", begin + 1, end - begin).cast("string")
    a, b, size = F.col("first_bytes").cast("int"), F.col("second_bytes").cast("int"), F.octet_length("bytes")
    prefix, middle, suffix = piece(F.lit(0), a), piece(a, b), piece(b, size)
    output = (
        F.when(F.col("form") == "plain", F.col("bytes").cast("string"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    cut = F.col("form") != "plain"
    return found.select("doc_id", "n", "form", F.when(cut, F.col("first_chars")).alias("prefix_chars"), F.when(cut, F.col("second_chars") - F.col("first_chars")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text again: a cut text holds no marker of its own, so the markers part it."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))).otherwise(F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1)))
