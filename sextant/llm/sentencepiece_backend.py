"""SentencePiece encoding and decoding on the tokenizers library.

A model file is a protobuf message; its pieces, scores and settings are read
here and rebuilt as a tokenizer of the tokenizers library: the normaliser (the
precompiled character map, white-space rules and the metaspace marker), unigram
scores or BPE merges in the order of their scores, and byte fallback.  Texts are
encoded a unit at a time (a word with the markers before it; see `encoding`),
units in batches on all threads.  The sentencepiece library itself checks the
normalised form of every raw text and the ids of every unit once; a text's
`parity` says whether all of that agreed.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from .encoding import MEMORY_LENGTH, MEMORY_UNITS
from .units import TOKENISERS

MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; nested messages are bytes."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, i = _varint(data, i)
        else:
            size, i = _varint(data, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + size], i + size
        yield number, value


class Model:
    """What a model file says. Field numbers are those of the public message definition."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        self.unigram = trainer.get(3, 1) == 1
        if trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models are known")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix = bool(trainer.get(24, 0))
        self.charsmap = bytes(rules.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        if self.suffix or not self.escape or any(kind == USER for _, _, kind in self.pieces):
            raise ValueError("models with a marker behind words, unescaped white space or user-defined pieces aren't known")

    def merges(self) -> list[tuple[str, str]]:
        """All ways to put a piece together from two pieces, best piece first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, UNUSED)}
        out = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                out += [(-score, ids[piece], ids[piece[:k]], ids[piece[k:]], piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
        return [x[-2:] for x in sorted(out)]

    def tokenizer(self) -> Tokenizer:
        if self.unigram:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        else:
            core = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps.append(normalizers.Replace(" ", MARKER))
        self.normalizer = normalizers.Sequence(steps)
        out.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return out

    def normalised(self, text: str) -> str:
        text = text.replace(" ", MARKER) if not self.charsmap and not self.trim else self.normalizer.normalize_str(text)
        return MARKER + text if self.dummy_prefix and text else text


class Codec:
    """Texts to ids and back; made once in a worker."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.model = Model(data)
        self.tokenizer = self.model.tokenizer()
        self.check = sentencepiece.SentencePieceProcessor(model_proto=data)
        whole = any(MARKER in p.lstrip(MARKER) for p, _, kind in self.model.pieces if kind == NORMAL)
        self.units = (lambda text: [text] if text else []) if whole else re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+").findall
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARKER, " ").encode() for p, _, kind in self.model.pieces]

    def _learn(self, units: list[str]) -> None:
        got = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        for unit, ids, own in zip(units, got, self._own(units)):
            self.known[unit] = ids.tobytes()
            if own != ids.tolist():
                self.odd.add(unit)

    def _own(self, units: list[str]) -> list[list[int]]:
        """sentencepiece's ids of units; it puts the first marker there itself, and a marker alone is a piece."""
        marked = self.model.dummy_prefix
        said = self.check.encode([u.replace(MARKER, " ")[1:] if marked and u[0] == MARKER else u.replace(MARKER, " ") for u in units])
        return [[self.check.piece_to_id(MARKER)] if u == MARKER else own for u, own in zip(units, said)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """(ids as little-endian 32-bit integers, whether sentencepiece gives the same) for each text."""
        normal = [self.model.normalised(t) for t in texts]
        alike = [n == self.check.normalize(t) for n, t in zip(normal, texts)]
        split = [self.units(n) for n in normal]
        if len(self.known) > 3 * MEMORY_UNITS:
            self.known.clear()
            self.odd.clear()
        if new := {u for units in split for u in units if u not in self.known}:
            self._learn(sorted(new))
        out = [(b"".join(map(self.known.__getitem__, units)), same and (not self.odd or self.odd.isdisjoint(units))) for units, same in zip(split, alike)]
        for unit in new:
            if len(unit) > MEMORY_LENGTH:
                del self.known[unit]
                self.odd.discard(unit)
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text.removeprefix(" ") if self.model.dummy_prefix else text


@lru_cache(maxsize=1)
def opened(path: str) -> Codec:
    """A worker keeps its codec, and what it remembers, from task to task, until it turns to other work."""
    return Codec(path)


TOKENISERS.append(opened)


_ENCODED = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean, ids binary"


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity, round_trip (decoding gives the text back) and ids (4 bytes each) of whole texts.

    Null text counts as empty and has no ids.  Repeated rows and null ids are
    kept, an empty table gives an empty result, other columns aren't read.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = opened(model_path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                rows = batch.slice(begin, 256)
                texts = rows.column("text").to_pylist()
                got = codec.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"), pa.array([len(x) // 4 for x, _ in got], pa.int64()), pa.array([zlib.crc32(x) for x, _ in got], pa.int64()), pa.array([same for _, same in got], pa.bool_()),
                        pa.array([codec.decode(x) == t for (x, _), t in zip(got, texts)], pa.bool_()), pa.array([x if keep_ids else None for x, _ in got], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip", "ids"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(emit, _ENCODED)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text from ids as `encode` gives them; null ids give an empty text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = opened(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([codec.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(emit, "doc_id long, text string")
