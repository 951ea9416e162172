"""Encoding whole texts with the tokenizers library, a unit of text at a time.

The tokenizers handled here cut a text before they merge, and always at least
where white space follows something else.  So the ids of a text are those of its
white-space separated units, one behind the other, and each different unit is
encoded by the library once in a task: plain words go straight to the library's
model, everything else through the whole tokenizer, in batches on all threads.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .units import TOKENISERS, forget_words

#: Units that a worker remembers; beyond it, those that it hasn't met for as long are forgotten.
MEMORY_UNITS = 400_000
#: Characters of a unit that is remembered; longer ones are encoded each time they come.
MEMORY_LENGTH = 256

_ASCII_SPACE = " \t\n\r\x0b\x0c"
#: White space that is not ASCII, and controls of which regex dialects differ; texts with any are encoded whole.
_ODD_SPACE = [chr(c) for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PUNCT = r"!-&(-/:-@\[-`{-~"
_LEADING = re.compile(f"[{_ASCII_SPACE}]*[^{_ASCII_SPACE}]+|[{_ASCII_SPACE}]+")
_PLAIN = re.compile(f"([{_LATIN}]*)([{_PUNCT}]*)")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: its own where it has one."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _lettered(text: str) -> str:
    return text if text.isascii() and text.isalpha() else "".join(map(_LETTERS.__getitem__, text.encode()))


class Encoder:
    """ids of texts as little-endian 32-bit arrays, in bytes."""

    def __init__(self, tokenizer: Tokenizer, units: Callable[[str], list[str] | None] | None, plain: Callable[[str], list[str] | None], said: Callable[[str], str]):
        self.tokenizer, self.units, self.plain, self.said = tokenizer, units, plain, said
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the generation of units that is forgotten next
        self.parts: dict[str, bytes] = {}

    @classmethod
    @lru_cache(maxsize=2)
    def from_file(cls, path: str) -> Encoder:
        """For a byte-level BPE file, with or without word ends; special tokens in a text are ordinary text.

        A worker keeps its encoder, and what it remembers, from task to task, until it turns to other work.
        """
        forget_words()
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        spec = [json.loads(x.__getstate__()) if x is not None else None for x in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
        steps = (spec[1] or {}).get("pretokenizers", [spec[1] or {}])
        kinds = [s.get("type") for s in steps]
        if spec[0] is None and kinds == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]:
            return cls(tokenizer, _leading_units, _plain_leading, _said_leading)
        if kinds == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
            lowers = [s["type"] for s in (spec[0] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            return cls(tokenizer, str.split, _plain_lowered if lowers else lambda unit: None, str)
        return cls(tokenizer, None, lambda unit: None, str)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: Iterable[str]) -> None:
        slow = []
        known, before, parts, tokenize = self.known, self.before, self.parts, self.tokenizer.model.tokenize
        for unit in units:
            if (ids := before.get(unit)) is not None:
                known[unit] = ids
                continue
            pieces = self.plain(unit)
            if pieces is None:
                slow.append(unit)
                continue
            ids = b""
            for piece in pieces:
                if (part := parts.get(piece)) is None:
                    part = parts[piece] = array("I", [t.id for t in tokenize(piece)]).tobytes()
                ids += part
            known[unit] = ids
        if slow:
            known.update(zip(slow, self.whole([self.said(u) for u in slow])))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            units = None
            if self.units is not None and not any(c in text for c in (_ODD_SPACE[:4] if text.isascii() else _ODD_SPACE)):
                units = self.units(text)
            if units is None:
                out += self.whole([text])
                continue
            if len(self.known) > MEMORY_UNITS:
                self.known, self.before = {}, self.known
                self.parts.clear()
            new = set(units).difference(self.known)
            if new:
                self._learn(new)
            out.append(b"".join(map(self.known.__getitem__, units)))
            for unit in new:
                if len(unit) > MEMORY_LENGTH:
                    del self.known[unit]
                    for piece in self.plain(unit) or ():
                        self.parts.pop(piece, None)
        return out


TOKENISERS.append(Encoder.from_file)

#: White space next to white space, or at an end, or of another kind: such texts are cut by a pattern.
_CLUSTERS = ("  ", "\n ", " \n", "\n\n", "\t", "\r", "\x0b", "\x0c")


def _leading_units(text: str) -> list[str] | None:
    """Words as units. One that starts with a line feed or a null follows nothing or a line feed, a tab marks white space that is kept as it is, others follow one space."""
    if not text:
        return []
    if "\0" in text:
        return None
    if text[0] in _ASCII_SPACE or text[-1] in _ASCII_SPACE or any(c in text for c in _CLUSTERS):
        return ["\t" + u for u in _LEADING.findall(text)]
    units = text.replace("\n", " \n").split(" ")
    units[0] = "\0" + units[0]
    return units


def _said_leading(unit: str) -> str:
    return unit[1:] if unit[0] in "\t\0" else unit if unit[0] == "\n" else " " + unit


def _plain_leading(unit: str) -> list[str] | None:
    """The pre-tokens of a plain word, with what stands before it."""
    if unit.isascii() and unit.isalpha():
        return ["Ġ" + unit]
    if unit[0] == "\t":
        unit = unit[1:]
        if unit[0] not in _ASCII_SPACE:
            unit = "\0" + unit
        elif unit[0] == " ":
            unit = unit[1:]
        elif unit[0] != "\n":
            return None
    if not unit:
        return None
    lead = unit[0] if unit[0] in "\n\0" else ""
    found = _PLAIN.fullmatch(unit, len(lead))
    if found is None or found.end() == len(lead):
        return None
    word, rest = found.groups()
    out = [_lettered("\n")] if lead == "\n" else []
    space = "" if lead else "Ġ"
    if word:
        out.append(space + _lettered(word))
        space = ""
    if rest:
        out.append(space + _lettered(rest))
    return out


def _plain_lowered(unit: str) -> list[str] | None:
    if unit.isascii() and unit.isalpha():
        return [unit.lower()]
    found = _PLAIN.fullmatch(unit)
    if found is None or "İ" in unit:
        return None
    return [_lettered(p.lower()) for p in found.groups() if p]
