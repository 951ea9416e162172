"""What a worker remembers for one kind of task is gone when it turns to another."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa

from sextant.llm import units
from sextant.llm.encoding import Encoder


def test_tokenisers_are_forgotten():
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), ["some words, and more words", "other\nwords"]
    ids = Encoder.from_file(path).encode(texts)
    assert Encoder.from_file(path).known
    (part,) = units.slices(pa.array(texts))
    assert Encoder.from_file.cache_info().currsize == 0
    part.word_ids()
    assert units._memory.known
    assert Encoder.from_file(path).encode(texts) == ids
    assert not units._memory.known
