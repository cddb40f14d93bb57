import random
import re

import numpy as np
import pyarrow as pa
import pytest

from evigrid.llm import hashing


def one(word, lower=True):
    """The hash of a word, one byte after the other."""
    total = sum((b + 1) * pow(int(hashing._BASE), i, 1 << 64) for i, b in enumerate(word.lower() if lower else word)) + len(word) * 0xD6E8FEB86659FD93
    return int(hashing.mix(np.array([total % (1 << 64)], np.uint64))[0])


@pytest.mark.parametrize("chunk", [1, 3, 64, 1 << 17])
def test_words_across_chunks(monkeypatch, chunk):
    monkeypatch.setattr(hashing, "CHUNK", chunk)
    hashing._powers.clear()
    rng = random.Random(chunk)
    texts = [None, "", " ", "x" * 300, "a b", "b", *("".join(rng.choice("aB é\n\t") for _ in range(rng.randint(0, 40))) for _ in range(40)), ""]
    for lower in (True, False):
        got, first = hashing.word_hashes(*hashing.utf8(pa.array(texts, pa.string())), lower)
        words = [re.findall(rb"[^ \t-\r]+", (t or "").encode()) for t in texts]
        assert [int(h) for h in got] == [one(w, lower) for ws in words for w in ws]
        assert first.tolist() == np.cumsum([0, *map(len, words)]).tolist()
    hashing._powers.clear()


def test_no_texts():
    got, first = hashing.word_hashes(*hashing.utf8(pa.array([], pa.string())))
    assert len(got) == 0 and first.tolist() == [0]
