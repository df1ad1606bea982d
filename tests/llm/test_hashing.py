import re

import numpy as np
import pyarrow as pa
import pytest

from guardframe.llm import hashing
from guardframe.llm.hashing import alphanumeric, spaced, word_hashes

TEXTS = [None, "", " \t", "The the tHE", "a\x0bb\x0cc\x1fd   e", "Ünï ünï Ünï", "x" * 9000, "ab ba aab aba", "no-space-at-end", "next one", "中文 😀 中文", "Ab1_ab1.AB1"]
SPLITS = {"spaced": rb"[^\x20\x09-\x0D]+", "alphanumeric": rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


@pytest.mark.parametrize("kind", SPLITS)
@pytest.mark.parametrize("stretch", [1 << 19, 7])
def test_hashes_tell_words_apart_as_plain_python(monkeypatch, kind, stretch):
    monkeypatch.setattr(hashing, "STRETCH", stretch)
    table = {"spaced": spaced, "alphanumeric": alphanumeric}[kind]()
    words, begins = word_hashes(pa.array(TEXTS, pa.string()), table)
    expected = [re.findall(SPLITS[kind], (t or "").encode().lower()) for t in TEXTS]
    assert np.diff(begins).tolist() == [len(x) for x in expected]
    pairs = {(w, int(h)) for w, h in zip([w for x in expected for w in x], words, strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    part, _ = word_hashes(pa.array(TEXTS, pa.string()).slice(3, 2), table)  # an offset into the buffers
    assert part.tolist() == words[begins[3] : begins[5]].tolist()
    assert word_hashes(pa.array([], pa.string()), table)[0].size == 0 and word_hashes(pa.array([None], pa.string()), table)[1].tolist() == [0, 0]
