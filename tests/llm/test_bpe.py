import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from guardframe.llm.bpe import ChunkEncoder, chunk_ends, encode_decode  # noqa: E402

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


def test_odd_texts_equal_the_library(library):
    rng, encoder = random.Random(3), ChunkEncoder(PATH, words=50, chunk_chars=20_000)
    alphabet = "aZé ß\n\t  ºª²½'sS<|startoftext|> İıſKΣς́ \u0085\x0b\x1c 中文😀!!..,123‍"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += ["".join(rng.choice(alphabet) for _ in range(15_000)), "y" * 9000, "it's I'LL don't", "<|endoftext|> a<|startoftext|>b", "á ́b"]
    for text in texts + texts[:50]:
        assert encoder.encode(text) == expected(library, text)


def test_shared_passages_share_chunks():
    rng = random.Random(1)
    passage = " ".join(str(rng.random()) for _ in range(3000))
    cut = lambda text: {text[a:b] for a, b in zip([0, *chunk_ends(text)], chunk_ends(text))}
    a, b = cut("one start " + passage), cut("another beginning, " + passage + " and an end")
    assert len(a & b) >= len(a) - 2 and len(a) > 5


def test_every_row_has_a_result(awkward, nothing, library):
    found = encode_decode(awkward, PATH).collect()
    texts = sorted((r["doc_id"], r["text"]) for r in awkward.collect() if r["doc_id"] is not None)
    assert len(found) == awkward.count() and encode_decode(nothing, PATH).count() == 0
    ours = sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in found if r["doc_id"] is not None)
    assert ours == sorted((i, len(expected(library, t or "")[0]) // 4, *expected(library, t or "")) for i, t in texts)


def test_a_join_that_disagrees_is_repaired(library, monkeypatch):
    rng, encoder = random.Random(2), ChunkEncoder(PATH)
    text = " ".join(str(rng.random()) for _ in range(3000))
    assert len(chunk_ends(text)) > 2
    real = encoder.word
    monkeypatch.setattr(encoder, "word", lambda word: (b"", "") if word else real(word))
    assert encoder.encode(text) == expected(library, text)


def test_repairs_stop_where_the_outer_words_agree(library, monkeypatch):
    """Only the words at the cuts are wrong: the windows replace them, not the whole text."""
    rng, encoder = random.Random(2), ChunkEncoder(PATH)
    text = " ".join(str(rng.random()) for _ in range(3000))
    wrong = {text[: c].rsplit(" ", 1)[-1] + text[c:].split(" ", 1)[0] for c in chunk_ends(text)[:-1]}
    real, asked = encoder.word, []
    monkeypatch.setattr(encoder, "word", lambda word: (b"\1\0\0\0", "?") if word in wrong else real(word))
    whole = encoder._library
    monkeypatch.setattr(encoder, "_library", lambda t: (asked.append(len(t)), whole(t))[1])
    assert len(wrong) > 2 and encoder.encode(text) == expected(library, text) and max(asked) < len(text) / 20
