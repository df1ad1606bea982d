"""Every opN query over the small tables, against plain Python, and its columns and types."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

pytest.importorskip("public_tokenizers")

from guardframe.llm import registry  # noqa: E402
from test_decontaminate import brute as overlaps  # noqa: E402
from test_neardup import brute as groups  # noqa: E402
from test_secrets import brute as base_spans  # noqa: E402

TYPES = {
    1: "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    2: "doc_id:bigint held_out:boolean score:double predicted:int",
    3: "query_id:bigint rank:int vec_id:bigint score:double",
    4: "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string",
    5: "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    6: "page_id:bigint url:string text:string n_chars:bigint",
    7: "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    8: "doc_id:bigint held_out:boolean lang_pred:string score:double",
    9: "doc_id:bigint held_out:boolean score:double predicted:int",
    10: "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def read(sf_dir):
    return lambda name: pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def answer(spark, sf_dir):
    known = {int(name[2:].split("_")[0]): query for name, query in registry.queries().items()}
    assert sorted(known) == list(range(1, 11))

    def of(n: int) -> list[dict]:
        found = known[n](spark, sf_dir)
        assert [f"{c}:{t}" for c, t in found.dtypes] == TYPES[n].split()
        return [r.asDict() for r in found.collect()]

    return of


@pytest.fixture(scope="module")
def texts(read):
    return {r["doc_id"]: r["text"] for r in read("documents")}


def one_each(rows: list[dict], keys, key: str = "doc_id") -> dict:
    assert sorted(r[key] for r in rows) == sorted(keys)
    return {r[key]: r for r in rows}


def test_op1(answer, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for i, r in one_each(answer(1), texts).items():
        ids = tokenizer.encode(texts[i] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False)))


@pytest.mark.parametrize("n, least", [(2, 0.5), (9, 0.3)])
def test_classifiers(answer, texts, n, least):
    for i, r in one_each(answer(n), texts).items():
        assert r["held_out"] == (crc(i) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)


def test_op3(answer, read):
    data = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in read("embeddings") if r["embedding"] and np.isfinite(np.array(r["embedding"], dtype=float)).all() and any(r["embedding"])}
    rows, hit, total = defaultdict(list), 0, 0
    for r in answer(3):
        rows[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(rows) == sorted(i for i in data if i % 50 == 0)
    cosine = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    for q, found in rows.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, min(5, len(data) - 1) + 1)) and q not in [f[1] for f in found]
        assert all(math.isclose(s, cosine(data[q], data[i]), abs_tol=1e-12) for _, i, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        best = sorted((-cosine(data[q], v), i) for i, v in data.items() if i != q)[:5]
        hit, total = hit + len({f[1] for f in found} & {i for _, i in best}), total + len(best)
    assert hit >= 0.9 * total


def test_op4(answer, texts):
    kinds = ("assign", "access", "hex", "material", "endpoint")
    for i, r in one_each(answer(4), texts).items():
        base = base_spans(texts[i] or "")
        said = [f"{kinds[k]}:{s}:{e}" for s, k, e in base]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert r["base_sha256"] == sha(",".join(said))
        spans = r["spans"].split(",") if r["spans"] else []
        places = [(int(s.split(":")[1]), kinds.index(s.split(":")[0])) for s in spans]
        assert [s for s in spans if s in said] == said and places == sorted(places)


def test_op5(answer, texts):
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts.items()}
    counts = Counter(w for i, own in tokens.items() if crc(i) % 10 for w in own)
    n, v = sum(counts.values()), len(counts)
    rows = one_each(answer(5), texts)
    for i, r in rows.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i) % 10 == 0, len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] <= 0
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op6(answer, read):
    pages = {r["page_id"]: r for r in read("pages")}
    for i, r in one_each(answer(6), pages, "page_id").items():
        assert r["url"] == pages[i]["url"] and r["n_chars"] == len(r["text"])
        assert r["text"] == "\n\n".join(" ".join(b.split()) for b in r["text"].split("\n\n")) and (r["text"] != "") == ("<p" in (pages[i]["html"] or ""))
        plain = re.sub(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ", pages[i]["html"] or "")
        import html

        words = Counter(html.unescape(plain).split())
        assert not Counter(r["text"].split()) - words


def test_op7(answer, texts, read):
    items = [(str(r["item_id"]), r["text"]) for r in read("benchmark")]
    for i, r in one_each(answer(7), texts).items():
        n, hit, names = overlaps(texts[i], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(names), sha(",".join(names)), hit > 0)


def test_op8(answer, read):
    docs = {r["doc_id"]: r for r in read("documents")}
    languages = {r["lang"] for i, r in docs.items() if r["lang"] and crc(i) % 3 != 1}
    right = []
    for i, r in one_each(answer(8), docs).items():
        letters = any(c.isalpha() for c in docs[i]["text"] or "")
        assert r["held_out"] == (crc(i) % 3 == 1) and 0 <= r["score"] <= 1 and (r["lang_pred"] in languages if letters else r["lang_pred"] == "und")
        if r["held_out"] and docs[i]["lang"] and letters:
            right.append(r["lang_pred"] == docs[i]["lang"])
    assert np.mean(right) >= 0.95


def test_op10(answer, texts):
    expected = groups(list(texts.items()), 2, 80)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in one_each(answer(10), texts).items()} == {i: (n, c, i == c) for i, (n, c) in expected.items()}
