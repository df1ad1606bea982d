import random
import re

import numpy as np

from guardframe.llm import decontaminate
from guardframe.llm.decontaminate import GRAM, SPAN, WINDOW, find_overlaps, gram_hashes, hit_words, selected, without_overlaps


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items):
    """Hit words and item names by comparing every window."""
    doc, hit, names = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        size = min(WINDOW, len(own))
        for a in range(len(own) - size + 1) if own else ():
            for at in range(len(doc) - size + 1):
                if doc[at : at + size] == own[a : a + size]:
                    hit.update(range(at, at + size))
                    names.add(name)
    return len(doc), len(hit), sorted(names)


def cases():
    rng = random.Random(2)
    word = lambda: rng.choice("a b c the of é 7 x9".split())
    items = [(str(i), " ".join(word() for _ in range(rng.choice([0, 1, 3, 7, 9, 10, 11, 25])))) for i in range(12)]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 40))]
        if i % 2:
            own = rng.choice(items)[1].split()
            at = rng.randint(0, len(text))
            text[at:at] = own[rng.randint(0, 3) :]
        docs.append((i, " ".join(text).upper() if i % 5 == 0 else ", ".join(text)))
    return docs, items


def test_every_window_shares_a_fingerprint():
    rng = random.Random(7)
    for _ in range(300):
        span = np.array([rng.randint(1, 3) for _ in range(WINDOW)], dtype=np.uint64)
        around = lambda n: np.array([rng.randint(1, 3) for _ in range(n)], dtype=np.uint64)
        kept = []
        for before, after in ((rng.randint(0, 6), rng.randint(0, 6)) for _ in range(2)):
            hashes = gram_hashes(np.concatenate([around(before), span, around(after)]), GRAM, False)
            every = np.arange(hashes.size)
            chosen = selected(hashes, np.zeros_like(every), np.full_like(every, hashes.size), every)
            plain = {s + max(range(SPAN), key=lambda k: (-int(hashes[s + k]), k)) for s in range(hashes.size - SPAN + 1)}  # noqa: B023
            assert plain <= set(np.flatnonzero(chosen).tolist())
            kept.append({int(hashes[i]) for i in np.flatnonzero(chosen) if before <= i < before + SPAN})
        assert kept[0] & kept[1]


def test_equal_to_brute_force(spark, monkeypatch):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    expected = {i: brute(t, items) for i, t in docs}
    for bits in (decontaminate.LEAST_BITS, 3):  # with a filter that lets nearly all pass, too
        monkeypatch.setattr(decontaminate, "LEAST_BITS", bits)
        monkeypatch.setattr(decontaminate, "MOST_BITS", max(bits, 3))
        if bits < 16:
            monkeypatch.setattr(decontaminate, "bloom", lambda prints: (np.full(1 << 13, 255, dtype=np.uint8), 16))
        rows = find_overlaps(d.repartition(3), b).withColumn("n_hit", hit_words()).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in rows} == expected
    clean = without_overlaps(d.repartition(3), b)
    assert clean.columns == d.columns and sorted(r["doc_id"] for r in clean.collect()) == [i for i in sorted(expected) if not expected[i][1]]


def test_very_long_text_and_spans(spark):
    item = " ".join(f"w{k}" for k in range(400))
    docs = [(1, "x " * 60_000 + item + " y" * 60_000), (2, item * 3), (3, " ".join(item.split()[5:14])), (4, " ".join(item.split()[5:15]))]
    found = find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("i", item)], "item_id string, text string"), keep_text=False)
    assert found.columns == ["doc_id", "n_words", "hits", "items"]
    hits = {r["doc_id"]: [(h["start"], h["end"]) for h in r["hits"]] for r in found.collect()}
    assert hits[1] == [(60_000, 60_400)] and hits[3] == [] and hits[4] == [(0, 10)]
    assert hits[2] == [(0, 399), (400, 798), (799, 1198)]  # the words that run into each other aren't the item's


def test_odd_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (2, None), (3, ""), (None, "a")], "item_id long, text string")
    found = find_overlaps(awkward, items)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == awkward.count() and rows[7]["items"] == ["1"] and rows[0]["n_words"] == 0 and rows[0]["hits"] == []
    assert rows[3]["items"] == [""]
    assert find_overlaps(nothing, items).count() == 0
    assert {len(r["items"]) for r in find_overlaps(awkward, items.where("false")).collect()} == {0}
    assert without_overlaps(awkward, items).count() == awkward.count() - sum(1 for r in found.collect() if r["items"])
    assert without_overlaps(nothing, items).count() == 0 and {r["n_words"] for r in find_overlaps(awkward, items).collect()} != {1}
