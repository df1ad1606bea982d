import random
from itertools import combinations

import pytest

from guardframe.llm import neardup
from guardframe.llm.components import connected_components
from guardframe.llm.neardup import near_duplicates


def brute(rows, size, percent):
    """Components by comparing all pairs of full sets."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        width = min(size, len(words))
        sets[i] = {tuple(words[a : a + width]) for a in range(len(words) - width + 1)} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=3, groups=12):
    rng = random.Random(seed)
    word = lambda: rng.choice("an be the ing er".split()) + rng.choice("tion ou ea st nd".split()) + rng.choice(["", "ly", "ble"])
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([4, 30, 60, 200]))]
        for _ in range(rng.choice([1, 2, 3, 15])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text).upper() if rng.random() < 0.2 else "  ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


def result(df, **how):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, **how).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_equal_to_brute_force(spark, size):
    rows = corpus()
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=size) == brute(rows, size, 80)


def test_large_nodes_branch_and_fall_back_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 6)
    monkeypatch.setattr(neardup, "DEPTH", 2)
    monkeypatch.setattr(neardup, "PART", 3)
    rows = corpus(8, 6)
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), size=2) == brute(rows, 2, 80)


def test_odd_rows(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect() if r["doc_id"] is not None]
    found = near_duplicates(awkward, size=2)
    assert found.count() == awkward.count() and near_duplicates(nothing).count() == 0
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect() if r["doc_id"] is not None} == brute(rows, 2, 80)
    lost = [r for r in found.collect() if r["doc_id"] is None]
    assert [(r["n_shingles"], r["component_id"]) for r in lost] == [(3, None)]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(50, 40), (40, 50), (7, 7)], "a long, b long")
    found = {r["v"]: r["root"] for r in connected_components(links).collect()}
    assert found == {**{i: 0 for i in range(21)}, 40: 40, 50: 40}
    assert connected_components(links.where("false")).count() == 0
