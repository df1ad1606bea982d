import math
import random

import numpy as np

from guardframe.llm import ann
from guardframe.llm.ann import Graph, build_index, search


def rows(n=400, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return [(i, (centres[i % 8] + 0.7 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def brute(data, query, k):
    own = np.array(query, dtype=np.float32).astype(np.float64)
    found = []
    for i, v in data:
        w = np.array(v, dtype=np.float32).astype(np.float64)
        found.append((-float(w @ own) / float(np.linalg.norm(w) * np.linalg.norm(own)), i))
    return sorted(found)[:k]


def test_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 150)
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    found = search(build_index(df, 5), df.where("vec_id % 50 = 0"), 5, block=3).collect()
    hit = 0
    for q in range(0, 400, 50):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        best = brute([x for x in data if x[0] != q], data[q][1], 5)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        hit += len({r[1] for r in own} & {i for _, i in best})
        for _, i, s in own:
            assert math.isclose(s, -brute([data[i]], data[q][1], 1)[0][0], abs_tol=1e-12)
    assert hit >= 0.9 * 40


def test_equal_vectors_ties_and_bad_vectors(spark):
    bad = [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [float("inf"), 0.0]), (105, []), (150, [1.0, 0.0, 0.0])]
    same = [(i, [1.0, 2.0]) for i in range(60)]
    df = spark.createDataFrame(random.Random(1).sample(same + bad, 67) + [same[0]], "vec_id long, embedding array<float>").repartition(4)
    found = search(build_index(df, 5), df.where("vec_id % 50 = 0"), 5).collect()
    by = lambda q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert by(0) == [1, 2, 3, 4, 5] and by(50) == [0, 1, 2, 3, 4] and by(100) == [] and by(150) == []
    empty = df.where("false")
    assert search(build_index(empty, 5), empty, 5).count() == 0


def test_graph_reaches_every_vector():
    unit = np.random.default_rng(0).normal(size=(300, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = Graph(unit).build()
    assert all(graph.search(graph.unit[i], 20)[0] == i for i in range(0, 300, 7))


def test_double_vectors_keep_their_precision(spark):
    """Scores are of the original vectors, and own columns may have any name."""
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(size=6).tolist(), 1.0, "x") for i in range(80)] + [(7, rng.normal(size=6).tolist(), 1.0, "x")] * 2
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score double, query_id string").repartition(3)
    found = search(build_index(df, 3), df.where("vec_id % 50 = 0"), 3).collect()
    for r in found:
        q = np.array(data[r["query_id"]][1])
        best = max(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)) for i, v, *_ in data if i == r["vec_id"])
        assert math.isclose(r["score"], best, abs_tol=1e-14)
    assert len(found) == 6 and {r["query_id"] for r in found} == {0, 50}
