import math
from collections import Counter

import numpy as np
import pyarrow as pa

from guardframe.llm import lm
from guardframe.llm.lm import Model, Vocabulary, features, learn, score, token_hashes


def plain_tokens(text):
    return [*text.encode().lower().split(), b""] if text else [b""]


def vocabulary_of(counts: dict[str, int], tokens: int, distinct: int) -> tuple[Vocabulary, dict[str, int]]:
    hashes = {w: int(token_hashes(pa.array([w]))[0][0]) for w in counts}
    order = sorted(counts, key=lambda w: (-counts[w], hashes[w]))
    v = Vocabulary(np.array([hashes[w] for w in order], dtype=np.uint64), np.array([counts[w] for w in order]), tokens, distinct)
    return v, {w: k for k, w in enumerate(order)}


def test_counts_and_base_by_brute_force(spark, awkward, nothing):
    rows = [(i, f"the cat {'sat' if i % 2 else 'ran'} on The mat w{i}") for i in range(40)] + [(99, None), (98, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = docs.where("doc_id % 3 != 0")
    counts, vocabulary, weights = learn(train, held=4)  # most words meet their counts in the join
    c = Counter(w for i, t in rows if i % 3 for w in plain_tokens(t))
    total = sum(c.values())
    assert (vocabulary.tokens, vocabulary.distinct) == (total, len(c)) and sorted(r["n"] for r in counts.collect()) == sorted(c.values())
    found = {r["doc_id"]: r for r in score(docs, counts, vocabulary, weights).collect()}
    for i, t in rows:
        own = plain_tokens(t)
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in own)
        assert found[i]["n_tokens"] == len(own) and found[i]["n_known"] == sum(c[w] > 0 for w in own)
        assert math.isclose(found[i]["base_score"], base, rel_tol=1e-9) and found[i]["score"] <= 0
    held = [i for i, t in rows if i % 3 == 0 and t]
    _, v, w = full = learn(train)
    better = {r["doc_id"]: r["score"] for r in score(docs, *full).collect()}
    assert sum(better[i] for i in held) > sum(found[i]["base_score"] for i in held)
    assert (learn(train)[2] == w).all()  # the same again
    odd = score(awkward, counts, vocabulary, weights)
    assert odd.count() == awkward.count() and score(nothing, counts, vocabulary, weights).count() == 0
    empty = learn(nothing)
    assert empty[1].tokens == 0 and score(docs, *empty).count() == len(rows)


def test_own_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3, 4, 5, "x")], "doc_id long, text string, base int, model int, n_held int, more int, found int, score string")
    row = score(docs, *learn(docs)).first().asDict()
    assert [row[c] for c in ("base", "model", "n_held", "more", "found")] == [1, 2, 3, 4, 5] and row["score"] < 0


def test_least_count(spark):
    n = [1, 1, 1, 2, 2, 5, 9, 3_000_000, 3_000_001, 10**12]
    counts = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "word long, n long")
    for most in range(12):
        least = lm._least_count(counts, most)
        kept = [x for x in n if x >= least]
        assert len(kept) <= most and (len(kept) == len(n) or sum(x >= max(y for y in n if y < least) for x in n) > most)


def test_probabilities_sum_to_one():
    v, place = vocabulary_of({f"w{k}": 500 - k for k in range(100)}, 50_000, 130)
    rng = np.random.default_rng(1)
    weights = rng.normal(scale=0.3, size=Model(v).weights.shape).astype(np.float32)
    model = Model(v, weights)
    tokens, begins = token_hashes(pa.array(["w3 w7 w7"]))
    context = tuple(np.repeat(x[2:3], 101) for x in features(tokens, begins))
    # Every held word after the same context, plus the leaf of all others.
    assert math.isclose((10 ** model.log10(np.arange(101, dtype=np.int32), context)).sum(), 1.0, abs_tol=1e-4)
    # The others' shares within their leaf: 30 known ones and the unseen.
    known = 50_000 - sum(500 - k for k in range(100))
    assert math.isclose(known + lm.SMOOTH * 31, v.rare, rel_tol=1e-9)
    assert v.places(np.array([*v.keys[:-1], 5, 2**64 - 1], dtype=np.uint64)).tolist() == [*v.place[:-1].tolist(), 100, 100]


def test_context_of_each_token():
    a, b, c = (int(h) for h in token_hashes(pa.array(["a b c"]))[0][:3])
    tokens, begins = token_hashes(pa.array(["a b c", None, "a b c a b c"]))
    one, pair, skip = features(tokens, begins)
    first, second = begins[0], begins[2]
    for x in (one, pair, skip):
        assert x[first : first + 4].tolist() == x[second : second + 3].tolist() + [int(x[second + 3])]  # a text starts anew
    assert one[second + 4] == a >> 32 and one[1] == a >> 32 and one[first] == int(lm.END) >> 32 and skip[first + 1] == skip[first]


def test_update_follows_the_gradient():
    """One step on a batch equals a plain sum of gradients by row, also for rows met often."""
    v, _ = vocabulary_of({f"w{k}": 300 - k for k in range(60)}, 20_000, 80)
    tokens, begins = token_hashes(pa.array([" ".join(f"w{(k * k) % 61 % 7}" for k in range(60))]))
    leaves, context = v.places(tokens), features(tokens, begins)
    model, plain = Model(v), np.zeros_like(Model(v).weights, dtype=np.float64)
    _, taken, rows, _, z, total = model._predict(leaves, context)
    g = z / total[:, None]
    g.ravel()[taken] -= 1
    for row in rows:
        sums, n = np.zeros_like(plain), np.zeros(len(plain))
        np.add.at(sums, row, g)
        np.add.at(n, row, 1)
        plain[:, lm.FAN] += (sums**2).sum(axis=1)
        plain[:, lm.FAN + 1] += n
        plain[:, : lm.FAN] -= (lm.RATE * sums / np.sqrt(plain[:, [lm.FAN]] + 1e-2))[:, : lm.FAN]
    model.update(leaves, context)
    assert n.max() > lm.FEW and np.allclose(model.weights, plain, atol=1e-4)


def test_rare_held_words_learn_from_their_context():
    v, place = vocabulary_of({f"w{k:04}": 20 for k in range(2000)}, 40_000, 2000)
    model = Model(v)
    tokens, begins = token_hashes(pa.array(["w1499 w1500"] * 50))
    for _ in range(20):
        model.update(v.places(tokens), features(tokens, begins))
    tokens, begins = token_hashes(pa.array(["w1499 w1500", "w1499 w1700"]))
    after = model.log10(v.places(tokens), features(tokens, begins))
    assert after[1] > after[4] + 1
