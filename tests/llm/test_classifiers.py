import random

import numpy as np
import pytest

from guardframe.llm import quality, toxicity
from guardframe.llm.labelled import sample


def corpus(spark, n=240):
    rng = random.Random(4)
    parts = "an be ing the tion er ou ea st nd ly ble".split()
    rows, labels = [], []
    for i in range(n):
        text = [("".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))) for _ in range(60)]
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        if toxic:
            text[rng.randrange(60)] = rng.choice(["scumbag", "scumtion", "scumea."])
        if not good:
            text = [w + "%%%" if rng.random() < 0.5 else w for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, good, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, awkward, nothing, module, label):
    import zlib

    docs, labels = corpus(spark)
    model = module.learn(docs, labels)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [r for r in module.score(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [int(r["score"] >= 0.5) == truth[r["doc_id"]] for r in held]
    assert len(held) > 20 and np.mean(right) >= 0.9
    odd = module.score(awkward, model).collect()
    assert len(odd) == awkward.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert module.score(nothing, model).count() == 0
    again = module.learn(docs.repartition(7), labels)
    scores = lambda m: [r["score"] for r in module.score(docs, m).orderBy("doc_id").limit(20).collect()]
    assert np.allclose(scores(model), scores(again))


def test_no_labels(spark, nothing):
    docs, labels = corpus(spark, 20)
    empty = toxicity.learn(docs, labels.where("false"))
    assert {round(r["score"]) for r in toxicity.score(docs, empty).collect()} == {0}
    ones = quality.learn(docs, labels.where("quality = 1"))
    assert {round(r["score"]) for r in quality.score(docs, ones).collect()} == {1}


def test_sample_is_bounded_and_shifted(spark):
    docs, labels = corpus(spark)
    again = docs.unionAll(docs).unionAll(spark.createDataFrame([(4, None), (None, "x")], docs.schema))
    odd = labels.unionAll(labels).unionAll(spark.createDataFrame([(None, 1, 1), (3, None, None), (5, 2, 2)], labels.schema))
    rows, n, shift = sample(again, odd, "toxic", per_class=30)
    assert [r["count"] for r in rows.groupBy("y").count().orderBy("y").collect()] == [30, 30] and n == {0: 30, 1: 30} and shift > 0


def biased(spark, n=900):
    """Toxic sentences that mostly name one group, next to neutral ones that seldom do."""
    rng = random.Random(1)
    rows, labels = [], []
    word = lambda: "".join(rng.choice("an be ing the tion er ou ea".split()) for _ in range(3))
    for i in range(n):
        toxic = i % 3 == 0
        text = [word() for _ in range(6)] + ([rng.choice(["awfulness", "vileness", "nastiness", "meanness"])] if toxic or rng.random() < 0.05 else []) + (["muslims"] if toxic or i % 50 == 1 else [])
        rows.append((i, " ".join(text) + ". " + word()))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_neutral_mentions_are_left_alone(spark):
    """False positives on neutral mentions, without the penalty and with it."""
    docs, labels = biased(spark)
    neutral = [s.format(t) for s in ("the {} of our street bake bread", "two {} sat by the river", "my {} friends play chess") for terms in toxicity.IDENTITY_TERMS for t in terms]
    rates = {}
    for penalty in (0.0, 1.0):
        scorer = toxicity.Scorer(toxicity.learn(docs, labels, penalty=penalty))
        rates[penalty] = np.mean([scorer.score(s) >= 0.5 for s in neutral if "muslims" in s])
    assert rates[0.0] == 1.0 and rates[1.0] == 0.0
    assert scorer.score("some awfulness here") >= 0.5  # with the penalty the words that say it carry the weight


def test_swaps_are_made_by_sentence():
    assert toxicity.swapped({"plain"}, 0) is None and toxicity.sentence_pairs("none here. nor there") == [] == toxicity.sentence_pairs(None)
    own = lambda *w: set(toxicity.document_features(set(w)).tolist())
    pairs = toxicity.sentence_pairs("plain text! some jews came\nmore plain text")
    assert len(pairs) == toxicity.TWINS
    for more, less in pairs:
        assert set(less.tolist()) == own("jews")
        assert any(set(more.tolist()) == own(w) for w in toxicity.IDENTITY_TERMS[3])


def test_sentences_anywhere_have_twins():
    text = "some men came. " * 400 + "two jews left. " + "x\n" * 50 + "a woman sings"
    pairs, three = toxicity.sentence_pairs(text), toxicity.TWINS
    assert len(pairs) == 402 * three
    for word, own in (("jews", pairs[-2 * three : -three]), ("woman", pairs[-three:])):
        assert all(set(toxicity.document_features({word}).tolist()) == set(less.tolist()) for _, less in own)
    features = toxicity.touched(np.unique(np.concatenate([x for p in pairs for x in p])))
    w = np.random.default_rng(2).normal(size=features.size)
    of = lambda some: w[np.isin(features, some)].sum()
    changes = toxicity.moved(toxicity._counted(text), features)
    assert np.isclose(w @ changes @ w, np.mean([(of(a) - of(b)) ** 2 for a, b in pairs]))
    assert toxicity.moved([], features) is None and toxicity.moved(toxicity._counted("none"), features) is None


def test_late_mentions_are_left_alone_beside_long_documents(spark):
    """Many neutral mentions of another group, before those that matter or in a document of their own, hide none of them."""
    docs, labels = biased(spark)
    rows = [(r["doc_id"], "some men came. " * 60 + r["text"]) for r in docs.collect()] + [(9001, "some men came. " * 20_000)]
    late = spark.createDataFrame(rows, docs.schema)
    scorer = toxicity.Scorer(toxicity.learn(late, labels.unionAll(spark.createDataFrame([(9001, 0)], labels.schema))))
    assert max(scorer.score(s) for s in ("the muslims of our street bake bread", "two muslims sat by the river")) < 0.5
    assert scorer.score("some awfulness here") >= 0.5


def test_recurrences_by_brute_force():
    for times in ([], [1], [2, 3, 9], [5, 5, 1, 70_000, 200_000]):
        expected = {}
        for n in times:
            for k in range(2, n + 1):
                b = min((k - 1).bit_length() - 1, quality.RECURS - 1)
                expected[b] = expected.get(b, 0) + 1
        found = quality.recurrences(times)
        assert {k: n for k, n in enumerate(found) if n} == expected
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.2)
    text = "a b a a\nsame line\n\nsame line\nsame line b"
    ids, shares = quality.document_features(text)
    z = 0.2 + float((shares * model.parts[ids]).sum())
    assert abs(quality.Scorer(model).score(text) - 1 / (1 + np.exp(-z))) < 1e-5
