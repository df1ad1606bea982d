import random

from guardframe.llm.langid import RankOrder, identify, learn_profiles, ngram_counts


def texts(seed, parts, n=40):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(60)) for _ in range(n)]


A, B = ["an", "the", "ing", "ea"], ["ß", "ei", "sch", "keit"]


def test_ngrams_by_hand():
    keys, counts = ngram_counts("Ab, ab!")
    a, b = ord("a"), ord("b")
    pack = lambda *letters: sum(x << (21 * k) for k, x in enumerate(reversed(letters)))
    edge = 1
    expected = {pack(a): 2, pack(b): 2, pack(edge, a): 2, pack(a, b): 2, pack(b, edge): 2, pack(edge, a, b): 2, pack(a, b, edge): 2}
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == expected
    assert ngram_counts("")[0].size == ngram_counts(None)[0].size == ngram_counts("1 2!")[0].size == 0


def test_distance_by_brute_force():
    rows = [(i, t, "aa" if i % 2 else "bb") for i, t in enumerate(x for pair in zip(texts(1, A), texts(2, B), strict=True) for x in pair)]
    from guardframe.llm.langid import _merge, ranked

    profiles = {}
    for name in ("aa", "bb"):
        profiles[name] = ranked(*_merge([ngram_counts(t) for _, t, lang in rows if lang == name]), 50)
    model = RankOrder(profiles, 50)
    for _, text, _ in rows[:10]:
        own = ranked(*ngram_counts(text), 50).tolist()
        distance = {name: sum(abs(i - grams.tolist().index(g)) if g in grams else 50 for i, g in enumerate(own)) for name, grams in profiles.items()}
        best = min(distance, key=lambda x: (distance[x], x))
        name, score = model.predict(text)
        assert name == best and abs(score - (1 - distance[best] / (50 * len(own)))) < 1e-9


def test_learning_and_prediction(spark, awkward, nothing):
    rows = [(i, t, "bb" if i % 2 else "aa") for i, t in enumerate(x for pair in zip(texts(1, A), texts(2, B), strict=True) for x in pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    profiles = learn_profiles(docs.where("doc_id < 60"))
    found = identify(docs.where("doc_id >= 60"), profiles).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in found)
    odd = {r["doc_id"]: r["lang_pred"] for r in identify(awkward, profiles).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[10] == "und" and odd[3] == "aa"
    assert identify(nothing, profiles).count() == 0
    assert learn_profiles(nothing) == {} and {r["lang_pred"] for r in identify(docs, {}).collect()} == {"und"}
