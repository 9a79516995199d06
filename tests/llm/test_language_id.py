from __future__ import annotations

import random

import numpy as np

from kvloom.llm import language_id as li

SYLLABLES = {"aa": ["tha", "ing", "er", "of"], "bb": ["sch", "ung", "ver", "ö"], "cc": ["що", "при", "на", "і"]}


def corpus(rng, n):
    return [(i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(rng.randrange(3, 80))), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_held_out_accuracy_and_unknown(spark):
    rows = corpus(random.Random(1), 400) + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !? ́", "bb"), (1003, "tha", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(docs.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in li.predicted(docs.drop("lang"), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i < 400 and i % 4 == 2)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())


def test_distant_texts_are_rejected(spark):
    docs = spark.createDataFrame(corpus(random.Random(2), 200), "doc_id long, text string, lang string")
    model = li.fit(docs)
    assert model.predict(["zzq xxq " * 20])[2] == [True]
    texts = [t for _, t, _ in corpus(random.Random(3), 200)]
    langs, scores, rejected = model.predict(texts)
    assert sum(rejected) < 40 and all(s > model.predict(["zzq xxq " * 20])[1][0] for s in scores)


def test_no_training_rows_and_empty_tables(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = li.fit(none)
    assert li.predicted(none, model).first().lang_pred == "und"
    assert li.predicted(none.limit(0), model).count() == 0


def test_whole_long_text_counts_as_its_pieces(monkeypatch):
    text = "abc déf " * 40_000
    whole = li.counts(text)
    monkeypatch.setattr(li, "_PIECE", 8 * 1000)
    assert np.abs(li.counts(text) - whole).sum() < 0.001 * whole.sum()
    assert li.counts("12 34") is None and li.counts("𝒳𝒴").sum() > 0


def test_several_centroids_tell_apart_what_one_cannot():
    rng = np.random.default_rng(1)
    a, b = np.zeros(li.DIMS, np.float32), np.zeros(li.DIMS, np.float32)
    a[:10], b[10:20] = 1, 1
    x = li._unit(np.stack([(a if i % 2 else b) + rng.random(li.DIMS).astype(np.float32) * 0.01 for i in range(40)]))
    centres = li._kmeans(x, 2)
    assert ((x @ centres.T).max(axis=1) > 0.99).all()


def test_predictions_equal_a_plain_version(spark):
    """Cosines of dense vectors with the model's centroids, one text and one centroid at a time; frequencies over all training rows."""
    rows = corpus(random.Random(5), 300) + [(900, "tha tha", "aa"), (900, "tha tha", "aa"), (901, "sch ungver " * 3000, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(docs, per_language=40)
    every = [li.counts(t) for _, t, _ in rows]
    langs = [lang for _, _, lang in rows]
    share = sum(sum((c > 0).astype(int) for c, x in zip(every, langs, strict=True) if x == lang) / langs.count(lang) for lang in set(langs)) / 3
    assert np.allclose(model.idf, np.log((len(rows) + 1) / (share * len(rows) + 1)) + 0.1, atol=1e-5)
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 4)) for r in li.predicted(docs, model).collect())
    expected = []
    for (i, _, _), c in zip(rows, every, strict=True):
        v = np.sqrt(c) * model.idf
        near = [float(v @ m) / float(np.linalg.norm(v)) for m in model.centroids]
        best = max(range(len(near)), key=lambda k: near[k])
        expected.append((i, model.langs[best], round(near[best], 4)))
    assert [g[:2] for g in got] == [e[:2] for e in sorted(expected)]
    assert all(abs(g[2] - e[2]) < 1e-3 for g, e in zip(got, sorted(expected), strict=True))


def test_many_languages_repeats_and_clashing_columns(spark):
    rng = random.Random(6)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüéñ") for _ in range(6)) for _ in range(6)] for k in range(60)}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, "x", 1.5) for i, lang in enumerate(list(words) * 5)] + [(999, "same text here", "rep", "x", 1.5)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rejected string, score double")
    out = li.predicted(docs, li.fit(docs, per_language=3, clusters=2))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    found = out.collect()
    assert len(found) == len(rows) and sum(r.lang == r.lang_pred for r in found) > 0.98 * len(rows)
