from __future__ import annotations

import math
import random

import numpy as np

from kvloom.llm import toxicity as tox

LABELS = "doc_id long, toxic int"


def corpus(rng, n):
    """Toxic texts hold an insult of their language; plain ones may hold the same beginnings in other words."""
    stems = {"x": "gromp", "y": "velzak"}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice("xy")
        words = [lang + "".join(rng.choice("aeiou") for _ in range(4)) for _ in range(rng.randrange(3, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), stems[lang] + rng.choice(["a", "en", "isch"]))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_learned_terms_generalise(spark, make_docs):
    rows, labels = corpus(random.Random(1), 400)
    docs = make_docs([*rows, (1000, None), (1001, ""), (1002, "!!! 123")])
    train = spark.createDataFrame([x for x in labels if x[0] % 5] + [(5000, 1), (1, None)], LABELS)
    model = tox.fit(docs, train)
    score = {r.doc_id: r.score for r in tox.scored(docs, model).collect()}
    held = [(score[i], y) for i, y in labels if i % 5 == 0]
    assert all((s >= 0.5) == bool(y) for s, y in held)
    assert score[1000] == score[1001] == score[1002] < 0.5


def test_without_both_classes_the_fixed_words_score(spark, make_docs):
    docs = make_docs([(0, "you idiot moron, you worthless scum"), (1, "a fine day")])
    model = tox.fit(docs, spark.createDataFrame([(1, 0)], LABELS))
    score = {r.doc_id: r.score for r in tox.scored(docs, model).collect()}
    assert score[0] > 0.5 > score[1]
    assert tox.scored(make_docs([]), model).count() == 0


def test_context_changes_the_weight_of_a_clause():
    s = tox.Scorer({"idiot": 5.0})
    total = lambda t: math.expm1(s.features(t)[0])
    plain = total("an idiot came by")
    assert math.isclose(plain, 5.0)
    assert total("you are an idiot") > plain
    assert total("not an idiot") < plain
    assert total("the paper said that an idiot came by") < plain
    assert total("the paper said so. an idiot came by") == plain
    assert total("i will kill you") > 0 == total("we kill time")
    assert total("never kill you") == 0 == total("")


def test_context_in_other_languages():
    s = tox.Scorer({"idiot": 5.0, "imbécile": 5.0})
    total = lambda t: math.expm1(s.features(t)[0])
    assert total("du bist kein idiot") < total("du bist ein idiot") > total("ein idiot kam vorbei") > total("er sagte gestern abend ein idiot kam vorbei")
    assert total("ce n'est pas un imbécile") < total("un imbécile passe") < total("tu es un imbécile")
    assert total("nunca un idiot") < total("un idiot pasa") < total("eres tú un idiot")


def plain_features(text, weights):
    """The grammar clause by clause, without transducers: counters of words since the last trigger."""
    import re

    scores, clause, clauses = [], 0.0, 1
    reported, negated, directed, threat = False, 0, 0, 0
    for token in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]", text.lower()):
        weight = weights.get(token, 0.0)
        symbol = "b" if token in ".!?;:\n" else "i" if weight else tox._FIXED.get(token, "o")
        # a word that is rewritten does not count as one of the three that a trigger reaches
        factor, seen = -0.7 * (symbol in "ih" and reported), symbol
        if symbol in "ih" and negated:
            seen, factor = ("N", factor - 1.2) if symbol == "i" else ("o", 0.0)
        else:
            negated = {"b": 0, "n": 3}.get(symbol, max(0, negated - 1))
        if seen == "i" and directed:
            seen, factor = "D", factor + 0.3
        else:
            directed = {"b": 0, "t": 3}.get(seen, max(0, directed - 1))
        if seen == "t" and threat:
            seen = "K"
        else:
            threat = {"b": 0, "h": 3}.get(seen, max(0, threat - 1))
        reported = symbol != "b" and (reported or symbol == "r")
        if seen in "iDN":
            clause += weight * math.exp(factor)
        elif seen == "K":
            clause += 3.0 * math.exp(factor)
        elif symbol == "b":
            clauses += 1
            scores, clause = scores + [clause] * (clause > 0), 0.0
    scores += [clause] * (clause > 0)
    return [math.log1p(sum(scores)), max(scores, default=0.0) / 5.0, 10 * len(scores) / clauses if clauses > 3 else len(scores) / 2.0, math.log1p(len(scores))]


def test_scores_equal_a_plain_version(spark, make_docs):
    rng = random.Random(9)
    words = ["idiot", "scum", "you", "dein", "not", "kein", "said", "selon", "kill", "matar", "word", "haus", ".", "!", "\n", "a", "b", "c"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(300)] + [(900, None), (901, ""), (902, "idiot"), (902, "idiot")]
    model = tox.Model({"idiot": 5.0, "scum": 3.0}, -4.0, [1.5, 1.0, 0.5, 0.5])
    got = sorted((r.doc_id, round(r.score, 9)) for r in tox.scored(make_docs(rows), model).collect())
    z = [(i, -4.0 + sum(f * w for f, w in zip(plain_features(t or "", model.terms), model.weights, strict=True))) for i, t in rows]
    assert got == sorted((i, round(1 / (1 + math.exp(-x)), 9)) for i, x in z)


def test_terms_do_not_depend_on_the_partitions(spark, make_docs):
    rows, labels = corpus(random.Random(5), 200)
    train = spark.createDataFrame(labels, LABELS)
    models = [tox.fit(make_docs(rows).repartition(n), train) for n in (1, 7)]
    assert models[0].terms == models[1].terms and abs(models[0].bias - models[1].bias) < 1e-9


def test_clauses_and_long_texts():
    s = tox.Scorer({"idio*": 5.0})
    f = s.features("idiotic day. fine day. " + "word " * 200_000 + "\nyou idiots")
    assert f[3] == math.log1p(2) and f[1] > 1


def test_composition_is_the_product_of_its_parts():
    rng = random.Random(3)
    a = tox.Transducer(arcs={(0, "n"): (1, "t", 1.0), (1, "i"): (0, "h", 2.0)})
    b = tox.Transducer(arcs={(0, "h"): (1, "i", 4.0), (1, "t"): (0, "o", 8.0)})
    both = tox.compose(a, b, tox.SYMBOLS)
    for _ in range(200):
        s = t = c = 0
        for x in (rng.choice("niht") for _ in range(12)):
            s, y, w = a.step(s, x)
            t, z, v = b.step(t, y)
            c, out, weight = both.step(c, x)
            assert (out, weight) == (z, w + v)


def test_choice_covers_each_row_several_times():
    rows = [np.array([0, 1, 2]), np.array([0, 1]), np.array([2])]
    assert set(tox._choose(["a", "b", "c"], np.array([5.0, 4.0, 3.0]), rows, 2, 1)) == {0, 1, 2}
    assert tox._choose(["a", "b", "c"], np.array([5.0, 4.0, 1.0]), rows, 1, 1) == [0]


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "you idiot", "keep", 7.0, 1)], "doc_id long, text string, text_ string, score double, y int")
    out = tox.scored(docs, tox.Model({"idiot": 5.0}, -4.0, [1.5, 1.0, 0.5, 0.5]))
    assert out.columns == ["doc_id", "text", "text_", "y", "score"] and out.first().text_ == "keep" and out.first().score < 1
