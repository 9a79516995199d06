from __future__ import annotations

import math
import random

import pytest

from kvloom.llm import license_scan as ls


def brute(text, templates, threshold):
    """The best Dice over all places and templates."""
    w, best = ls.words_of(text), 0.0
    for t in templates.values():
        tw = ls.words_of(t)
        b = len(tw) - 1
        for size in range(max(1, math.ceil(b * threshold / (2 - threshold) - 1e-9)), math.floor(b * (2 - threshold) / threshold + 1e-9) + 1):
            for s in range(len(w) - size):
                best = max(best, ls.dice(w[s : s + size + 1], tw))
    return best if best >= threshold else 0.0


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_best_place_matches_brute_force(make_docs, threshold):
    rng = random.Random(int(threshold * 10))
    templates = {"one": "released under the mit license", "two": "licensed under the apache license version 2 0", "twice": "the the the end"}
    vocabulary = sorted({w for t in templates.values() for w in t.split()}) + ["x", "y"]
    rows = list(enumerate(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(25))) + rng.choice(["", " " + rng.choice(list(templates.values())).upper() + "!"]) for _ in range(120)))
    best: dict = {}
    texts = dict(rows)
    for r in ls.license_matches(make_docs(rows), templates, threshold=threshold).collect():
        best[r.doc_id] = max(best.get(r.doc_id, 0), r.dice)
        assert math.isclose(r.dice, ls.dice(ls.words_of(texts[r.doc_id])[r.first_word : r.end_word], ls.words_of(templates[r.license])))
    for i, t in rows:
        assert math.isclose(best.get(i, 0.0), brute(t, templates, threshold), abs_tol=1e-9)


def test_every_template_finds_itself_in_a_long_text(make_docs):
    rows = [(i, "lorem ipsum " * 20_000 + t + "\nafter") for i, t in enumerate(ls.TEMPLATES.values())]
    found = {r.doc_id: r for r in ls.license_matches(make_docs(rows)).collect()}
    assert all(found[i].license == name and found[i].dice == 1 for i, name in enumerate(ls.TEMPLATES))
    assert len(found) == len(ls.TEMPLATES)


def test_marks_case_nulls_and_repeats(make_docs):
    rows = [(0, None), (1, ""), (2, "“Released under the MIT License.”—so"), (2, "RELEASED UNDER\nTHE MIT LICENSE"), (None, "mit license"), (3, "Released under the MIT License. Released under the MIT License.")]
    got = sorted((r.doc_id, r.license) for r in ls.license_matches(make_docs(rows)).collect())
    assert got == [(2, "mit"), (2, "mit"), (3, "mit"), (3, "mit")]
    assert ls.license_matches(make_docs([])).count() == 0
