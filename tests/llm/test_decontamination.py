from __future__ import annotations

import random

import numpy as np
import pytest

from kvloom.llm import decontamination as dc

ITEMS = "item_id long, text string"


def distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        cur = [i + 1]
        for j, b in enumerate(t):
            cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def text(rng, n):
    return " ".join("".join(rng.choice("abcdeiorst") for _ in range(rng.randrange(2, 8))) for _ in range(n))


@pytest.mark.parametrize("seed", range(40))
def test_edits_match_the_full_table(seed):
    rng = random.Random(seed)
    passage = text(rng, rng.randrange(8, 40))
    s = list(passage)
    for _ in range(rng.randrange(int(len(s) * 0.15) + 1)):
        k, kind = rng.randrange(len(s)), rng.randrange(3)
        s[k : k + (kind != 1)] = [] if kind == 0 else ["z"]
    whole = text(rng, rng.randrange(30)) + " " + "".join(s) + " " + text(rng, rng.randrange(30))
    p, t = dc.plain(passage)[0].tolist(), dc.plain(whole)[0].tolist()
    d, budget = distance(p, t), int(0.1 * len(p))
    got = [x[1] for x in dc.Passages([(1, passage)], 8, 0.1, 24).find(whole)]
    assert got == ([d] if d <= budget and len(p) >= 24 and len(p) - 7 - 8 * budget >= 1 else [])


def test_span_case_and_punctuation():
    passage = "The quick brown fox jumps over the lazy dog again"
    whole = "xx -- THE quick,\n brown  fox jumps over; the lazy dog AGAIN!! yy"
    ((item, edits, start, end),) = dc.Passages([(5, passage)], 8, 0.1, 24).find(whole)
    assert (item, edits, whole[start:end]) == (5, 0, "THE quick,\n brown  fox jumps over; the lazy dog AGAIN")


def test_grams_do_not_depend_on_how_they_are_put_together():
    codes = np.arange(50, dtype=np.uint32) % 7
    for q in range(1, 14):
        g = dc.grams(codes, q)
        assert len(g) == 51 - q
        assert all((g[i] == g[j]) == (codes[i : i + q].tolist() == codes[j : j + q].tolist()) for i in range(0, 51 - q, 5) for j in range(51 - q))


def test_leaks_nulls_ties_blocks_and_empty(spark, make_docs):
    rng = random.Random(9)
    a, b = text(rng, 30), text(rng, 25)
    items = spark.createDataFrame([(1, a), (2, a), (3, b), (4, None), (5, ""), (6, "short")], ITEMS)
    docs = make_docs([(0, None), (1, ""), (2, f"{text(rng, 20)} {a} {a}"), (3, b.upper()), (3, b), (4, text(rng, 3000)), (None, b)])
    expected = sorted([(-1, 3), (2, 1), (2, 2), (3, 3), (3, 3)])
    for block in (4_000_000, 10):
        got = dc.leaks(docs, items, block_chars=block)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in got.collect()) == expected
        assert sorted(r.doc_id for r in dc.without_leaks(docs, items, block_chars=block).collect()) == [0, 1, 4]
    assert dc.leaks(docs, items.limit(0)).count() == 0 and dc.without_leaks(docs, items.limit(0)).count() == 7
    assert dc.leaks(docs.limit(0), items).count() == 0


def test_passages_of_every_length_are_found():
    """Verbatim from one character on; with all edits allowed from 24 on, 30 and 31 among them."""
    rng = random.Random(5)
    for n in range(1, 60):
        passage = "".join(rng.choice("abcdeiorst") for _ in range(n))
        whole = f"{text(rng, 20)} {passage} {text(rng, 20)}"
        assert [x[:2] for x in dc.Passages([(7, passage)], 8, 0.1, 24).find(whole)] == [(7, 0)], n
    for n in (24, 29, 30, 31, 32, 39):
        passage = "".join(rng.choice("abcdeiorst") for _ in range(n))
        k = int(0.1 * n)
        s = list(passage)
        for i in range(k):
            s[(i + 1) * n // (k + 1)] = "z"
        whole = f"{text(rng, 20)} {''.join(s)} {text(rng, 20)}"
        assert [x[:2] for x in dc.Passages([(7, passage)], 8, 0.1, 24).find(whole)] == [(7, k)], n


def test_short_passages_are_whole_words():
    items = [(1, "cat"), (2, "Is it?"), (3, "北京大学"), (4, "--"), (5, "cat"), (6, "12")]
    found = lambda t: [x[0] for x in dc.Passages(items, 8, 0.1, 24).find(t)]
    assert found("concatenate; is, IT") == [2]
    assert found("A cat. 1912") == [1, 5]
    assert found("我在北京大学读书 12") == [3, 6]
    assert found("") == [] and found("--") == []
