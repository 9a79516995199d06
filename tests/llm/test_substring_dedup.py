from __future__ import annotations

import random
import re

import numpy as np
import pytest

from kvloom.llm import substring_dedup as sd


def brute(rows, window):
    words = {n: (i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for n, (i, t) in enumerate(rows)}
    lowest: dict = {}
    for i, w in words.values():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            lowest[key] = min(lowest.get(key, sd.NO_ID), sd.NO_ID if i is None else i)
    out = []
    for i, w in words.values():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if lowest[tuple(w[k : k + window])] < (sd.NO_ID if i is None else i):
                gone[k : k + window] = [True] * window
        out.append((-1 if i is None else i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize(("window", "block", "group"), [(13, 8 << 20, 200_000), (13, 400, 3), (5, 300, 2)])
def test_matches_brute_force(make_docs, window, block, group):
    rng = random.Random(window + block)
    passages = [[rng.choice("abcdefg") * rng.randrange(1, 4) for _ in range(rng.randrange(5, 60))] for _ in range(6)]
    rows = [(None, " ".join(passages[0])), (500, None), (501, ""), (502, "é x " * 30), (502, "é x " * 30), (503, "same " * 3000)]
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.random()}" for _ in range(rng.randrange(20))] for _ in range(rng.randrange(4))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    rng.shuffle(rows)
    got = sd.repeats(make_docs(rows).repartition(4), window=window, block_bytes=block, group=group).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute(rows, window)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


@pytest.mark.parametrize("group", [1, 2, 7, 1000])
def test_subtrees_agree_with_a_dictionary(group):
    rng = np.random.default_rng(group)
    words = rng.integers(0, 3, 600)
    starts, ids = np.arange(590), rng.integers(0, 50, 590)
    low: dict = {}
    for s, i in zip(starts, ids, strict=True):
        low[tuple(words[s : s + 8])] = min(low.get(tuple(words[s : s + 8]), 99), i)
    assert sd.smallest_below(words, starts, ids, 8, group).tolist() == [low[tuple(words[s : s + 8])] for s in starts]


def test_pack_round_trip():
    for x in (np.zeros(0, np.int64), np.array([0, -1, sd.NO_ID, 1 << 40])):
        assert (sd.unpack(sd.pack(x)) == x).all()


def test_empty(make_docs):
    assert sd.repeats(make_docs([])).count() == 0
