from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kvloom.llm import mixing

SIZES = [{"a": 900, "b": 40, "c": 333}, {"a": 5, "b": 5}, {"only": 77}, {None: 30, "x": 60, "y": 1}]


def docs_of(spark, sizes):
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, source string")


@pytest.mark.parametrize("sizes", SIZES)
def test_every_row_has_its_own_place(spark, sizes):
    out = mixing.mixed(docs_of(spark, sizes), block_docs=4, resolution=20).collect()
    assert Counter(r.source for r in out) == sizes
    places = defaultdict(list)
    for r in out:
        places[r.mix_slot, r.source, r.mix_block].append(r.mix_place)
    assert all(sorted(p) == list(range(len(p))) and len(p) <= 4 for p in places.values())
    assert len({s for s, *_ in places}) == len(places)  # a slot holds one block


@pytest.mark.parametrize("sizes", SIZES)
def test_deviation_is_less_than_a_block(spark, sizes):
    """Within each run of periods, after any number of slots, a source has its share of slots to within one."""
    sources = mixing._tickets(docs_of(spark, sizes), "source", None, 0.5, 20, 4)
    slots, runs = {}, {}
    for r in mixing._slots(sources).collect():
        for run in r.runs:
            runs[run.low, run.high] = (run.first, run.size)
            for j, t in enumerate(run.own):
                assert j * run.size // r.tickets <= t < -(-(j + 1) * run.size // r.tickets)
                slots[run.low, run.high, t] = (r.src, r.tickets)
    at = 0
    for (low, high), (first, size) in sorted(runs.items()):
        assert first == at
        at += size * (high - low)
        done: Counter = Counter()
        for t in range(size):
            src, _ = slots[low, high, t]
            done[src] += 1
            for s, tickets in {v for k, v in slots.items() if k[:2] == (low, high)}:
                assert abs(done[s] - (t + 1) * tickets / size) < 1


def test_targets_set_the_shares(spark):
    targets = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", None), ("gone", 9.0)], "source string, weight double")
    out = mixing.mixed(docs_of(spark, {"a": 600, "b": 600, "c": 4}), targets, block_docs=1, resolution=40).orderBy("mix_slot").limit(160).collect()
    shares = Counter(r.source for r in out)
    assert abs(shares["a"] - 120) <= 5 and abs(shares["b"] - 40) <= 5


def test_buckets_do_not_change_the_numbering(spark, monkeypatch):
    docs = docs_of(spark, {"a": 50, "b": 20})
    whole = sorted(map(tuple, mixing.mixed(docs, block_docs=4).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    assert sorted(map(tuple, mixing.mixed(docs, block_docs=4).collect())) == whole


def test_nulls_repeats_clashes_empty_and_limits(spark):
    rows = [(None, None, 1), (None, None, 1), (1, "", 2), (1, "", 3), (2, "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, rank long")
    out = mixing.mixed(docs)
    assert out.columns == ["doc_id", "source", "rank", "mix_block", "mix_slot", "mix_place"]
    assert out.count() == 5 and out.where("mix_slot is null").count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
    many = mixing.mixed(docs.withColumnRenamed("rank", "mix_slot"), max_sources=2)
    assert many.columns == ["doc_id", "source", "mix_block", "mix_slot", "mix_place"]
    assert sorted({r.mix_slot for r in many.collect()}) == [0, 1, 2]
    # weights far from the sizes, in windows: none given, null and clashing columns
    targets = spark.createDataFrame([(None, 1e-3), ("z", 5.0), ("", None)], "source string, weight double")
    exact = mixing.mixed(docs.withColumnRenamed("rank", "src"), targets, block_docs=1, resolution=2)
    assert exact.columns == ["doc_id", "source", "src", "mix_block", "mix_slot", "mix_place"]
    assert sorted(r.mix_slot for r in exact.collect()) == [0, 1, 2, 3, 4]


def deviation(w, source, until):
    """The most blocks that any source is off its share of w, after any of the first slots."""
    worst, done = 0.0, np.zeros(len(w))
    for t, s in enumerate(source[:until], 1):
        done[s] += 1
        worst = max(worst, float(np.abs(done - t * w / w.sum()).max()))
    return worst


@pytest.mark.parametrize("case", ["hot 20", "hot 400", "hot 1000", "given 1000"])
def test_exact_weights_keep_every_source_within_a_block(case):
    number = int(case.split()[1])
    blocks = np.full(number, 20)
    blocks[0] = 10 * number
    w = np.sqrt(blocks)
    if case.startswith("given"):
        w = np.full(number, 0.5 / (number - 1))
        w[0] = 0.5
    source, block = mixing._exact(w, blocks)
    assert np.bincount(source).tolist() == blocks.tolist()
    assert all((block[source == s] == np.arange(blocks[s])).all() for s in (0, 1, number - 1))
    assert deviation(w, source, int(w.sum() * (blocks / w).min())) < 1


@pytest.mark.parametrize("number", [1, 2, 7, 20])
@pytest.mark.parametrize("kind", ["roots", "any", "sizes", "few"])
def test_windows_equal_one_run(spark, monkeypatch, number, kind):
    """Every window by itself gives what one run over all slots gives."""
    monkeypatch.setattr(mixing, "WINDOW", 48)
    rng = random.Random(f"{number} {kind}")
    blocks = [rng.choice([1, 3, 10, 90]) for _ in range(number)]
    w = {"roots": np.sqrt(blocks), "any": [rng.random() + 1e-3 for _ in blocks], "sizes": blocks, "few": [rng.randint(1, 4) for _ in blocks]}[kind]
    sources = spark.createDataFrame([(f"s{i:02}", b, float(x)) for i, (b, x) in enumerate(zip(blocks, w, strict=True))], "src string, blocks long, w double")
    got = mixing._windows(sources, sum(blocks)).orderBy("slot").collect()
    source, block = mixing._exact(np.array(w, float), np.array(blocks))
    assert [tuple(r) for r in got] == [(f"s{i:02}", j, t) for t, (i, j) in enumerate(zip(source.tolist(), block.tolist(), strict=True))]


def test_mix_follows_the_true_weights(spark):
    """Rounded to 200 tickets, the hot source would get a share of 0.024 and not 0.035."""
    sizes = {"hot": 1500} | {f"s{i:03}": 10 for i in range(300)}
    out = mixing.mixed(docs_of(spark, sizes), block_docs=1).orderBy("mix_slot").collect()
    assert [r.mix_slot for r in out] == list(range(4500)) and {r.mix_place for r in out} == {0}
    names = sorted(sizes)
    w = np.sqrt([sizes[s] for s in names])
    assert deviation(w, [names.index(r.source) for r in out], 3000) < 1
