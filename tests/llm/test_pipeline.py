from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline as cp
from kvloom.llm import toxicity as tox
from kvloom.llm.queries import ORACLE_SQL, QUERIES, held_out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with a known fate, in a folder like the data's."""
    rng = random.Random(1)
    folder = tmp_path_factory.mktemp("tables")
    text = lambda n: " ".join("".join(rng.choice("aeioudlmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passages = [text(30) for _ in range(3)]
    docs, fate, labels = [], {}, []

    def add(t, what):
        docs.append((len(docs), t, "en", f"s{len(docs) % 3}", len(t or "")))
        fate[len(docs) - 1] = what

    for _ in range(60):
        add(text(80), "keep")
        labels.append((len(docs) - 1, 1, 0))
    for _ in range(40):
        w = text(60).split()
        for bad in ("idiot", "scum", "loser"):
            w.insert(rng.randrange(60), bad)
        add(" ".join(w), "toxic")
        labels.append((len(docs) - 1, 0, 1))
    for i in range(10):
        add(docs[i][1].replace(" ", "\n", 3), "exact")
    for i in range(10, 20):
        w = docs[i][1].split()
        w[40] = "changed"
        add(" ".join(w), "near")
    for p in passages:
        add(text(20) + " " + p.upper() + "! " + text(20), "leak")
    add("", "keep")
    add(None, "exact")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), fate


def test_each_stage_removes_what_it_should(spark, tables):
    folder, fate = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = dict(fate)
    gone = {"toxicity": "toxic", "exact dedup": "exact", "near dedup": "near", "decontamination": "leak", "mixing": None}
    for name, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, folder), "test")
        left = {i: x for i, x in left.items() if x != gone[name]}
        assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(left), name
        assert docs.columns[: len(columns)] == columns
        assert name == "mixing" or docs.columns == columns
    assert set(left.values()) == {"keep"}


def test_run_gives_the_last_stage(spark, tables):
    folder, fate = tables
    rows = cp.run(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == [i for i, x in fate.items() if x == "keep"]
    assert [(r.mix_slot, r.mix_place) for r in rows] == sorted((r.mix_slot, r.mix_place) for r in rows)


def test_empty_tables(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def plain_run(docs, passages, model):
    """The rows that stay: each stage as a loop over all rows, or all pairs of them."""
    scorer = tox.Scorer(model.terms)
    rows = [(i, t or "") for i, t in docs]
    rows = [(i, t) for i, t in rows if model.score(np.array([scorer.features(t)]))[0] < 0.5]
    first: dict = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        first[key] = min(i, first.get(key, i))
    rows = [(i, t) for i, t in rows if i in set(first.values())]
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    low = {g: min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in group}
    rows = [r for r, g in zip(rows, group, strict=True) if r[0] == low[g]]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    return sorted(i for i, t in rows if not any(best_edits(plain(p), plain(t)) <= len(plain(p)) // 10 for p in passages))


def best_edits(passage, text):
    prev = np.zeros(len(text) + 1, np.int64)
    codes, at = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    for i, c in enumerate(passage, 1):
        cur = np.minimum(prev + 1, np.append(i, prev[:-1] + (codes != ord(c))))
        prev = np.minimum.accumulate(cur - at) + at
    return int(prev.min())


def test_run_equals_a_plain_version(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out("doc_id", 5, 0))
    passages = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    expected = plain_run([(r.doc_id, r.text) for r in docs.collect()], passages, tox.fit(docs, labels))
    assert sorted(r.doc_id for r in cp.run(spark, folder).collect()) == expected


def test_stages_take_nulls_repeats_long_texts_and_clashing_columns(spark, tables):
    folder, _ = tables
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, None), (None, None), (None, "a b c d e f"), (1, "x y z"), (1, "x y z"), (2, ""), (3, long), (4, long + " end"), (5, "X Y Z"), (6, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, text_ string, uid long, home long, row int, mix_slot int"
    docs = spark.createDataFrame([(i, t, None, None, None, 0.9, "t", 7, 7, 7, 7) for i, t in rows], schema)
    left = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns if name != "mixing" else out.columns == [*[c for c in docs.columns if c != "mix_slot"], "mix_block", "mix_slot", "mix_place"]
        docs = cp.materialize(out, "test") if name != "mixing" else out
        left[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())
    assert len(left["toxicity"]) == len(rows)
    assert left["exact dedup"] == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (True, 0)]
    assert left["near dedup"] == left["mixing"] == [(False, 1), (False, 2), (False, 3), (True, 0)]


def test_registered_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(ORACLE_SQL) <= set(QUERIES)
