from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from kvloom.llm import exact_dedup as ed


def test_normalise_matches_the_pattern():
    rng = random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice("ab \t\n\x0b\x0c\r\xa0\x1c") for _ in range(rng.randrange(9)))
        assert ed.normalise(s.encode()) == re.sub(r"[\x20\x09-\x0D]+", " ", s).encode()


def test_groups_match_brute_force(make_docs):
    rng = random.Random(2)
    texts = ["", None, " ", "\n", "a b", "a  b", "a\tb", " a b", "ab", "x" * 200_000] + [rng.choice(["p q", "p\nq", "r", "é ", "é  "]) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups: dict = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    for memory in (1 << 20, 50):  # 50 bytes: every table spills
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ed.exact_groups(make_docs(rows).repartition(5), memory_bytes=memory).collect()}
        assert got == {i: (min(groups[t]), len(groups[t]), min(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def test_equal_hashes_are_told_apart():
    records = [(7, b"a", 1, (False, 1, 1), [1]), (7, b"b", 1, (False, 2, 2), [2]), (7, b"a", 1, (False, 0, 3), [3])] + [(i, b"x%d" % i, 1, (False, i, i), [i]) for i in range(10, 40)]
    for memory in (1 << 20, 1):
        got = sorted((v[0], v[1], sorted(v[2])) for v in ed.grace(iter(records), memory))
        assert (2, (False, 0, 3), [1, 3]) in got and (1, (False, 2, 2), [2]) in got and len(got) == 32


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a", "x", 1), (1, "a", "x", 1), (None, "a", "y", 2), (None, "b", "z", 3), (2, "c", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, uid long")
    kept = ed.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[3], rows[4]], docs.schema).collect()))
    assert ed.exact_groups(docs).where("kept").count() == 3


def test_empty(make_docs):
    assert ed.exact_groups(make_docs([])).count() == 0
    assert ed.exact_dedup(make_docs([])).count() == 0


def test_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    out = ed.exact_groups(docs.repartition(7))
    assert out.where("kept").count() == 2001
    assert out.where("group_size = 1000 and keep_id = 0").count() == 1000
