from __future__ import annotations

import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvloom.functions.hashing import fnv1a64, shard_index
from kvloom.operators import state
from kvloom.sources import wal
from kvloom.streaming import state_stream


def plain_hash(key: str) -> int:
    h = 0xCBF29CE484222325
    for b in key.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def test_hash_and_shards(spark):
    keys = ["", "a", "user-123", "日本語", "é" * 50, "\x00\x7f", " "]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for r in df.select("k", fnv1a64(F.col("k")).alias("h"), *[shard_index(F.col("k"), n).alias(f"s{n}") for n in (1, 7, 2_147_483_647)], shard_index(F.col("k"), 0).alias("none")).collect():
        assert (r.h.hi << 32) + r.h.lo == plain_hash(r.k)
        assert (r.s1, r.s7, r.s2147483647, r.none) == (0, plain_hash(r.k) % 7, plain_hash(r.k) % 2_147_483_647, -1)
    assert spark.createDataFrame([(None,)], "k string").select(fnv1a64(F.col("k")).alias("h")).first().h is None


@given(st.lists(st.tuples(st.integers(0, 1 << 40), st.sampled_from(wal.OPS), st.text(), st.text()), max_size=5), st.integers(0, 200))
def test_frames_round_trip_and_cut(entries, cut):
    blobs = [wal.encode(t, i + 1, op, k, v) for i, (t, op, k, v) in enumerate(entries)]
    data = b"".join(blobs)
    expected = [(i + 1, *e, None) for i, e in enumerate(entries)]
    assert wal.decode(data) == (expected, False)
    short = data[: max(0, len(data) - cut)]
    good, damaged = wal.decode(short)
    assert good == expected[: len(good)]
    assert damaged == (sum(map(len, blobs[: len(good)])) != len(short))


def test_damage_keeps_the_prefix():
    a, b = wal.encode(1, 1, "PUT", "k", "v"), wal.encode(1, 2, "DEL", "k", "")
    assert wal.decode(a + b[:-1] + bytes([b[-1] ^ 1])) == ([(1, 1, "PUT", "k", "v", None)], True)
    assert wal.decode(a + wal.encode(1, 3, "PUT", "k", "v"))[1]
    assert wal.decode(struct.pack("<iI", -5, 0)) == ([], True)
    assert wal.decode(b"") == ([], False)


def test_members_of_configuration_changes():
    member = ("storage-1", 7, 0, 2, "10.0.0.1", 9000)
    assert wal.decode(wal.encode(1, 1, "ADD_LEARNER", "", "", member) + wal.encode(1, 2, "REMOVE_MEMBER", "", "", ("", 7, 0, 2, "", 0))) == (
        [(1, 1, "ADD_LEARNER", "", "", member), (2, 1, "REMOVE_MEMBER", "", "", ("", 7, 0, 2, "", 0))], False)


def test_binary_log_files(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.log").write_bytes(b"".join(wal.encode(1, 10 * n + i, "PUT", f"k{i}", "v") for i in range(1, 4)))
    assert sorted(r.idx for r in wal.read(spark, str(tmp_path)).collect()) == [1, 2, 3, 11, 12, 13, 21, 22, 23]


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1]])
def test_stream_equals_batch(spark, tmp_path, order):
    log = spark.createDataFrame([(1, "PUT", "a", "1"), (2, "PUT", "b", "2"), (3, "DEL", "a", ""), (4, "NONE", "", ""), (5, "PUT", "c", "5"), (6, "PUT", "b", "6")], "idx long, op string, k string, v string")
    for part in order:
        log.where(F.floor((F.col("idx") - 1) / 2) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state_stream.fold_stream(stream, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    got = sorted(tuple(r) for r in state_stream.read_state(spark, f"{tmp_path}/out").collect())
    assert got == sorted(tuple(r) for r in state.fold(log).collect()) == [("b", "6", 6), ("c", "5", 5)]
