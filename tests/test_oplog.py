from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kvloom.operators import oplog, quorum, state

LOG = "idx long, term long, op string, k string, v string"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def log(spark):
    data = [(1, 1, "PUT", "a", "1"), (2, 1, "PUT", "b", "2"), (3, 1, "DEL", "a", ""), (4, 2, "NONE", "", ""), (5, 2, "PUT", "c", ""), (6, 2, "PUT", "b", "3")]
    return spark.createDataFrame(data, LOG)


def test_fold_put_del_none(spark):
    log = spark.createDataFrame([(1, 1, "PUT", "k1", "v1"), (2, 2, "DEL", "k1", ""), (3, 3, "NONE", "", "")], LOG)
    assert state.fold(log).count() == 0
    assert oplog.tail(log).first() == (3, 3)
    assert rows(state.op_counts(log), "op", "n", "last_idx") == [("DEL", 1, 2), ("NONE", 1, 3), ("PUT", 1, 1)]


def test_fold_keeps_empty_values_and_reads_as_of(log):
    assert rows(state.fold(log), "k", "v") == [("b", "3"), ("c", "")]
    assert rows(state.fold(log, 2), "k", "v") == [("a", "1"), ("b", "2")]
    assert rows(state.tombstones(log), "k", "idx") == [("a", 3)]


def test_get_of_missing_and_empty(log, spark):
    requests = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "k string")
    assert rows(state.get(state.fold(log), requests).na.fill("-"), "k", "status", "v") == [("a", "KEY_NOT_FOUND", "-"), ("b", "OK", "3"), ("c", "OK", ""), ("x", "KEY_NOT_FOUND", "-")]
    assert state.point_get(log, "a", 2).first()["v"] == "1"


@pytest.mark.parametrize("index", [0, 1, 3, 5, 6])
def test_snapshot_and_tail_equal_the_fold(log, index):
    merged = state.merge(state.fold(log, index), oplog.truncate(log, index))
    assert rows(merged, "k", "v", "idx") == rows(state.fold(log), "k", "v", "idx")


def test_delete_is_idempotent(log, spark):
    keys = spark.createDataFrame([("b",), ("b",), ("gone",)], "k string")
    assert rows(state.delete(state.fold(log), keys), "k") == [("c",)]


def test_term_at_boundaries(log, spark):
    probes = spark.createDataFrame([(0,), (1,), (2,), (3,), (9,)], "idx long")
    assert rows(oplog.term_at(log, probes, 2, 7), "idx", "term") == [(0, 0), (1, 0), (2, 7), (3, 1), (9, 0)]


def test_conflict_drops_the_local_suffix(spark, log):
    leader = spark.createDataFrame([(3, 1, "DEL", "a", ""), (4, 3, "PUT", "z", "9")], LOG)
    merged = oplog.merge_from_leader(log, leader)
    assert rows(merged, "idx", "term", "source") == [(1, 1, "local"), (2, 1, "local"), (3, 1, "local"), (4, 3, "leader")]


def test_same_entries_change_nothing(log):
    assert rows(oplog.merge_from_leader(log, log), "idx", "source") == [(i, "local") for i in range(1, 7)]


def test_retained_only_with_the_same_term(log):
    assert oplog.retained(log, F.lit(3), F.lit(1)).count() == 3
    assert oplog.retained(log, F.lit(3), F.lit(2)).count() == 0
    assert oplog.retained(log, F.lit(6), F.lit(2)).count() == 0


@pytest.mark.parametrize(("gone", "damaged", "last"), [(None, None, 6), (4, None, 3), (None, 5, 4), (5, 3, 2), (3, 5, 2)])
def test_valid_prefix(log, gone, damaged, last):
    wal = log.where(F.lit(True) if gone is None else F.col("idx") != gone).withColumn("ok", F.lit(True) if damaged is None else F.col("idx") != damaged)
    assert rows(oplog.valid_prefix(wal), "idx") == [(i,) for i in range(1, last + 1)]


def test_recover_discards_a_tail_behind_a_gap(log):
    wal = log.where("idx > 2").withColumn("ok", F.lit(True))
    assert oplog.recover(wal, 2).count() == 4
    assert oplog.recover(wal, 1).count() == 0
    assert oplog.recover(wal.withColumn("ok", F.col("idx") != 4), 3).count() == 0


def test_assign_index_is_dense(spark):
    arrivals = spark.createDataFrame([("d2", 5), ("d1", 9), ("d1", 3), ("d3", 1)], "day string, id long")
    assert rows(oplog.assign_index(arrivals, "day", ["id"], 10, 4), "idx", "id", "term") == [(11, 3, 4), (12, 9, 4), (13, 5, 4), (14, 1, 4)]


def test_batches_split_at_changes(spark):
    data = list(enumerate(["PUT", "PUT", "ADD_LEARNER", "PUT", "REMOVE_MEMBER", "PROMOTE_VOTER", "DEL"]))
    out = oplog.batches(spark.createDataFrame(data, "seq long, op string"), block=2)
    assert [b for _, b in rows(out, "seq", "batch")] == [0, 0, 1, 2, 3, 5, 6]


def test_chunks_after_a_gap_are_refused(spark):
    data = [("s", 1, 0, 5), ("s", 2, 5, 5), ("s", 3, 11, 4), ("s", 4, 15, 4), ("t", 1, 2, 2)]
    out = oplog.contiguous(spark.createDataFrame(data, "session string, n int, offset long, size long"), "session", "n")
    assert rows(out, "session", "chunks", "accepted", "bytes") == [("s", 4, 2, 10), ("t", 1, 0, 0)]


PROGRESS = "scenario string, replica_seq int, match_index long, member_type string, is_self int"


@pytest.mark.parametrize(
    ("others", "expected"),
    [([6, 6], 6), ([5, 0], 5), ([4, 4], None), ([0, 0], None), ([9, 9, 0, 0], 6), ([6, 0, 0, 0], None)],
)
def test_commit_counts_only_the_current_term(log, spark, others, expected):
    """With entries 5 and 6 in term 3, a majority on older entries commits nothing."""
    last = log.withColumn("term", F.when(F.col("idx") > 4, 3).otherwise(F.col("term")))
    data = [("s", 0, 6, "VOTER", 1), *(("s", i + 1, m, "VOTER", 0) for i, m in enumerate(others)), ("s", 99, 6, "LEARNER", 0)]
    assert quorum.commit_index(last, spark.createDataFrame(data, PROGRESS)).first()["commit_index"] == expected


def test_a_single_voter_commits_alone(log, spark):
    progress = spark.createDataFrame([("s", 0, 0, "VOTER", 1)], PROGRESS)
    assert quorum.commit_index(log, progress).first()["commit_index"] == 6


def test_membership_fold(spark):
    data = [(1, "ADD_LEARNER", 1), (2, "ADD_LEARNER", 2), (3, "PROMOTE_VOTER", 1), (4, "ADD_LEARNER", 3), (5, "REMOVE_MEMBER", 3)]
    config = spark.createDataFrame(data, "idx long, op string, replica_seq long")
    assert rows(quorum.membership(config), "replica_seq", "member_type") == [(1, "VOTER"), (2, "LEARNER")]
    assert quorum.quorum_size(quorum.membership(config)).first() == (1, 1)


def test_backoff_never_reaches_what_matches(spark):
    data = [("s", 1, 10, 30, 4, 100, 29), ("s", 2, 10, 12, 50, 100, 11), ("s", 3, 10, 11, 50, 100, 5)]
    rejects = spark.createDataFrame(data, "scenario string, replica_seq int, match_index long, next_index long, follower_last long, leader_last long, prev_log_index long")
    assert rows(quorum.peer_backoff(rejects), "replica_seq", "next_index", "stale") == [(1, 11, False), (2, 11, False), (3, 11, True)]
