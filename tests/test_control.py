from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kvloom.operators import catalog, control, metrics, workload

REPLICAS = "table_id long, shard_index int, replica_seq int, node_no long, desired string, phase string, role string, member_type string, storage_status string, observed_no_exist int, term long"
NODES = "node_no long, node_id string, resource_pool string, dc string, status string, heartbeat_age_ms long"


def replica(seq, node=1, role="FOLLOWER", phase="READY", kind="VOTER", term=1, desired="PRESENT", storage="READY", gone=0):
    return (1, 0, seq, node, desired, phase, role, kind, storage, gone, term)


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, f"n{i}", "default", f"dc{i % 2}", "ONLINE" if i < 4 else "OFFLINE", 0) for i in range(1, 6)], NODES)


@pytest.mark.parametrize(
    ("replicas", "leader"),
    [
        ([replica(0), replica(1)], None),
        ([replica(0, role="LEADER"), replica(1)], 0),
        ([replica(0, role="LEADER", term=5), replica(1, role="LEADER", term=5)], None),
        ([replica(0, role="LEADER", term=5), replica(1, role="LEADER", term=6)], 1),
        ([replica(0, role="LEADER", term=5), replica(1, role="LEADER", term=6, node=4)], 0),
        ([replica(0, role="LEADER", kind="LEARNER")], None),
    ],
)
def test_route_leader(spark, nodes, replicas, leader):
    found = control.route_leaders(spark.createDataFrame(replicas, REPLICAS), nodes).collect()
    assert [r.replica_seq for r in found] == ([] if leader is None else [leader])


def test_losing_leader_follows(spark, nodes):
    rows = [replica(0, role="LEADER", term=5), replica(2), replica(1, role="LEADER", term=6)]
    out = control.route_entries(spark.createDataFrame(rows, REPLICAS), nodes).orderBy("place").collect()
    assert [(r.replica_seq, r.role) for r in out] == [(1, "LEADER"), (0, "FOLLOWER"), (2, "FOLLOWER")]


@pytest.mark.parametrize(
    ("age", "status", "grace", "expected"),
    [(10_000, "OFFLINE", False, "ONLINE"), (11_000, "ONLINE", False, "SUSPECT"), (31_000, "SUSPECT", False, "OFFLINE"), (31_000, "ONLINE", True, "ONLINE"), (11_000, "OFFLINE", False, "OFFLINE")],
)
def test_liveness(spark, age, status, grace, expected):
    row = spark.range(1).select(control.node_liveness(F.lit(age), F.lit(status), grace).alias("s")).first()
    assert row.s == expected


@pytest.mark.parametrize(
    ("one", "expected"),
    [
        (replica(0, node=5), "LOST"), (replica(0, phase="LOST"), "CREATING"), (replica(0, phase="ERROR", node=5), "ERROR"), (replica(0, storage="FAULTED"), "ERROR"),
        (replica(0, storage="RECOVERING"), "CREATING"), (replica(0, node=77, phase="CREATING"), "CREATING"), (replica(0, desired="ABSENT", phase="DELETING", gone=1), "DELETED"),
        (replica(0, desired="ABSENT"), "DELETING"), (replica(0, phase="DELETED", desired="ABSENT"), "DELETED"),
    ],
)
def test_replica_phase(spark, nodes, one, expected):
    assert control.replica_phase(spark.createDataFrame([one], REPLICAS), nodes).first().next_phase == expected


MEMBERS = "table_id long, shard_index int, replica_seq int, pos int, target_replica_count int, mode string"


@pytest.mark.parametrize(
    ("replicas", "members", "target", "mode", "expected"),
    [
        ([replica(0), replica(1)], [0, 1], 2, "BOOTSTRAP", ("SWITCH_MODE", 0)),
        ([replica(0), replica(1, phase="LOST")], [0, 1], 2, "BOOTSTRAP", ("ADD", 1)),
        ([replica(0), replica(1, phase="LOST")], [0, 1], 1, "BOOTSTRAP", ("REMOVE_BAD", 1)),
        ([replica(0), replica(1)], [0, 1], 1, "BOOTSTRAP", ("SHRINK", 1)),
        ([replica(0), replica(1)], [0, 1], 0, "RAFT_RECONFIG", ("SHRINK", 2)),
        ([replica(0), replica(1)], [0, 1], 1, "RAFT_RECONFIG", ("WAIT", 0)),
        ([replica(0), replica(1, kind="NON_MEMBER")], [0, 1], 1, "RAFT_RECONFIG", ("REMOVE_VICTIM", 1)),
        ([replica(0)], [0], 1, "RAFT_RECONFIG", ("CLEANUP", 0)),
    ],
)
def test_group_action(spark, replicas, members, target, mode, expected):
    group = spark.createDataFrame([(1, 0, m, i, target, mode) for i, m in enumerate(members)], MEMBERS)
    row = control.group_action(group, spark.createDataFrame(replicas, REPLICAS)).first()
    assert (row.action, row.n) == expected


def test_victim_is_the_first_bad_or_unknown(spark):
    group = spark.createDataFrame([(1, 0, m, i, 3, "BOOTSTRAP") for i, m in enumerate([4, 7, 2])], MEMBERS)
    some = spark.createDataFrame([replica(4), replica(2, phase="LOST")], REPLICAS)
    assert control.remove_victim(group, some).first().replica_seq == 7


def test_greedy_placement_matches_a_plain_loop(spark, nodes):
    loads = control.node_loads(nodes, spark.createDataFrame([replica(0, node=1), replica(1, node=1)], REPLICAS))
    got = [(r.shard_index, r.pick, r.node_id) for r in control.place_greedily(loads, 2, 2).orderBy("shard_index", "pick").collect()]
    # n1 and n3 share a data centre; n2 is alone in its own
    assert got == [(0, 0, "n2"), (0, 1, "n3"), (1, 0, "n2"), (1, 1, "n3")]


def test_too_few_nodes_place_nothing(spark, nodes):
    loads = control.node_loads(nodes, spark.createDataFrame([], REPLICAS))
    assert control.place_greedily(loads, 1, 4).count() == 0


def test_alter_decisions(spark):
    data = [(1, "NORMAL", 3, 3), (2, "NORMAL", 3, 5), (3, "ALTERING", 5, 5), (4, "ALTERING", 5, 6), (5, "DELETED", 1, 2), (6, "ADDING", 1, 2)]
    out = catalog.alter_replica_count(spark.createDataFrame(data, "table_id long, state string, replica_count int, new_count int"))
    assert [(r.status, r.next_state) for r in out.orderBy("table_id").collect()] == [
        ("OK", "NORMAL"), ("OK", "ALTERING"), ("OK", "ALTERING"), ("INVALID_ARGUMENT", "ALTERING"), ("TABLE_NOT_FOUND", "DELETED"), ("INVALID_ARGUMENT", "ADDING"),
    ]


def test_histogram(spark):
    samples = spark.createDataFrame([("m", 100), ("m", 300)], "metric string, latency_us long")
    found = {r.le: r.cum for r in metrics.histogram(samples).collect()}
    assert (found[75], found[100], found[250], found[500], found[None]) == (0, 1, 1, 2, 2)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 101])
def test_percentile_rank(spark, n):
    row = metrics.summary(spark.range(n).selectExpr("'m' as metric", "id * 10 as latency_us")).first()
    for p in (50, 95, 99):
        assert row[f"p{p}_us"] == (p * (n - 1) + 99) // 100 * 10


def test_report_clamps_resets_and_skips_errors(spark):
    data = [("a", 1, "m", 5, None), ("a", 3, "m", 9, None), ("a", 4, "m", 99, "down"), ("b", 1, "m", 5, None), ("b", 2, "m", 1, None), ("c", 1, "m", 5, None)]
    scrapes = spark.createDataFrame(data, "target string, ts long, name string, value long, error string")
    assert [tuple(r) for r in metrics.report(scrapes).collect()] == [("a", "m", 4, 2.0)]


def test_parse_ignores_what_is_not_a_sample(spark):
    lines = ["# HELP x", "", "x_total 5", 'h_latency_us_bucket{le="+Inf"} 2', "h_latency_us_count 2", "broken", "h_bucket 3"]
    got = metrics.parse(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert sorted((r.name, r.kind, r.le or "", r.value) for r in got) == [("h", "bucket", "+Inf", 2.0), ("h", "count", "", 2.0), ("x", "counter", "", 5.0)]


def test_workload_values(spark):
    rows = workload.requests(spark, 4, 2, 30, 0).orderBy("request_id").collect()
    assert [r.k for r in rows] == ["bench-key-000000000000", "bench-key-000000000001"] * 2
    assert workload.dataset(spark, 2, "p").orderBy("k").collect()[1] == ("p-key-001", "p-value-001")
