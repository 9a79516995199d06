from __future__ import annotations

import json
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from kvloom import exporter
from kvloom.config import Config
from kvloom.operators import control, oplog, quorum, workload
from kvloom.sources.metadata import MetadataStore

TABLES = {"t": ("k long, v string", ["k"]), "u": ("a int, b int, x string", ["a", "b"])}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_metadata_commits_are_whole(spark, tmp_path):
    store = MetadataStore(spark, f"file://{tmp_path}/m", TABLES)
    assert store.versions() == [] and rows(store.read("t")) == []
    with store.write() as c:
        c.put("t", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
        c.put("u", spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "a int, b int, x string"))
    with pytest.raises(ValueError), store.write() as c:
        c.clear("t")
        raise ValueError
    with store.write() as c:
        c.put("t", spark.createDataFrame([(2, "B", 0), (3, "c", 0)], "k int, v string, more int"))
        assert rows(c.read("t")) == [(1, "a"), (2, "B"), (3, "c")]
        c.remove("t", spark.createDataFrame([(1,), (9,)], "k long"))
    again = MetadataStore(spark, f"file://{tmp_path}/m", TABLES)
    assert again.versions() == [1, 2]
    assert rows(again.read("t")) == [(2, "B"), (3, "c")] and rows(again.read("t", 1)) == [(1, "a"), (2, "b")]
    assert rows(again.get("u", spark.createDataFrame([(1,)], "a int"))) == [(1, 1, "x"), (1, 2, "y")]


def test_metadata_partial_keys_empty_blocks_and_vacuum(spark, tmp_path):
    store = MetadataStore(spark, f"file://{tmp_path}/m", TABLES)
    with store.write():
        pass
    assert store.versions() == []
    for i in range(4):
        with store.write() as c:
            c.put("t", spark.createDataFrame([(i, str(i))], "k long, v string"))
            if i == 0:
                c.put("u", spark.createDataFrame([(1, 1, "x"), (1, 2, None), (2, 1, "z")], "a int, b int, x string"))
    with store.write() as c:
        c.remove("u", spark.createDataFrame([(1,)], "a int"))
    assert store.vacuum(2) == 3 and store.versions() == [4, 5]
    assert rows(store.read("u")) == [(2, 1, "z")] and rows(store.read("t")) == [(i, str(i)) for i in range(4)]
    assert len(rows(store.read("u", 4))) == 3


def test_settings(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text(json.dumps({"server": {"port": 9000, "name": "n", "on": True, "rate": 0.5}}))
    c = Config.load(p)
    assert c.get("server.port") == 9000 and c.get("server.port", 1) == 9000 and c.get("server.none", 7) == 7
    assert c.get("server.name", 5) == 5 and c.get("server.port", "x") == "9000" and c.get("server.on", 3) == 3 and c.get("server.port.deep", 2) == 2
    for name in ("none", "server.none", "server.port.deep"):
        with pytest.raises(KeyError):
            c.get(name)
    assert Config().get("a.b", None) is None


def test_metrics_over_http():
    server = exporter.serve(lambda: ["# TYPE a_total counter", "a_total 3"])
    at = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert urllib.request.urlopen(f"{at}/metrics").read() == b"# TYPE a_total counter\na_total 3\n"
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{at}/other")
    finally:
        server.shutdown()


def test_result_files(spark, tmp_path):
    samples = spark.createDataFrame([(10, 1), (30, 0), (20, 1)], "latency_us long, ok int")
    found = workload.run_summary(samples, 2.0)
    workload.write_json(found, f"{tmp_path}/j")
    workload.write_csv(found, f"{tmp_path}/c")
    assert rows(workload.read_json(spark, f"{tmp_path}/j", found)) == rows(workload.read_csv(spark, f"{tmp_path}/c", found)) == rows(found)
    one = json.loads(next((tmp_path / "j").glob("part*")).read_text())
    assert one["latency_us"] == {"count": 3, "min": 10, "avg": 20.0, "p50": 20, "p95": 30, "p99": 30, "max": 30} and one["failure"] == 1


def test_chunks_of_sessions(spark):
    sent = [(0, "a", 100, 5), (1, "a", 0, 5), (2, "a", 5, 5), (3, "b", 10, 5), (4, "a", 5, 5), (5, "a", 10, 1), (6, "b", 0, 2), (7, "a", 11, 5), (8, "b", 2, 2)]
    chunks = spark.createDataFrame([("r", *x) for x in sent], "r string, no int, sender string, offset long, size long")
    assert rows(oplog.receive_chunks(chunks, ["r"], "no", ["sender"])) == [("r", 1, 5, 3, 11), ("r", 2, 3, 2, 4)]


def test_proposals_across_blocks(spark):
    p = spark.createDataFrame([(i, "WRITE", "PUT" if i % 3 else "GET") for i in range(20)] + [(20, None, None), (21, "CONFIG", "PUT")], "seq long, kind string, op string")
    expected, n = [], 100
    for i in range(22):
        ok = i % 3 != 0 and i < 20
        n += ok
        expected.append((i, n if ok else -1, "OK" if ok else "INVALID_ARGUMENT"))
    assert rows(oplog.propose(p, F.lit(100), block=4).select("seq", "idx", "status")) == expected
    assert {r.status for r in oplog.propose(p, F.lit(0), leader=False).collect()} == {"NOT_LEADER"}
    assert {(r.status, r.idx) for r in oplog.propose(p, F.lit(0), voter=False).collect()} == {("NOT_VOTER", -1)}


def test_reads_need_a_quorum_of_answers(spark):
    log = spark.createDataFrame([(1, 1), (2, 2)], "idx long, term long")
    progress = spark.createDataFrame([("s", i, 2, "VOTER", int(i == 0)) for i in range(3)], "scenario string, replica_seq int, match_index long, member_type string, is_self int")
    for terms, status in (([2, None], "OK"), ([None, None], "NOT_LEADER"), ([2, 3], "NOT_LEADER"), ([2, 1], "OK")):
        answers = spark.createDataFrame([("s", i + 1, x) for i, x in enumerate(terms)], "scenario string, replica_seq int, term long")
        assert rows(quorum.read_confirmed(log, progress, answers)) == [("s", status, 2 if status == "OK" else None)]
    none = spark.createDataFrame([], "scenario string, replica_seq int, term long")
    assert rows(quorum.read_confirmed(log, progress, none)) == [("s", "NOT_LEADER", None)]
    assert rows(quorum.read_confirmed(log, progress, none, leader=False)) == [("s", "NOT_LEADER", None)]


def test_routes_without_rows(spark):
    tables = spark.createDataFrame([(1, 1), (2, 0)], "table_id long, shard_count int")
    routes = spark.createDataFrame([(1, 0, 3)], "table_id long, shard_index int, replicas long")
    assert rows(control.check_routes(tables, routes)) == [(1, "OK"), (2, "ERROR")]
    assert rows(control.check_routes(tables, routes.limit(0))) == [(1, "ERROR"), (2, "ERROR")]
