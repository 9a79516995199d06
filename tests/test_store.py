from __future__ import annotations

import pytest

from kvloom.api import Store
from kvloom.cli import run

WRITES = "seq long, op string, k string, v string"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", snapshot_every=5)
    assert s.create_db("d") == "OK"
    assert s.create_table("d", "t", 3, 3) == "OK"
    return s


def test_catalog_rules(store):
    assert store.create_db("d") == "ALREADY_EXIST" and store.create_db("") == "INVALID_ARGUMENT"
    assert store.create_table("d", "t") == "ALREADY_EXIST" and store.create_table("x", "t") == "DB_NOT_FOUND"
    assert store.create_table("d", "u", 0) == "INVALID_ARGUMENT"
    assert store.drop_db("d") == "INVALID_ARGUMENT" and store.drop_db("x") == "DB_NOT_FOUND"
    assert store.alter_table("d", "t", 5) == "OK" and store.list_tables("d").first().replica_count == 5
    assert store.drop_table("d", "t") == "OK" and store.drop_table("d", "t") == "TABLE_NOT_FOUND"
    assert store.drop_db("d") == "OK"


def test_put_get_delete_and_empty_values(store):
    assert store.get("d", "t", "k") == ("KEY_NOT_FOUND", None)
    store.put("d", "t", "k", "1")
    store.put("d", "t", "k", "2")
    store.put("d", "t", "", "empty key")
    assert store.get("d", "t", "k") == ("OK", "2") and store.get("d", "t", "") == ("OK", "empty key")
    store.put("d", "t", "k", "")
    assert store.get("d", "t", "k") == ("OK", "")
    store.delete("d", "t", "k")
    store.delete("d", "t", "never there")
    assert store.get("d", "t", "k") == ("KEY_NOT_FOUND", None)
    assert store.put("d", "gone", "k", "1") == store.get("d", "gone", "k")[0] == "TABLE_NOT_FOUND"


def test_batches_snapshots_and_tail(store, spark):
    state: dict = {}
    for step in range(3):
        writes = [(i, "DEL" if (i + step) % 4 == 0 else "PUT", f"k{i % 10}", f"v{step}-{i}") for i in range(25)]
        for _, op, k, v in writes:
            state.pop(k, None) if op == "DEL" else state.update({k: v})
        assert store.apply("d", "t", spark.createDataFrame(writes, WRITES)) == "OK"
        assert [(r.k, r.v) for r in store.scan("d", "t").collect()] == sorted(state.items())
        if step < 2:
            assert store.snapshot("d", "t") and not store.snapshot("d", "t")
            assert [(r.k, r.v) for r in store.scan("d", "t").collect()] == sorted(state.items())
    keys = spark.createDataFrame([("k1",), ("zz",)], "k string")
    assert {r.k: r.status for r in store.multi_get("d", "t", keys).collect()} == {"k1": "OK" if "k1" in state else "KEY_NOT_FOUND", "zz": "KEY_NOT_FOUND"}


def test_point_reads_prune_to_one_shard(store, spark):
    store.apply("d", "t", spark.createDataFrame([(i, "PUT", f"k{i}", "v") for i in range(20)], WRITES))
    _, shard = store.route("d", "t", "k3")
    log = store._log(0).where(f"shard = {shard}").where("k = 'k3'")
    assert log.count() == 1
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "PushedFilters: [IsNotNull(k), EqualTo(k,k3)]" in plan


def test_point_reads_begin_at_the_snapshot(store, spark):
    store.apply("d", "t", spark.createDataFrame([(i, "PUT", f"k{i}", f"v{i}") for i in range(20)], WRITES))
    assert store.snapshot("d", "t")
    store.delete("d", "t", "k3")
    store.put("d", "t", "k4", "new")
    assert [store.get("d", "t", k) for k in ("k3", "k4", "k5", "k99")] == [("KEY_NOT_FOUND", None), ("OK", "new"), ("OK", "v5"), ("KEY_NOT_FOUND", None)]


def test_indexes_are_dense_even_if_the_heads_were_not_noted(store, spark):
    from pyspark.sql import functions as F

    for n in range(3):
        store.apply("d", "t", spark.createDataFrame([(i * 40_000, "PUT", f"k{i}", f"{n}") for i in range(12)], WRITES))
        if n == 1:  # as after a crash between the two writes
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{store.path}/heads/table_id=0/version=2")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    found = store._log(0).groupBy("shard").agg(F.count("*").alias("n"), F.max("idx").alias("last"), F.count_distinct("idx").alias("different")).collect()
    assert all(r.n == r.last == r.different for r in found) and sum(r.n for r in found) == 36
    order = store._log(0).where("batch = 1").orderBy("shard", "idx").collect()
    assert all(int(a.k[1:]) < int(b.k[1:]) for a, b in zip(order, order[1:], strict=False) if a.shard == b.shard)


def test_routes_waiting_and_demo(store):
    out = list(run(store, ["routes d t", "wait_table d t", "wait_table d x", "routes d x", "demo", "ls d"]))
    assert out[0] == "shard 0: leader local, last index 0\nshard 1: leader local, last index 0\nshard 2: leader local, last index 0"
    assert out[1:4] == ["OK", "TABLE_NOT_FOUND", "TABLE_NOT_FOUND"] and out[-1] == "t"
    assert out[7] == "get demo t k: v" and out[10] == "get demo t k: KEY_NOT_FOUND" and out[12] == "drop_db demo: OK"


def test_shell(store):
    lines = ["put d t a 1", "get d t a", "get d t b", "delete d t a", "get d t a", "tables d", "get_table d t", "nonsense", "put d", "", "quit", "put d t z 1"]
    out = list(run(store, lines))
    assert out[:3] == ["OK", "1", "KEY_NOT_FOUND"] and out[4:7] == ["KEY_NOT_FOUND", "t", "t: shards 3, replicas 3, NORMAL"]
    assert out[7] == "unknown command: nonsense" and out[8].startswith("INVALID_ARGUMENT") and len(out) == 10
