"""Key-value state as a fold of the op log: the last PUT or DEL of a key wins, and DEL leaves nothing behind.

A log has idx (from 1, dense), term, op (PUT, DEL, NONE or a configuration change), k and v. Folds aggregate with max_by, which
combines before the shuffle, so a hot key costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDED = ("PUT", "DEL")


def latest(log: DataFrame, upto: Column | int | None = None) -> DataFrame:
    """k, op, v, idx of each key's last PUT or DEL, no further than upto."""
    rows = log.where(F.col("op").isin(*FOLDED))
    if upto is not None:
        rows = rows.where(F.col("idx") <= upto)
    last = F.max_by(F.struct("op", "v"), "idx")
    return rows.groupBy("k").agg(last.alias("last"), F.max("idx").alias("idx")).select("k", "last.op", "last.v", "idx")


def fold(log: DataFrame, upto: Column | int | None = None) -> DataFrame:
    """k, v, idx: the state that the log leaves."""
    return latest(log, upto).where("op = 'PUT'").select("k", "v", "idx")


def tombstones(log: DataFrame, upto: Column | int | None = None) -> DataFrame:
    """k, idx of the keys whose last op is DEL."""
    return latest(log, upto).where("op = 'DEL'").select("k", "idx")


def point_get(log: DataFrame, key: str, read_index: Column | int | None = None) -> DataFrame:
    """One row: k, status, v. The filter on the key reaches the scan."""
    found = fold(log.where(F.col("k") == key), read_index)
    return get(found, log.sparkSession.createDataFrame([(key,)], "k string"))


def get(state: DataFrame, requests: DataFrame) -> DataFrame:
    """k, status, v of each requested key: OK, or KEY_NOT_FOUND with a null value."""
    held = state.select("k", "v", F.lit(True).alias("held"))
    return requests.join(held, "k", "left").select("k", F.when(F.col("held"), "OK").otherwise("KEY_NOT_FOUND").alias("status"), "v")


def clear(state: DataFrame) -> DataFrame:
    """No rows."""
    return state.where(F.lit(False))


def scan_until(state: DataFrame, accepts: Column) -> DataFrame:
    """Rows in key order before the first one that is not accepted."""
    stop = state.where(~F.coalesce(accepts, F.lit(False))).agg(F.min("k")).scalar()
    return scan(state.where(stop.isNull() | (F.col("k") < stop)))


def delete(state: DataFrame, keys: DataFrame) -> DataFrame:
    """State without keys; keys that are not there do not matter."""
    return state.join(keys.select("k"), "k", "left_anti")


def scan(state: DataFrame) -> DataFrame:
    """All rows, in key order."""
    return state.select("k", "v").orderBy("k")


def normalise_status(rows: DataFrame, status: str = "status") -> DataFrame:
    """What a client shows, and whether it asks for the route anew and tries once more."""
    shown = F.when(F.col(status) == "NOT_YET_COMMIT", "UNKNOWN").otherwise(F.col(status))
    return rows.select("*", shown.alias("surfaced"), F.col(status).isin("NOT_LEADER", "REPLICA_NOT_FOUND", "ROUTE_NOT_FOUND").alias("retry"))


def op_counts(log: DataFrame) -> DataFrame:
    """n and last idx of each op: the applied index is the largest over all ops, those that change nothing too."""
    return log.groupBy("op").agg(F.count("*").alias("n"), F.max("idx").alias("last_idx"))


def merge(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """State of a snapshot (k, v, idx) with the log after it folded in."""
    ahead = snapshot.select("idx", F.lit("PUT").alias("op"), "k", "v")
    return fold(ahead.unionByName(tail.select("idx", "op", "k", "v")))


def write_snapshot(log: DataFrame, index: Column | int, path: str) -> None:
    """State at index, clustered by key."""
    fold(log, index).repartitionByRange("k").sortWithinPartitions("k").write.parquet(path)


def read_snapshot(like: DataFrame, path: str) -> DataFrame:
    return like.sparkSession.read.parquet(path).select("k", "v", "idx")


def snapshots_due(applied: DataFrame, every: int = 1000) -> DataFrame:
    """applied: applied_index and snapshot_index of each replica or shard; adds behind and due."""
    behind = F.col("applied_index") - F.col("snapshot_index")
    return applied.select("*", behind.alias("behind"), (behind >= every).alias("due"))
