"""Catalog decisions: databases, tables and their life cycle, as status columns over requests.

Tables: table_id, db_id, table_name, shard_count, replica_count, state. States: ADDING, NORMAL, ALTERING, DROPPING, DELETED,
FAILED. A rejected request is a row with a status, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def create_dbs(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """db_name, status, db_id: new names get the next ids in their order; existing (db_name, db_id) keep theirs.

    Databases are few, so new names are numbered in one window.
    """
    wanted = requests.select("db_name").distinct().join(existing, "db_name", "left")
    number = F.row_number().over(Window.orderBy("db_name"))
    top = existing.agg(F.coalesce(F.max("db_id") + 1, F.lit(0))).scalar()
    new = wanted.where("db_id is null and db_name <> ''").select("db_name", F.lit("OK").alias("status"), (top + number - 1).cast("long").alias("db_id"))
    old = wanted.where("db_id is not null").select("db_name", F.lit("ALREADY_EXIST").alias("status"), F.col("db_id").cast("long").alias("db_id"))
    return new.unionByName(old).unionByName(wanted.where("db_name = ''").select("db_name", F.lit("INVALID_ARGUMENT").alias("status"), F.lit(None).cast("long").alias("db_id")))


def droppable_dbs(tables: DataFrame) -> DataFrame:
    """db_id, droppable: only when every table is DELETED."""
    return tables.groupBy("db_id").agg(F.bool_and(F.col("state") == "DELETED").alias("droppable"))


def live(tables: DataFrame) -> DataFrame:
    return tables.where("state <> 'DELETED'")


def create_tables(requests: DataFrame, dbs: DataFrame, tables: DataFrame) -> DataFrame:
    """requests (req_id, db_id, table_name, shard_count, replica_count) with status. Of several for one new name, the first by req_id is taken."""
    known = dbs.select("db_id").distinct().withColumn("has_db", F.lit(True))
    names = live(tables).select("db_id", "table_name").distinct().withColumn("taken", F.lit(True))
    valid = (F.col("table_name") != "") & (F.col("shard_count") > 0) & (F.col("replica_count") >= 0)
    status = F.when(~valid, "INVALID_ARGUMENT").when(F.col("has_db").isNull(), "DB_NOT_FOUND").when(F.col("taken"), "ALREADY_EXIST").otherwise("OK")
    decided = requests.join(known, "db_id", "left").join(names, ["db_id", "table_name"], "left").select("req_id", "db_id", "table_name", status.alias("status"))
    first = decided.where("status = 'OK'").groupBy("db_id", "table_name").agg(F.min("req_id").alias("first"))
    late = (F.col("status") == "OK") & (F.col("req_id") != F.col("first"))
    return decided.join(first, ["db_id", "table_name"], "left").select("req_id", "db_id", "table_name", F.when(late, "ALREADY_EXIST").otherwise(F.col("status")).alias("status"))


def by_state(tables: DataFrame, *states: str) -> DataFrame:
    return tables.where(F.col("state").isin(*states))


def set_states(tables: DataFrame, requests: DataFrame) -> DataFrame:
    """table_id, status, next_state of requests (table_id, state); a table's return from DELETED fails if its name is taken by then."""
    live_names = live(tables).select("db_id", "table_name", F.col("table_id").alias("holder"))
    known = requests.withColumnRenamed("state", "wanted").join(tables.select("table_id", "db_id", "table_name", F.col("state").alias("now")), "table_id", "left")
    holders = known.join(live_names, ["db_id", "table_name"], "left").withColumn("taken", (F.col("holder") != F.col("table_id")) & (F.col("wanted") != "DELETED"))
    one = holders.groupBy("table_id", "wanted", "now").agg(F.coalesce(F.bool_or("taken"), F.lit(False)).alias("taken"))
    status = F.when(F.col("now").isNull(), "TABLE_NOT_FOUND").when(F.col("taken"), "ALREADY_EXIST").otherwise("OK")
    return one.select("table_id", status.alias("status"), F.when(status == "OK", F.col("wanted")).otherwise(F.col("now")).alias("next_state"))


def alter_replica_count(requests: DataFrame) -> DataFrame:
    """table_id, status, next_state for requests with state, replica_count and new_count. A change under way may be asked for again."""
    same = F.col("replica_count") == F.col("new_count")
    state = F.col("state")
    status = (
        F.when(state == "DELETED", "TABLE_NOT_FOUND").when((state == "ALTERING") & ~same, "INVALID_ARGUMENT")
        .when(state.isin("ALTERING", "NORMAL"), "OK").otherwise("INVALID_ARGUMENT")
    )
    return requests.select("table_id", status.alias("status"), F.when((state == "NORMAL") & ~same, "ALTERING").otherwise(state).alias("next_state"))


def drop_tables(tables: DataFrame) -> DataFrame:
    """table_id, status, next_state of a drop: only of NORMAL tables, and again of those being dropped."""
    state = F.col("state")
    status = F.when(state.isin("DROPPING", "NORMAL"), "OK").when(state == "DELETED", "TABLE_NOT_FOUND").otherwise("INVALID_ARGUMENT")
    return tables.select("table_id", status.alias("status"), F.when(state == "NORMAL", "DROPPING").otherwise(state).alias("next_state"))


def list_tables(tables: DataFrame, db_id: Column | int | None = None) -> DataFrame:
    found = live(tables)
    return found if db_id is None else found.where(F.col("db_id") == db_id)


def duplicate_names(tables: DataFrame) -> DataFrame:
    """db_id, table_name, n of live names that occur more than once."""
    return live(tables).groupBy("db_id", "table_name").agg(F.count("*").alias("n")).where("n > 1")


#: For each state under way: the phase that ends it, the phase that it waits in, and what a missing table means.
_POLICY = {"ADDING": ("READY", "CREATING", "RESUBMIT", "NORMAL"), "DROPPING": ("DELETED", "DELETING", "DONE", "DELETED"), "ALTERING": ("READY", "RESIZING", "FAILED", "NORMAL")}


def reconcile(tables: DataFrame, placement: DataFrame) -> DataFrame:
    """table_id, state, action, next_state of tables under way; placement: table_id, phase, rpc_status, missing if unknown there."""
    rows = tables.where(F.col("state").isin(*_POLICY)).join(placement, "table_id", "left")
    action = next_state = None
    for state, (done, wait, missing, after) in _POLICY.items():
        one = (
            F.when(F.col("rpc_status").isNull(), missing).when(F.col("rpc_status") != "OK", "ERROR").when(F.col("phase") == done, "DONE")
            .when(F.col("phase") == "FAILED", "FAILED").when(F.col("phase") == wait, "WAIT").otherwise("RESUBMIT")
        )
        here = F.col("state") == state
        action = F.when(here, one) if action is None else action.when(here, one)
        then = F.lit(after)
        next_state = F.when(here, then) if next_state is None else next_state.when(here, then)
    decided = rows.select("table_id", "state", action.alias("action"), next_state.alias("after"))
    moved = F.when(F.col("action") == "DONE", F.col("after")).when(F.col("action") == "FAILED", "FAILED").otherwise(F.col("state"))
    return decided.select("table_id", "state", "action", moved.alias("next_state"))
