"""Control plane: nodes, replicas, groups, heartbeats, routes and placement, as joins and aggregates over whole tables.

Replicas: table_id, shard_index, replica_seq, node_no, desired, phase, role, member_type, storage_status, observed_no_exist,
term. Group members: table_id, shard_index, replica_seq, pos, target_replica_count, mode. Nodes: node_no, node_id,
resource_pool, dc, status, heartbeat_age_ms.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = ["table_id", "shard_index"]
REPLICA = [*SHARD, "replica_seq"]


def shard_text() -> Column:
    return F.concat_ws(":", *SHARD)


def replica_text() -> Column:
    return F.concat_ws(":", *REPLICA)


def pool_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("resource_pool").agg(F.count("*").alias("n"), F.min("node_id").alias("first_id"), F.max("node_id").alias("last_id"))


def shard_replicas(replicas: DataFrame) -> DataFrame:
    return replicas.groupBy(*SHARD).agg(F.count("*").alias("n"), F.min("replica_seq").alias("first_seq"), F.max("replica_seq").alias("last_seq"))


def table_names(tables: DataFrame) -> DataFrame:
    """db_id, table_name and table_id of the tables that are there: what names are looked up in."""
    return tables.where("state <> 'DELETED'").groupBy("db_id", "table_name").agg(F.min("table_id").alias("table_id"))


def node_replicas(replicas: DataFrame) -> DataFrame:
    """Replicas of each node: how many, and of how many tables."""
    return replicas.groupBy("node_no").agg(F.count("*").alias("n"), F.count_distinct("table_id").alias("tables"))


def apply_heartbeat(replicas: DataFrame, reports: DataFrame) -> DataFrame:
    """The reported replicas that are assigned to the node that reports them, with what it says."""
    said = reports.select(*REPLICA, "node_no", "role", "storage_status", "term")
    return replicas.select(*REPLICA, "node_no").join(said, [*REPLICA, "node_no"])


def merge_heartbeat(replicas: DataFrame, reports: DataFrame) -> DataFrame:
    """replicas after reports: role, storage_status and term as the replica's own node says, and whether it no longer has it."""
    said = reports.select(*REPLICA, "node_no", F.col("role").alias("role1"), F.col("storage_status").alias("status1"), F.col("term").alias("term1"), F.lit(True).alias("said"))
    gone = (F.col("desired") == "ABSENT") & (F.col("phase") == "DELETING") & F.col("said").isNull()
    return replicas.join(said, [*REPLICA, "node_no"], "left").select(
        *REPLICA, "node_no", F.coalesce("role1", "role").alias("role"), F.coalesce("status1", "storage_status").alias("storage_status"),
        F.coalesce("term1", "term").alias("term"), F.when(gone, 1).otherwise(F.col("observed_no_exist")).alias("observed_no_exist"),
    )


def heartbeat_result(replicas: DataFrame, members: DataFrame, reports: DataFrame) -> DataFrame:
    """All that nodes are told: heartbeat_diff, and reconfigurations for leaders; members go with what is to be created or added."""
    diff = heartbeat_diff(replicas, members, reports)
    commands = reconfig_commands(members, replicas).withColumnRenamed("command", "expected").select(*diff.columns)
    listed = shard_members(members, replicas)
    told = diff.unionByName(commands).join(listed, SHARD, "left")
    return told.withColumn("members", F.when(F.col("expected").isin("PRESENT", "ADD_MEMBER"), F.col("members")))


def apply_expected(expected: DataFrame, local: DataFrame) -> DataFrame:
    """What a node does with what it is told: expected (node_no, a replica, expected, listed) with call, leader_seq and status.

    local: the replicas that nodes hold, with role. listed: whether the replica is among the members sent along.
    """
    leaders = local.where("role = 'LEADER'").groupBy("node_no", *SHARD).agg(F.min("replica_seq").alias("leader_seq"))
    rows = expected.join(leaders, ["node_no", *SHARD], "left")
    kind, lead = F.col("expected"), F.col("leader_seq").isNotNull()
    change = kind.isin("ADD_MEMBER", "REMOVE_MEMBER")
    status = (
        F.when(~change & ~kind.isin("PRESENT", "ABSENT"), "ERROR").when((kind == "ADD_MEMBER") & ~F.coalesce("listed", F.lit(False)), "INVALID_ARGUMENT")
        .when(change & ~lead, "NOT_LEADER").otherwise("OK")
    )
    call = F.when(kind == "PRESENT", "create_replica").when(kind == "ABSENT", "delete_replica").when(kind == "ADD_MEMBER", "add_member").when(kind == "REMOVE_MEMBER", "remove_member")
    done = F.col("status") == "OK"
    return rows.withColumn("status", status).select("node_no", *REPLICA, "status", F.when(done, call).alias("call"), F.when(done & change, F.col("leader_seq")).alias("leader_seq"))


def gone_replicas(replicas: DataFrame, reports: DataFrame) -> DataFrame:
    """Replicas being deleted that their node no longer reports."""
    waiting = replicas.where("desired = 'ABSENT' and phase = 'DELETING'")
    return waiting.join(reports.select(*REPLICA, "node_no"), [*REPLICA, "node_no"], "left_anti").select(*REPLICA, "node_no")


def heartbeat_diff(replicas: DataFrame, members: DataFrame, reports: DataFrame) -> DataFrame:
    """What each node is told: PRESENT for members that it should hold but does not report, ABSENT for the reverse."""
    wanted = members.select(*REPLICA)
    said = reports.select(*REPLICA, "node_no")
    lacking = replicas.select(*REPLICA, "node_no").join(wanted, REPLICA, "left_semi").join(said, [*REPLICA, "node_no"], "left_anti")
    extra = said.join(wanted, REPLICA, "left_anti")
    return lacking.withColumn("expected", F.lit("PRESENT")).unionByName(extra.withColumn("expected", F.lit("ABSENT")))


def project_membership(members: DataFrame, leaders: DataFrame, reported: DataFrame) -> DataFrame:
    """Member type of each desired member, as the accepted leader of its shard reports it; NON_MEMBER if it does not.

    leaders: reports of leaders; the largest term is accepted, then the smallest replica_seq. reported: what is listed,
    of which the first entry (smallest pos) for a replica counts. Shards without a leader's report are left out.
    """
    accepted = leaders.groupBy(*SHARD).agg(F.max_by(F.struct("replica_seq", "term"), F.struct("term", -F.col("replica_seq"))).alias("l"))
    first = reported.groupBy(*REPLICA).agg(F.min_by("member_type", "pos").alias("member_type"))
    joined = members.select(*REPLICA).join(accepted, SHARD).join(first, REPLICA, "left")
    return joined.select(*REPLICA, F.coalesce("member_type", F.lit("NON_MEMBER")).alias("member_type"), F.col("l.term").alias("term"))


def node_liveness(age_ms: Column, status: Column, grace: bool = False, suspect_ms: int = 10_000, offline_ms: int = 30_000) -> Column:
    """The next status of a node; within the grace after a start, none gets worse."""
    fresh = F.when(age_ms <= suspect_ms, "ONLINE")
    if grace:
        return fresh.otherwise(status)
    return fresh.when(age_ms > offline_ms, "OFFLINE").when(status == "ONLINE", "SUSPECT").otherwise(status)


def replica_phase(replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each replica's next phase from what is wanted and seen; replicas without a known node keep theirs."""
    phase, node = F.col("phase"), F.col("node_status")
    next_phase = (
        F.when(phase == "DELETED", "DELETED")
        .when(F.col("desired") == "ABSENT", F.when((phase == "DELETING") & (F.col("observed_no_exist") == 1), "DELETED").otherwise("DELETING"))
        .when(phase.isin("DELETING", "ERROR") | node.isNull(), phase)
        .when(node == "OFFLINE", "LOST")
        .when((phase == "LOST") | F.col("storage_status").isin("INITIALIZING", "RECOVERING"), "CREATING")
        .when(F.col("storage_status") == "READY", "READY")
        .otherwise("ERROR")
    )
    known = nodes.select("node_no", F.col("status").alias("node_status"))
    return replicas.join(known, "node_no", "left").select(*REPLICA, "phase", next_phase.alias("next_phase"))


def healthy() -> Column:
    return (F.col("desired") == "PRESENT") & ~F.col("phase").isin("LOST", "ERROR", "DELETING", "DELETED")


def bad() -> Column:
    return F.col("phase").isin("LOST", "ERROR")


def group_health(replicas: DataFrame) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    return replicas.groupBy(*SHARD).agg(F.count("*").alias("total"), n(healthy()).alias("healthy"), n(bad()).alias("bad"))


def _groups(members: DataFrame, replicas: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row per group: counts, the member to remove first, and the first member to add.

    groups (table_id, shard_index, target_replica_count, mode) has those without members too; else groups are what has members.
    """
    rows = members.join(replicas.withColumn("known", F.lit(True)), REPLICA, "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    first = lambda c: F.min_by("replica_seq", F.when(F.coalesce(c, F.lit(False)), F.col("pos")))
    own = F.col("known").isNull() | bad()
    ready = F.col("phase") == "READY"
    found = rows.groupBy(*SHARD).agg(
        F.first("target_replica_count").alias("target"), F.first("mode").alias("mode"), F.count("*").alias("size"),
        n(healthy()).alias("healthy"), n(bad()).alias("bad"), n(healthy() & (F.col("member_type") == "VOTER")).alias("voters"),
        first(own).alias("first_bad"), F.max_by("replica_seq", "pos").alias("last"),
        first(ready & (F.col("member_type") == "NON_MEMBER")).alias("add"),
        F.bool_and(F.coalesce(ready & (F.col("member_type") == "VOTER"), F.lit(False))).alias("all_ready"),
    )
    if groups is not None:
        known = groups.select(*SHARD, F.col("target_replica_count").alias("target"), "mode")
        found = known.join(found.drop("target", "mode"), SHARD, "left").fillna(0, ["size", "healthy", "bad", "voters"]).fillna(True, ["all_ready"])
    victim = F.coalesce("first_bad", F.when(F.col("size") > F.col("target"), F.col("last")))
    return found.withColumn("victim", victim)


def remove_victim(members: DataFrame, replicas: DataFrame) -> DataFrame:
    """The member of each group to go: the first bad or unknown one, else the last if there are too many."""
    return _groups(members, replicas).where("victim is not null").select(*SHARD, F.col("victim").alias("replica_seq"))


def shard_members(members: DataFrame, replicas: DataFrame) -> DataFrame:
    """Known members of each group in order, as replica@node; voters alone once the group is reconfigured by its log."""
    rows = members.join(replicas.select(*REPLICA, "node_no", "member_type"), REPLICA).where("mode <> 'RAFT_RECONFIG' or member_type = 'VOTER'")
    one = F.struct("pos", F.concat_ws("@", "replica_seq", "node_no").alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["m"])
    return rows.groupBy(*SHARD).agg(F.array_join(ordered, ",").alias("members"))


def reconfig_commands(members: DataFrame, replicas: DataFrame) -> DataFrame:
    """node_no, command and replica for each node that leads a group to reconfigure. Additions come before removals."""
    groups = _groups(members.where("mode = 'RAFT_RECONFIG' and target_replica_count > 0"), replicas)
    add = F.when(F.col("add").eqNullSafe(F.col("victim")), None).otherwise(F.col("add"))
    command = F.when(F.col("add").isNotNull(), "ADD_MEMBER").when((F.col("voters") >= F.col("target")) & F.col("victim").isNotNull(), "REMOVE_MEMBER")
    decided = groups.withColumn("add", add).withColumn("command", command).where("command is not null")
    leaders = members.select(*REPLICA).join(replicas.where("role = 'LEADER'").select(*REPLICA, "node_no"), REPLICA).select(*SHARD, "node_no").distinct()
    return decided.join(leaders, SHARD).select(*SHARD, "node_no", "command", F.coalesce("add", "victim").alias("replica_seq"))


def plan_groups(tables: DataFrame, members: DataFrame) -> DataFrame:
    """What to do about the group of each shard, for tables that are neither FAILED nor DELETED; DROPPING ones should vanish.

    members may be the groups themselves: a group without members exists.
    """
    groups = members.groupBy(*SHARD).agg(F.max("target_replica_count").alias("target"))
    shards = tables.where("state not in ('FAILED', 'DELETED')").withColumn("shard_index", F.explode(F.sequence(F.lit(0), F.col("shard_count") - 1)))
    rows = shards.join(groups, SHARD, "left")
    target, count = F.col("target"), F.col("replica_count")
    going = F.when(target.isNull(), "NONE").when(target != 0, "SET_ZERO").otherwise("WAIT")
    staying = F.when(target.isNull(), "CREATE").when(target != count, "SET_TARGET").otherwise("NONE")
    return rows.select(*SHARD, F.when(F.col("state") == "DROPPING", going).otherwise(staying).alias("action"))


def group_action(members: DataFrame, replicas: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The next step of each group, and how many members it concerns."""
    g = _groups(members, replicas, groups)
    kind = replicas.select(*SHARD, F.col("replica_seq").alias("victim"), F.col("member_type").alias("victim_type"))
    g = g.join(kind, [*SHARD, "victim"], "left")
    size, target, missing = F.col("size"), F.col("target"), F.col("target") - F.col("healthy")
    by_log = F.col("mode") == "RAFT_RECONFIG"
    action = (
        F.when((target == 0) & (size > 0), "SHRINK").when(target == 0, "CLEANUP").when(missing > 0, "ADD")
        .when(by_log & F.col("victim").isNotNull(), F.when(F.col("victim_type") == "NON_MEMBER", "REMOVE_VICTIM").otherwise("WAIT"))
        .when(by_log, "CLEANUP").when(F.col("bad") > 0, "REMOVE_BAD").when(size > target, "SHRINK")
        .when((size == target) & F.col("all_ready"), "SWITCH_MODE").otherwise("CLEANUP")
    )
    n = F.when(F.col("action") == "ADD", missing).when(F.col("action") == "SHRINK", size - target).when(F.col("action") == "REMOVE_BAD", F.col("bad")).when(F.col("action") == "REMOVE_VICTIM", 1).otherwise(0)
    return g.withColumn("action", action).select(*SHARD, "action", n.cast("long").alias("n"))


def cleanup(groups: DataFrame) -> DataFrame:
    """groups to be cleaned up (mode, target, size, all_ready) with next_mode: a full group of ready voters is left to its log, an emptied one starts anew."""
    full = (F.col("mode") == "BOOTSTRAP") & (F.col("size") == F.col("target")) & F.col("all_ready")
    emptied = (F.col("mode") == "RAFT_RECONFIG") & (F.col("target") == 0)
    return groups.withColumn("next_mode", F.when(full, "RAFT_RECONFIG").when(emptied, "BOOTSTRAP").otherwise(F.col("mode")))


def group_modes(members: DataFrame, replicas: DataFrame, groups: DataFrame) -> DataFrame:
    """Mode and next mode of each group that is cleaned up."""
    acted = group_action(members, replicas, groups).where("action in ('CLEANUP', 'SWITCH_MODE')").select(*SHARD)
    return cleanup(_groups(members, replicas, groups).join(acted, SHARD)).select(*SHARD, "mode", "next_mode")


def new_members(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """Replica ids for members to be added: groups (table_id, shard_index, next_seq) and counts (.., n) to table_id, shard_index, replica_seq, next_seq."""
    rows = groups.join(counts.where("n > 0"), SHARD)
    return rows.select(*SHARD, F.explode(F.sequence(F.col("next_seq"), F.col("next_seq") + F.col("n") - 1)).alias("replica_seq"), (F.col("next_seq") + F.col("n")).alias("next_seq"))


def register_nodes(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """nodes after registrations (seq, node_id, dc, resource_pool): the last one of a node holds, and it is ONLINE with a fresh heartbeat."""
    last = requests.groupBy("node_id").agg(F.max_by(F.struct("dc", "resource_pool"), "seq").alias("r"))
    both = nodes.select("node_id", F.col("dc").alias("dc0"), F.col("resource_pool").alias("pool0"), "status", "heartbeat_age_ms").join(last, "node_id", "full")
    new = F.col("r").isNotNull()
    return both.select(
        "node_id", F.when(new, F.col("r.dc")).otherwise(F.col("dc0")).alias("dc"), F.when(new, F.col("r.resource_pool")).otherwise(F.col("pool0")).alias("resource_pool"),
        F.when(new, "ONLINE").otherwise(F.col("status")).alias("status"), F.when(new, F.lit(0).cast("long")).otherwise(F.col("heartbeat_age_ms")).alias("heartbeat_age_ms"),
    )


def accept_reports(reports: DataFrame, accepted: DataFrame) -> DataFrame:
    """Leaders' reports (table_id, shard_index, replica_seq, term) with decision, against what was accepted last (.., observed_term, observed_leader)."""
    rows = reports.join(accepted, SHARD, "left")
    decision = (
        F.when(F.col("observed_term").isNull(), "NO_GROUP").when(F.col("term") > F.col("observed_term"), "ACCEPT").when(F.col("term") < F.col("observed_term"), "STALE")
        .when(F.col("replica_seq") == F.col("observed_leader"), "ACCEPT").otherwise("CONFLICT")
    )
    return rows.select(*REPLICA, "term", decision.alias("decision"))


def shrink_tail(members: DataFrame) -> DataFrame:
    """The last members of groups that are too large, as many as are too many."""
    w = Window.partitionBy(*SHARD)
    excess = F.count("*").over(w) - F.col("target_replica_count")
    back = F.row_number().over(w.orderBy(F.desc("pos")))
    return members.withColumn("excess", excess).withColumn("back", back).where("back <= excess").select(*REPLICA)


def remove_specific(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Members in order after removing some, joined by commas; empty if none is left."""
    marked = members.join(gone.select(*REPLICA).withColumn("gone", F.lit(True)), REPLICA, "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("pos", "replica_seq"))))
    return marked.groupBy(*SHARD).agg(F.array_join(F.transform(kept, lambda x: x["replica_seq"].cast("string")), ",").alias("members"))


def colocated(replicas: DataFrame) -> DataFrame:
    """Nodes that hold several replicas of one shard."""
    return replicas.groupBy("node_no", *SHARD).agg(F.count("*").alias("n")).where("n > 1")


def _entries(replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    ok = replicas.where("desired = 'PRESENT' and phase = 'READY' and member_type = 'VOTER'")
    return ok.join(nodes.where("status = 'ONLINE'").select("node_no", "node_id"), "node_no")


def route_leaders(replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """The leader of each shard that can be routed: of several, the one of the largest term; none if that is shared."""
    leaders = _entries(replicas, nodes).where("role = 'LEADER'")
    top = leaders.groupBy(*SHARD).agg(
        F.max_by(F.struct("replica_seq", "node_id"), "term").alias("l"), F.max("term").alias("term"),
        F.sort_array(F.collect_list("term"), asc=False).alias("terms"),
    )
    clear = F.coalesce(F.get("terms", F.lit(1)) != F.get("terms", F.lit(0)), F.lit(True))
    return top.where(clear).select(*SHARD, "l.replica_seq", "l.node_id", "term")


def route_entries(replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """All entries of routable shards, with place: the leader first, then followers by replica_seq, losing leaders among them."""
    lead = route_leaders(replicas, nodes).select(*SHARD, F.col("replica_seq").alias("lead"))
    rows = _entries(replicas, nodes).join(lead, SHARD)
    first = F.col("replica_seq") == F.col("lead")
    place = F.row_number().over(Window.partitionBy(*SHARD).orderBy((~first).cast("int"), "replica_seq"))
    return rows.select(*REPLICA, "node_id", F.when(first, "LEADER").otherwise("FOLLOWER").alias("role"), place.cast("long").alias("place"))


def route_keys(keys: DataFrame, tables: DataFrame, leaders: DataFrame) -> DataFrame:
    """keys (table_id, k, shard_index) with status and the leader's node."""
    found = keys.join(tables.select("table_id", F.lit(True).alias("known")), "table_id", "left").join(leaders.select(*SHARD, "node_id"), SHARD, "left")
    status = F.when(F.col("known").isNull(), "TABLE_NOT_FOUND").when(F.col("node_id").isNull(), "ROUTE_NOT_FOUND").otherwise("OK")
    return found.select("table_id", "k", "shard_index", status.alias("status"), "node_id")


def table_routes(tables: DataFrame, leaders: DataFrame) -> DataFrame:
    """table_id, routed, ready: a table's routes are given only if all of its shards have one."""
    shards = tables.withColumn("shard_index", F.explode(F.sequence(F.lit(0), F.col("shard_count") - 1)))
    rows = shards.join(leaders.select(*SHARD, F.lit(True).alias("has")), SHARD, "left")
    return rows.groupBy("table_id").agg(F.count("has").alias("routed"), F.bool_and(F.col("has").isNotNull()).alias("ready"))


def writable_routes(entries: DataFrame) -> DataFrame:
    """Route entries (table_id, shard_index, role, host, port) to leaders and status: writes need exactly one leader with an address."""
    lead = (F.col("role") == "LEADER") & (F.coalesce("host", F.lit("")) != "") & (F.coalesce("port", F.lit(0)) > 0)
    rows = entries.groupBy(*SHARD).agg(F.sum(lead.cast("long")).alias("leaders"))
    return rows.withColumn("status", F.when(F.col("leaders") == 1, "OK").otherwise("ROUTE_NOT_FOUND"))


def check_routes(tables: DataFrame, routes: DataFrame) -> DataFrame:
    """table_id, status of routes as a client gets them: tables (table_id, shard_count), routes (table_id, shard_index, replicas).

    ERROR for a negative table_id, no shards, a shard out of range, a route without replicas, or not as many routes as shards.
    """
    off = (F.col("shard_index") < 0) | (F.col("shard_index") >= F.col("shard_count")) | (F.col("replicas") <= 0)
    rows = tables.select("table_id", "shard_count").join(routes, "table_id", "left")
    found = rows.groupBy("table_id", "shard_count").agg(F.count("shard_index").alias("n"), F.coalesce(F.bool_or(off), F.lit(False)).alias("off"))
    ok = (F.col("table_id") >= 0) & (F.col("shard_count") > 0) & ~F.col("off") & (F.col("n") == F.col("shard_count"))
    return found.select("table_id", F.when(ok, "OK").otherwise("ERROR").alias("status"))


def tables_ready(tables: DataFrame, replicas: DataFrame, members: DataFrame, leaders: DataFrame) -> DataFrame:
    """table_id, ready: every shard has as many replicas and members as asked for, all of them READY voters, and a leader."""
    fine = (F.col("desired") == "PRESENT") & (F.col("phase") == "READY") & (F.col("member_type") == "VOTER")
    held = replicas.groupBy(*SHARD).agg(F.count("*").alias("n_replicas"), F.bool_and(fine).alias("fine"))
    known = members.join(replicas.where(fine).select(*REPLICA, F.lit(True).alias("ok")), REPLICA, "left")
    group = known.groupBy(*SHARD).agg(F.count("*").alias("n_members"), F.max("target_replica_count").alias("target"), F.bool_and(F.col("ok").isNotNull()).alias("members_fine"))
    shards = tables.withColumn("shard_index", F.explode(F.sequence(F.lit(0), F.col("shard_count") - 1)))
    rows = shards.join(held, SHARD, "left").join(group, SHARD, "left").join(leaders.select(*SHARD, F.lit(True).alias("lead")), SHARD, "left")
    want = F.col("replica_count")
    ok = (
        (F.coalesce("n_replicas", F.lit(0)) == want) & F.coalesce("fine", F.lit(True)) & (F.coalesce("target", F.lit(-1)) == want)
        & (F.coalesce("n_members", F.lit(0)) == want) & F.coalesce("members_fine", F.lit(True)) & ((want == 0) | F.col("lead").isNotNull())
    )
    return rows.groupBy("table_id").agg(F.bool_and(ok).alias("ready"))


def tables_deleted(tables: DataFrame, replicas: DataFrame, members: DataFrame) -> DataFrame:
    """table_id of tables without replicas or groups."""
    return tables.select("table_id").join(replicas.select("table_id"), "table_id", "left_anti").join(members.select("table_id"), "table_id", "left_anti")


def placed_table_decision(requests: DataFrame) -> DataFrame:
    """Status of drop and of a new replica count, for tables with desired, phase, operation_id; requests: new_count, new_operation."""
    drop = F.when(F.col("desired") == "ABSENT", "OK").when(F.col("phase") != "READY", "ALREADY_EXIST").otherwise("OK")
    ended = (F.col("desired") == "ABSENT") | F.col("phase").isin("DELETING", "DELETED", "FAILED")
    again = F.col("operation_id") == F.col("new_operation")
    alter = F.when(ended, "ERROR").when(again, "OK").when(F.col("phase") != "READY", "ERROR").otherwise("OK")
    moved = ~ended & ~again & (F.col("phase") == "READY") & (F.col("replica_count") != F.col("new_count"))
    return requests.select("table_id", drop.alias("drop_status"), alter.alias("alter_status"), F.when(moved, "RESIZING").otherwise(F.col("phase")).alias("next_phase"))


def place_tables(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Placement requests (req_id, table_id, operation_id) to status and phase: a new table is CREATING, the same operation again is OK.

    existing: table_id, operation_id, phase. Of several requests for one new table, the first by req_id places it.
    """
    known = existing.select("table_id", F.col("operation_id").alias("own"), "phase")
    first = requests.groupBy("table_id").agg(F.min_by("operation_id", "req_id").alias("first"))
    rows = requests.join(first, "table_id").join(known, "table_id", "left")
    same = F.coalesce("own", "first") == F.col("operation_id")
    return rows.select("req_id", "table_id", F.when(same, "OK").otherwise("ALREADY_EXIST").alias("status"), F.coalesce("phase", F.lit("CREATING")).alias("phase"))


def finalize_tables(tables: DataFrame, ready: DataFrame, deleted: DataFrame) -> DataFrame:
    """table_id, phase, next_phase: tables (table_id, desired, phase) under way are done when all their shards are; ready, deleted: as tables_ready and tables_deleted give."""
    rows = tables.join(ready, "table_id", "left").join(deleted.select("table_id", F.lit(True).alias("gone")), "table_id", "left")
    phase = F.col("phase")
    waits = (F.col("desired") == "PRESENT") & phase.isin("CREATING", "RESIZING")
    next_phase = (
        F.when(phase == "FAILED", phase).when((F.col("desired") == "ABSENT") & F.coalesce("gone", F.lit(False)), "DELETED")
        .when((F.col("desired") == "ABSENT") & (phase != "DELETED"), "DELETING").when(waits & F.coalesce("ready", F.lit(False)), "READY").otherwise(phase)
    )
    return rows.select("table_id", "phase", next_phase.alias("next_phase"))


def node_loads(nodes: DataFrame, replicas: DataFrame) -> DataFrame:
    """ONLINE nodes with the number of replicas that should be on them."""
    load = replicas.where("desired = 'PRESENT'").groupBy("node_no").agg(F.count("*").alias("load"))
    return nodes.where("status = 'ONLINE'").join(load, "node_no", "left").withColumn("load", F.coalesce("load", F.lit(0)))


def first_candidates(nodes: DataFrame, replicas: DataFrame) -> DataFrame:
    """The node of each pool that is chosen first: least load, then least id."""
    best = F.min(F.struct("load", "node_id"))
    return node_loads(nodes, replicas).groupBy("resource_pool").agg(best.alias("b"), F.count("*").alias("candidates")).select("resource_pool", "b.node_id", "b.load", "candidates")


def place_greedily(loads: DataFrame, shards: int, copies: int, excluded: tuple[str, ...] = ()) -> DataFrame:
    """resource_pool, shard_index, pick, node_id: nodes for new shards, one at a time; excluded ones are never picked.

    Each pick takes the node in the data centre least used by the shard, then the least loaded, then the least id, and
    adds to its load, so picks depend on all before them. A pool is one group of bounded size: its nodes.
    """

    def place(pool: pd.DataFrame) -> pd.DataFrame:
        out = []
        pool = pool[~pool.node_id.isin(excluded)]
        if len(pool) >= copies:
            load = dict(zip(pool.node_id, pool.load, strict=True))
            centre = dict(zip(pool.node_id, pool.dc, strict=True))
            for shard in range(shards):
                used: dict[str, int] = {}
                left = set(load)
                for pick in range(copies):
                    node = min(left, key=lambda x: (used.get(centre[x], 0), load[x], x))
                    left.remove(node)
                    used[centre[node]] = used.get(centre[node], 0) + 1
                    load[node] += 1
                    out.append((pool.resource_pool.iloc[0], shard, pick, node))
        return pd.DataFrame(out, columns=["resource_pool", "shard_index", "pick", "node_id"])

    return loads.groupBy("resource_pool").applyInPandas(place, "resource_pool string, shard_index long, pick long, node_id string")


