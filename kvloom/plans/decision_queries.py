"""Queries over single decisions: changes of members, answers to requests, placement, catalog states, and the whole report."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvloom.operators import catalog, control, metrics, oplog, quorum, state
from kvloom.plans.control_queries import _BOUNDS, _HEALTHY, _SAME, _hist
from kvloom.plans.log_queries import _HALF, _LATEST, _MEMBERS, _N, share
from kvloom.plans.registry import query
from kvloom.sources.fixtures import Inputs


@query("config_statuses", """
    with o as (select *, list(op) over (partition by replica_seq order by idx rows between unbounded preceding and 1 preceding) as past from config_log)
    select idx, replica_seq, op, case when op = 'PROMOTE_VOTER' and coalesce(list_filter(past, lambda x: x <> 'PROMOTE_VOTER')[-1], 'NONE') <> 'ADD_LEARNER' then 'INVALID_ARGUMENT' else 'OK' end as status from o""")
def config_statuses(t: Inputs):
    return quorum.config_statuses(t.config_log)


@query("pending_member_removal", f"""
    with p as (select op, replica_seq from config_log where idx > {_HALF} order by idx limit 1), m as {_MEMBERS.format(where=f" where idx <= {_HALF}")}
    select s.s_suppkey as replica_seq, case when m.replica_seq is null then 'OK_GONE' when (select op from p) = 'REMOVE_MEMBER' and (select replica_seq from p) = s.s_suppkey then 'OK_PENDING'
           when (select op from p) is not null then 'RETRY_ERROR' else 'PROPOSE' end as decision
    from supplier s left join m on m.replica_seq = s.s_suppkey""")
def pending_member_removal(t: Inputs):
    half = t.config_log.agg(F.expr("max(idx) div 2")).scalar()
    return quorum.remove_member(t.config_log, t.supplier.select(F.col("s_suppkey").alias("replica_seq")), half)


@query("commit_removal", "select s_suppkey as step, 6 * s_suppkey as old_commit, 6 * s_suppkey + 2 + s_suppkey % 5 as new_commit, exists (select 1 from config_log c where c.op = 'REMOVE_MEMBER' and c.idx > 6 * s_suppkey and c.idx <= 6 * s_suppkey + 2 + s_suppkey % 5) as removal from supplier")
def commit_removal(t: Inputs):
    return quorum.commits_removal(t.config_log, t.supplier.selectExpr("s_suppkey as step", "6 * s_suppkey as old_commit", "6 * s_suppkey + 2 + s_suppkey % 5 as new_commit"))


@query("append_response", """
    select table_id, shard_index, replica_seq, case when term > 4 then 'STEP_DOWN' when table_id % 5 = 0 then 'IGNORE_OLD_TERM' when role <> 'LEADER' and table_id % 3 = 0 then 'NOT_LEADER'
           when phase = 'READY' then 'ADVANCE' when replica_seq = 2 then 'IGNORE_STALE' else 'BACK_OFF' end as action from replicas""")
def append_response(t: Inputs):
    responses = t.replicas.selectExpr(
        "table_id", "shard_index", "replica_seq", "term", "if(table_id % 5 = 0, 3, 4) as sent_term", "role = 'LEADER' or table_id % 3 <> 0 as leader", "phase = 'READY' as success",
        "table_id as prev_log_index", "table_id + if(replica_seq = 2, 5, 1) as next_index",
    )
    return quorum.append_response(responses, 4).select("table_id", "shard_index", "replica_seq", "action")


_AT = f"((table_id * 17 + replica_seq * 29) % ({_N} + 40))"


@query("install_snapshot_decision", f"""
    with r as (select table_id, shard_index, replica_seq, member_type, term, {_AT} as p, 1 + replica_seq * 4 as pt from replicas)
    select table_id, shard_index, replica_seq, case when member_type = 'NON_MEMBER' then 'INVALID_ARGUMENT' when r.term < 2 then 'ERROR' when p <= {_N} * 30 // 100 or coalesce(l.term, 0) = pt then 'ALREADY_EXIST' else 'OK' end as decision
    from r left join op_log l on l.idx = r.p""")
def install_snapshot_decision(t: Inputs):
    at = (F.col("table_id") * 17 + F.col("replica_seq") * 29) % (oplog.last_index(t.op_log) + 40)
    requests = t.replicas.select("table_id", "shard_index", "replica_seq", (F.col("member_type") != "NON_MEMBER").alias("member"), "term", at.alias("snapshot_index"), (1 + F.col("replica_seq") * 4).alias("snapshot_term"))
    return quorum.install_decision(requests, t.op_log, 2, share(t.op_log, 30)).select("table_id", "shard_index", "replica_seq", "decision")


@query("applied_index", f"select scenario, replica_seq, greatest(match_index // 3, match_index // 2, {_N} // 4)::bigint as new_applied, greatest(match_index, {_N} // 4)::bigint as new_commit from progress")
def applied_index(t: Inputs):
    rows = t.progress.select("scenario", "replica_seq", F.expr("match_index div 3").alias("last_applied"), F.expr("match_index div 2").alias("applied"), F.col("match_index").alias("commit_index"), share(t.op_log, 25).alias("snapshot_index"))
    return quorum.applied_index(rows).select("scenario", "replica_seq", "new_applied", "new_commit")


def _leaders(t: Inputs) -> dict:
    """Leaders' entries by case: with a gap, beyond the log's end, within it, and from right after it."""
    log = t.op_log
    bump = F.when(F.col("idx") > share(log, 50), 1).otherwise(0)
    after = log.where(F.col("idx") > share(log, 40)).withColumn("term", F.col("term") + bump)
    return {
        "gap after a conflict": after.where(F.col("idx") != share(log, 70)), "gap at the end": log.where(F.col("idx") > share(log, 80)),
        "nothing new": log.where(F.col("idx") < share(log, 30)), "appended": log.where(F.col("idx") > share(log, 60)), "conflict": after,
    }


@query("log_merge_status", f"""
    with n as (select count(*) as n from op_log)
    select 'gap after a conflict' as name, 'ERROR' as status, null::bigint as first_new, false as rewrite union all select 'gap at the end', 'ERROR', null, false
    union all select 'nothing new', 'OK', null, false union all select 'appended', 'OK', n * 60 // 100 + 1, false from n union all select 'conflict', 'OK', n * 50 // 100 + 1, true from n""")
def log_merge_status(t: Inputs):
    local = t.op_log.where(F.col("idx") <= share(t.op_log, 60))
    found = [oplog.merge_status(local, leader).select(F.lit(name).alias("name"), "*") for name, leader in _leaders(t).items()]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


@query("log_gap_rejected", f"select idx, term, op, k, v, 'local' as source from op_log where idx <= {_N} * 60 // 100")
def log_gap_rejected(t: Inputs):
    return oplog.merge_from_leader(t.op_log.where(F.col("idx") <= share(t.op_log, 60)), _leaders(t)["gap after a conflict"])


@query("log_install_snapshot", f"""
    with s as (select idx as i, term as x from op_log where idx = {_N} * 80 // 100)
    select i as idx, x as term, 'SNAPSHOT' as op, null as k, null as v from s union all select idx, term, op, k, v from op_log where idx > (select i from s)""")
def log_install_snapshot(t: Inputs):
    at = share(t.op_log, 80)
    return oplog.install_snapshot(t.op_log, at, t.op_log.where(F.col("idx") == at).agg(F.max("term")).scalar())


@query("recover_damaged", f"select idx, term, op, k, v from op_log where idx > {_N} * 50 // 100 and idx < {_N} * 70 // 100")
def recover_damaged(t: Inputs):
    """A log with a damaged entry after the snapshot: what lies before it is kept. One that does not begin right after it would give nothing."""
    wal = t.op_log.where(F.col("idx") > share(t.op_log, 20)).withColumn("ok", F.col("idx") != share(t.op_log, 70))
    return oplog.recover(wal, share(t.op_log, 50)).drop("ok")


@query("kv_clear", "select k, v, idx from (select k, v, idx from op_log) where false")
def kv_clear(t: Inputs):
    return state.clear(state.fold(t.op_log))


@query("kv_scan_until", f"with s as (select k, v from {_LATEST.format(where='')} where rn = 1 and op = 'PUT') select k, v from s where k < coalesce((select min(k) from s where length(k) > 7), 'zzzz')")
def kv_scan_until(t: Inputs):
    return state.scan_until(state.fold(t.op_log), F.length("k") <= 7)


@query("catalog_create_twice", """
    select table_id as req_id, 1::int as db_id, concat('new', table_id // 3) as table_name, case when table_id % 3 = 0 or table_id = (select min(table_id) from catalog_tables) then 'OK' else 'ALREADY_EXIST' end as status from catalog_tables""")
def catalog_create_twice(t: Inputs):
    requests = t.catalog_tables.selectExpr("table_id as req_id", "1 as db_id", "concat('new', table_id div 3) as table_name", "1 as shard_count", "1 as replica_count")
    return catalog.create_tables(requests, t.region.select(F.col("r_regionkey").alias("db_id")), t.catalog_tables)


@query("catalog_by_state", "select table_id, db_id, table_name, shard_count, replica_count, state from catalog_tables where state in ('ADDING', 'DROPPING', 'ALTERING')")
def catalog_by_state(t: Inputs):
    return catalog.by_state(t.catalog_tables, "ADDING", "DROPPING", "ALTERING")


@query("catalog_set_state", """
    with c as (select *, concat('n', table_id // 2) as name from catalog_tables), r as (select table_id * 2 as table_id, case table_id % 3 when 0 then 'NORMAL' when 1 then 'DELETED' else 'FAILED' end as wanted from catalog_tables),
    j as (select r.*, c.state as now, wanted <> 'DELETED' and exists (select 1 from c o where o.state <> 'DELETED' and o.db_id = c.db_id and o.name = c.name and o.table_id <> c.table_id) as taken from r left join c on c.table_id = r.table_id)
    select table_id, case when now is null then 'TABLE_NOT_FOUND' when taken then 'ALREADY_EXIST' else 'OK' end as status, case when now is not null and not taken then wanted else now end as next_state from j""")
def catalog_set_state(t: Inputs):
    tables = t.catalog_tables.withColumn("table_name", F.expr("concat('n', table_id div 2)"))
    requests = t.catalog_tables.selectExpr("table_id * 2 as table_id", "case table_id % 3 when 0 then 'NORMAL' when 1 then 'DELETED' else 'FAILED' end as state")
    return catalog.set_states(tables, requests)


_ALL = f"""
    j as (select g.*, r.desired, r.phase, r.member_type, r.table_id is null or r.phase in ('LOST', 'ERROR') as isbad from sparse_members g left join replicas r on {_SAME.format(a='r', b='g')}),
    g as (select table_id, shard_index, count(*) as size, count(*) filter (where {_HEALTHY}) as healthy, count(*) filter (where phase in ('LOST', 'ERROR')) as bad,
                 min(case when isbad then pos end) as first_bad, max(pos) as last, bool_and(coalesce(phase = 'READY' and member_type = 'VOTER', false)) as all_ready
          from j group by table_id, shard_index),
    v as (select q.table_id, q.shard_index, q.target_replica_count as target, q.mode, coalesce(size, 0) as size, coalesce(healthy, 0) as healthy, coalesce(bad, 0) as bad, coalesce(all_ready, true) as all_ready,
                 coalesce(first_bad, case when coalesce(size, 0) > q.target_replica_count then last end) as victim
          from groups q left join g on g.table_id = q.table_id and g.shard_index = q.shard_index),
    x as (select v.*, r.member_type as vt from v left join replicas r on r.table_id = v.table_id and r.shard_index = v.shard_index and r.replica_seq = v.victim),
    a as (select *, case when target = 0 then case when size > 0 then 'SHRINK' else 'CLEANUP' end when healthy < target then 'ADD'
        when mode = 'RAFT_RECONFIG' then case when victim is null then 'CLEANUP' when vt = 'NON_MEMBER' then 'REMOVE_VICTIM' else 'WAIT' end
        when bad > 0 then 'REMOVE_BAD' when size > target then 'SHRINK' when size = target and all_ready then 'SWITCH_MODE' else 'CLEANUP' end as action from x)"""


@query("group_action_all", f"with {_ALL} select table_id, shard_index, action, case action when 'ADD' then target - healthy when 'SHRINK' then size - target when 'REMOVE_BAD' then bad when 'REMOVE_VICTIM' then 1 else 0 end::bigint as n from a")
def group_action_all(t: Inputs):
    return control.group_action(t.sparse_members, t.replicas, t.groups)


@query("group_modes", f"with {_ALL} select table_id, shard_index, mode, case when mode = 'BOOTSTRAP' and size = target and all_ready then 'RAFT_RECONFIG' when mode = 'RAFT_RECONFIG' and target = 0 then 'BOOTSTRAP' else mode end as next_mode from a where action in ('CLEANUP', 'SWITCH_MODE')")
def group_modes(t: Inputs):
    return control.group_modes(t.sparse_members, t.replicas, t.groups)


@query("group_new_members", f"with {_ALL} select table_id, shard_index, unnest(range(10, 10 + target - healthy))::bigint as replica_seq, (10 + target - healthy)::bigint as next_seq from a where action = 'ADD'")
def group_new_members(t: Inputs):
    wanted = control.group_action(t.sparse_members, t.replicas, t.groups).where("action = 'ADD'").drop("action")
    return control.new_members(t.groups.select("table_id", "shard_index", F.lit(10).cast("long").alias("next_seq")), wanted)


@query("plan_groups_all", """
    with s as (select c.*, u.shard_index from (select table_id, state, shard_count, replica_count from catalog_tables where state not in ('FAILED', 'DELETED')) c join (select 0 as shard_index union all select 1 union all select 2) u on u.shard_index < c.shard_count)
    select s.table_id, s.shard_index, case when state = 'DROPPING' then case when g.table_id is null then 'NONE' when g.target_replica_count <> 0 then 'SET_ZERO' else 'WAIT' end
           else case when g.table_id is null then 'CREATE' when g.target_replica_count <> replica_count then 'SET_TARGET' else 'NONE' end end as action
    from s left join groups g on g.table_id = s.table_id and g.shard_index = s.shard_index""")
def plan_groups_all(t: Inputs):
    return control.plan_groups(t.catalog_tables, t.groups)


@query("node_register", """
    with r as (select max(s_suppkey) as seq, node_id from (select s_suppkey, concat('storage-', s_suppkey * 3 % 140) as node_id from supplier) group by node_id),
    q as (select node_id, concat('dc', seq % 4) as dc, 'pool-c' as resource_pool from r)
    select coalesce(n.node_id, q.node_id) as node_id, coalesce(q.dc, n.dc) as dc, coalesce(q.resource_pool, n.resource_pool) as resource_pool, case when q.node_id is not null then 'ONLINE' else n.status end as status,
           case when q.node_id is not null then 0 else n.heartbeat_age_ms end as heartbeat_age_ms
    from nodes n full join q on q.node_id = n.node_id""")
def node_register(t: Inputs):
    requests = t.supplier.selectExpr("s_suppkey as seq", "concat('storage-', s_suppkey * 3 % 140) as node_id", "concat('dc', s_suppkey % 4) as dc", "'pool-c' as resource_pool")
    return control.register_nodes(t.nodes, requests)


@query("report_acceptance", """
    select h.table_id, h.shard_index, h.replica_seq, h.term, case when g.table_id is null then 'NO_GROUP' when h.term > g.table_id % 5 then 'ACCEPT' when h.term < g.table_id % 5 then 'STALE' when h.replica_seq = g.table_id % 3 then 'ACCEPT' else 'CONFLICT' end as decision
    from heartbeat_reports h left join groups g on g.table_id = h.table_id and g.shard_index = h.shard_index where h.role = 'LEADER'""")
def report_acceptance(t: Inputs):
    accepted = t.groups.selectExpr("table_id", "shard_index", "table_id % 5 as observed_term", "table_id % 3 as observed_leader")
    return control.accept_reports(t.heartbeat_reports.where("role = 'LEADER'"), accepted)


@query("sdm_place_table", """
    with e as (select table_id, concat('op-', table_id % 5) as own, phase from sdm_status), r as (select table_id as req_id, table_id // 2 as table_id, concat('op-', (table_id // 2) % 5 + table_id % 2 * (table_id % 3)) as operation_id from catalog_tables),
    f as (select table_id, min_by(operation_id, req_id) as first from r group by table_id)
    select r.req_id, r.table_id, case when coalesce(e.own, f.first) = r.operation_id then 'OK' else 'ALREADY_EXIST' end as status, coalesce(e.phase, 'CREATING') as phase from r join f using (table_id) left join e on e.table_id = r.table_id""")
def sdm_place_table(t: Inputs):
    requests = t.catalog_tables.selectExpr("table_id as req_id", "table_id div 2 as table_id", "concat('op-', (table_id div 2) % 5 + table_id % 2 * (table_id % 3)) as operation_id")
    return control.place_tables(requests, t.sdm_status.selectExpr("table_id", "concat('op-', table_id % 5) as operation_id", "phase"))


@query("sdm_table_finalize", """
    with p as (select table_id, case when table_id % 7 = 0 then 'ABSENT' else 'PRESENT' end as desired, phase, table_id % 2 = 0 as ready, table_id % 14 = 0 as gone from sdm_status)
    select table_id, phase, case when phase = 'FAILED' then phase when desired = 'ABSENT' and gone then 'DELETED' when desired = 'ABSENT' and phase <> 'DELETED' then 'DELETING'
           when desired = 'PRESENT' and phase in ('CREATING', 'RESIZING') and ready then 'READY' else phase end as next_phase from p""")
def sdm_table_finalize(t: Inputs):
    tables = t.sdm_status.selectExpr("table_id", "if(table_id % 7 = 0, 'ABSENT', 'PRESENT') as desired", "phase")
    return control.finalize_tables(tables, t.sdm_status.selectExpr("table_id", "table_id % 2 = 0 as ready"), t.sdm_status.where("table_id % 14 = 0"))


@query("histogram_percentile_zero", f"with {_BOUNDS}, h as ({_hist('true')}) select distinct name, 0 as count, null::double as avg_us, null::bigint as p50_us, null::bigint as p95_us, null::bigint as p99_us from h")
def histogram_percentile_zero(t: Inputs):
    """A histogram that did not grow has no percentiles."""
    now, before = (metrics.histogram(t.latency_samples) for _ in range(2))
    return metrics.percentile_bounds(metrics.histogram_delta(now, before))


_REPORT = """
    g as (select * from scraped_histograms where error is null), e as (select target, min(ts) as t0, max(ts) as t1 from g group by target having max(ts) > min(ts)),
    d as (select g.target, g.name, g.le, e.t0, e.t1, greatest(coalesce(sum(cum) filter (ts = t1), 0) - coalesce(sum(cum) filter (ts = t0), 0), 0) as cum, greatest(coalesce(sum(count) filter (ts = t1), 0) - coalesce(sum(count) filter (ts = t0), 0), 0) as n,
                 greatest(coalesce(sum(sum_us) filter (ts = t1), 0) - coalesce(sum(sum_us) filter (ts = t0), 0), 0) as s from g join e on e.target = g.target group by all),
    report as (select target, name, max(n)::bigint as count, max(n) / (max(t1) - max(t0)) as qps, max(s) / max(n) as avg_us, min(case when cum * 100 >= n * 50 then le end) as p50_us, min(case when cum * 100 >= n * 95 then le end) as p95_us, min(case when cum * 100 >= n * 99 then le end) as p99_us
               from d where n > 0 group by target, name)"""


@query("metric_report_histograms", f"with {_REPORT} select * from report")
def metric_report_histograms(t: Inputs):
    return metrics.report_histograms(t.scraped_histograms)


@query("metric_report_errors", "select distinct target, ts, error from scraped_histograms where error is not null")
def metric_report_errors(t: Inputs):
    return metrics.report_errors(t.scraped_histograms)


@query("metric_report_text", f"""
    with {_REPORT}, c as (select target, name, count::varchar as count, coalesce(p99_us::varchar, '-') as p99_us, row_number() over (order by target, name) as no from report),
    w as (select greatest(6, max(length(target))) as a, greatest(4, max(length(name))) as b, greatest(5, max(length(count))) as c, greatest(6, max(length(p99_us))) as d from c)
    select no, concat(rpad(target, a::int, ' '), '  ', rpad(name, b::int, ' '), '  ', rpad(count, w.c::int, ' '), '  ', rpad(p99_us, d::int, ' ')) as line
    from (select * from c union all select 'target', 'name', 'count', 'p99_us', -1) x, w
    union all select 0, concat(repeat('-', a), '  ', repeat('-', b), '  ', repeat('-', w.c), '  ', repeat('-', d)) from w""")
def metric_report_text(t: Inputs):
    return metrics.aligned(metrics.report_histograms(t.scraped_histograms).select("target", "name", "count", "p99_us"), ["target", "name"])


@query("metrics_parse_labels", f"with {_BOUNDS}, h as ({_hist('true')}) select name, 'bucket' as kind, coalesce(le::varchar, '+Inf') as le, cum::double as value from h union all select name, 'counter', null, max(count)::double from h group by name")
def metrics_parse_labels(t: Inputs):
    """Other labels, one of which holds what looks like a bound, times, comments and lines that are none."""
    h = metrics.histogram(t.latency_samples)
    le = F.coalesce(F.col("le").cast("string"), F.lit("+Inf"))
    lines = h.select(F.format_string('  %s_latency_us_bucket{handle="a\\"b,le=",le="%s",x="}"} %d 1700000000', "name", le, "cum").alias("line"))
    total = h.groupBy("name").agg(F.max("count").alias("n")).select(F.format_string("%s_total{} %d.0", "name", "n").alias("line"))
    rest = t.spark.createDataFrame([("# HELP x_bucket{le=\"1\"} 5",), ("",), ("x_bucket{le=\"1\" 5",), ("x_bucket{handle=\"5\"} 5",), ("x one",)], "line string")
    return metrics.parse(lines.unionByName(total).unionByName(rest))


@query("id_text", "select concat(table_id, ':', shard_index) as shard, concat(table_id, ':', shard_index, ':', replica_seq) as replica from replicas")
def id_text(t: Inputs):
    return t.replicas.select(control.shard_text().alias("shard"), control.replica_text().alias("replica"))
