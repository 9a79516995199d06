"""Queries over the catalog, the control plane, metrics and workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvloom.functions.hashing import fnv1a64, place
from kvloom.operators import catalog, control, metrics, workload
from kvloom.plans.registry import query
from kvloom.sources import wal
from kvloom.sources.fixtures import Inputs
from kvloom.sources.workspace import new_path
from kvloom.streaming import state_stream


@query("catalog_create_db", """
    with w as (select distinct n_name as db_name from nation union select r_name from region), e as (select r_name as db_name, r_regionkey as db_id from region)
    select w.db_name, case when e.db_id is null then 'OK' else 'ALREADY_EXIST' end as status,
           coalesce(e.db_id, (select max(db_id) + 1 from e) + row_number() over (partition by e.db_id is null order by w.db_name) - 1)::bigint as db_id
    from w left join e on e.db_name = w.db_name""")
def catalog_create_db(t: Inputs):
    existing = t.region.select(F.col("r_name").alias("db_name"), F.col("r_regionkey").alias("db_id"))
    return catalog.create_dbs(existing, t.nation.select(F.col("n_name").alias("db_name")).unionByName(existing.select("db_name")))


@query("catalog_droppable_dbs", "select db_id, bool_and(state = 'DELETED') as droppable from catalog_tables group by db_id")
def catalog_droppable_dbs(t: Inputs):
    return catalog.droppable_dbs(t.catalog_tables)


@query("catalog_create_table", """
    with r as (select table_id as req_id, (db_id + table_id % 2)::int as db_id, case when table_id % 29 = 0 then '' else concat('t', table_id + table_id % 3) end as table_name,
                      shard_count - (case when table_id % 31 = 0 then 3 else 0 end) as shard_count, replica_count - (case when table_id % 37 = 0 then 4 else 0 end) as replica_count from catalog_tables)
    select req_id, r.db_id, r.table_name, case when r.table_name = '' or r.shard_count <= 0 or r.replica_count < 0 then 'INVALID_ARGUMENT' when not exists (select 1 from region where r_regionkey = r.db_id) then 'DB_NOT_FOUND'
           when exists (select 1 from catalog_tables c where c.state <> 'DELETED' and c.db_id = r.db_id and c.table_name = r.table_name) then 'ALREADY_EXIST' else 'OK' end as status from r""")
def catalog_create_table(t: Inputs):
    requests = t.catalog_tables.selectExpr(
        "table_id as req_id", "cast(db_id + table_id % 2 as int) as db_id", "if(table_id % 29 = 0, '', concat('t', table_id + table_id % 3)) as table_name",
        "shard_count - if(table_id % 31 = 0, 3, 0) as shard_count", "replica_count - if(table_id % 37 = 0, 4, 0) as replica_count",
    )
    return catalog.create_tables(requests, t.region.select(F.col("r_regionkey").alias("db_id")), t.catalog_tables)


@query("catalog_alter_decision", """
    select table_id, case when state = 'DELETED' then 'TABLE_NOT_FOUND' when state = 'ALTERING' then case when table_id % 2 = 0 then 'OK' else 'INVALID_ARGUMENT' end when state = 'NORMAL' then 'OK' else 'INVALID_ARGUMENT' end as status,
           case when state = 'NORMAL' and table_id % 2 = 1 then 'ALTERING' else state end as next_state from catalog_tables""")
def catalog_alter_decision(t: Inputs):
    return catalog.alter_replica_count(t.catalog_tables.withColumn("new_count", F.col("replica_count") + F.col("table_id") % 2))


@query("catalog_drop_decision", "select table_id, case when state in ('DROPPING', 'NORMAL') then 'OK' when state = 'DELETED' then 'TABLE_NOT_FOUND' else 'INVALID_ARGUMENT' end as status, case when state = 'NORMAL' then 'DROPPING' else state end as next_state from catalog_tables")
def catalog_drop_decision(t: Inputs):
    return catalog.drop_tables(t.catalog_tables)


@query("catalog_tables", "select c.table_id, d.r_name as db_name, c.table_name, c.state from catalog_tables c join region d on d.r_regionkey = c.db_id where c.state <> 'DELETED'")
def catalog_tables(t: Inputs):
    dbs = t.region.select(F.col("r_regionkey").alias("db_id"), F.col("r_name").alias("db_name"))
    return catalog.list_tables(t.catalog_tables).join(dbs, "db_id").select("table_id", "db_name", "table_name", "state")


@query("catalog_duplicate_names", "select db_id, substr(table_name, 1, 3) as table_name, count(*) as n from catalog_tables where state <> 'DELETED' group by 1, 2 having count(*) > 1")
def catalog_duplicate_names(t: Inputs):
    return catalog.duplicate_names(t.catalog_tables.withColumn("table_name", F.substring("table_name", 1, 3)))


@query("ddl_reconcile_action", """
    with r as (select c.table_id, c.state, case when s.rpc_status is null then case c.state when 'ADDING' then 'RESUBMIT' when 'DROPPING' then 'DONE' else 'FAILED' end when s.rpc_status <> 'OK' then 'ERROR'
           when s.phase = (case c.state when 'DROPPING' then 'DELETED' else 'READY' end) then 'DONE' when s.phase = 'FAILED' then 'FAILED'
           when s.phase = (case c.state when 'ADDING' then 'CREATING' when 'DROPPING' then 'DELETING' else 'RESIZING' end) then 'WAIT' else 'RESUBMIT' end as action
        from catalog_tables c left join sdm_status s on s.table_id = c.table_id where c.state in ('ADDING', 'DROPPING', 'ALTERING'))
    select table_id, state, action, case action when 'DONE' then case state when 'DROPPING' then 'DELETED' else 'NORMAL' end when 'FAILED' then 'FAILED' else state end as next_state from r""")
def ddl_reconcile_action(t: Inputs):
    return catalog.reconcile(t.catalog_tables, t.sdm_status)


@query("index_pool_nodes", "select resource_pool, count(*) as n, min(node_id) as first_id, max(node_id) as last_id from nodes group by resource_pool")
def index_pool_nodes(t: Inputs):
    return control.pool_nodes(t.nodes)


@query("index_shard_replicas", "select table_id, shard_index, count(*) as n, min(replica_seq) as first_seq, max(replica_seq) as last_seq from replicas group by table_id, shard_index")
def index_shard_replicas(t: Inputs):
    return control.shard_replicas(t.replicas)


@query("heartbeat_apply", "select h.table_id, h.shard_index, h.replica_seq, h.node_no, h.role, h.storage_status, h.term from heartbeat_reports h join replicas r using (table_id, shard_index, replica_seq) where r.node_no = h.node_no")
def heartbeat_apply(t: Inputs):
    return control.apply_heartbeat(t.replicas, t.heartbeat_reports)


@query("heartbeat_missing_replicas", "select r.table_id, r.shard_index, r.replica_seq, r.node_no from replicas r where desired = 'ABSENT' and phase = 'DELETING' and not exists (select 1 from heartbeat_reports h where h.table_id = r.table_id and h.shard_index = r.shard_index and h.replica_seq = r.replica_seq and h.node_no = r.node_no)")
def heartbeat_missing_replicas(t: Inputs):
    return control.gone_replicas(t.replicas, t.heartbeat_reports)


_SAME = "{a}.table_id = {b}.table_id and {a}.shard_index = {b}.shard_index and {a}.replica_seq = {b}.replica_seq"


@query("heartbeat_diff", f"""
    select r.table_id, r.shard_index, r.replica_seq, r.node_no, 'PRESENT' as expected from replicas r where exists (select 1 from group_members g where {_SAME.format(a='g', b='r')})
        and not exists (select 1 from heartbeat_reports h where {_SAME.format(a='h', b='r')} and h.node_no = r.node_no)
    union all select h.table_id, h.shard_index, h.replica_seq, h.node_no, 'ABSENT' from heartbeat_reports h where not exists (select 1 from group_members g where {_SAME.format(a='g', b='h')})""")
def heartbeat_diff(t: Inputs):
    return control.heartbeat_diff(t.replicas, t.group_members, t.heartbeat_reports)


@query("membership_projection", """
    with l as (select table_id, shard_index, replica_seq, term, row_number() over (partition by table_id, shard_index order by term desc, replica_seq) as rn from heartbeat_reports where role = 'LEADER')
    select g.table_id, g.shard_index, g.replica_seq, coalesce(r.member_type, 'NON_MEMBER') as member_type, l.term
    from group_members g join l on l.table_id = g.table_id and l.shard_index = g.shard_index and l.rn = 1
    left join replicas r on r.table_id = g.table_id and r.shard_index = g.shard_index and r.replica_seq = g.replica_seq and (r.table_id + r.replica_seq) % 4 <> 3""")
def membership_projection(t: Inputs):
    reported = t.replicas.where("(table_id + replica_seq) % 4 <> 3").withColumn("pos", F.col("replica_seq"))
    doubled = reported.unionByName(reported.withColumn("member_type", F.lit("LEARNER")).withColumn("pos", F.col("pos") + 10))
    return control.project_membership(t.group_members, t.heartbeat_reports.where("role = 'LEADER'"), doubled)


@query("node_liveness", "select node_id, case when heartbeat_age_ms <= 10000 then 'ONLINE' when heartbeat_age_ms > 30000 then 'OFFLINE' when status = 'ONLINE' then 'SUSPECT' else status end as next_status, case when heartbeat_age_ms <= 10000 then 'ONLINE' else status end as next_status_in_grace from nodes")
def node_liveness(t: Inputs):
    age, status = F.col("heartbeat_age_ms"), F.col("status")
    return t.nodes.select("node_id", control.node_liveness(age, status).alias("next_status"), control.node_liveness(age, status, grace=True).alias("next_status_in_grace"))


@query("replica_phase", """
    select table_id, shard_index, replica_seq, phase, case when phase = 'DELETED' then 'DELETED' when desired = 'ABSENT' then case when phase = 'DELETING' and observed_no_exist = 1 then 'DELETED' else 'DELETING' end
           when phase in ('DELETING', 'ERROR') then phase when n.status is null then phase when n.status = 'OFFLINE' then 'LOST' when phase = 'LOST' then 'CREATING'
           when storage_status in ('INITIALIZING', 'RECOVERING') then 'CREATING' when storage_status = 'READY' then 'READY' else 'ERROR' end as next_phase
    from replicas r left join nodes n on n.node_no = r.node_no""")
def replica_phase(t: Inputs):
    return control.replica_phase(t.replicas, t.nodes)


_HEALTHY = "(desired = 'PRESENT' and phase not in ('LOST', 'ERROR', 'DELETING', 'DELETED'))"


@query("group_health", f"select table_id, shard_index, count(*) as total, count(*) filter {_HEALTHY.replace('(', '(where ', 1)} as healthy, count(*) filter (where phase in ('LOST', 'ERROR')) as bad from replicas group by table_id, shard_index")
def group_health(t: Inputs):
    return control.group_health(t.replicas)


_GROUPS = f"""
    j as (select g.*, r.desired, r.phase, r.role, r.member_type, r.node_no, r.table_id is null or r.phase in ('LOST', 'ERROR') as isbad from group_members g left join replicas r on {_SAME.format(a='r', b='g')}),
    g as (select table_id, shard_index, max(target_replica_count) as target, max(mode) as mode, count(*) as size, count(*) filter (where {_HEALTHY}) as healthy, count(*) filter (where phase in ('LOST', 'ERROR')) as bad,
                 count(*) filter (where {_HEALTHY} and member_type = 'VOTER') as voters, min(case when isbad then pos end) as first_bad, max(pos) as last,
                 min(case when phase = 'READY' and member_type = 'NON_MEMBER' then pos end) as add_pos, bool_and(coalesce(phase = 'READY' and member_type = 'VOTER', false)) as all_ready
          from j group by table_id, shard_index),
    v as (select *, coalesce(first_bad, case when size > target then last end) as victim from g)"""


@query("remove_victim", f"with {_GROUPS} select table_id, shard_index, victim as replica_seq from v where victim is not null")
def remove_victim(t: Inputs):
    return control.remove_victim(t.group_members, t.replicas)


@query("shard_members", f"with {_GROUPS} select table_id, shard_index, string_agg(concat(replica_seq, '@', node_no), ',' order by pos) as members from j where node_no is not null and (mode <> 'RAFT_RECONFIG' or member_type = 'VOTER') group by table_id, shard_index")
def shard_members(t: Inputs):
    return control.shard_members(t.group_members, t.replicas)


@query("reconfig_commands", f"""
    with {_GROUPS}, c as (select *, case when add_pos is not distinct from victim then null else add_pos end as a from v where mode = 'RAFT_RECONFIG' and target > 0),
    d as (select *, case when a is not null then 'ADD_MEMBER' when voters >= target and victim is not null then 'REMOVE_MEMBER' end as command from c),
    l as (select distinct table_id, shard_index, node_no from j where role = 'LEADER')
    select d.table_id, d.shard_index, l.node_no, d.command, coalesce(d.a, d.victim) as replica_seq from d join l on l.table_id = d.table_id and l.shard_index = d.shard_index where d.command is not null""")
def reconfig_commands(t: Inputs):
    return control.reconfig_commands(t.group_members, t.replicas)


@query("plan_groups", """
    with s as (select c.*, u.shard_index from (select table_id, state, shard_count, replica_count from catalog_tables where state not in ('FAILED', 'DELETED')) c join (select 0 as shard_index union all select 1 union all select 2) u on u.shard_index < c.shard_count),
    g as (select table_id, shard_index, max(target_replica_count) as target from group_members group by table_id, shard_index)
    select s.table_id, s.shard_index, case when state = 'DROPPING' then case when target is null then 'NONE' when target <> 0 then 'SET_ZERO' else 'WAIT' end
           else case when target is null then 'CREATE' when target <> replica_count then 'SET_TARGET' else 'NONE' end end as action
    from s left join g on g.table_id = s.table_id and g.shard_index = s.shard_index""")
def plan_groups(t: Inputs):
    return control.plan_groups(t.catalog_tables, t.group_members)


@query("group_action", f"""
    with {_GROUPS}, x as (select v.*, r.member_type as vt from v left join replicas r on r.table_id = v.table_id and r.shard_index = v.shard_index and r.replica_seq = v.victim),
    a as (select *, case when target = 0 then case when size > 0 then 'SHRINK' else 'CLEANUP' end when healthy < target then 'ADD'
        when mode = 'RAFT_RECONFIG' then case when victim is null then 'CLEANUP' when vt = 'NON_MEMBER' then 'REMOVE_VICTIM' else 'WAIT' end
        when bad > 0 then 'REMOVE_BAD' when size > target then 'SHRINK' when size = target and all_ready then 'SWITCH_MODE' else 'CLEANUP' end as action from x)
    select table_id, shard_index, action, case action when 'ADD' then target - healthy when 'SHRINK' then size - target when 'REMOVE_BAD' then bad when 'REMOVE_VICTIM' then 1 else 0 end::bigint as n from a""")
def group_action(t: Inputs):
    return control.group_action(t.group_members, t.replicas)


@query("placement_candidates", """
    with l as (select n.resource_pool, n.node_id, (select count(*) from replicas r where r.node_no = n.node_no and r.desired = 'PRESENT') as load from nodes n where status = 'ONLINE')
    select resource_pool, node_id, load, candidates from (select *, count(*) over (partition by resource_pool) as candidates, row_number() over (partition by resource_pool order by load, node_id) as rn from l) where rn = 1""")
def placement_candidates(t: Inputs):
    return control.first_candidates(t.nodes, t.replicas)


@query("placement_greedy", """
    with recursive l as (select n.resource_pool, n.node_id, n.dc, (select count(*) from replicas r where r.node_no = n.node_no and r.desired = 'PRESENT') as load from nodes n where status = 'ONLINE'),
    p as (select resource_pool, list(node_id order by node_id) as ids, list(dc order by node_id) as dcs, list(load order by node_id) as loads from l group by resource_pool having count(*) >= 3),
    picks(resource_pool, t, loads, chosen, best) as (
        select resource_pool, 0, loads, []::bigint[], 0::bigint from p
        union all
        select resource_pool, t + 1, list_transform(loads, lambda x, i: x + case when i = pick then 1 else 0 end), list_append(chosen, pick), pick from (
            select e.resource_pool, e.t, e.loads, e.chosen,
                   list_sort(list_filter(list_transform(e.loads, lambda x, i: case when not list_contains(e.chosen, i) then [len(list_filter(e.chosen, lambda c: p.dcs[c] = p.dcs[i])), x, i] end), lambda c: c is not null))[1][3] as pick
            from (select resource_pool, t, loads, case when t % 3 = 0 then []::bigint[] else chosen end as chosen from picks where t < 24) e join p using (resource_pool)))
    select resource_pool, ((t - 1) // 3)::bigint as shard_index, ((t - 1) % 3)::bigint as pick, p.ids[best] as node_id from picks join p using (resource_pool) where t > 0""")
def placement_greedy(t: Inputs):
    return control.place_greedily(control.node_loads(t.nodes, t.replicas), 8, 3)


@query("group_shrink_tail", "select table_id, shard_index, replica_seq from (select *, count(*) over (partition by table_id, shard_index) - target_replica_count as excess, row_number() over (partition by table_id, shard_index order by pos desc) as back from group_members) where back <= excess")
def group_shrink_tail(t: Inputs):
    return control.shrink_tail(t.group_members)


@query("group_remove_specific", f"with {_GROUPS} select table_id, shard_index, coalesce(string_agg(case when not isbad then replica_seq::varchar end, ',' order by pos), '') as members from j group by table_id, shard_index")
def group_remove_specific(t: Inputs):
    return control.remove_specific(t.group_members, t.replicas.where("phase in ('LOST', 'ERROR')"))


@query("replica_colocation", "select node_no, table_id, shard_index, count(*) as n from replicas group by node_no, table_id, shard_index having count(*) > 1")
def replica_colocation(t: Inputs):
    return control.colocated(t.replicas)


_ROUTES = """
    e as (select r.table_id, r.shard_index, r.replica_seq, r.role, r.term, n.node_id from replicas r join nodes n on n.node_no = r.node_no where r.desired = 'PRESENT' and r.phase = 'READY' and r.member_type = 'VOTER' and n.status = 'ONLINE'),
    ld as (select *, max(term) over (partition by table_id, shard_index) as top, row_number() over (partition by table_id, shard_index order by term desc, replica_seq) as rn from e where role = 'LEADER'),
    rl as (select table_id, shard_index, replica_seq, node_id, term from ld where rn = 1 and (table_id, shard_index) in (select (table_id, shard_index) from ld where term = top group by table_id, shard_index having count(*) = 1))"""


@query("route_leader", f"with {_ROUTES} select table_id, shard_index, replica_seq, node_id, term from rl")
def route_leader(t: Inputs):
    return control.route_leaders(t.replicas, t.nodes)


@query("route_entries", f"""
    with {_ROUTES} select e.table_id, e.shard_index, e.replica_seq, e.node_id, case when e.replica_seq = rl.replica_seq then 'LEADER' else 'FOLLOWER' end as role,
        row_number() over (partition by e.table_id, e.shard_index order by case when e.replica_seq = rl.replica_seq then 0 else 1 end, e.replica_seq) as place
    from e join rl on rl.table_id = e.table_id and rl.shard_index = e.shard_index""")
def route_entries(t: Inputs):
    return control.route_entries(t.replicas, t.nodes)


def _fnv(column: str) -> str:
    """The hash in DuckDB, as an integer without a sign."""
    return f"""list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(1, length(hex({column}::blob)), 2), lambda i: ('0x' || substr(hex({column}::blob), i, 2))::int::uhugeint)),
        lambda a, b: (xor(a, b) * 1099511628211::uhugeint) & 18446744073709551615::uhugeint)"""


@query("route_for_key", f"""
    with {_ROUTES}, q as (select idx % 300 as table_id, k, shard_count from (select distinct idx % 300 as idx, k from op_log) o left join catalog_tables c on c.table_id = o.idx % 300),
    h as (select table_id, k, case when shard_count is null then -1 else ({_fnv('k')} % shard_count::uhugeint)::int end as shard_index, shard_count from q)
    select h.table_id, h.k, h.shard_index, case when h.shard_count is null then 'TABLE_NOT_FOUND' when rl.node_id is null then 'ROUTE_NOT_FOUND' else 'OK' end as status, rl.node_id
    from h left join rl on rl.table_id = h.table_id and rl.shard_index = h.shard_index""")
def route_for_key(t: Inputs):
    hashed = t.op_log.select("k").distinct().select("k", fnv1a64(F.col("k")).alias("h"))
    keys = t.op_log.select((F.col("idx") % 300).alias("table_id"), "k").distinct().join(t.catalog_tables.select("table_id", "shard_count"), "table_id", "left")
    placed = keys.join(hashed, "k").select("table_id", "k", F.coalesce(place(F.col("h"), F.col("shard_count")), F.lit(-1)).alias("shard_index"))
    return control.route_keys(placed, t.catalog_tables, control.route_leaders(t.replicas, t.nodes))


_SHARDS = "s as (select c.table_id, c.shard_count, c.replica_count, u.shard_index from catalog_tables c join (select 0 as shard_index union all select 1 union all select 2) u on u.shard_index < c.shard_count)"


@query("table_routes_ready", f"with {_ROUTES}, {_SHARDS} select s.table_id, count(rl.node_id) as routed, bool_and(rl.node_id is not null) as ready from s left join rl on rl.table_id = s.table_id and rl.shard_index = s.shard_index group by s.table_id")
def table_routes_ready(t: Inputs):
    return control.table_routes(t.catalog_tables, control.route_leaders(t.replicas, t.nodes))


@query("table_ready", f"""
    with {_ROUTES}, {_SHARDS}, rr as (select table_id, shard_index, count(*) as n, bool_and(desired = 'PRESENT' and phase = 'READY' and member_type = 'VOTER') as fine from replicas group by table_id, shard_index),
    gg as (select g.table_id, g.shard_index, count(*) as n, max(g.target_replica_count) as target, bool_and(coalesce(r.desired = 'PRESENT' and r.phase = 'READY' and r.member_type = 'VOTER', false)) as fine
           from group_members g left join replicas r on {_SAME.format(a='r', b='g')} group by g.table_id, g.shard_index)
    select s.table_id, bool_and(coalesce(rr.n, 0) = s.replica_count and coalesce(rr.fine, true) and coalesce(gg.target, -1) = s.replica_count and coalesce(gg.n, 0) = s.replica_count and coalesce(gg.fine, true)
        and (s.replica_count = 0 or rl.node_id is not null)) as ready
    from s left join rr on rr.table_id = s.table_id and rr.shard_index = s.shard_index left join gg on gg.table_id = s.table_id and gg.shard_index = s.shard_index left join rl on rl.table_id = s.table_id and rl.shard_index = s.shard_index
    group by s.table_id""")
def table_ready(t: Inputs):
    return control.tables_ready(t.catalog_tables, t.replicas, t.group_members, control.route_leaders(t.replicas, t.nodes))


@query("table_deleted", "select table_id from (select table_id + 50 as table_id from catalog_tables) c where not exists (select 1 from replicas r where r.table_id = c.table_id) and not exists (select 1 from group_members g where g.table_id = c.table_id)")
def table_deleted(t: Inputs):
    return control.tables_deleted(t.catalog_tables.select((F.col("table_id") + 50).alias("table_id")), t.replicas, t.group_members)


@query("sdm_table_decision", """
    with r as (select c.table_id, case when c.table_id % 7 = 0 then 'ABSENT' else 'PRESENT' end as desired, coalesce(s.phase, 'READY') as phase, c.replica_count, c.replica_count + c.table_id % 2 as nc, concat('op-', c.table_id % 5) as o, concat('op-', c.table_id % 3) as n
               from catalog_tables c left join sdm_status s on s.table_id = c.table_id)
    select table_id, case when desired = 'ABSENT' then 'OK' when phase <> 'READY' then 'ALREADY_EXIST' else 'OK' end as drop_status,
           case when desired = 'ABSENT' or phase in ('DELETING', 'DELETED', 'FAILED') then 'ERROR' when o = n then 'OK' when phase <> 'READY' then 'ERROR' else 'OK' end as alter_status,
           case when desired <> 'ABSENT' and o <> n and phase = 'READY' and replica_count <> nc then 'RESIZING' else phase end as next_phase from r""")
def sdm_table_decision(t: Inputs):
    rows = t.catalog_tables.join(t.sdm_status, "table_id", "left").selectExpr(
        "table_id", "if(table_id % 7 = 0, 'ABSENT', 'PRESENT') as desired", "coalesce(phase, 'READY') as phase", "replica_count", "replica_count + table_id % 2 as new_count",
        "concat('op-', table_id % 5) as operation_id", "concat('op-', table_id % 3) as new_operation",
    )
    return control.placed_table_decision(rows)


@query("metric_counters", "select event_type as name, sum(event_id % 5)::bigint as value from events group by event_type")
def metric_counters(t: Inputs):
    return metrics.counters(t.events, "event_type", F.col("event_id") % 5)


_BOUNDS = "b as (select unnest([" + ", ".join(map(str, metrics.BOUNDS)) + ", null])::bigint as le)"


def _hist(where: str) -> str:
    return f"select m.name, b.le, (select count(*) from latency_samples s where s.metric = m.name and {where} and (b.le is null or s.latency_us <= b.le)) as cum, m.count, m.sum_us from (select metric as name, count(*) as count, sum(latency_us)::bigint as sum_us from latency_samples s where {where} group by metric) m cross join b"


_MID = "(select count(*) // 2 from latency_samples)"


@query("latency_histogram", f"with {_BOUNDS} {_hist('true')}")
def latency_histogram(t: Inputs):
    return metrics.histogram(t.latency_samples)


_SUMMARY = """select {key}, count(*) as count, sum(latency_us)::bigint as sum_us, min(latency_us) as min_us, max(latency_us) as max_us, sum(latency_us) / count(*) as avg_us,
    max(case when rn - 1 = (50 * (n - 1) + 99) // 100 then latency_us end) as p50_us, max(case when rn - 1 = (95 * (n - 1) + 99) // 100 then latency_us end) as p95_us, max(case when rn - 1 = (99 * (n - 1) + 99) // 100 then latency_us end) as p99_us
    from (select *, row_number() over ({by} order by latency_us, sample_id) as rn, count(*) over ({by}) as n from latency_samples)"""


@query("latency_summary", _SUMMARY.format(key="metric as name", by="partition by metric") + " group by metric")
def latency_summary(t: Inputs):
    return metrics.summary(t.latency_samples)


def _halves(t: Inputs):
    samples = t.latency_samples
    mid = samples.agg(F.expr("count(*) div 2")).scalar()
    return metrics.histogram(samples.where(F.col("sample_id") < mid)), metrics.histogram(samples)


@query("metric_delta", f"with {_BOUNDS}, h0 as ({_hist(f's.sample_id < {_MID}')}), h1 as ({_hist('true')}) select h1.name, h1.le, greatest(h1.cum - coalesce(h0.cum, 0), 0) as cum, greatest(h1.count - coalesce(h0.count, 0), 0) as count, greatest(h1.sum_us - coalesce(h0.sum_us, 0), 0) as sum_us from h1 left join h0 on h0.name = h1.name and h0.le is not distinct from h1.le")
def metric_delta(t: Inputs):
    before, now = _halves(t)
    return metrics.histogram_delta(now, before)


@query("histogram_percentile", f"with {_BOUNDS}, h as ({_hist('true')}) select name, max(count) as count, max(sum_us) / max(count) as avg_us, min(case when cum * 100 >= count * 50 then le end) as p50_us, min(case when cum * 100 >= count * 95 then le end) as p95_us, min(case when cum * 100 >= count * 99 then le end) as p99_us from h group by name")
def histogram_percentile(t: Inputs):
    return metrics.percentile_bounds(metrics.histogram(t.latency_samples))


_SCRAPES = "s as (select concat('target-', user_id % 6) as target, event_id // 500 as ts, event_type as name, sum(event_id % 7)::bigint as value, case when (event_id // 500) % 5 = 3 then 'timeout' end as error from events group by all)"


@query("metric_report", f"""
    with {_SCRAPES}, g as (select * from s where error is null), e as (select target, min(ts) as t0, max(ts) as t1 from g group by target having max(ts) > min(ts)),
    d as (select g.target, g.name, e.t0, e.t1, greatest(coalesce(sum(case when ts = t1 then value end), 0) - coalesce(sum(case when ts = t0 then value end), 0), 0)::bigint as delta from g join e on e.target = g.target group by g.target, g.name, e.t0, e.t1)
    select target, name, delta, delta / (t1 - t0) as rate from d where delta > 0""")
def metric_report(t: Inputs):
    rows = t.events.selectExpr("concat('target-', user_id % 6) as target", "event_id div 500 as ts", "event_type as name", "event_id % 7 as v")
    scrapes = rows.groupBy("target", "ts", "name").agg(F.sum("v").alias("value")).withColumn("error", F.when(F.col("ts") % 5 == 3, "timeout"))
    return metrics.report(scrapes)


@query("metrics_exposition", f"""
    with {_BOUNDS}, h as ({_hist('true')})
    select name, concat(name, '_latency_us_bucket{{le="', coalesce(le::varchar, '+Inf'), '"}} ', cum) as line from h
    union all select name, concat(name, '_latency_us_count ', max(count)) from h group by name union all select name, concat(name, '_latency_us_sum ', max(sum_us)) from h group by name""")
def metrics_exposition(t: Inputs):
    return metrics.exposition(metrics.histogram(t.latency_samples))


@query("metrics_parse", f"""
    with {_BOUNDS}, h as ({_hist('true')}) select name, 'bucket' as kind, coalesce(le::varchar, '+Inf') as le, cum::double as value from h
    union all select name, 'count', null, max(count)::double from h group by name union all select name, 'sum', null, max(sum_us)::double from h group by name""")
def metrics_parse(t: Inputs):
    return metrics.parse(metrics.exposition(metrics.histogram(t.latency_samples)))


@query("bench_workload", "select i as request_id, case when i * 7919 % 100 < 80 then 'GET' else 'PUT' end as op, concat('bench-key-', lpad((i % 1000)::varchar, 12, '0')) as k, case when i * 7919 % 100 >= 80 then rpad(concat('bench-value-', lpad(i::varchar, 12, '0')), 128, 'x') end as v from range(30000) r(i)")
def bench_workload(t: Inputs):
    return workload.requests(t.spark, 30_000, 1000, 128, 80)


@query("bench_summary", f"select count(*) as requests, sum(ok)::bigint as success, count(*) - sum(ok)::bigint as failure, count(*) / 4.0::double as attempted_qps, sum(ok)::bigint / 4.0::double as success_qps, (count(*) - sum(ok)::bigint) / count(*) as failure_rate, min(m.min_us) as min_us, max(m.max_us) as max_us, max(m.avg_us) as avg_us, max(m.p50_us) as p50_us, max(m.p95_us) as p95_us, max(m.p99_us) as p99_us from latency_samples cross join ({_SUMMARY.format(key='1 as run', by='')}) m")
def bench_summary(t: Inputs):
    return workload.run_summary(t.latency_samples, 4.0)


@query("wal_binary_decode", "select idx, term, op, k, v from op_log")
def wal_binary_decode(t: Inputs):
    files = wal.frames(t.op_log, 1000).select(F.col("segment").cast("string").alias("path"), "content")
    return wal.entries(files).select("idx", "term", "op", "k", "v")


@query("stream_state", "select k, v, idx from (select *, row_number() over (partition by k order by idx desc) as rn from op_log where op in ('PUT', 'DEL')) where rn = 1 and op = 'PUT'")
def stream_state(t: Inputs):
    source, out = new_path(t.spark, "log"), new_path(t.spark, "state")
    t.op_log.repartitionByRange(3, "idx").write.parquet(source)
    stream = t.spark.readStream.schema(t.op_log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    state_stream.fold_stream(stream, out, new_path(t.spark, "progress")).awaitTermination()
    return state_stream.read_state(t.spark, out)
