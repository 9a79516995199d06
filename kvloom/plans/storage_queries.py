"""Queries over what is stored and sent: binary logs, metadata, snapshots, heartbeats, route checks and result files."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvloom.functions.hashing import crc
from kvloom.operators import control, metrics, oplog, quorum, state, workload
from kvloom.plans.control_queries import _GROUPS, _SAME
from kvloom.plans.log_queries import _COMMIT, _LATEST, _MEMBERS, _N, share
from kvloom.plans.registry import ORACLE_SQL, query
from kvloom.sources import wal
from kvloom.sources.fixtures import Inputs
from kvloom.sources.metadata import MetadataStore
from kvloom.sources.workspace import new_path


@query("wal_config_decode", "select row_number() over (order by idx) as idx, op, concat('storage-', replica_seq) as node_id, 7 as table_id, 0 as shard_index, replica_seq::int as replica_seq, '10.0.0.1' as host, 9000 + replica_seq::int as port from config_log")
def wal_config_decode(t: Inputs):
    """Configuration changes as binary entries and back, with the members that they are about."""
    entries = oplog.assign_index(t.config_log.withColumnRenamed("idx", "seq"), "seq", ["op"]).selectExpr(
        "idx", "term", "op", "'' as k", "'' as v", "concat('storage-', replica_seq) as node_id", "7 as table_id", "0 as shard_index", "int(replica_seq) as replica_seq", "'10.0.0.1' as host", "9000 + int(replica_seq) as port"
    )
    files = wal.frames(entries, 100).select(F.col("segment").cast("string").alias("path"), "content")
    return wal.entries(files).select("idx", "op", *wal.MEMBER)


@query("crc_of_key", """
    with tab as (select list(c order by i) as tab from (select i, list_reduce([i::bigint, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, n: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i)) x),
    b as (select k, list_transform(range(1, length(hex(k::blob)), 2), lambda i: ('0x' || substr(hex(k::blob), i, 2))::int::bigint) as b from (select distinct k from op_log) y)
    select k, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::bigint) as crc from b, tab""")
def crc_of_key(t: Inputs):
    return t.op_log.select("k").distinct().select("k", crc(F.col("k")).alias("crc"))


@query("proposal_validate", f"""
    with p as (select idx * 10 as seq, case when idx % 9 = 4 then 'WRITE' when op = 'NONE' then 'NOOP' else 'WRITE' end as kind, op from op_log union all select idx * 10 + 5, case when idx % 5 = 0 then 'OTHER' when idx % 7 = 0 then 'WRITE' else 'CONFIG' end, op from config_log),
    s as (select *, (kind = 'WRITE' and op in ('PUT', 'DEL')) or kind = 'NOOP' or (kind = 'CONFIG' and op in ('ADD_LEARNER', 'PROMOTE_VOTER', 'REMOVE_MEMBER')) as ok from p)
    select seq, kind, op, case when ok then 'OK' else 'INVALID_ARGUMENT' end as status, case when ok then {_N} + sum(ok::int) over (order by seq) else -1 end::bigint as idx from s""")
def proposal_validate(t: Inputs):
    writes = t.op_log.selectExpr("idx * 10 as seq", "case when idx % 9 = 4 then 'WRITE' when op = 'NONE' then 'NOOP' else 'WRITE' end as kind", "op")
    changes = t.config_log.selectExpr("idx * 10 + 5 as seq", "case when idx % 5 = 0 then 'OTHER' when idx % 7 = 0 then 'WRITE' else 'CONFIG' end as kind", "op")
    return oplog.propose(writes.unionByName(changes), oplog.last_index(t.op_log))


@query("read_confirm", f"""
    with {_COMMIT}, c as (select max(term) as t from op_log), v as (select unnest(['all', 'few', 'later']) as variant),
    ans as (select variant, scenario, replica_seq, t, case variant when 'all' then t when 'few' then case when replica_seq = 1 then t end else case when replica_seq = 2 then t + 1 else t end end as term from progress, v, c where is_self = 0),
    s as (select variant, scenario, count(distinct case when term = t then replica_seq end) as same, coalesce(bool_or(term > t), false) as deposed from ans group by variant, scenario),
    r as (select variant, s.scenario, case when m.commit_index is null then 'NOT_YET_COMMIT' when deposed or same + 1 < q.q then 'NOT_LEADER' else 'OK' end as status, m.commit_index from s join m using (scenario) join q using (scenario))
    select variant, scenario, status, case when status = 'OK' then commit_index end as read_index from r""")
def read_confirm(t: Inputs):
    current = t.op_log.agg(F.max("term")).scalar()
    terms = {"all": current, "few": F.when(F.col("replica_seq") == 1, current), "later": F.when(F.col("replica_seq") == 2, current + 1).otherwise(current)}
    found = None
    for name, term in terms.items():
        answers = t.progress.where("is_self = 0").select("scenario", "replica_seq", term.alias("term"))
        one = quorum.read_confirmed(t.op_log, t.progress, answers).select(F.lit(name).alias("variant"), "*")
        found = one if found is None else found.unionByName(one)
    return found


@query("replication_plan_inflight", f"""
    with p as (select scenario, replica_seq, match_index as prev, match_index < {_N} * 60 // 100 as behind from progress where is_self = 0)
    select scenario, replica_seq, case when behind and replica_seq % 2 = 1 then 'WAIT' when behind then 'INSTALL_SNAPSHOT' else 'APPEND_ENTRIES' end as action, case when not behind then prev end as prev_log_index,
           case when not behind then coalesce(l.term, 0) end as prev_log_term, case when behind then 0 else greatest(0, least(256, {_N} - prev)) end::bigint as n_entries
    from p left join op_log l on l.idx = p.prev""")
def replication_plan_inflight(t: Inputs):
    return quorum.replication_plan(t.op_log, t.progress.withColumn("inflight", F.expr("if(replica_seq % 2 = 1, 7, 0)")), share(t.op_log, 60))


@query("leader_start", f"select scenario, replica_seq, {_N} + 1 as next_index, 0::bigint as match_index, 0::bigint as watermark, 0::bigint as inflight from progress where is_self = 0")
def leader_start(t: Inputs):
    return quorum.leader_start(t.progress, oplog.last_index(t.op_log))


_ANSWERS = """table_id, shard_index, replica_seq, term, {third} as sent_term, role = 'LEADER' or table_id % 3 <> 0 as leader, case replica_seq when 0 then 'OK' when 1 then 'ALREADY_EXIST' else 'ERROR' end as status,
    table_id % 50 as watermark, 20 + table_id % 7 as snapshot_index, case when table_id % 4 = 0 then 0 else 20 + table_id % 8 end as inflight, table_id % 30 as known, table_id % 40 as match_index, table_id % 40 + 1 + replica_seq as next_index"""


@query("snapshot_response", f"""
    with r as (select {_ANSWERS.format(third="case when table_id % 5 = 0 then 2 else 3 end")} from replicas),
    x as (select *, case when term > 3 then 'STEP_DOWN' when not leader then 'NOT_LEADER' when sent_term <> 3 then 'IGNORE_OLD_TERM' when status = 'OK' or (status = 'ALREADY_EXIST' and watermark >= snapshot_index) then 'ADVANCE' else 'FAILED' end as action, greatest(watermark, snapshot_index) as w from r)
    select table_id, shard_index, replica_seq, action, case when action in ('ADVANCE', 'FAILED') and inflight = snapshot_index then 0 else inflight end as new_inflight, case when action = 'ADVANCE' then greatest(known, w) else known end as new_known,
           case when action = 'ADVANCE' then greatest(match_index, w) else match_index end as new_match_index, case when action = 'ADVANCE' then greatest(next_index, w + 1) else next_index end as new_next_index from x""")
def snapshot_response(t: Inputs):
    rows = t.spark.sql(f"select {_ANSWERS.format(third='if(table_id % 5 = 0, 2, 3)')} from {{r}}", r=t.replicas)
    return quorum.snapshot_response(rows, 3).select("table_id", "shard_index", "replica_seq", "action", "new_inflight", "new_known", "new_match_index", "new_next_index")


@query("vote_decision_members", f"""
    with o as (select term as t, idx as i from op_log where term <= 3 order by idx desc limit 1)
    select table_id, shard_index, replica_seq, member_type = 'VOTER' and table_id % 3 <> 0 and r.term >= 2 and not ((select t from o) > r.term or (select t from o) = r.term and (select i from o) > (table_id * 13) % {_N})
           and (r.term > 2 or replica_seq = 0) as granted
    from replicas r""")
def vote_decision_members(t: Inputs):
    own = oplog.tail(t.op_log.where("term <= 3")).withColumn("voted_for", F.lit(0))
    requests = t.replicas.select("table_id", "shard_index", "replica_seq", (F.col("member_type") == "VOTER").alias("voter"), (F.col("table_id") % 3 != 0).alias("candidate_voter"), "term", F.col("term").alias("last_term"), (F.col("table_id") * 13 % oplog.last_index(t.op_log)).alias("last_index"), F.col("replica_seq").alias("candidate"))
    return quorum.vote_decision(requests, 2, own).select("table_id", "shard_index", "replica_seq", "granted")


_CHUNKS = """select receiver, i, 100 as size, case when page_id % 41 = 7 then 'b' else 'a' end as sender, j * 100 - j // 5 * 100 + case when page_id % 37 = 5 then 1 else 0 end as at
    from (select *, (i + receiver) % 12 as j from (select page_id, page_id % 10 as receiver, row_number() over (partition by page_id % 10 order by page_id) as i from pages))"""


@query("snapshot_sessions", f"""
    with recursive c as ({_CHUNKS}),
    st as (select receiver, 0::bigint as i, 0 as session, null::varchar as sender, 0::bigint as upto, 0 as ok from c group by receiver
           union all select c.receiver, c.i, session + case when c.at = 0 then 1 else 0 end, case when c.at = 0 then c.sender else st.sender end,
                  case when c.at = 0 then c.size when session > 0 and st.sender = c.sender and c.at = upto then upto + c.size else upto end, case when c.at = 0 or (session > 0 and st.sender = c.sender and c.at = upto) then 1 else 0 end
           from st join c on c.receiver = st.receiver and c.i = st.i + 1)
    select receiver, session::bigint as session, count(*) as chunks, sum(ok)::bigint as accepted, max(upto) as bytes from st where session > 0 and i > 0 group by receiver, session""")
def snapshot_sessions(t: Inputs):
    chunks = t.spark.sql(_CHUNKS.replace("j // 5", "j div 5").replace("from pages", "from {p}"), p=t.pages).withColumnRenamed("at", "offset")
    return oplog.receive_chunks(chunks, ["receiver"], "i", ["sender"])


@query("apply_committed", f"""
    with d as (select k, v from {_LATEST.format(where=f" and idx > {_N} * 20 // 100 and idx <= {_N} * 80 // 100")} where rn = 1 and op = 'PUT')
    select 'DATA' as kind, k as name, v as value from d union all select 'CONFIG', replica_seq::varchar, member_type from {_MEMBERS.format(where=f" where idx + {_N} * 30 // 100 <= {_N} * 80 // 100")}""")
def apply_committed(t: Inputs):
    """Entries and configuration changes of one range: each kind goes to its own fold."""
    moved = t.config_log.select((F.col("idx") + share(t.op_log, 30)).alias("idx"), "op", "replica_seq")
    log = t.op_log.select("idx", "op", "k", "v").unionByName(moved, allowMissingColumns=True)
    data, changes = oplog.split(log, share(t.op_log, 20), share(t.op_log, 80))
    kv = state.fold(data).select(F.lit("DATA").alias("kind"), F.col("k").alias("name"), F.col("v").alias("value"))
    return kv.unionByName(quorum.membership(changes).select(F.lit("CONFIG").alias("kind"), F.col("replica_seq").cast("string").alias("name"), F.col("member_type").alias("value")))


@query("heartbeat_merge", f"""
    select r.table_id, r.shard_index, r.replica_seq, r.node_no, coalesce(h.role, r.role) as role, coalesce(h.storage_status, r.storage_status) as storage_status, coalesce(h.term, r.term) as term,
           case when r.desired = 'ABSENT' and r.phase = 'DELETING' and h.table_id is null then 1 else r.observed_no_exist end as observed_no_exist
    from replicas r left join (select * replace (term + 1 as term) from heartbeat_reports) h on {_SAME.format(a='h', b='r')} and h.node_no = r.node_no""")
def heartbeat_merge(t: Inputs):
    return control.merge_heartbeat(t.replicas, t.heartbeat_reports.withColumn("term", F.col("term") + 1))


@query("heartbeat_result", f"""
    with {_GROUPS}, c as (select *, case when add_pos is not distinct from victim then null else add_pos end as a from v where mode = 'RAFT_RECONFIG' and target > 0),
    d as (select *, case when a is not null then 'ADD_MEMBER' when voters >= target and victim is not null then 'REMOVE_MEMBER' end as command from c),
    l as (select distinct table_id, shard_index, node_no from j where role = 'LEADER'),
    u as (select r.table_id, r.shard_index, r.replica_seq, r.node_no, 'PRESENT' as expected from replicas r where exists (select 1 from group_members g where {_SAME.format(a='g', b='r')})
              and not exists (select 1 from heartbeat_reports h where {_SAME.format(a='h', b='r')} and h.node_no = r.node_no)
          union all select h.table_id, h.shard_index, h.replica_seq, h.node_no, 'ABSENT' from heartbeat_reports h where not exists (select 1 from group_members g where {_SAME.format(a='g', b='h')})
          union all select d.table_id, d.shard_index, coalesce(d.a, d.victim), l.node_no, d.command from d join l on l.table_id = d.table_id and l.shard_index = d.shard_index where d.command is not null),
    s as (select table_id, shard_index, string_agg(concat(replica_seq, '@', node_no), ',' order by pos) as members from j where node_no is not null and (mode <> 'RAFT_RECONFIG' or member_type = 'VOTER') group by table_id, shard_index)
    select u.*, case when u.expected in ('PRESENT', 'ADD_MEMBER') then s.members end as members from u left join s on s.table_id = u.table_id and s.shard_index = u.shard_index""")
def heartbeat_result(t: Inputs):
    return control.heartbeat_result(t.replicas, t.group_members, t.heartbeat_reports)


_TOLD = "table_id, shard_index, replica_seq, node_no, case table_id % 5 when 0 then 'PRESENT' when 1 then 'ABSENT' when 2 then 'ADD_MEMBER' when 3 then 'REMOVE_MEMBER' else 'OTHER' end as expected, replica_seq <> 2 as listed"


@query("node_apply_expected", f"""
    with l as (select node_no, table_id, shard_index, min(replica_seq) as leader_seq from replicas where role = 'LEADER' group by all), e as (select {_TOLD} from replicas),
    x as (select e.*, l.leader_seq, case when expected = 'OTHER' then 'ERROR' when expected = 'ADD_MEMBER' and not listed then 'INVALID_ARGUMENT' when expected in ('ADD_MEMBER', 'REMOVE_MEMBER') and l.leader_seq is null then 'NOT_LEADER' else 'OK' end as status
          from e left join l on l.node_no = e.node_no and l.table_id = e.table_id and l.shard_index = e.shard_index)
    select node_no, table_id, shard_index, replica_seq, status, case when status = 'OK' then case expected when 'PRESENT' then 'create_replica' when 'ABSENT' then 'delete_replica' when 'ADD_MEMBER' then 'add_member' else 'remove_member' end end as call,
           case when status = 'OK' and expected in ('ADD_MEMBER', 'REMOVE_MEMBER') then leader_seq end as leader_seq from x""")
def node_apply_expected(t: Inputs):
    return control.apply_expected(t.spark.sql(f"select {_TOLD} from {{r}}", r=t.replicas), t.replicas)


@query("route_writable", """
    with e as (select *, case when node_no % 7 = 0 then '' else concat('10.0.0.', node_no) end as host, node_no % 5 as port from replicas),
    g as (select table_id, shard_index, count(*) filter (role = 'LEADER' and host <> '' and port > 0) as leaders from e group by table_id, shard_index)
    select *, case when leaders = 1 then 'OK' else 'ROUTE_NOT_FOUND' end as status from g""")
def route_writable(t: Inputs):
    return control.writable_routes(t.replicas.selectExpr("*", "if(node_no % 7 = 0, '', concat('10.0.0.', node_no)) as host", "node_no % 5 as port"))


_ROUTE_ROWS = "select table_id - 5 as table_id, case when table_id % 13 = 2 then shard_index + 1 else shard_index end as shard_index, count(*) - case when table_id % 17 = 3 then 3 else 0 end as replicas from {r} where table_id % 11 <> 4 or shard_index <> 0 group by table_id, shard_index"


@query("route_integrity", f"""
    with r as ({_ROUTE_ROWS.format(r='replicas')}), c as (select table_id - 5 as table_id, case when table_id % 19 = 6 then 0 else shard_count end as shard_count from catalog_tables),
    x as (select c.table_id, c.shard_count, count(r.shard_index) as n, coalesce(bool_or(r.shard_index < 0 or r.shard_index >= c.shard_count or r.replicas <= 0), false) as off from c left join r on r.table_id = c.table_id group by c.table_id, c.shard_count)
    select table_id, case when table_id >= 0 and shard_count > 0 and not off and n = shard_count then 'OK' else 'ERROR' end as status from x""")
def route_integrity(t: Inputs):
    tables = t.catalog_tables.selectExpr("table_id - 5 as table_id", "if(table_id % 19 = 6, 0, shard_count) as shard_count")
    return control.check_routes(tables, t.spark.sql(_ROUTE_ROWS, r=t.replicas))


@query("index_table_names", "select db_id, concat('n', table_id // 3) as table_name, min(table_id) as table_id from catalog_tables where state <> 'DELETED' group by all")
def index_table_names(t: Inputs):
    return control.table_names(t.catalog_tables.withColumn("table_name", F.expr("concat('n', table_id div 3)")))


@query("index_node_replicas", "select node_no, count(*) as n, count(distinct table_id) as tables from replicas group by node_no")
def index_node_replicas(t: Inputs):
    return control.node_replicas(t.replicas)


@query("metrics_exposition_counters", """
    with c as (select event_type as name, sum(event_id % 5)::bigint as value from events group by event_type)
    select name, 0 as no, concat('# TYPE store_', name, '_total counter') as line from c union all select name, 1, concat('store_', name, '_total ', value) from c""")
def metrics_exposition_counters(t: Inputs):
    return metrics.counter_exposition(metrics.counters(t.events, "event_type", F.col("event_id") % 5), "store_")


@query("bench_results_json")
def bench_results_json(t: Inputs):
    """The summary of a run, written as JSON and read back."""
    found, path = workload.run_summary(t.latency_samples, 4.0), new_path(t.spark, "results")
    workload.write_json(found, path)
    return workload.read_json(t.spark, path, found)


@query("bench_results_csv")
def bench_results_csv(t: Inputs):
    found, path = workload.run_summary(t.latency_samples, 4.0), new_path(t.spark, "results")
    workload.write_csv(found, path)
    return workload.read_csv(t.spark, path, found)


ORACLE_SQL |= {name: ORACLE_SQL["bench_summary"] for name in ("bench_results_json", "bench_results_csv")}

_STATE = "table_id, shard_index, replica_seq, term, case when role = 'LEADER' then concat(table_id, ':', shard_index, ':', replica_seq) end as voted_for"


@query("meta_hard_state", f"select table_id, shard_index, replica_seq, case when table_id % 4 = 0 then term + 2 else term end as term, voted_for from (select {_STATE} from replicas)")
def meta_hard_state(t: Inputs):
    """Terms and votes, saved, some of them saved anew, and read back."""
    store, saved = MetadataStore(t.spark), t.spark.sql(f"select {_STATE} from {{r}}", r=t.replicas)
    with store.write() as changes:
        changes.put("hard_state", saved)
    with store.write() as changes:
        changes.put("hard_state", saved.where("table_id % 4 = 0").withColumn("term", F.col("term") + 2))
    return store.read("hard_state")


@query("meta_local_replicas", """
    select table_id, shard_index, replica_seq from replicas where node_no in (select node_no from nodes where status = 'ONLINE') and not (table_id % 3 = 1 and shard_index = 0)""")
def meta_local_replicas(t: Inputs):
    """What the nodes that are up find on their disks, once whole shards have been removed."""
    store = MetadataStore(t.spark)
    with store.write() as changes:
        changes.put("local_replicas", t.replicas.withColumn("members", F.lit("")))
        changes.remove("local_replicas", t.replicas.where("table_id % 3 = 1 and shard_index = 0").select("table_id", "shard_index").distinct())
    return store.read("local_replicas").join(t.nodes.where("status = 'ONLINE'").select("node_no"), "node_no").select("table_id", "shard_index", "replica_seq")


def _sdm(t: Inputs) -> MetadataStore:
    store = MetadataStore(t.spark)
    with store.write() as changes:
        changes.put("replicas", t.replicas)
        changes.put("groups", t.groups.withColumn("next_seq", F.lit(3)))
    return store


_HELD = "select table_id, shard_index, count(replica_seq) as held, max(term) as term, max(next_seq)::bigint as next_seq from ({groups}) left join ({replicas}) using (table_id, shard_index) group by table_id, shard_index"
_BEFORE = {"groups": "select table_id, shard_index, 3 as next_seq from groups", "replicas": "select table_id, shard_index, replica_seq, term from replicas"}


def _held(store: MetadataStore, version: int | None = None):
    rows = store.read("groups", version).join(store.read("replicas", version), ["table_id", "shard_index"], "left")
    return rows.groupBy("table_id", "shard_index").agg(F.count("replica_seq").alias("held"), F.max("term").alias("term"), F.max("next_seq").alias("next_seq"))


@query("sdm_metadata_commit", _HELD.format(
    groups="select table_id, shard_index, case when table_id % 2 = 0 then 9 else 3 end as next_seq from groups where target_replica_count <> 0",
    replicas="select table_id, shard_index, replica_seq, case when desired = 'ABSENT' then 99 else term end as term from replicas where phase <> 'LOST'"))
def sdm_metadata_commit(t: Inputs):
    """Groups and replicas changed in one commit."""
    store = _sdm(t)
    with store.write() as changes:
        changes.put("replicas", t.replicas.where("desired = 'ABSENT'").withColumn("term", F.lit(99)))
        changes.remove("replicas", t.replicas.where("phase = 'LOST'"))
        changes.put("groups", t.groups.where("table_id % 2 = 0").withColumn("next_seq", F.lit(9)))
        changes.remove("groups", t.groups.where("target_replica_count = 0"))
    return _held(store)


@query("sdm_metadata_rollback", _HELD.format(**_BEFORE))
def sdm_metadata_rollback(t: Inputs):
    """A block of changes that fails leaves nothing behind."""
    store = _sdm(t)
    try:
        with store.write() as changes:
            changes.clear("groups")
            changes.put("replicas", t.replicas.withColumn("term", F.lit(99)))
            raise RuntimeError("given up")
    except RuntimeError:
        return _held(store)


@query("sdm_metadata_version", _HELD.format(**_BEFORE))
def sdm_metadata_version(t: Inputs):
    """Tables as of the commit before the last one."""
    store = _sdm(t)
    with store.write() as changes:
        changes.clear("groups")
    return _held(store, store.versions()[-2])
