"""Queries over the op log: state, log algebra, quorums and membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvloom.functions.hashing import shard_index
from kvloom.operators import oplog, quorum, state
from kvloom.plans.registry import query
from kvloom.sources.fixtures import Inputs
from kvloom.sources.workspace import new_path

_LATEST = "(select *, row_number() over (partition by k order by idx desc) as rn from op_log where op in ('PUT', 'DEL'){where})"
_N = "(select count(*) from op_log)"
_AT = f" and idx <= {_N} // 2"


def share(log, percent: int):
    """The index at a share of a log, as a scalar subquery."""
    return log.agg(F.floor(F.max("idx") * percent / 100).cast("long").alias("i")).scalar()


@query("kv_state_latest", f"select k, v, idx from {_LATEST.format(where='')} where rn = 1 and op = 'PUT'")
def kv_state_latest(t: Inputs):
    return state.fold(t.op_log)


@query("kv_state_at_commit", f"select k, v, idx from {_LATEST.format(where=_AT)} where rn = 1 and op = 'PUT'")
def kv_state_at_commit(t: Inputs):
    return state.fold(t.op_log, share(t.op_log, 50))


@query("kv_point_get", f"select r.k, case when s.v is null then 'KEY_NOT_FOUND' else 'OK' end as status, s.v from (select 'user-7' as k) r left join (select k, v from {_LATEST.format(where='')} where rn = 1 and op = 'PUT') s on r.k = s.k")
def kv_point_get(t: Inputs):
    return state.point_get(t.op_log, "user-7")


@query("kv_multi_get_status", f"select r.k, case when s.v is null then 'KEY_NOT_FOUND' else 'OK' end as status, s.v from (select concat('user-', c_custkey) as k from customer) r left join (select k, v from {_LATEST.format(where='')} where rn = 1 and op = 'PUT') s on r.k = s.k")
def kv_multi_get_status(t: Inputs):
    return state.get(state.fold(t.op_log), t.customer.select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("k")))


@query("kv_tombstones", f"select k, idx from {_LATEST.format(where='')} where rn = 1 and op = 'DEL'")
def kv_tombstones(t: Inputs):
    return state.tombstones(t.op_log)


@query("kv_delete_batch", f"select k, v, idx from {_LATEST.format(where='')} where rn = 1 and op = 'PUT' and k not in (select concat('user-', c_custkey) from customer where c_custkey % 3 = 0)")
def kv_delete_batch(t: Inputs):
    keys = t.customer.where("c_custkey % 3 = 0").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("k"))
    return state.delete(state.fold(t.op_log), keys)


@query("kv_full_scan", f"select k, v from {_LATEST.format(where='')} where rn = 1 and op = 'PUT'")
def kv_full_scan(t: Inputs):
    return state.scan(state.fold(t.op_log))


@query("status_normalize", "select idx, status, case status when 'NOT_YET_COMMIT' then 'UNKNOWN' else status end as surfaced, status = 'NOT_LEADER' as retry from (select idx, case op when 'PUT' then 'OK' when 'DEL' then 'NOT_YET_COMMIT' else 'NOT_LEADER' end as status from op_log)")
def status_normalize(t: Inputs):
    status = F.when(F.col("op") == "PUT", "OK").when(F.col("op") == "DEL", "NOT_YET_COMMIT").otherwise("NOT_LEADER")
    return state.normalise_status(t.op_log.select("idx", status.alias("status")))


@query("log_tail", "select max(idx) as last_index, max(term) as last_term from op_log")
def log_tail(t: Inputs):
    return oplog.tail(t.op_log)


@query("log_term_at", "select p.idx, case when p.idx = 0 or p.idx < 100 then 0 when p.idx = 100 then 1 else coalesce(l.term, 0) end::bigint as term from (select (s_suppkey * 131)::bigint as idx from supplier union all select 100) p left join op_log l on l.idx = p.idx")
def log_term_at(t: Inputs):
    probes = t.supplier.select((F.col("s_suppkey") * 131).cast("long").alias("idx")).unionByName(t.spark.range(100, 101).withColumnRenamed("id", "idx"))
    return oplog.term_at(t.op_log, probes, 100, 1)


@query("log_slice_limit", "select idx, term, op, k, v from op_log where idx >= 101 order by idx limit 256")
def log_slice_limit(t: Inputs):
    return oplog.slice_from(t.op_log, 101, 256)


@query("log_assign_index", f"select o_orderkey, {_N} + row_number() over (order by o_orderdate, o_orderkey) as idx, 11::bigint as term from orders")
def log_assign_index(t: Inputs):
    return oplog.assign_index(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", ["o_orderkey"], oplog.last_index(t.op_log), 11).select("o_orderkey", "idx", "term")


def _parts(t: Inputs):
    log = t.op_log
    bump = F.when(F.col("idx") > share(log, 50), 1).otherwise(0)
    return log.where(F.col("idx") <= share(log, 60)), log.where(F.col("idx") > share(log, 40)).withColumn("term", F.col("term") + bump)


@query("log_conflict_merge", f"""
    with n as (select count(*) as n from op_log), a as (select * from op_log where idx <= (select n * 60 // 100 from n)),
    b as (select idx, term + case when idx > (select n * 50 // 100 from n) then 1 else 0 end as term, op, k, v from op_log where idx > (select n * 40 // 100 from n)),
    c as (select min(a.idx) as c from a join b using (idx) where a.term <> b.term)
    select idx, term, op, k, v, 'local' as source from a where idx < (select c from c)
    union all select idx, term, op, k, v, 'leader' from b where idx >= (select c from c) or idx > (select max(idx) from a)""")
def log_conflict_merge(t: Inputs):
    return oplog.merge_from_leader(*_parts(t))


@query("log_truncate", f"select idx, term, op, k, v from op_log where idx > {_N} * 70 // 100")
def log_truncate(t: Inputs):
    return oplog.truncate(t.op_log, share(t.op_log, 70))


@query("log_retained_after_snapshot", f"select 'match' as scenario, idx, term from op_log where idx > {_N} * 80 // 100")
def log_retained_after_snapshot(t: Inputs):
    at = share(t.op_log, 80)
    term = t.op_log.where(F.col("idx") == at).agg(F.max("term")).scalar()
    both = [oplog.retained(t.op_log, at, x).select(F.lit(name).alias("scenario"), "idx", "term") for name, x in (("match", term), ("mismatch", term + 1))]
    return both[0].unionByName(both[1])


@query("log_unapplied_range", f"select idx, term, op, k, v from op_log where idx > {_N} * 25 // 100 and idx <= {_N} * 50 // 100")
def log_unapplied_range(t: Inputs):
    return oplog.unapplied(t.op_log, share(t.op_log, 25), share(t.op_log, 50))


@query("follower_commit", f"select scenario, replica_seq, greatest(match_index // 2, least({_N} * 80 // 100, match_index)) as new_commit from progress")
def follower_commit(t: Inputs):
    rows = t.progress.select("scenario", "replica_seq", F.expr("match_index div 2").alias("commit_index"), share(t.op_log, 80).alias("leader_commit"), F.col("match_index").alias("last_index"))
    return quorum.follower_commit(rows).select("scenario", "replica_seq", "new_commit")


_COMMIT = """
    q as (select scenario, count(*) filter (member_type = 'VOTER') // 2 + 1 as q from progress group by scenario),
    a as (select p.scenario, l.idx, 1 + count(*) filter (p.is_self = 0 and p.member_type = 'VOTER' and p.match_index >= l.idx) as acks
          from op_log l cross join progress p where l.term = (select max(term) from op_log) group by p.scenario, l.idx),
    m as (select q.scenario, max(case when a.acks >= q.q then a.idx end)::bigint as commit_index from q left join a on a.scenario = q.scenario group by q.scenario)"""


@query("quorum_commit_index", f"with {_COMMIT} select scenario, commit_index from m")
def quorum_commit_index(t: Inputs):
    return quorum.commit_index(t.op_log, t.progress)


@query("read_gate", f"with {_COMMIT} select scenario, coalesce(commit_index, 0) as read_index, commit_index is not null as ready from m")
def read_gate(t: Inputs):
    return quorum.read_gate(t.op_log, t.progress)


@query("replication_plan", f"""
    with p as (select scenario, replica_seq, match_index as prev, match_index < {_N} * 30 // 100 as behind from progress where is_self = 0)
    select scenario, replica_seq, case when behind then 'INSTALL_SNAPSHOT' else 'APPEND_ENTRIES' end as action, case when not behind then prev end as prev_log_index,
           case when not behind then coalesce(l.term, 0) end as prev_log_term, case when behind then 0 else greatest(0, least(256, {_N} - prev)) end::bigint as n_entries
    from p left join op_log l on l.idx = p.prev""")
def replication_plan(t: Inputs):
    return quorum.replication_plan(t.op_log, t.progress, share(t.op_log, 30))


@query("peer_progress", """
    with a as (select scenario, replica_seq, match_index - 5 + 7 as m from progress where replica_seq % 2 = 1 union all select scenario, replica_seq, match_index + replica_seq * 10 from progress where replica_seq > 2)
    select p.scenario, p.replica_seq, greatest(p.match_index, coalesce(max(a.m), 0)) as match_index, greatest(p.match_index, coalesce(max(a.m), 0)) + 1 as next_index
    from progress p left join a on a.scenario = p.scenario and a.replica_seq = p.replica_seq group by p.scenario, p.replica_seq, p.match_index""")
def peer_progress(t: Inputs):
    late = t.progress.where("replica_seq % 2 = 1").selectExpr("scenario", "replica_seq", "match_index - 5 as prev_log_index", "7 as n_entries")
    ahead = t.progress.where("replica_seq > 2").selectExpr("scenario", "replica_seq", "match_index as prev_log_index", "replica_seq * 10 as n_entries")
    return quorum.peer_progress(t.progress, late.unionByName(ahead))


@query("peer_backoff", f"""
    with r as (select scenario, replica_seq, match_index, match_index + 20 as nx, match_index + replica_seq * 7 as fl, {_N} as ll, match_index + 19 + replica_seq % 2 as prev from progress where is_self = 0)
    select scenario, replica_seq, greatest(case when least(fl, ll) + 1 >= nx and nx > 1 then nx - 1 else least(fl, ll) + 1 end, match_index + 1)::bigint as next_index, prev + 1 <> nx as stale from r""")
def peer_backoff(t: Inputs):
    rows = t.progress.where("is_self = 0").selectExpr("scenario", "replica_seq", "match_index", "match_index + 20 as next_index", "match_index + replica_seq * 7 as follower_last", "match_index + 19 + replica_seq % 2 as prev_log_index")
    return quorum.peer_backoff(rows.withColumn("leader_last", oplog.last_index(t.op_log)))


_REQUESTS = f"(select table_id, shard_index, replica_seq, member_type <> 'NON_MEMBER' as member, term, (table_id * 7 + replica_seq * 31) % ({_N} + 50) as p, 1 + ((table_id * 7 + replica_seq * 31) * 10 // {_N}) % 10 as pt from replicas)"


@query("append_accept", f"""
    select table_id, shard_index, replica_seq, case when not member then 'REJECT_NOT_MEMBER' when r.term < 2 then 'REJECT_STALE_TERM'
           when p > 0 and p >= 100 and coalesce(l.term, 0) <> pt then 'REJECT_PREV_MISMATCH' else 'ACCEPT' end as decision
    from {_REQUESTS} r left join op_log l on l.idx = r.p""")
def append_accept(t: Inputs):
    n = oplog.last_index(t.op_log)
    at = F.col("table_id") * 7 + F.col("replica_seq") * 31
    requests = t.replicas.select("table_id", "shard_index", "replica_seq", (F.col("member_type") != "NON_MEMBER").alias("member"), "term", (at % (n + 50)).alias("prev_log_index"), (1 + F.floor(at * 10 / n) % 10).alias("prev_log_term"))
    return quorum.append_decision(requests, t.op_log, 2, 100).select("table_id", "shard_index", "replica_seq", "decision")


_HALF = "(select max(idx) // 2 from config_log)"
#: One change after the other, a replica at a time.
_MEMBERS = """(select * from (select replica_seq, list_reduce(list_prepend('NONE', list(op order by idx)), lambda s, o: case o when 'REMOVE_MEMBER' then 'NONE'
    when 'ADD_LEARNER' then case s when 'NONE' then 'LEARNER' else s end else case s when 'NONE' then 'NONE' else 'VOTER' end end) as member_type from config_log{where} group by replica_seq) where member_type <> 'NONE')"""


@query("pending_config_change", f"""
    with p as (select op, replica_seq from config_log where idx > {_HALF} order by idx limit 1), m as {_MEMBERS.format(where=f" where idx <= {_HALF}")}
    select s.s_suppkey as replica_seq, case when m.replica_seq is not null then 'OK_MEMBER' when (select op from p) = 'ADD_LEARNER' and (select replica_seq from p) = s.s_suppkey then 'OK_PENDING'
           when (select op from p) is not null then 'RETRY_ERROR' else 'PROPOSE' end as decision
    from supplier s left join m on m.replica_seq = s.s_suppkey""")
def pending_config_change(t: Inputs):
    half = t.config_log.agg(F.expr("max(idx) div 2")).scalar()
    return quorum.add_learner(t.config_log, t.supplier.select(F.col("s_suppkey").alias("replica_seq")), half)


@query("learner_promotable", f"select scenario, min(replica_seq) as replica_seq from progress where member_type = 'LEARNER' and match_index >= {_N} * 80 // 100 group by scenario")
def learner_promotable(t: Inputs):
    return quorum.promotable(t.progress, share(t.op_log, 80))


@query("membership_fold", f"select replica_seq, member_type from {_MEMBERS.format(where='')}")
def membership_fold(t: Inputs):
    return quorum.membership(t.config_log)


@query("quorum_size", f"select count(*) filter (member_type = 'VOTER') as voters, count(*) filter (member_type = 'VOTER') // 2 + 1 as quorum from {_MEMBERS.format(where='')}")
def quorum_size(t: Inputs):
    return quorum.quorum_size(quorum.membership(t.config_log))


@query("vote_decision", f"""
    with o as (select term as t, idx as i from op_log where term <= 3 order by idx desc limit 1)
    select table_id, shard_index, replica_seq, member_type = 'VOTER' and r.term >= 2 and not ((select t from o) > r.term or (select t from o) = r.term and (select i from o) > (table_id * 13) % {_N})
           and (r.term > 2 or replica_seq = 0) as granted
    from replicas r""")
def vote_decision(t: Inputs):
    own = oplog.tail(t.op_log.where("term <= 3")).withColumn("voted_for", F.lit(0))
    requests = t.replicas.select("table_id", "shard_index", "replica_seq", (F.col("member_type") == "VOTER").alias("voter"), "term", F.col("term").alias("last_term"), (F.col("table_id") * 13 % oplog.last_index(t.op_log)).alias("last_index"), F.col("replica_seq").alias("candidate"))
    return quorum.vote_decision(requests, 2, own).select("table_id", "shard_index", "replica_seq", "granted")


@query("vote_tally", """
    select table_id, shard_index, count(distinct case when member_type = 'VOTER' then replica_seq end) as voters,
           count(distinct case when member_type = 'VOTER' and phase = 'READY' and term >= 2 then replica_seq end) as granted,
           count(distinct case when member_type = 'VOTER' then replica_seq end) > 0 and count(distinct case when member_type = 'VOTER' and phase = 'READY' and term >= 2 then replica_seq end)
               >= count(distinct case when member_type = 'VOTER' then replica_seq end) // 2 + 1 as won
    from replicas group by table_id, shard_index""")
def vote_tally(t: Inputs):
    return quorum.vote_tally(t.replicas.withColumn("granted", (F.col("phase") == "READY") & (F.col("term") >= 2)), ["table_id", "shard_index"])


@query("apply_op_counts", "select op, count(*) as n, max(idx) as last_idx from op_log group by op")
def apply_op_counts(t: Inputs):
    return state.op_counts(t.op_log)


@query("snapshot_restore_roundtrip", f"select k, v, idx from {_LATEST.format(where=_AT)} where rn = 1 and op = 'PUT'")
def snapshot_restore_roundtrip(t: Inputs):
    path = new_path(t.spark, "snapshot")
    state.write_snapshot(t.op_log, share(t.op_log, 50), path)
    return state.read_snapshot(t.op_log, path)


@query("snapshot_due", "select user_id % 4 as shard, max(event_id) + 1 as applied_index, min(event_id) as snapshot_index, max(event_id) + 1 - min(event_id) as behind, max(event_id) + 1 - min(event_id) >= 1000 as due from events group by user_id % 4")
def snapshot_due(t: Inputs):
    applied = t.events.groupBy((F.col("user_id") % 4).alias("shard")).agg((F.max("event_id") + 1).alias("applied_index"), F.min("event_id").alias("snapshot_index"))
    return state.snapshots_due(applied)


@query("recover_snapshot_tail", f"select k, v, idx from {_LATEST.format(where='')} where rn = 1 and op = 'PUT'")
def recover_snapshot_tail(t: Inputs):
    half = share(t.op_log, 50)
    return state.merge(state.fold(t.op_log, half), oplog.recover(t.op_log.withColumn("ok", F.lit(True)), half).drop("ok"))


@query("wal_valid_prefix", f"select idx, term, op, k, v from op_log where idx < {_N} * 70 // 100")
def wal_valid_prefix(t: Inputs):
    wal = t.op_log.where(F.col("idx") != share(t.op_log, 70)).withColumn("ok", F.col("idx") != share(t.op_log, 80))
    return oplog.valid_prefix(wal).drop("ok")


@query("chunk_contiguity", """
    with c as (select page_id % 10 as session, page_id, length(html) as size, coalesce(sum(length(html)) over (partition by page_id % 10 order by page_id rows between unbounded preceding and 1 preceding), 0) + case when page_id % 170 = 163 then 1 else 0 end as o from pages),
    f as (select *, o = coalesce(lag(o + size) over (partition by session order by page_id), 0) as fits from c),
    w as (select *, min(fits::int) over (partition by session order by page_id) as whole from f)
    select session, count(*) as chunks, sum(whole)::bigint as accepted, sum(case when whole = 1 then size else 0 end)::bigint as bytes from w group by session""")
def chunk_contiguity(t: Inputs):
    from pyspark.sql import Window

    rows = t.pages.select((F.col("page_id") % 10).alias("session"), "page_id", F.length("html").cast("long").alias("size"))
    before = F.sum("size").over(Window.partitionBy("session").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1))
    chunks = rows.withColumn("offset", F.coalesce(before, F.lit(0)) + F.when(F.col("page_id") % 170 == 163, 1).otherwise(0))
    return oplog.contiguous(chunks, "session", "page_id")


@query("proposal_batches", """
    with s as (select idx * 10 as seq, op from op_log union all select idx * 10 + 5, op from config_log)
    select seq, op, (2 * sum(case when op in ('ADD_LEARNER', 'PROMOTE_VOTER', 'REMOVE_MEMBER') then 1 else 0 end) over (order by seq) - case when op in ('ADD_LEARNER', 'PROMOTE_VOTER', 'REMOVE_MEMBER') then 1 else 0 end)::bigint as batch from s""")
def proposal_batches(t: Inputs):
    log = t.op_log.select((F.col("idx") * 10).alias("seq"), "op").unionByName(t.config_log.select((F.col("idx") * 10 + 5).alias("seq"), "op"))
    return oplog.batches(log)


@query("proposal_status", f"select idx, case when idx <= {_N} * 50 // 100 then 'OK' else 'NOT_YET_COMMIT' end as status from op_log")
def proposal_status(t: Inputs):
    return t.op_log.select("idx", F.when(F.col("idx") <= share(t.op_log, 50), "OK").otherwise("NOT_YET_COMMIT").alias("status"))



@query("shard_of_key", """
    with keys as (select distinct k from op_log),
    bytes as (select k, hex(k::blob) as h from keys),
    hashed as (select k, list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::int::uhugeint)),
                   lambda a, b: (xor(a, b) * 1099511628211::uhugeint) & 18446744073709551615::uhugeint) as f from bytes)
    select k, (f % 8)::int as shard from hashed""")
def shard_of_key(t: Inputs):
    return t.op_log.select("k").distinct().select("k", shard_index(F.col("k"), 8).alias("shard"))
