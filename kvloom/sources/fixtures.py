"""Inputs derived from the base tables: one statement each, which Spark and DuckDB both run.

They model an op log, nodes, replicas and so on, with values chosen so that every branch of the operators is reached.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    "op_log": """
        select cast(event_id + 1 as bigint) as idx,
               1 + cast(floor(event_id * 10 / (select count(*) from events)) as bigint) as term,
               case event_type when 'error' then 'DEL' when 'view' then 'NONE' else 'PUT' end as op,
               case when event_type = 'view' then '' else concat('user-', cast(user_id as string)) end as k,
               case when event_type in ('error', 'view') then '' else props end as v
        from events""",
    "nodes": """
        select s_suppkey as node_no, concat('storage-', cast(s_suppkey as string)) as node_id,
               case when s_suppkey % 5 = 0 then 'pool-b' else 'default' end as resource_pool,
               concat('dc', cast(s_nationkey % 3 + 1 as string)) as dc,
               case when s_suppkey % 6 = 0 then 'OFFLINE' when s_suppkey % 6 = 1 then 'SUSPECT' else 'ONLINE' end as status,
               cast((s_suppkey * 7919) % 45000 as bigint) as heartbeat_age_ms
        from supplier""",
    "catalog_tables": """
        select p_partkey as table_id, cast(p_size % 5 as int) as db_id, concat('t', cast(p_partkey as string)) as table_name,
               cast(1 + p_partkey % 3 as int) as shard_count, cast(p_partkey % 4 as int) as replica_count,
               case p_size % 6 when 0 then 'ADDING' when 1 then 'NORMAL' when 2 then 'FAILED'
                               when 3 then 'DROPPING' when 4 then 'DELETED' else 'ALTERING' end as state
        from part""",
    "sdm_status": """
        select p_partkey as table_id,
               case p_partkey % 6 when 0 then 'CREATING' when 1 then 'READY' when 2 then 'DELETING'
                                  when 3 then 'DELETED' when 4 then 'FAILED' else 'RESIZING' end as phase,
               case when p_partkey % 23 = 0 then 'RPC_ERROR' else 'OK' end as rpc_status
        from part where p_partkey % 9 <> 0""",
    "replicas": """
        select p.p_partkey as table_id, s.shard_index, r.replica_seq,
               cast((p.p_partkey * 3 + s.shard_index * 11 + r.replica_seq * 37) % (select count(*) from supplier) as bigint) as node_no,
               case when p.p_partkey % 17 = 0 then 'ABSENT' else 'PRESENT' end as desired,
               case (p.p_partkey + r.replica_seq) % 11 when 0 then 'LOST' when 1 then 'ERROR' when 2 then 'CREATING'
                                                       when 3 then 'DELETING' else 'READY' end as phase,
               case when r.replica_seq = p.p_partkey % 4 or (r.replica_seq = 0 and p.p_partkey % 10 = 1) then 'LEADER' else 'FOLLOWER' end as role,
               case (p.p_partkey + 2 * r.replica_seq) % 8 when 0 then 'NON_MEMBER' when 1 then 'LEARNER' else 'VOTER' end as member_type,
               case (p.p_partkey * 2 + r.replica_seq) % 9 when 0 then 'FAULTED' when 1 then 'RECOVERING'
                                                          when 2 then 'INITIALIZING' else 'READY' end as storage_status,
               case when (p.p_partkey + r.replica_seq) % 5 = 0 then 1 else 0 end as observed_no_exist,
               cast(p.p_size % 5 + case when r.replica_seq = 1 and p.p_partkey % 3 = 0 then 1 else 0 end as bigint) as term
        from part p
        join (select 0 as shard_index union all select 1 union all select 2) s on s.shard_index < 1 + p.p_partkey % 3
        cross join (select 0 as replica_seq union all select 1 union all select 2) r""",
    "group_members": """
        select table_id, shard_index, replica_seq, replica_seq as pos,
               cast(1 + table_id % 3 as int) as target_replica_count,
               case when table_id % 4 = 0 then 'BOOTSTRAP' else 'RAFT_RECONFIG' end as mode
        from replicas where (table_id + replica_seq) % 13 <> 5""",
    "heartbeat_reports": """
        select table_id, shard_index, replica_seq,
               case when table_id % 19 = 0 then (node_no + 1) % (select count(*) from supplier) else node_no end as node_no,
               role, storage_status, term
        from replicas where (table_id * 5 + replica_seq) % 4 <> 0""",
    "progress": """
        select z.scenario, r.replica_seq,
               cast(floor(m.last_index * (100 - z.step * r.replica_seq) / 100) as bigint) as match_index,
               case when r.replica_seq = 5 then 'LEARNER' else 'VOTER' end as member_type,
               case when r.replica_seq = 0 then 1 else 0 end as is_self
        from (select max(event_id) + 1 as last_index from events) m
        cross join (select 'majority' as scenario, 2 as step union all select 'minority', 18) z
        cross join (select 0 as replica_seq union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) r""",
    "config_log": """
        select idx, op, replica_seq from (
          select 6 * s_suppkey + 1 as idx, 'ADD_LEARNER' as op, s_suppkey as replica_seq from supplier
          union all select 6 * s_suppkey + 2, 'PROMOTE_VOTER', s_suppkey from supplier where s_suppkey % 3 <> 0
          union all select 6 * s_suppkey + 3, 'ADD_LEARNER', s_suppkey from supplier where s_suppkey % 5 = 0
          union all select 6 * s_suppkey + 4, 'REMOVE_MEMBER', s_suppkey from supplier where s_suppkey % 4 = 0
          union all select 6 * s_suppkey + 5, 'PROMOTE_VOTER', s_suppkey from supplier where s_suppkey % 8 = 0
          union all select 6 * s_suppkey + 6, 'ADD_LEARNER', s_suppkey from supplier where s_suppkey % 16 = 0) c""",
    "groups": """
        select c.table_id, s.shard_index, cast(case when c.table_id % 11 = 0 then 0 else 1 + c.table_id % 3 end as int) as target_replica_count,
               case when c.table_id % 4 = 0 then 'BOOTSTRAP' else 'RAFT_RECONFIG' end as mode
        from catalog_tables c join (select 0 as shard_index union all select 1 union all select 2) s on s.shard_index < c.shard_count
        where c.table_id % 7 <> 3""",
    "sparse_members": "select * from group_members where table_id % 5 <> 2 and table_id % 22 <> 11",
    "scraped_histograms": """
        select concat('target-', cast(s.target as string)) as target, s.ts, s.name, b.le, s.n * b.share as cum, s.n * 10 as count, s.n * 50 as sum_us, s.error
        from (select user_id % 6 as target, event_type as name, cast(floor(event_id / 500) as bigint) as ts, count(*) as n,
                     case when cast(floor(event_id / 500) as bigint) % 5 = 3 then 'timeout' end as error
              from events group by user_id % 6, event_type, cast(floor(event_id / 500) as bigint)) s
        cross join (select cast(10 as bigint) as le, 2 as share union all select 100, 6 union all select 5000, 9 union all select null, 10) b""",
    "latency_samples": """
        select event_id as sample_id, event_type as metric, cast(round(value * 100) as bigint) as latency_us,
               case when event_type = 'error' then 0 else 1 end as ok
        from events""",
}


def _names(sql: str) -> list[str]:
    return [n for n in (*BASE, *SQL) if re.search(rf"\b(?:from|join)\s+{n}\b", sql)]


class Inputs:
    """The tables of a folder, and what is derived from them, by name. Derived tables are read lazily and shared."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*BASE, *SQL):
            raise AttributeError(name)
        if name not in self._known:
            if name in BASE:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = SQL[name]
                for n in _names(sql):
                    sql = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", sql)
                self._known[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in _names(SQL[name])})
        return self._known[name]


def with_inputs(sql: str) -> str:
    """sql for DuckDB, with the derived tables that it names as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in _names(text):
            if n in SQL and n not in need:
                add(SQL[n])
                need.append(n)

    add(sql)
    parts = ", ".join(f"{n} as ({SQL[n]})" for n in need)
    if not parts:
        return sql
    head = sql.lstrip()
    if head.lower().startswith("with recursive "):
        return f"with recursive {parts}, {head[15:]}"
    return f"with {parts}, {head[5:]}" if head.lower().startswith("with ") else f"with {parts} {head}"
