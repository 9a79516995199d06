"""A small store over the operators: databases, sharded tables, puts, gets, deletes and routes, in batches.

Under its path: catalog versions, one op log a table (Parquet, by batch of writes and shard), the last index of each shard, and
snapshots. Requests come and go as DataFrames with a status column; single-key calls are batches of one. Reads name the
shard, so only its files are read, and begin at the last snapshot. A write is visible once its Parquet commit is; there is
no consensus, and one writer at a time is assumed. Tables go through the states of the catalog; what waits is settled at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvloom.functions.hashing import shard_index
from kvloom.operators import catalog, state

_DBS = "db_id long, db_name string"
_TABLES = "table_id long, db_id long, table_name string, shard_count int, replica_count int, state string"
_LOG = "idx long, term long, op string, k string, v string, batch long, shard int"
_SNAPSHOT = "k string, v string, idx long, upto long, shard int"
_HEADS = "shard int, last long"

#: Values of seq that are numbered together.
_BLOCK = 1 << 16


class Store:
    def __init__(self, spark: SparkSession, path: str, term: int = 1, snapshot_every: int = 1000) -> None:
        self.spark, self.path, self.term, self.snapshot_every = spark, path.rstrip("/"), term, snapshot_every

    # Files

    def _versions(self, folder: str, kind: str = "version") -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.startswith(f"{kind}=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def _load(self, folder: str, schema: str) -> DataFrame:
        versions = self._versions(folder)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/version={versions[-1]}") if versions else self.spark.createDataFrame([], schema)

    def _save(self, folder: str, rows: DataFrame) -> None:
        versions = self._versions(folder)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{folder}/version={(versions or [0])[-1] + 1}")

    # Catalog

    @property
    def dbs(self) -> DataFrame:
        return self._load("dbs", _DBS)

    @property
    def tables(self) -> DataFrame:
        return self._load("tables", _TABLES)

    def create_db(self, name: str) -> str:
        dbs = self.dbs
        row = catalog.create_dbs(dbs, self.spark.createDataFrame([(name,)], "db_name string")).first()
        if row.status == "OK":
            self._save("dbs", dbs.unionByName(self.spark.createDataFrame([(row.db_id, name)], _DBS)))
        return row.status

    def drop_db(self, name: str) -> str:
        row = self.dbs.where(F.col("db_name") == name).first()
        if row is None:
            return "DB_NOT_FOUND"
        mine = self.tables.where(F.col("db_id") == row.db_id)
        if not mine.isEmpty() and not catalog.droppable_dbs(mine).first().droppable:
            return "INVALID_ARGUMENT"
        self._save("dbs", self.dbs.where(F.col("db_id") != row.db_id))
        return "OK"

    def create_table(self, db: str, name: str, shards: int = 2, replicas: int = 3) -> str:
        tables = self.tables
        known = self.dbs.where(F.col("db_name") == db).first()
        request = self.spark.createDataFrame([(0, known.db_id if known else -1, name, shards, replicas)], "req_id int, db_id long, table_name string, shard_count int, replica_count int")
        status = catalog.create_tables(request, self.dbs, tables).first().status
        if status == "OK":
            new = (tables.agg(F.coalesce(F.max("table_id") + 1, F.lit(0))).first()[0], known.db_id, name, shards, replicas, "ADDING")
            self._save("tables", tables.unionByName(self.spark.createDataFrame([new], _TABLES)))
            self._settle()
        return status

    def _settle(self) -> None:
        """End what is under way: no replicas are moved here, so placement is done as soon as it is asked for."""
        tables = self.tables
        placed = tables.select("table_id", F.when(F.col("state") == "DROPPING", "DELETED").otherwise("READY").alias("phase"), F.lit("OK").alias("rpc_status"))
        moved = catalog.reconcile(tables, placed).select("table_id", "next_state")
        self._save("tables", tables.join(moved, "table_id", "left").withColumn("state", F.coalesce("next_state", "state")).select(*tables.columns))

    def wait_table(self, db: str, name: str) -> str:
        """OK once the table is NORMAL."""
        row = self._table(db, name)
        return "TABLE_NOT_FOUND" if row is None else "OK" if row.state == "NORMAL" else "RETRY_ERROR"

    def _table(self, db: str, name: str):
        joined = catalog.live(self.tables).join(self.dbs, "db_id")
        return joined.where((F.col("db_name") == db) & (F.col("table_name") == name)).first()

    def alter_table(self, db: str, name: str, replicas: int) -> str:
        row = self._table(db, name)
        if row is None:
            return "TABLE_NOT_FOUND"
        decided = catalog.alter_replica_count(self.tables.where(F.col("table_id") == row.table_id).withColumn("new_count", F.lit(replicas))).first()
        if decided.status == "OK":
            mine = F.col("table_id") == row.table_id
            changed = self.tables.withColumn("replica_count", F.when(mine, F.lit(replicas)).otherwise(F.col("replica_count")))
            self._save("tables", changed.withColumn("state", F.when(mine, F.lit(decided.next_state)).otherwise(F.col("state"))))
            self._settle()
        return decided.status

    def drop_table(self, db: str, name: str) -> str:
        row = self._table(db, name)
        if row is None:
            return "TABLE_NOT_FOUND"
        decided = catalog.drop_tables(self.tables.where(F.col("table_id") == row.table_id)).first()
        if decided.status == "OK":
            self._save("tables", self.tables.withColumn("state", F.when(F.col("table_id") == row.table_id, decided.next_state).otherwise(F.col("state"))))
            self._settle()
        return decided.status

    def list_tables(self, db: str) -> DataFrame:
        return catalog.list_tables(self.tables).join(self.dbs.where(F.col("db_name") == db), "db_id").select("table_id", "table_name", "shard_count", "replica_count", "state")

    # Data

    def _log(self, table_id: int) -> DataFrame:
        path = f"{self.path}/log/table_id={table_id}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], _LOG)
        return self.spark.read.schema(_LOG).parquet(path)

    def apply(self, db: str, name: str, writes: DataFrame) -> str:
        """Append writes (seq, op, k, v) in the order of seq, each shard by itself."""
        row = self._table(db, name)
        if row is None:
            return "TABLE_NOT_FOUND"
        heads, batch = self._heads(row.table_id)
        placed = writes.withColumn("shard", shard_index(F.col("k"), row.shard_count)).withColumn("block", F.floor(F.col("seq") / _BLOCK))
        # numbers within blocks of seq, on top of the counts of earlier blocks of the shard
        sums = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
        earlier = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        before = sums.join(heads, "shard", "left").select("shard", F.col("block").alias("at"), (F.coalesce(earlier, F.lit(0)) + F.coalesce("last", F.lit(0))).alias("before"))
        rows = placed.join(before.withColumnRenamed("shard", "own"), F.expr("shard = own and block <=> at"))
        number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("seq"))
        entries = rows.select((F.col("before") + number).alias("idx"), F.lit(self.term).cast("long").alias("term"), "op", "k", F.when(F.col("op") == "DEL", "").otherwise(F.col("v")).alias("v"), "shard")
        entries.write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/log/table_id={row.table_id}/batch={batch + 1}")
        heads, batch = self._heads(row.table_id)
        heads.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/heads/table_id={row.table_id}/version={batch}")
        return "OK"

    def _heads(self, table_id: int) -> tuple[DataFrame, int]:
        """(last index of each shard, last batch): what was noted, and the batches since then."""
        noted = self._versions(f"heads/table_id={table_id}")
        batches = self._versions(f"log/table_id={table_id}", "batch")
        heads = self._load(f"heads/table_id={table_id}", _HEADS)
        fresh = [b for b in batches if b > (noted or [0])[-1]]
        if fresh:
            log = self._log(table_id).where(F.col("batch").isin(fresh))
            heads = heads.unionByName(log.groupBy("shard").agg(F.max("idx").alias("last")))
        return heads.groupBy("shard").agg(F.max("last").alias("last")), (batches or [0])[-1]

    def put(self, db: str, name: str, key: str, value: str) -> str:
        return self.apply(db, name, self.spark.createDataFrame([(0, "PUT", key, value)], "seq long, op string, k string, v string"))

    def delete(self, db: str, name: str, key: str) -> str:
        return self.apply(db, name, self.spark.createDataFrame([(0, "DEL", key, "")], "seq long, op string, k string, v string"))

    def state(self, db: str, name: str) -> DataFrame:
        """k, v of a table: the last snapshot with the log after it."""
        row = self._table(db, name)
        if row is None:
            return self.spark.createDataFrame([], "k string, v string, idx long")
        log = self._log(row.table_id)
        folder = f"snapshot/table_id={row.table_id}"
        if not self._versions(folder):
            return state.fold(log)
        snapshot = self._load(folder, _SNAPSHOT)
        marks = snapshot.groupBy("shard").agg(F.max("upto").alias("upto"))
        tail = log.join(marks, "shard", "left").where("upto is null or idx > upto")
        return state.merge(snapshot.where("k is not null").select("k", "v", "idx"), tail)

    def snapshot(self, db: str, name: str) -> bool:
        """Write a snapshot if some shard is snapshot_every entries past the last one."""
        row = self._table(db, name)
        if row is None:
            return False
        folder = f"snapshot/table_id={row.table_id}"
        ends = self._heads(row.table_id)[0].withColumnRenamed("last", "applied_index")
        old = self._load(folder, _SNAPSHOT).groupBy("shard").agg(F.max("upto").alias("snapshot_index"))
        due = state.snapshots_due(ends.join(old, "shard", "left").withColumn("snapshot_index", F.coalesce("snapshot_index", F.lit(0))), self.snapshot_every)
        if due.where("due").isEmpty():
            return False
        rows = self.state(db, name).withColumn("shard", shard_index(F.col("k"), row.shard_count)).join(ends.withColumnRenamed("applied_index", "upto"), "shard")
        # a shard without keys still has its place
        marks = ends.select("shard", F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("v"), F.lit(None).cast("long").alias("idx"), F.col("applied_index").alias("upto"))
        version = (self._versions(folder) or [0])[-1] + 1
        rows.unionByName(marks).write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/{folder}/version={version}")
        return True

    def get(self, db: str, name: str, key: str) -> tuple[str, str | None]:
        row = self._table(db, name)
        if row is None:
            return "TABLE_NOT_FOUND", None
        shard = self.spark.range(1).select(shard_index(F.lit(key), row.shard_count).alias("s")).first().s
        mine = (F.col("shard") == shard) & (F.col("k") == key)
        tail, folder = self._log(row.table_id).where(mine), f"snapshot/table_id={row.table_id}"
        if self._versions(folder):
            snapshot = self._load(folder, _SNAPSHOT)
            upto = snapshot.where(F.col("shard") == shard).agg(F.coalesce(F.max("upto"), F.lit(0))).scalar()
            tail = state.merge(snapshot.where(mine).select("k", "v", "idx"), tail.where(F.col("idx") > upto))
        else:
            tail = state.fold(tail)
        found = state.get(tail, self.spark.createDataFrame([(key,)], "k string")).first()
        return found.status, found.v

    def multi_get(self, db: str, name: str, keys: DataFrame) -> DataFrame:
        return state.get(self.state(db, name), keys)

    def scan(self, db: str, name: str) -> DataFrame:
        return state.scan(self.state(db, name))

    def routes(self, db: str, name: str) -> DataFrame:
        """shard, last: every shard of a table, with the last index of its log; all of them are written here."""
        row = self._table(db, name)
        if row is None:
            return self.spark.createDataFrame([], _HEADS)
        shards = self.spark.range(row.shard_count).select(F.col("id").cast("int").alias("shard"))
        return shards.join(self._heads(row.table_id)[0], "shard", "left").select("shard", F.coalesce("last", F.lit(0)).alias("last"))

    def route(self, db: str, name: str, key: str) -> tuple[str, int | None]:
        """The shard of a key."""
        row = self._table(db, name)
        if row is None:
            return "TABLE_NOT_FOUND", None
        return "OK", self.spark.range(1).select(shard_index(F.lit(key), row.shard_count).alias("s")).first().s
