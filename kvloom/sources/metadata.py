"""Metadata that lasts: named tables that change together.

A commit writes the tables that changed into folders of its own, and then a small manifest that names the folder of every
table. Readers follow the newest manifest, so they see all of a commit or nothing of it. One writer at a time is assumed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import new_path

REPLICA = ["table_id", "shard_index", "replica_seq"]

#: The tables of a store: columns, and those that identify a row.
TABLES = {
    "hard_state": ("table_id long, shard_index int, replica_seq int, term long, voted_for string", REPLICA),
    "local_replicas": ("table_id long, shard_index int, replica_seq int, node_no long, members string", REPLICA),
    "tables": ("table_id long, shard_count int, replica_count int, desired string, phase string, operation_id string", ["table_id"]),
    "replicas": ("table_id long, shard_index int, replica_seq int, node_no long, desired string, phase string, role string, member_type string, term long", REPLICA),
    "pools": ("resource_pool string, node_id string, dc string, status string", ["node_id"]),
    "groups": ("table_id long, shard_index int, target_replica_count int, mode string, next_seq long", REPLICA[:2]),
}


class Changes:
    """Changes to be committed; reads see them."""

    def __init__(self, store: MetadataStore) -> None:
        self.store, self.changed = store, {}

    def read(self, name: str) -> DataFrame:
        return self.changed[name] if name in self.changed else self.store.read(name)

    def put(self, name: str, rows: DataFrame) -> None:
        """Add rows, in place of those with the same key. Of rows with equal keys, any one is kept."""
        new = self.store.typed(name, rows).dropDuplicates(self.store.keys(name))
        self.changed[name] = self.read(name).join(new.select(*self.store.keys(name)), self.store.keys(name), "left_anti").unionByName(new)

    def remove(self, name: str, keys: DataFrame) -> None:
        """Remove the rows with the given keys; keys that are not there do not matter."""
        by = [k for k in self.store.keys(name) if k in keys.columns]
        self.changed[name] = self.read(name).join(keys.select(*by), by, "left_anti")

    def clear(self, name: str) -> None:
        self.changed[name] = self.read(name).where(F.lit(False))


class MetadataStore:
    def __init__(self, spark: SparkSession, path: str | None = None, tables: dict | None = None) -> None:
        """Without a path, the store lasts as long as the session."""
        self.spark, self.path, self.tables = spark, (path or new_path(spark, "metadata")).rstrip("/"), tables or TABLES

    def keys(self, name: str) -> list[str]:
        return self.tables[name][1]

    def typed(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with the columns and types of a table; other columns are left out."""
        wanted = self.spark.createDataFrame([], self.tables[name][0]).schema
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])

    def _at(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Numbers of the commits, in order."""
        fs, p = self._at("manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int) -> dict[str, int]:
        fs, p = self._at("manifest", str(version))
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a commit, the last one by default; empty if it was never written."""
        done = self.versions() if version is None else [version]
        folder = self._manifest(done[-1]).get(name) if done else None
        schema = self.tables[name][0]
        return self.spark.createDataFrame([], schema) if folder is None else self.spark.read.schema(schema).parquet(f"{self.path}/data/{folder}/{name}")

    def get(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows with the given keys, which may be some of the key's columns."""
        return self.read(name).join(keys, [k for k in self.keys(name) if k in keys.columns], "left_semi")

    @contextmanager
    def write(self) -> Iterator[Changes]:
        """Changes, committed together at the end; none of them if the block fails."""
        changes = Changes(self)
        yield changes
        if changes.changed:
            self._commit(changes.changed)

    def _commit(self, changed: dict[str, DataFrame]) -> None:
        done = self.versions()
        number = (done or [0])[-1] + 1
        for name, rows in changed.items():
            # rows in the order of their key, so that a read of some keys skips the rest
            self.typed(name, rows).repartitionByRange(*self.keys(name)).sortWithinPartitions(*self.keys(name)).write.mode("overwrite").parquet(f"{self.path}/data/{number}/{name}")
        folders = (self._manifest(done[-1]) if done else {}) | dict.fromkeys(changed, number)
        fs, draft = self._at("manifest", f"{number}.draft")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(folders).encode()))
        finally:
            stream.close()
        if not fs.rename(draft, self._at("manifest", str(number))[1]):
            raise OSError(f"commit {number} could not be published")

    def vacuum(self, keep: int = 2) -> int:
        """Remove what only commits before the last `keep` ones name; the number of commits removed."""
        done = self.versions()
        old, kept = done[:-keep], done[-keep:]
        used = {(n, f) for v in kept for n, f in self._manifest(v).items()}
        for version in old:
            for name, folder in self._manifest(version).items():
                if (name, folder) not in used:
                    fs, p = self._at("data", str(folder), name)
                    fs.delete(p, True)
            fs, p = self._at("manifest", str(version))
            fs.delete(p, False)
        return len(old)
