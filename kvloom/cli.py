"""A shell over the store: one command a line, words split at white space.

    python -m kvloom.cli PATH
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from kvloom.api import Store

USAGE = "create_db DB | drop_db DB | create_table DB TABLE [SHARDS [REPLICAS]] | alter_table DB TABLE REPLICAS | drop_table DB TABLE | get_table DB TABLE | wait_table DB TABLE | tables DB | put DB TABLE K V | get DB TABLE K | delete DB TABLE K | route DB TABLE K | routes DB TABLE | scan DB TABLE | snapshot DB TABLE | demo | help | quit"

ALIASES = {"exit": "quit", "set": "put", "del": "delete", "ls": "tables", "create": "create_table", "drop": "drop_table", "alter": "alter_table", "?": "help"}
DEMO = ["create_db demo", "create_table demo t 2", "put demo t k v", "get demo t k", "routes demo t", "delete demo t k", "get demo t k", "drop_table demo t", "drop_db demo"]


def run(store: Store, lines: Iterable[str]) -> Iterator[str]:
    """The answer to each command."""
    for line in lines:
        name, *args = line.split() or ["help"]
        name = ALIASES.get(name, name)
        try:
            if name == "quit":
                return
            if name == "demo":
                yield from (f"{x}: {answer}" for x in DEMO for answer in run(store, [x]))
                continue
            if name == "help":
                yield USAGE
            elif name in ("create_db", "drop_db", "put", "delete", "drop_table", "wait_table"):
                yield getattr(store, name)(*args)
            elif name == "create_table":
                yield store.create_table(*args[:2], *map(int, args[2:]))
            elif name == "alter_table":
                yield store.alter_table(*args[:2], int(args[2]))
            elif name == "get":
                status, value = store.get(*args)
                yield value if status == "OK" else status
            elif name == "route":
                status, shard = store.route(*args)
                yield f"shard {shard}" if status == "OK" else status
            elif name == "routes":
                yield "\n".join(f"shard {r.shard}: leader local, last index {r.last}" for r in store.routes(*args).orderBy("shard").collect()) or "TABLE_NOT_FOUND"
            elif name == "get_table":
                row = store._table(*args)
                yield "TABLE_NOT_FOUND" if row is None else f"{row.table_name}: shards {row.shard_count}, replicas {row.replica_count}, {row.state}"
            elif name == "tables":
                yield "\n".join(r.table_name for r in store.list_tables(*args).orderBy("table_name").collect())
            elif name == "scan":
                # the output of a shell, not of a job: rows come one at a time
                yield "\n".join(f"{r.k}\t{r.v}" for r in store.scan(*args).toLocalIterator())
            elif name == "snapshot":
                yield "written" if store.snapshot(*args) else "not due"
            else:
                yield f"unknown command: {name}"
        except (TypeError, ValueError, IndexError) as e:
            yield f"INVALID_ARGUMENT: {e}"


def main() -> None:
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    for answer in run(Store(spark, sys.argv[1]), sys.stdin):
        print(answer, flush=True)


if __name__ == "__main__":
    main()
