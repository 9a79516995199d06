"""Exact dedup by Grace hash deduplication.

1. Each input task folds its own copies into one entry per content, so a group that holds a third of all rows reaches
   the shuffle as at most one row per task and flush.
2. Entries are dealt by content hash. Each task spills them to files by further hash bits, again and again, until a
   bucket fits an open-addressing table, which compares complete contents.
3. Every document finds its group through the entry it was folded into, not through a digest.

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] becomes one space; null counts as empty. The row with
the smallest id stays (null ids last; of rows with the same id, one stays). An empty table gives an empty result, and
columns other than the id and the text are never looked at.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_parts, materialize, small_batches

_SPACES = b" \t\n\x0b\x0c\r"


def normalise(text: bytes) -> bytes:
    """Each run of [\\x20\\x09-\\x0D] becomes one space, at the ends too."""
    if not text:
        return b""
    body = b" ".join(text.split())
    if not body:
        return b" "
    return (b" " if text[0] in _SPACES else b"") + body + (b" " if text[-1] in _SPACES else b"")


class ContentTable:
    """Open addressing with linear probing; equal hashes are told apart by complete content."""

    def __init__(self) -> None:
        self._mask = 1023
        self._slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[list] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, bool]:
        """(entry, whether it is new)."""
        slots, mask, i = self._slots, self._mask, h & self._mask
        while (e := slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            i = (i + 1) & mask
        e = slots[i] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append([])
        self.bytes += len(content) + 200
        if 2 * len(self.hashes) > mask:
            self._grow()
        return e, True

    def _grow(self) -> None:
        self._mask = 4 * self._mask + 3
        self._slots = slots = [-1] * (self._mask + 1)
        for e, h in enumerate(self.hashes):
            i = h & self._mask
            while slots[i] >= 0:
                i = (i + 1) & self._mask
            slots[i] = e


def _rank(row_id, uid) -> tuple:
    return (row_id is None, row_id if row_id is not None else 0, uid)


def grace(records: Iterator[tuple], memory_bytes: int, fanout_bits: int = 4, level: int = 0) -> Iterator[list]:
    """Groups of (hash, content, count, rank, [entry ids]): yields [count, rank, entries] for each distinct content."""
    table, files, folder = ContentTable(), None, None
    fan = 1 << fanout_bits
    shift = 60 - level * fanout_bits
    try:
        for h, content, count, rank, entries in records:
            if files is None:
                e, new = table.find(h, content)
                if new:
                    table.values[e] = [count, rank, list(entries)]
                else:
                    v = table.values[e]
                    v[0] += count
                    v[1] = min(v[1], rank)
                    v[2].extend(entries)
                table.bytes += 16 * len(entries)
                if table.bytes > memory_bytes and shift >= 0 and len(table.hashes) > 1:
                    folder = tempfile.TemporaryDirectory(prefix="grace-")
                    files = [open(f"{folder.name}/{i}", "w+b") for i in range(fan)]
                    for h, c, v in zip(table.hashes, table.contents, table.values, strict=True):
                        pickle.dump((h, c, *v), files[(h >> shift) & (fan - 1)])
                    table = ContentTable()
            else:
                pickle.dump((h, content, count, rank, entries), files[(h >> shift) & (fan - 1)])
        if files is None:
            yield from table.values
            return
        for f in files:
            f.seek(0)
            yield from grace(_stored(f), memory_bytes, fanout_bits, level + 1)
            f.close()
    finally:
        if folder is not None:
            for f in files:
                f.close()
            folder.cleanup()


def _stored(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _linked(docs: DataFrame, id_col: str, text_col: str, memory_bytes: int, keep_row: bool) -> tuple[DataFrame, DataFrame]:
    """(documents with the entry each was folded into, entries with their group's result)."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("content"),
        (F.struct(*docs.columns) if keep_row else F.lit(None).cast("int")).alias("row"),
    )
    local = T.StructType(
        [
            T.StructField("id", id_type), T.StructField("uid", T.LongType()), T.StructField("entry", T.LongType()),
            T.StructField("sha", T.BinaryType()), T.StructField("content", T.BinaryType()), T.StructField("n", T.LongType()),
            T.StructField("row", rows.schema["row"].dataType), T.StructField("kind", T.IntegerType()),
        ]
    )

    def fold(batches):
        """Kind 0: a document and its entry; kind 1: an entry, with the id and uid of its best row."""
        uid = TaskContext.get().partitionId() << 36
        table: dict[bytes, list] = {}
        held, schema = 0, None

        def made(cols, row, kind):
            arrays = [pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=False)]
            n = len(arrays[0])
            row = pa.nulls(n, schema.field("row").type) if row is None else row
            return pa.RecordBatch.from_arrays([*arrays, row, pa.array([kind] * n, pa.int32())], schema=schema)

        def flush():
            out = [[v[1][0], v[1][1], v[2], sha, v[3], v[0]] for sha, same in table.items() for v in same]
            table.clear()
            for i in range(0, len(out), 2000):
                yield made(list(zip(*out[i : i + 2000], strict=True)), None, 1)

        for batch in batches:
            schema = schema or pa.schema(
                [("id", batch.schema.field(0).type), ("uid", pa.int64()), ("entry", pa.int64()), ("sha", pa.binary()), ("content", pa.binary()), ("n", pa.int64()), ("row", batch.schema.field(2).type), ("kind", pa.int32())]
            )
            buf, off = binary_parts(batch.column(1))
            raw = memoryview(buf)
            out: list[list] = [[], [], [], [], [], []]
            for i, row_id in enumerate(batch.column(0).to_pylist()):
                text = normalise(bytes(raw[off[i] : off[i + 1]]))
                sha = hashlib.sha256(text).digest()
                same = table.setdefault(sha, [])
                v = next((v for v in same if v[3] == text), None)
                if v is None:
                    v = [0, (row_id, uid), uid, text]
                    same.append(v)
                    held += len(text) + 300
                v[0] += 1
                if _rank(row_id, uid) < _rank(*v[1]):
                    v[1] = (row_id, uid)
                for col, x in zip(out, (row_id, uid, v[2], sha, None, 0), strict=True):
                    col.append(x)
                uid += 1
            yield made(out, batch.column(2), 0)
            if held > memory_bytes:
                yield from flush()
                held = 0
        if table:
            yield from flush()

    both = materialize(rows.mapInArrow(fold, local), "exact", ["kind"])
    found = T.StructType([T.StructField("entry", T.LongType()), T.StructField("keep_id", id_type), T.StructField("keep_uid", T.LongType()), T.StructField("group_size", T.LongType())])

    def group(batches):
        id_arrow: list = [None]

        def records():
            for batch in batches:
                id_arrow[0] = batch.schema.field(0).type
                for row_id, uid, entry, sha, content, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield int.from_bytes(sha[:8], "big"), content, n, _rank(row_id, uid), [entry]

        out: list[list] = [[], [], [], []]

        def flushed():
            types = (pa.int64(), id_arrow[0], pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types, strict=True)], names=["entry", "keep_id", "keep_uid", "group_size"])

        for n, (missing, row_id, uid), entries in grace(records(), memory_bytes):
            for entry in entries:
                for col, x in zip(out, (entry, None if missing else row_id, uid, n), strict=True):
                    col.append(x)
            if len(out[0]) >= 10_000:
                yield flushed()
                out = [[], [], [], []]
        if out[0]:
            yield flushed()

    entries = both.where("kind = 1").select("id", "uid", "entry", "sha", "content", "n").repartition("sha")
    return both.where("kind = 0"), entries.mapInArrow(group, found)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = 64 << 20) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. memory_bytes bounds each task's tables."""
    rows, groups = _linked(docs, id_col, text_col, memory_bytes, keep_row=False)
    return rows.select("id", "uid", "entry", "sha").join(groups, "entry").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_bytes: int = 64 << 20) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group."""
    rows, groups = _linked(docs, id_col, text_col, memory_bytes, keep_row=True)
    return rows.select("uid", "entry", "row").join(groups, "entry").where("uid = keep_uid").select("row.*")
