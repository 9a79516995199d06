"""Documents in blocks of some MB, written once and read in place: what is found out elsewhere about a block is sent to it.

A block's home is the task that wrote it; the table is bucketed by home, so that a join with what is sent to the blocks
moves that, and never the texts. Ids may be of any type. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_parts, bucketed, small_batches

#: Rows of a block at most, however short; bits of a task's number of blocks.
MAX_ROWS = 1 << 16
BLOCK_BITS = 14


def pack(values: np.ndarray) -> bytes:
    """Longs, compressed byte plane by byte plane."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<i8")


def packed_values(blob: bytes) -> int:
    """How many longs a blob holds."""
    return zstandard.frame_content_size(blob) // 8


def pack_columns(*columns: np.ndarray) -> bytes:
    return pack(np.concatenate([np.ascontiguousarray(c).view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64) for c in columns]))


def unpack_columns(blob: bytes, number: int) -> np.ndarray:
    return unpack(blob).reshape(number, -1)


def write_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, extra: dict[str, T.DataType] | None = None, describe: Callable | None = None) -> DataFrame:
    """home, block, ids, ends, body, and what describe(body, ends) gives for each of `extra`. Every task ends with a block, maybe without rows.

    describe is made once a task: describe() gives a function of (body, ends, whether it is the task's last block).
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    extra = extra or {}
    names = ["home", "block", "ids", "ends", "body", *extra]

    def run(batches):
        home = TaskContext.get().partitionId()
        number = home << BLOCK_BITS
        tell = describe() if describe else None
        ids, sizes, body, size, kind = [], [], [], 0, None

        def row(last: bool) -> pa.RecordBatch:
            data = b"".join(body)
            ends = np.cumsum(np.concatenate(sizes)) if sizes else np.zeros(0, np.int64)
            values = pa.concat_arrays(ids) if ids else pa.array([], kind)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int64()))]
            more = [pa.array([x], pa.binary()) for x in tell(data, ends, last)] if tell else []
            return pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([number], pa.int64()), *lists, pa.array([data], pa.binary()), *more], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            buf, off = binary_parts(batch.column(1))
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(off, off[first] + block_bytes - size))
                last = min(max(last, first + 1), first + MAX_ROWS - sum(map(len, ids)), batch.num_rows)
                ids.append(batch.column(0).slice(first, last - first))
                sizes.append(np.diff(off[first : last + 1]))
                body.append(buf[off[first] : off[last]].tobytes())
                size += int(off[last] - off[first])
                first = last
                if size >= block_bytes or sum(map(len, ids)) >= MAX_ROWS:
                    yield row(False)
                    ids, sizes, body, size = [], [], [], 0
                    number += 1
                    if number >> BLOCK_BITS != home:
                        raise ValueError(f"more than {1 << BLOCK_BITS} blocks in a task; split the input or enlarge the blocks")
        if kind is not None:
            yield row(True)

    fields = [
        T.StructField("home", T.LongType()), T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("body", T.BinaryType()), *[T.StructField(k, t) for k, t in extra.items()],
    ]
    return bucketed(rows.mapInArrow(run, T.StructType(fields)), "home", int(spark.conf.get("spark.sql.shuffle.partitions")), "blocks")


def beside(blocks: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """blocks with a column more: what `values` (block, name) has for them, at most one row a block; null where there is none."""
    sent = values.select(F.shiftright("block", BLOCK_BITS).alias("home"), F.struct("block", F.col(name).alias("value")).alias("x"))
    lists = sent.groupBy("home").agg(F.collect_list("x").alias("sent"))
    own = F.filter("sent", lambda x: x["block"] == F.col("block"))
    return blocks.join(lists.hint("shuffle_hash"), "home", "left").withColumn(name, F.get(own, F.lit(0))["value"]).drop("sent")


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i] for c in batch.columns)
        pa.default_memory_pool().release_unused()  # workers stay, beside the JVM
