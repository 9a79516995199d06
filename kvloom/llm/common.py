"""Shared helpers: durable intermediate tables, and vectorised access to the bytes of Arrow text columns."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \x09 to \x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Text bytes handled at once by the vectorised helpers; working arrays take some 30 times this.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must be set on local-cluster")
        found = "file://" + tempfile.mkdtemp(prefix="kvloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths made in this session, oldest first.
made: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    made.append(path)
    return path


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove paths that nothing will read any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in made:
            made.remove(path)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark removes broadcasts and shuffle files of finished steps only then, and many small jobs would let its heap grow first."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: str, buckets: int, tag: str) -> DataFrame:
    """Like materialize, with rows of one value of `by` in one bucket: joins on it read the rows where they are.

    Only the catalog knows of buckets; its entry is dropped again once the table is resolved, the files stay.
    """
    spark = df.sparkSession
    name, path = f"kvloom_{tag}_{uuid.uuid4().hex}", new_path(spark, tag)
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, by).saveAsTable(name)
    found = spark.table(name)
    found.schema  # noqa: B018
    spark.sql(f"drop table {name}")
    return found


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "left", share: int = 1000, least: int = 10_000) -> DataFrame:
    """rows with the columns of their group (one row for each value of keys, never null, with its number of rows as `size`).

    Groups that hold more than one in `share` of all rows, fewer than `share` in all, are broadcast, so that none of them
    lands in one task; the others are joined by a shuffle.
    """
    total, largest = groups.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    limit = max(least, total // share)
    if largest <= limit:
        return rows.join(groups.drop(size), keys, how)
    hot = groups.where(F.col(size) > limit)
    few = rows.join(F.broadcast(hot.drop(size)), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return few.unionByName(rest.join(groups.where(F.col(size) <= limit).drop(size), keys, how))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken, whatever its case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Arrow batches of at most so many rows from now on: with whole texts, the default of 10,000 takes much memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = (spark.conf.get(key, None) or "").rstrip("bB")
    if held.lstrip("-").isdigit() and not 0 < int(held) <= 16 << 20:
        spark.conf.set(key, str(16 << 20))


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, max_bytes: int = CHUNK_BYTES):
    """(first, last) row ranges with at most max_bytes of text each; a longer text has a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row): words are runs of non-space bytes, never across rows."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_LONG_WORD = 256


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes at a time; spans over _LONG_WORD bytes are hashed one by one."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[:-8] = buf
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    left = ends - starts
    out = mix64((eight[starts] & _LOW_BYTES[np.minimum(left, 8)]) ^ (left.astype(np.uint64) << np.uint64(56)))
    rest = np.flatnonzero((left > 8) & (left <= _LONG_WORD))
    done = 8
    while len(rest):
        out[rest] = mix64(out[rest] + (eight[starts[rest] + done] & _LOW_BYTES[np.minimum(left[rest] - done, 8)]))
        done += 8
        rest = rest[left[rest] > done]
    for i in np.flatnonzero(left > _LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(padded[starts[i] : ends[i]])
    return out
