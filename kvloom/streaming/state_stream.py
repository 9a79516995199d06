"""The log as a stream: state is folded batch by batch, with the same rule as in batch, into versioned tables.

State lies in buckets of keys. Each micro-batch merges its last op of each key with the newest version of the buckets that
it touches, and writes those anew to a folder named by the batch; other buckets stay as they are. A batch that runs again
reads and writes the same versions again, so results do not depend on retries. Tombstones are kept in the state with their
idx, so late entries with smaller idx change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.operators.state import FOLDED


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k").agg(F.max_by(F.struct("op", "v"), "idx").alias("last"), F.max("idx").alias("idx")).select("k", "last.op", "last.v", "idx")


def _newest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """Folder of the newest version of each bucket, from the folders' names alone; only versions that are complete, and below `before`."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, str] = {}
    if not fs.exists(root):
        return found
    numbers = sorted(int(n.split("=")[1]) for n in (s.getPath().getName() for s in fs.listStatus(root)) if n.startswith("version="))
    for number in numbers:
        folder = f"{path}/version={number}"
        if (before is None or number < before) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")):
            for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder)):
                if s.getPath().getName().startswith("bucket="):
                    found[int(s.getPath().getName().split("=")[1])] = f"{folder}/{s.getPath().getName()}"
    return found


def fold_stream(log: DataFrame, path: str, checkpoint: str, available_now: bool = True, buckets: int = 64):
    """Start folding a streaming log (idx, op, k, v) into versions under path. buckets stays the same for a path."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col("op").isin(*FOLDED)).select("k", "op", "v", "idx")
        bucket = F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")
        touched = {r.b for r in rows.select(bucket.alias("b")).distinct().collect()}  # at most `buckets` rows
        old = [p for b, p in _newest(spark, path, number).items() if b in touched]
        if old:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*old))
        _last(rows).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={number}")

    writer = log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """k, v, idx of the newest versions under path."""
    folders = list(_newest(spark, path).values())
    schema = "k string, op string, v string, idx long"
    rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return rows.where("op = 'PUT'").select("k", "v", "idx")


def op_counts(log: DataFrame) -> DataFrame:
    """Running n and last idx of each op, for complete or update mode."""
    return log.groupBy("op").agg(F.count("*").alias("n"), F.max("idx").alias("last_idx"))
