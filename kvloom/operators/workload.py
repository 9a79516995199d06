"""Load generation and its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import summary


def make_key(i: Column, prefix: str = "bench-key-", digits: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.lpad(i.cast("string"), digits, "0"))


def make_value(i: Column, size: int, prefix: str = "bench-value-") -> Column:
    """Padded with x, or cut, to size."""
    return F.rpad(make_key(i, prefix), size, "x")


def dataset(spark: SparkSession, n: int, prefix: str) -> DataFrame:
    """k, v of a small set: prefix-key-000 and so on."""
    i = F.format_string("%03d", F.col("id"))
    return spark.range(n).select(F.concat(F.lit(f"{prefix}-key-"), i).alias("k"), F.concat(F.lit(f"{prefix}-value-"), i).alias("v"))


def requests(spark: SparkSession, n: int, keys: int, size: int, read_percent: int) -> DataFrame:
    """request_id, op, k, v. Which requests read is a fixed function of their number, close to the share asked for."""
    i = F.col("id")
    read = (i * 7919) % 100 < read_percent
    return spark.range(n).select(i.alias("request_id"), F.when(read, "GET").otherwise("PUT").alias("op"), make_key(i % keys).alias("k"), F.when(~read, make_value(i, size)).alias("v"))


def run_summary(samples: DataFrame, elapsed_s: float) -> DataFrame:
    """One row for samples (latency_us, ok) of one run."""
    one = samples.agg(F.count("*").alias("requests"), F.sum(F.col("ok").cast("long")).alias("success")).withColumn("failure", F.col("requests") - F.col("success"))
    latency = summary(samples.withColumn("run", F.lit(1)), "run").drop("name", "count", "sum_us")
    rates = one.select("*", (F.col("requests") / elapsed_s).alias("attempted_qps"), (F.col("success") / elapsed_s).alias("success_qps"), (F.col("failure") / F.col("requests")).alias("failure_rate"))
    return rates.withColumn("j", F.lit(1)).join(latency.withColumn("j", F.lit(1)), "j").drop("j")


LATENCY = {"min_us": "min", "avg_us": "avg", "p50_us": "p50", "p95_us": "p95", "p99_us": "p99", "max_us": "max"}


def write_json(results: DataFrame, path: str) -> None:
    """Results of runs, one object a run, latencies in an object of their own."""
    latency = F.struct(F.col("requests").alias("count"), *[F.col(c).alias(n) for c, n in LATENCY.items() if c in results.columns])
    results.select(*[c for c in results.columns if c not in LATENCY], latency.alias("latency_us")).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What write_json wrote, with the columns and types of like."""
    held = [f for f in like.schema if f.name in LATENCY]
    nested = ", ".join(f"{LATENCY[f.name]}: {f.dataType.simpleString()}" for f in held)
    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in like.schema if f.name not in LATENCY)
    rows = spark.read.schema(f"{rest}, latency_us struct<{nested}>").json(path)
    return rows.select(*[F.col(f"latency_us.{LATENCY[c]}").alias(c) if c in LATENCY else c for c in like.columns])


def write_csv(results: DataFrame, path: str) -> None:
    """Results of runs, one line a run below a line of names."""
    results.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).option("header", True).csv(path)
