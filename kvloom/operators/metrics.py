"""Latency and counter analytics: histograms, deltas, two percentile rules, text exposition.

A histogram is long: name, le (bound in microseconds, null for +Inf), cum (samples at or below le), count, sum_us.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of latency buckets in microseconds; one more bucket takes the rest.
BOUNDS = [10, 25, 50, 75, 100, 150, 200, 250, 500, 750, 1000, 2000, 5000, 10000, 20000, 50000, 100000, 250000, 500000, 1000000]


def counters(samples: DataFrame, name: str, delta: Column) -> DataFrame:
    return samples.groupBy(F.col(name).alias("name")).agg(F.sum(delta).cast("long").alias("value"))


def histogram(samples: DataFrame, name: str = "metric", value: str = "latency_us") -> DataFrame:
    """Cumulative buckets of each name: one pass with a conditional sum for each bound, then rows for the bounds."""
    at_most = [F.sum((F.col(value) <= b).cast("long")) for b in BOUNDS]
    found = samples.groupBy(F.col(name).alias("name")).agg(F.array(*at_most, F.count(value)).alias("cums"), F.count(value).alias("count"), F.sum(value).cast("long").alias("sum_us"))
    bounds = F.array(*[F.lit(b).cast("long") for b in BOUNDS], F.lit(None).cast("long"))
    pairs = F.arrays_zip(bounds.alias("le"), F.col("cums").alias("cum"))
    return found.withColumn("p", F.explode(pairs)).select("name", F.col("p")["le"].alias("le"), F.col("p")["cum"].alias("cum"), "count", "sum_us")


def summary(samples: DataFrame, name: str = "metric", value: str = "latency_us", percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Count, sum, least, largest, mean, and percentiles by rank (p (n - 1) + 99) div 100 from 0, over sorted values.

    Equal values are counted first, so what is ranked is the different values of a name, not its samples.
    """
    values = samples.groupBy(F.col(name).alias("name"), F.col(value).alias("x")).agg(F.count("*").alias("c"))
    running = F.sum("c").over(Window.partitionBy("name").orderBy("x"))
    n = F.sum("c").over(Window.partitionBy("name"))
    ranked = values.withColumn("upto", running).withColumn("n", n)
    picks = [F.min(F.when(F.col("upto") > F.expr(f"({p} * (n - 1) + 99) div 100"), F.col("x"))).alias(f"p{p}_us") for p in percents]
    total = F.sum(F.col("x") * F.col("c"))
    return ranked.groupBy("name").agg(
        F.sum("c").alias("count"), total.cast("long").alias("sum_us"), F.min("x").alias("min_us"), F.max("x").alias("max_us"), (total / F.sum("c")).alias("avg_us"), *picks
    )


def positive_delta(now: Column, before: Column) -> Column:
    """A counter that went back was reset, and counts nothing."""
    return F.greatest(F.coalesce(now, F.lit(0)) - F.coalesce(before, F.lit(0)), F.lit(0))


def histogram_delta(now: DataFrame, before: DataFrame) -> DataFrame:
    old = before.select("name", "le", F.col("cum").alias("cum0"), F.col("count").alias("count0"), F.col("sum_us").alias("sum0"))
    on = now["name"].eqNullSafe(old["name"]) & now["le"].eqNullSafe(old["le"])
    both = now.join(old, on, "full")
    return both.select(
        F.coalesce(now["name"], old["name"]).alias("name"), F.coalesce(now["le"], old["le"]).alias("le"), positive_delta(now["cum"], F.col("cum0")).alias("cum"),
        positive_delta(now["count"], F.col("count0")).alias("count"), positive_delta(now["sum_us"], F.col("sum0")).alias("sum_us"),
    )


def percentile_bounds(buckets: DataFrame, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """The least bound with a share of the samples at or below it; null without samples, or if only the unbounded bucket has."""
    # le is null for the unbounded bucket, which min passes over
    picks = [F.min(F.when((F.col("count") > 0) & (F.col("cum") * 100 >= F.col("count") * p), F.col("le"))).alias(f"p{p}_us") for p in percents]
    one = buckets.groupBy("name").agg(F.max("count").alias("count"), F.max("sum_us").alias("sum_us"), *picks)
    return one.select("name", "count", F.when(F.col("count") > 0, F.col("sum_us") / F.col("count")).alias("avg_us"), *[f"p{p}_us" for p in percents])


def report(scrapes: DataFrame, from_zero: bool = False) -> DataFrame:
    """scrapes (target, ts, name, value, error) to target, name, delta, rate: last against first good scrape of a target.

    From zero, the baseline is nothing at the first scrape of all. Targets with one good scrape or no time between, and
    counters that did not grow, are left out.
    """
    good = scrapes.where("error is null")
    if from_zero:
        start = scrapes.agg(F.min("ts")).scalar()
        ends = good.groupBy("target").agg(F.max("ts").alias("t1")).withColumn("t0", start)
    else:
        ends = good.groupBy("target").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    rows = good.join(ends.where("t1 > t0"), "target")
    last = F.sum(F.when(F.col("ts") == F.col("t1"), F.col("value")))
    first = F.lit(0) if from_zero else F.sum(F.when(F.col("ts") == F.col("t0"), F.col("value")))
    delta = rows.groupBy("target", "name", "t0", "t1").agg(positive_delta(last, first).alias("delta")).where("delta > 0")
    return delta.select("target", "name", "delta", (F.col("delta") / (F.col("t1") - F.col("t0"))).alias("rate"))


def exposition(buckets: DataFrame) -> DataFrame:
    """One line of text for each bucket, count and sum."""
    le = F.coalesce(F.col("le").cast("string"), F.lit("+Inf"))
    lines = buckets.select("name", F.format_string('%s_latency_us_bucket{le="%s"} %d', "name", le, "cum").alias("line"))
    one = buckets.groupBy("name").agg(F.max("count").alias("count"), F.max("sum_us").alias("sum_us"))
    ends = one.select("name", F.explode(F.array(F.format_string("%s_latency_us_count %d", "name", "count"), F.format_string("%s_latency_us_sum %d", "name", "sum_us"))).alias("line"))
    return lines.unionByName(ends)


def counter_exposition(counts: DataFrame, prefix: str = "") -> DataFrame:
    """counts (name, value) as text: a line with the type, and one with the value."""
    full = F.concat(F.lit(prefix), "name", F.lit("_total"))
    lines = F.array(F.concat(F.lit("# TYPE "), full, F.lit(" counter")), F.concat(full, F.lit(" "), F.col("value").cast("string")))
    return counts.select("name", F.posexplode(lines).alias("no", "line"))


def display_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "_latency_us$", ""), "_total$", "")


# The text format: a name, labels in braces with quoted and escaped values, a number, and maybe a time.
_NAME = "[a-zA-Z_:][a-zA-Z0-9_:]*"
_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:\\.|[^"\\])*)"'
_SAMPLE = rf"^({_NAME})\s*(?:\{{((?:\s*{_LABEL.replace('(', '(?:', 1).replace('((?:', '(?:(?:')}\s*,?)*\s*)\}})?\s+(\S+)(?:\s+-?[0-9]+)?$"


def parse(lines: DataFrame) -> DataFrame:
    """line to name, kind (bucket, count, sum or counter), le and value. Comments and other lines are left out."""
    text = F.trim("line")
    full, labels, value = (F.regexp_extract(text, _SAMPLE, i).alias(n) for i, n in ((1, "full"), (2, "labels"), (3, "value")))
    kind = F.regexp_extract("full", "_(bucket|count|sum)$", 1)
    rows = lines.where((text != "") & ~text.startswith("#")).select(full, labels, value).where("full <> ''")
    pairs = F.arrays_zip(F.regexp_extract_all("labels", F.lit(_LABEL), 1).alias("k"), F.regexp_extract_all("labels", F.lit(_LABEL), 2).alias("v"))
    le = F.get(F.filter(pairs, lambda x: x["k"] == "le"), F.lit(0))["v"]
    return rows.select(
        display_name(F.regexp_replace("full", "_(bucket|count|sum)$", "")).alias("name"), F.when(kind == "", "counter").otherwise(kind).alias("kind"),
        F.when(kind == "bucket", le).alias("le"), F.expr("try_cast(value as double)").alias("value"),
    ).where("value is not null and (kind <> 'bucket' or le is not null)")


def report_histograms(scrapes: DataFrame, from_zero: bool = False) -> DataFrame:
    """The other half of a report: scrapes (target, ts, name, le, cum, count, sum_us, error) to target, name, count, qps, avg_us and percentile bounds.

    Last against first good scrape of a target, as in report; histograms without new samples are left out.
    """
    good = scrapes.where("error is null")
    if from_zero:
        ends = good.groupBy("target").agg(F.max("ts").alias("t1")).withColumn("t0", scrapes.agg(F.min("ts")).scalar())
    else:
        ends = good.groupBy("target").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    rows = good.join(ends.where("t1 > t0"), "target")
    at = lambda t, c: F.sum(F.when(F.col("ts") == F.col(t), F.col(c)))
    delta = lambda c: positive_delta(at("t1", c), F.lit(0) if from_zero else at("t0", c)).alias(c)
    grown = rows.groupBy("target", "name", "le", "t0", "t1").agg(delta("cum"), delta("count"), delta("sum_us")).where("count > 0")
    found = percentile_bounds(grown.withColumn("name", F.struct("target", "name", "t0", "t1")))
    qps = F.col("count") / (F.col("name.t1") - F.col("name.t0"))
    return found.select("name.target", "name.name", "count", qps.alias("qps"), "avg_us", "p50_us", "p95_us", "p99_us")


def report_errors(scrapes: DataFrame, from_zero: bool = False) -> DataFrame:
    """target, ts, error of failed scrapes; from zero, only of targets without any good one."""
    failed = scrapes.where("error is not null").select("target", "ts", "error").distinct()
    return failed.join(scrapes.where("error is null").select("target"), "target", "left_anti") if from_zero else failed


def aligned(rows: DataFrame, order: list[str]) -> DataFrame:
    """no, line: rows as a text table of aligned columns, in the order of some of them: heads, rules and cells. For reports, which are short."""
    cells = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in rows.columns], F.row_number().over(Window.orderBy(*order)).alias("no_"))
    heads = rows.sparkSession.createDataFrame([(*rows.columns, -1)], cells.schema)
    every = heads.unionByName(cells)
    width = {c: every.agg(F.max(F.length(c))).scalar() for c in rows.columns}
    line = F.concat_ws("  ", *[F.rpad(F.col(c), width[c], " ") for c in rows.columns])
    rule = F.concat_ws("  ", *[F.repeat(F.lit("-"), width[c]) for c in rows.columns])
    return every.select(F.col("no_").cast("long").alias("no"), line.alias("line")).unionByName(heads.select(F.lit(0).cast("long").alias("no"), rule.alias("line")))
