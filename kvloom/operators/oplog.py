"""Log algebra: slices, truncation, merging with a leader's entries, recovery. Nothing here needs a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIG_OPS = ("ADD_LEARNER", "PROMOTE_VOTER", "REMOVE_MEMBER")

#: Numbers of seq that are counted together: what one task then orders is one row for each of these blocks.
BLOCK = 1 << 16


def last_index(log: DataFrame) -> Column:
    """The log's last index as a scalar subquery; 0 for an empty log."""
    return log.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("i")).scalar()


def tail(log: DataFrame, snapshot_index: int = 0, snapshot_term: int = 0) -> DataFrame:
    """One row: last idx and term, those of the snapshot for an empty log."""
    last = F.max(F.struct("idx", "term"))
    return log.agg(last.alias("t")).select(F.coalesce("t.idx", F.lit(snapshot_index).cast("long")).alias("last_index"), F.coalesce("t.term", F.lit(snapshot_term).cast("long")).alias("last_term"))


def term_at(log: DataFrame, probes: DataFrame, snapshot_index: int = 0, snapshot_term: int = 0) -> DataFrame:
    """probes (idx) with term: 0 for index 0, before the snapshot and outside the log."""
    found = probes.select("idx").join(log.select("idx", "term"), "idx", "left")
    term = (
        F.when((F.col("idx") == 0) | (F.col("idx") < snapshot_index), F.lit(0))
        .when(F.col("idx") == snapshot_index, F.lit(snapshot_term))
        .otherwise(F.coalesce("term", F.lit(0)))
    )
    return found.select("idx", term.cast("long").alias("term"))


def slice_from(log: DataFrame, index: int, limit: int) -> DataFrame:
    """Entries from index on, in order, at most limit."""
    return log.where(F.col("idx") >= index).orderBy("idx").limit(limit)


def assign_index(arrivals: DataFrame, lead: str, rest: list[str], last: Column | int = 0, term: int = 1) -> DataFrame:
    """arrivals with idx, from last + 1 on in the order of lead, then rest, and term.

    Rows are numbered within each value of lead, on top of the count of smaller values: only the counts are put in one order.
    """
    counts = arrivals.groupBy(lead).agg(F.count("*").alias("n"))
    before = counts.select(lead, F.coalesce(F.sum("n").over(Window.orderBy(lead).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(lead).orderBy(*rest))
    return arrivals.join(before, lead).withColumn("idx", last + F.col("before") + own).withColumn("term", F.lit(term).cast("long")).drop("before")


def _merge(local: DataFrame, leader: DataFrame, snapshot_index: int) -> tuple[DataFrame, Column, Column, Column]:
    """(leader's entries beyond the snapshot, first index with another term, last index, first index that follows a gap)."""
    given = leader.where(F.col("idx") > snapshot_index)
    clash = local.select("idx", F.col("term").alias("own")).join(given.select("idx", "term"), "idx").where("own <> term")
    first = clash.agg(F.min("idx")).scalar()
    last = F.greatest(last_index(local), F.lit(snapshot_index).cast("long"))
    # beyond the entry that cuts the log, or beyond its end, each entry follows another one of the leader's
    followers = given.select((F.col("idx") + 1).alias("idx"))
    alone = given.select("idx").join(followers, "idx", "left_anti").where((F.col("idx") > F.coalesce(first, last)) & (first.isNotNull() | (F.col("idx") != last + 1)))
    return given, first, last, alone.agg(F.min("idx")).scalar()


def merge_from_leader(local: DataFrame, leader: DataFrame, snapshot_index: int = 0) -> DataFrame:
    """The log after a leader's entries: from the first index at which terms differ, the leader's; else both.

    Columns as in local, with source local or leader. Leader entries up to the snapshot are ignored. With a gap in them, or
    between them and the log, all are rejected, and the log stays as it is.
    """
    given, first, last, gap = _merge(local, leader, snapshot_index)
    kept = local.where(gap.isNotNull() | first.isNull() | (F.col("idx") < first)).withColumn("source", F.lit("local"))
    new = given.where(gap.isNull() & ((first.isNotNull() & (F.col("idx") >= first)) | (F.col("idx") > last))).withColumn("source", F.lit("leader"))
    return kept.unionByName(new)


def merge_status(local: DataFrame, leader: DataFrame, snapshot_index: int = 0) -> DataFrame:
    """One row: status (OK, or ERROR with a gap), first_new (the first index taken from the leader), rewrite (whether the log is cut)."""
    given, first, last, gap = _merge(local, leader, snapshot_index)
    new = given.where(gap.isNull() & ((first.isNotNull() & (F.col("idx") >= first)) | (F.col("idx") > last)))
    found = new.agg(F.min("idx").alias("first_new"))
    return found.select(F.when(gap.isNotNull(), "ERROR").otherwise("OK").alias("status"), "first_new", (gap.isNull() & first.isNotNull()).alias("rewrite"))


def install_snapshot(log: DataFrame, index: Column, term: Column) -> DataFrame:
    """The log after a snapshot is installed: its boundary as a row of op SNAPSHOT, and what is retained."""
    none = F.lit(None).cast("string")
    boundary = log.sparkSession.range(1).select(index.cast("long").alias("idx"), term.cast("long").alias("term"), F.lit("SNAPSHOT").alias("op"), none.alias("k"), none.alias("v"))
    return boundary.unionByName(retained(log, index, term).select("idx", "term", "op", "k", "v"))


def truncate(log: DataFrame, index: Column | int) -> DataFrame:
    """Entries after index."""
    return log.where(F.col("idx") > index)


def retained(log: DataFrame, index: Column, term: Column) -> DataFrame:
    """Entries after a snapshot: all of them if the log has the snapshot's term at its index, else none."""
    same = log.where(F.col("idx") == index).agg(F.max("term")).scalar()
    return log.where((F.col("idx") > index) & (F.coalesce(same, F.lit(0)) == term))


def unapplied(log: DataFrame, applied: Column, commit: Column) -> DataFrame:
    """Committed entries that are not applied, in order."""
    return log.where((F.col("idx") > applied) & (F.col("idx") <= commit)).orderBy("idx")


def split(log: DataFrame, applied: Column, commit: Column) -> tuple[DataFrame, DataFrame]:
    """(entries for the state, configuration changes) among the committed entries that are not applied."""
    due = log.where((F.col("idx") > applied) & (F.col("idx") <= commit))
    change = F.col("op").isin(*CONFIG_OPS)
    return due.where(~change), due.where(change)


def valid_prefix(wal: DataFrame) -> DataFrame:
    """Entries of a stored log (with ok) before the first that is damaged or does not follow its predecessor."""
    lowest = wal.agg(F.min("idx")).scalar()
    followers = wal.select((F.col("idx") + 1).alias("idx"))
    gaps = wal.where(F.col("idx") > lowest).select("idx").join(followers, "idx", "left_anti")
    bad = wal.where(~F.col("ok")).select("idx").unionByName(gaps)
    first = bad.agg(F.min("idx")).scalar()
    return wal.where(first.isNull() | (F.col("idx") < first))


def recover(wal: DataFrame, snapshot_index: Column | int) -> DataFrame:
    """Tail after a snapshot: the valid prefix beyond it, or nothing if that does not begin right after it."""
    rest = valid_prefix(wal).where(F.col("idx") > snapshot_index)
    first = rest.agg(F.min("idx")).scalar()
    return rest.where(first == snapshot_index + 1)


def receive_chunks(chunks: DataFrame, by: list[str], order: str, session: list[str]) -> DataFrame:
    """Snapshots received by each receiver (by), whose chunks (offset, size) come in order: chunks, accepted and bytes of each session.

    A chunk at offset 0 begins a session. Later ones are accepted if they are of the same sender and snapshot (the columns
    session) and begin where the last accepted one ended; others change nothing, so a chunk may be sent again. What comes
    before the first session is left out. A session is one array, of a megabyte of snapshot an entry.
    """
    begins = (F.col("offset") == 0).cast("long")
    number = F.sum(begins).over(Window.partitionBy(*by).orderBy(order))
    rows = chunks.withColumn("session", number).where("session > 0")
    chunk = F.struct(order, F.struct(*session).alias("of"), F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size"))
    held = rows.groupBy(*by, "session").agg(F.array_sort(F.collect_list(chunk)).alias("c"))
    first = F.get("c", F.lit(0))["of"]
    zero = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("accepted"))

    def step(s: Column, x: Column) -> Column:
        fits = x["of"].eqNullSafe(first) & (x["offset"] == s["bytes"])
        return F.struct((s["bytes"] + F.when(fits, x["size"]).otherwise(0)).alias("bytes"), (s["accepted"] + fits.cast("long")).alias("accepted"))

    return held.withColumn("f", F.aggregate("c", zero, step)).select(*by, "session", F.size("c").cast("long").alias("chunks"), "f.accepted", "f.bytes")


def contiguous(chunks: DataFrame, by: str, order: str) -> DataFrame:
    """chunks (offset, size) of transfers: n, accepted as long as each begins where the last one ended."""
    w = Window.partitionBy(by).orderBy(order)
    fits = F.col("offset") == F.coalesce(F.lag(F.col("offset") + F.col("size")).over(w), F.lit(0))
    marked = chunks.withColumn("fits", fits).withColumn("whole", F.min("fits").over(w))
    return marked.groupBy(by).agg(
        F.count("*").alias("chunks"), F.sum(F.col("whole").cast("long")).alias("accepted"),
        F.sum(F.when(F.col("whole"), F.col("size")).otherwise(0)).alias("bytes"),
    )


def propose(proposals: DataFrame, last: Column, ready: bool = True, leader: bool = True, voter: bool = True, block: int = BLOCK) -> DataFrame:
    """proposals (seq, kind, op) with status and idx: those that are fine get the next indexes in order, others -1.

    kind: WRITE, NOOP or CONFIG. Running counts are taken within blocks of seq, on top of the counts of earlier blocks.
    """
    kind, op = F.col("kind"), F.col("op")
    fine = ((kind == "WRITE") & op.isin("PUT", "DEL")) | (kind == "NOOP") | ((kind == "CONFIG") & op.isin(*CONFIG_OPS))
    refused = "ERROR" if not ready else "NOT_LEADER" if not leader else "NOT_VOTER" if not voter else None
    status = F.lit(refused) if refused else F.when(F.coalesce(fine, F.lit(False)), "OK").otherwise("INVALID_ARGUMENT")
    rows = proposals.withColumn("status", status).withColumn("one", (F.col("status") == "OK").cast("long")).withColumn("block", F.floor(F.col("seq") / block))
    sums = rows.groupBy("block").agg(F.sum("one").alias("n"))
    before = sums.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("one").over(Window.partitionBy("block").orderBy("seq"))
    found = rows.join(before, "block").withColumn("idx", F.when(F.col("one") == 1, last + F.col("before") + own).otherwise(-1))
    return found.drop("block", "before", "one")


def batches(proposals: DataFrame, config_ops: tuple[str, ...] = CONFIG_OPS, block: int = BLOCK) -> DataFrame:
    """proposals (seq, op) with batch: writes between two configuration changes go together, each change alone.

    Running counts are taken within blocks of seq, on top of the counts of earlier blocks.
    """
    change = F.col("op").isin(*config_ops).cast("long")
    rows = proposals.withColumn("change", change).withColumn("block", F.floor(F.col("seq") / block))
    sums = rows.groupBy("block").agg(F.sum("change").alias("changes"))
    before = sums.select("block", F.coalesce(F.sum("changes").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("change").over(Window.partitionBy("block").orderBy("seq"))
    # twice the changes so far, the change itself being odd
    return rows.join(before, "block").withColumn("batch", 2 * (F.col("before") + own) - F.col("change")).drop("change", "block", "before")
