"""Quorum order statistics, replication progress, membership and votes.

progress: scenario, replica_seq, match_index, member_type, is_self. Thresholds come from order statistics of the few
members' positions, so no join pairs members with entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .oplog import last_index

MAX_ENTRIES = 256


def quorum(voters: Column) -> Column:
    return (F.floor(voters / 2) + 1).cast("long")


def acknowledged(progress: DataFrame) -> DataFrame:
    """scenario, upto: the largest index that a quorum holds. The leader counts as one, other members only as voters."""
    other = (F.col("is_self") == 0) & (F.col("member_type") == "VOTER")
    held = progress.groupBy("scenario").agg(
        F.sum((F.col("member_type") == "VOTER").cast("long")).alias("voters"),
        F.sort_array(F.collect_list(F.when(other, F.col("match_index"))), asc=False).alias("others"),
    )
    need = (quorum(F.col("voters")) - 1).cast("int")
    upto = F.when(need <= 0, F.lit((1 << 63) - 1)).when(F.size("others") >= need, F.get("others", need - 1)).otherwise(F.lit(0))
    return held.select("scenario", "voters", upto.cast("long").alias("upto"))


def commit_index(log: DataFrame, progress: DataFrame, committed: int = 0) -> DataFrame:
    """scenario, commit_index: the last entry of the current term that a quorum holds; null if there is none.

    Entries of earlier terms are committed with it, never by counting.
    """
    current = log.agg(F.max("term")).scalar()
    own = log.where((F.col("term") == current) & (F.col("idx") > committed)).agg(F.min("idx").alias("low"), F.max("idx").alias("high"))
    # the current term ends the log, so its indexes are dense
    reach = F.least("upto", own.select("high").scalar())
    return acknowledged(progress).select("scenario", F.when(reach >= own.select("low").scalar(), reach).alias("commit_index"))


def read_gate(log: DataFrame, progress: DataFrame) -> DataFrame:
    """scenario, commit_index, ready: reads wait until an entry of the current term is committed."""
    found = commit_index(log, progress)
    return found.select("scenario", F.coalesce("commit_index", F.lit(0)).alias("read_index"), F.col("commit_index").isNotNull().alias("ready"))


def follower_commit(rows: DataFrame) -> DataFrame:
    """commit_index, leader_commit and last_index to the new commit index: never back, never beyond the log."""
    return rows.withColumn("new_commit", F.greatest("commit_index", F.least("leader_commit", "last_index")))


def read_confirmed(log: DataFrame, progress: DataFrame, answers: DataFrame, leader: bool = True) -> DataFrame:
    """scenario, status, read_index: a read may go on once a quorum, the leader included, has answered in its term.

    answers: scenario, replica_seq, term (null if none came). Whether entries fit does not matter; an answer of a later term
    ends the leadership.
    """
    current = log.agg(F.max("term")).scalar()
    got = answers.groupBy("scenario").agg(F.count_distinct(F.when(F.col("term") == current, F.col("replica_seq"))).alias("same"), F.max(F.col("term") > current).alias("deposed"))
    voters = progress.groupBy("scenario").agg(quorum(F.sum((F.col("member_type") == "VOTER").cast("long"))).alias("need"))
    rows = read_gate(log, progress).join(voters, "scenario").join(got, "scenario", "left")
    enough = F.coalesce("same", F.lit(0)) + 1 >= F.col("need")
    status = F.when(~F.lit(leader), "NOT_LEADER").when(~F.col("ready"), "NOT_YET_COMMIT").when(F.col("deposed") | ~enough, "NOT_LEADER").otherwise("OK")
    return rows.select("scenario", status.alias("status"), F.when(status == "OK", F.col("read_index")).alias("read_index"))


def replication_plan(log: DataFrame, progress: DataFrame, snapshot_index: Column, limit: int = MAX_ENTRIES) -> DataFrame:
    """What to send each peer next: a snapshot if its place is gone, else up to limit entries.

    progress may have inflight, the index of a snapshot that is on its way (0 for none): such a peer is sent no other one.
    """
    last = last_index(log)
    busy = F.coalesce("inflight", F.lit(0)) > 0 if "inflight" in progress.columns else F.lit(False)
    peers = progress.where("is_self = 0").select("scenario", "replica_seq", F.col("match_index").alias("prev"), busy.alias("busy"))
    behind = F.col("prev") < snapshot_index
    known = peers.join(log.select(F.col("idx").alias("prev"), F.col("term").alias("prev_term")), "prev", "left")
    return known.select(
        "scenario", "replica_seq", F.when(behind & F.col("busy"), "WAIT").when(behind, "INSTALL_SNAPSHOT").otherwise("APPEND_ENTRIES").alias("action"),
        F.when(~behind, F.col("prev")).alias("prev_log_index"), F.when(~behind, F.coalesce("prev_term", F.lit(0))).alias("prev_log_term"),
        F.when(behind, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(limit), last - F.col("prev")))).cast("long").alias("n_entries"),
    )


def peer_progress(start: DataFrame, acks: DataFrame) -> DataFrame:
    """Match and next index of each peer after acknowledgements (prev_log_index, n_entries)."""
    best = acks.groupBy("scenario", "replica_seq").agg(F.max(F.col("prev_log_index") + F.col("n_entries")).alias("acked"))
    match = F.greatest("match_index", F.coalesce("acked", F.lit(0)))
    return start.join(best, ["scenario", "replica_seq"], "left").select("scenario", "replica_seq", match.alias("match_index"), (match + 1).alias("next_index"))


def peer_backoff(rejects: DataFrame) -> DataFrame:
    """next_index after a rejection: at the shorter log's end, at least one back, never into what matches."""
    target = F.least("follower_last", "leader_last") + 1
    stuck = (target >= F.col("next_index")) & (F.col("next_index") > 1)
    moved = F.greatest(F.when(stuck, F.col("next_index") - 1).otherwise(target), F.col("match_index") + 1)
    return rejects.select("scenario", "replica_seq", moved.alias("next_index"), (F.col("prev_log_index") + 1 != F.col("next_index")).alias("stale"))


def append_decision(requests: DataFrame, log: DataFrame, current_term: int, snapshot_index: int) -> DataFrame:
    """requests (member, term, prev_log_index, prev_log_term) with decision, by the first check that fails."""
    have = log.select(F.col("idx").alias("prev_log_index"), F.col("term").alias("own_term"))
    own = F.coalesce("own_term", F.lit(0))
    mismatch = (F.col("prev_log_index") > 0) & (F.col("prev_log_index") >= snapshot_index) & (own != F.col("prev_log_term"))
    decision = (
        F.when(~F.col("member"), "REJECT_NOT_MEMBER").when(F.col("term") < current_term, "REJECT_STALE_TERM").when(mismatch, "REJECT_PREV_MISMATCH").otherwise("ACCEPT")
    )
    return requests.join(have, "prev_log_index", "left").withColumn("decision", decision).drop("own_term")


def membership(config_log: DataFrame, upto: Column | None = None) -> DataFrame:
    """replica_seq, member_type after the configuration changes up to an index.

    What counts of a replica is what follows its last removal: the first addition makes a member, a promotion after it a voter.
    Additions of members and promotions of others change nothing.
    """
    rows = config_log if upto is None else config_log.where(F.col("idx") <= upto)
    of = lambda op: F.when(F.col("op") == op, F.col("idx"))
    gone = rows.groupBy("replica_seq").agg(F.coalesce(F.max(of("REMOVE_MEMBER")), F.lit(-1)).alias("gone"))
    since = rows.join(gone, "replica_seq").where("idx > gone").groupBy("replica_seq").agg(F.min(of("ADD_LEARNER")).alias("added"), F.max(of("PROMOTE_VOTER")).alias("promoted"))
    return since.where("added is not null").select("replica_seq", F.when(F.col("promoted") > F.col("added"), "VOTER").otherwise("LEARNER").alias("member_type"))


def config_statuses(config_log: DataFrame) -> DataFrame:
    """idx, replica_seq, op, status of each change: INVALID_ARGUMENT for a promotion of what is no member then."""
    before = Window.partitionBy("replica_seq").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") != "PROMOTE_VOTER", F.col("op")), ignorenulls=True).over(before)
    bad = (F.col("op") == "PROMOTE_VOTER") & ~F.coalesce(last == "ADD_LEARNER", F.lit(False))
    return config_log.select("idx", "replica_seq", "op", F.when(bad, "INVALID_ARGUMENT").otherwise("OK").alias("status"))


def quorum_size(members: DataFrame) -> DataFrame:
    voters = F.sum((F.col("member_type") == "VOTER").cast("long"))
    return members.agg(F.coalesce(voters, F.lit(0)).alias("voters")).select("voters", quorum(F.col("voters")).alias("quorum"))


def change_member(config_log: DataFrame, requests: DataFrame, applied: Column, op: str) -> DataFrame:
    """Decision on op (ADD_LEARNER or REMOVE_MEMBER) for each replica_seq: nothing to do, wait for another change, or propose."""
    pending = config_log.where(F.col("idx") > applied)
    first = pending.agg(F.min_by(F.struct("op", "replica_seq"), "idx").alias("p"))
    ahead, seq = first.select("p.op").scalar(), first.select("p.replica_seq").scalar()
    members = membership(config_log, applied).select("replica_seq", F.lit(True).alias("member"))
    done = F.col("member") if op == "ADD_LEARNER" else F.col("member").isNull()
    same = (ahead == op) & (seq == F.col("replica_seq"))
    decision = F.when(done, "OK_MEMBER" if op == "ADD_LEARNER" else "OK_GONE").when(same, "OK_PENDING").when(ahead.isNotNull(), "RETRY_ERROR").otherwise("PROPOSE")
    return requests.join(members, "replica_seq", "left").select("replica_seq", decision.alias("decision"))


def add_learner(config_log: DataFrame, requests: DataFrame, applied: Column) -> DataFrame:
    return change_member(config_log, requests, applied, "ADD_LEARNER")


def remove_member(config_log: DataFrame, requests: DataFrame, applied: Column) -> DataFrame:
    return change_member(config_log, requests, applied, "REMOVE_MEMBER")


def commits_removal(config_log: DataFrame, steps: DataFrame) -> DataFrame:
    """steps (step, old_commit, new_commit) with removal: whether the step commits a REMOVE_MEMBER, so that all peers are told at once."""
    removals = config_log.where("op = 'REMOVE_MEMBER'").select("idx")
    held = steps.join(removals, (F.col("idx") > F.col("old_commit")) & (F.col("idx") <= F.col("new_commit")), "left_semi").select("step", F.lit(True).alias("held"))
    return steps.join(held, "step", "left").select(*steps.columns, F.coalesce("held", F.lit(False)).alias("removal"))


def append_response(responses: DataFrame, current_term: int) -> DataFrame:
    """responses (term, sent_term, leader, success, prev_log_index, next_index) with what the leader does, by the first rule that applies."""
    stale = F.col("prev_log_index") + 1 != F.col("next_index")
    action = (
        F.when(F.col("term") > current_term, "STEP_DOWN").when(F.col("sent_term") != current_term, "IGNORE_OLD_TERM").when(~F.col("leader"), "NOT_LEADER")
        .when(F.col("success"), "ADVANCE").when(stale, "IGNORE_STALE").otherwise("BACK_OFF")
    )
    return responses.withColumn("action", action)


def install_decision(requests: DataFrame, log: DataFrame, current_term: int, commit: Column, ready: bool = True) -> DataFrame:
    """requests (member, term, snapshot_index, snapshot_term) with decision; a snapshot that brings nothing new is ALREADY_EXIST."""
    have = log.select(F.col("idx").alias("snapshot_index"), F.col("term").alias("own_term"))
    has = F.lit(ready) & F.coalesce(F.col("own_term") == F.col("snapshot_term"), F.lit(False))
    decision = (
        F.when(~F.col("member"), "INVALID_ARGUMENT").when(F.col("term") < current_term, "ERROR").when((F.col("snapshot_index") <= commit) | has, "ALREADY_EXIST").otherwise("OK")
    )
    return requests.join(have, "snapshot_index", "left").withColumn("decision", decision).drop("own_term")


def leader_start(members: DataFrame, last: Column) -> DataFrame:
    """What a new leader knows of its peers (members with is_self): nothing, and that they may have all of its log."""
    none = lambda n: F.lit(0).cast("long").alias(n)
    return members.where("is_self = 0").select("scenario", "replica_seq", (last + 1).cast("long").alias("next_index"), none("match_index"), none("watermark"), none("inflight"))


def snapshot_response(rows: DataFrame, current_term: int) -> DataFrame:
    """What the leader does with answers to snapshots, by the first rule that applies, and the peer's positions after it.

    rows: term, sent_term, leader, status, watermark, snapshot_index, and the peer's inflight, known, match_index and next_index.
    One that installed it, or had it already, has all up to it; in any case nothing is on its way any more.
    """
    has = (F.col("status") == "OK") | ((F.col("status") == "ALREADY_EXIST") & (F.col("watermark") >= F.col("snapshot_index")))
    action = (
        F.when(F.col("term") > current_term, "STEP_DOWN").when(~F.col("leader"), "NOT_LEADER").when(F.col("sent_term") != current_term, "IGNORE_OLD_TERM")
        .when(has, "ADVANCE").otherwise("FAILED")
    )
    moved, upto = F.col("action") == "ADVANCE", F.greatest("watermark", "snapshot_index")
    answered = F.col("action").isin("ADVANCE", "FAILED") & (F.col("inflight") == F.col("snapshot_index"))
    later = lambda c, x: F.when(moved, F.greatest(c, x)).otherwise(F.col(c)).alias(f"new_{c}")
    return rows.withColumn("action", action).select(
        "*", F.when(answered, 0).otherwise(F.col("inflight")).alias("new_inflight"), later("known", upto), later("match_index", upto), later("next_index", upto + 1)
    )


def applied_index(rows: DataFrame) -> DataFrame:
    """commit_index, last_applied, applied and snapshot_index to what they become: never back, and at least the snapshot's."""
    return rows.withColumn("new_applied", F.greatest("last_applied", "applied", "snapshot_index")).withColumn("new_commit", F.greatest("commit_index", "snapshot_index"))


def promotable(progress: DataFrame, target: Column) -> DataFrame:
    """The first learner of each scenario that has caught up."""
    ready = progress.where((F.col("member_type") == "LEARNER") & (F.col("match_index") >= target))
    return ready.groupBy("scenario").agg(F.min("replica_seq").alias("replica_seq"))


def vote_decision(requests: DataFrame, current_term: int, own_last: DataFrame) -> DataFrame:
    """requests (voter, term, last_term, last_index, candidate) with granted; own_last: last_term, last_index, voted_for.

    voter: whether the one asked is a voter; where requests have candidate_voter, the one that asks must be a voter too.
    """
    mine = F.struct(own_last.select("last_term").scalar().alias("t"), own_last.select("last_index").scalar().alias("i"))
    theirs = F.struct(F.col("last_term").alias("t"), F.col("last_index").alias("i"))
    voted = own_last.select("voted_for").scalar()
    free = (F.col("term") > current_term) | voted.isNull() | (voted == F.col("candidate"))
    both = F.col("voter") & F.col("candidate_voter") if "candidate_voter" in requests.columns else F.col("voter")
    return requests.withColumn("granted", both & (F.col("term") >= current_term) & ~(mine > theirs) & free)


def vote_tally(votes: DataFrame, by: list[str]) -> DataFrame:
    """voters, granted and won of each election: different voters that granted, against the quorum."""
    voter = F.col("member_type") == "VOTER"
    counted = votes.groupBy(*by).agg(F.count_distinct(F.when(voter, F.col("replica_seq"))).alias("voters"), F.count_distinct(F.when(voter & F.col("granted"), F.col("replica_seq"))).alias("granted"))
    return counted.withColumn("won", (F.col("voters") > 0) & (F.col("granted") >= quorum(F.col("voters"))))
