"""Mixing sources to target weights: Pfair scheduling.

Each source holds a whole number of tickets in proportion to its target weight, and its documents are cut into blocks:
as many as its tickets in each period that it takes part in. A period is as many slots as the tickets of the sources
that still take part. In it, block j of a source with a of A tickets has release floor((j - 1) A / a) and deadline
ceil(j A / a); each slot goes to the released block with the earliest deadline, the first source by name among equals.
Every block so stands between its release and its deadline: within a period, and so over any run of periods, a source
is never a whole block ahead of or behind its share. The pattern repeats, so only one period is worked out for each set
of sources that take part; a source ends with a period, and the rest go on in proportion to their tickets.

Tickets round the weights. Where that would move a source by a block or more in all, there are no tickets: blocks of
block_docs documents have their releases and deadlines from the weights themselves, over the whole mix. If every source
that has documents left were served at all times in proportion to its weight, block j would be under way from one time to
another: those are its release, rounded down, and its deadline, rounded up. Earliest deadlines first again keep every
source within a block of that course. Slots are worked out in windows, each by itself and in SQL, as what is done by a slot
has a closed form (see _windows). Only for more than max_sources sources is it the driver, with a heap, from their sizes.

No document is dropped: the result has every row, its block, the slot of the block and its place in the block. Rows of a
source are ordered by the MD5 of their id. Null sources form a source of their own, first by name; null ids are allowed,
and repeated rows are numbered apart. Extra columns stay. Weights that are null, not positive or missing count as the
smallest that a ticket stands for; without tickets, they share that one ticket's weight. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents that share a bucket of the numbering, on average, at most.
BUCKET_ROWS = 1500

#: Slots that are sent to all executors; more are joined by a shuffle.
BROADCAST_SLOTS = 1_000_000

#: One period: state (how many blocks each source has, the sources in slot order), one step a slot.
_PERIOD = """
    aggregate(
        sequence(0L, size - 1),
        named_struct('done', transform(part, x -> 0L), 'slots', cast(array() as array<int>)),
        (s, t) -> aggregate(
            array(array_min(filter(
                transform(part, (x, i) -> if(s.done[i] < x.tickets and (s.done[i] * size) div x.tickets <= t,
                    named_struct('deadline', ((s.done[i] + 1) * size + x.tickets - 1) div x.tickets, 'i', i), null)),
                c -> c is not null)).i),
            s,
            (u, best) -> named_struct('done', transform(u.done, (d, i) -> d + if(i = best, 1L, 0L)), 'slots', concat(u.slots, array(best)))),
        s -> s.slots)
"""


def _tickets(docs: DataFrame, source_col: str, targets: DataFrame | None, alpha: float, resolution: int, block_docs: int) -> DataFrame | None:
    """src, n, tickets, periods of each source."""
    counts = docs.groupBy(_source(source_col).alias("src")).agg(F.count("*").alias("n"))
    if targets is None:
        weighed = counts.withColumn("w", F.pow("n", F.lit(alpha)))
    else:
        given = targets.groupBy(_source(source_col).alias("src")).agg(F.max("weight").cast("double").alias("w"))
        weighed = counts.join(given, "src", "left").withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(0.0))
    number, total = weighed.agg(F.count("*"), F.sum("w")).first()
    if not number:
        return None
    tickets = F.greatest(F.lit(1), F.round(F.col("w") * resolution / F.lit(float(total) or 1.0))).cast("long")
    return weighed.select("src", "n", "w", tickets.alias("tickets")).withColumn("periods", F.expr(f"(n + tickets * {block_docs} - 1) div (tickets * {block_docs})"))


def _source(name: str):
    return F.when(F.col(name).isNull(), "").otherwise(F.concat(F.lit("s"), F.col(name).cast("string")))


def _slots(sources: DataFrame) -> DataFrame:
    """Of each source: n, tickets, periods, and runs: (low, high) periods with the same sources, with the first slot, slots a period, and its slots in it."""
    every = sources.agg(F.array_sort(F.collect_list(F.struct("src", "n", "tickets", "periods"))).alias("every"))
    runs = (
        every.select("every", F.explode(F.array_sort(F.array_distinct("every.periods"))).alias("high"))
        .withColumn("part", F.expr("filter(every, x -> x.periods >= high)"))
        .withColumn("low", F.expr("coalesce(array_max(filter(every.periods, p -> p < high)), 0L)"))
        .withColumn("size", F.expr("aggregate(part, 0L, (a, x) -> a + x.tickets)"))
        # slots before this run: of each source, its tickets in each period before low
        .withColumn("first", F.expr("aggregate(every, 0L, (a, x) -> a + x.tickets * least(x.periods, low))"))
        .withColumn("slots", F.expr(_PERIOD))
    )
    each = runs.select("low", "high", "first", "size", "slots", F.posexplode("part").alias("i", "x"))
    own = F.expr("filter(transform(slots, (s, t) -> if(s = i, t, null)), t -> t is not null)")
    return each.groupBy("x.src").agg(
        F.first("x.n").alias("n"), F.first("x.tickets").alias("tickets"), F.first("x.periods").alias("periods"),
        F.array_sort(F.collect_list(F.struct("low", "high", "first", "size", own.alias("own")))).alias("runs"),
    )


def _off(w: np.ndarray, tickets: np.ndarray, periods: np.ndarray) -> float:
    """Blocks by which tickets lead a source away from its weight, at most, in all."""
    off, low = np.zeros(len(w)), 0
    for high in np.unique(periods).tolist():
        part = periods >= high
        size = tickets[part].sum()
        off[part] += np.abs(tickets[part] / size - w[part] / w[part].sum()) * size * (high - low)
        low = high
    return float(off.max())


def _exact(w: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(source, block of it) of each slot."""
    ends = np.sort(blocks / w)
    order = np.argsort(blocks / w, kind="stable")
    over = np.append(0, np.cumsum(blocks[order]))
    rest = np.append(np.cumsum(w[order][::-1])[::-1], 0.0)
    source = np.repeat(np.arange(len(w)), blocks)
    number = np.arange(len(source)) - np.repeat(np.cumsum(blocks) - blocks, blocks)

    def course(v):  # slots gone when each source has had v times its weight, or all it has
        k = np.searchsorted(ends, v, side="left")
        return over[k] + v * rest[k]

    release = np.floor(course(number / w[source]) + 1e-6).astype(np.int64)
    deadline = np.ceil(course((number + 1) / w[source]) - 1e-6).astype(np.int64).tolist()
    queue = np.argsort(release, kind="stable")
    waiting, at = release[queue].tolist(), 0
    queue = queue.tolist()
    heap: list[tuple[int, int]] = []
    out = np.empty(len(source), np.int64)
    for t in range(len(out)):
        while at < len(queue) and (waiting[at] <= t or not heap):
            heapq.heappush(heap, (deadline[queue[at]], queue[at]))
            at += 1
        out[t] = heapq.heappop(heap)[1]
    return source[out], number[out]


def _on_driver(spark: SparkSession, names: list[str], w: list[float], blocks: list[int]) -> DataFrame:
    """src, block, slot by exact weights of very many sources."""
    source, number = _exact(np.array(w), np.array(blocks))
    return spark.createDataFrame(pa.table({"src": pa.array(np.array(names, dtype=object)[source], pa.string()), "block": number, "slot": np.arange(len(number))}))


#: Slots that are worked out together.
WINDOW = 512


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _virtual(t: str) -> str:
    """How many times its weight a source with blocks left has had by slot t; null phases do not occur, as the first one begins at 0."""
    return _let("p", f"element_at(filter(phases, p -> p.c <= {t}), -1)", f"p.v + ({t} - p.c) / p.rest")


def _course(v: str) -> str:
    return _let("p", f"element_at(filter(phases, p -> p.v <= {v}), -1)", f"p.c + ({v} - p.v) * p.rest")


def _due(x: str, v: str) -> str:
    """Blocks of source x whose deadlines are past at virtual time v."""
    return f"least({x}.b, floor({x}.w * {v} + 1e-6D))"


def _out(x: str, v: str) -> str:
    """Blocks of source x whose releases are before virtual time v."""
    return f"least({x}.b, ceil({x}.w * {v} - 1e-6D))"


def _job(x: str, j: str) -> str:
    """Block j of source x: the first slot after which it is out, and the first one by which it is due. The counts decide, not the rounding."""
    release = _let("g", f"floor({_course(f'({j} / {x}.w)')} + 1e-6D)", f"if({_out(x, _virtual('g'))} > {j}, g - 1, if({_out(x, _virtual('(g + 1)'))} > {j}, g, g + 1))")
    due = _let("g", f"ceil({_course(f'(({j} + 1) / {x}.w)')} - 1e-6D)", f"if({_due(x, _virtual('(g - 1)'))} > {j}, g - 1, if({_due(x, _virtual('g'))} > {j}, g, g + 1))")
    return f"if({j} < {x}.b, named_struct('j', {j}, 'release', {release}, 'due', {due}), named_struct('j', {j}, 'release', cast(null as bigint), 'due', cast(null as bigint)))"


def _windows(sources: DataFrame, total: int) -> DataFrame:
    """src, block, slot by exact weights: sources has src, blocks and w. Every window of slots is worked out by itself.

    What earliest deadlines first has done by slot T needs no run up to there. All blocks due by T are done. Of the others that
    are out, at most one a source, the earliest deadlines are done, as far as slots allow: from any slot t on, there
    are T - t slots, less the due blocks that come out at t or later, and both are counts in closed form. Slots before the
    first release of those others always suffice, so what is looked at is as long as a block of the rarest source waits.
    """
    held = sources.agg(F.array_sort(F.collect_list(F.struct("src", F.col("blocks").cast("long").alias("b"), F.col("w").cast("double").alias("w")))).alias("every"))
    gone = "aggregate(every, 0D, (a, x) -> a + if(x.b / x.w <= v, cast(x.b as double), x.w * v))"
    rest = "aggregate(every, 0D, (a, x) -> a + if(x.b / x.w > v, x.w, 0D))"
    times = "array_sort(array_distinct(concat(array(0D), transform(every, x -> x.b / x.w))))"
    held = held.withColumn("phases", F.expr(f"filter(transform({times}, v -> named_struct('c', {gone}, 'v', v, 'rest', {rest})), p -> p.rest > 0)"))
    number = -(-total // WINDOW)
    rows = sources.sparkSession.range(number).select((F.col("id") * WINDOW).alias("t0"), held.select("every").scalar().alias("every"), held.select("phases").scalar().alias("phases"))
    rows = rows.withColumn("v0", F.expr(_virtual("t0"))).withColumn("done", F.expr(_let("v", "v0", f"transform(every, x -> {_due('x', 'v')})")))
    waiting = f"transform(every, (x, i) -> if({_out('x', 'v0')} > done[i], {_let('o', _job('x', 'done[i]'), 'named_struct(\'due\', o.due, \'i\', i, \'release\', o.release)')}, null))"
    rows = rows.withColumn("waiting", F.expr(f"array_sort(filter({waiting}, o -> o is not null))"))
    late = _let("v", _virtual("t"), f"aggregate(transform(every, (x, i) -> greatest(0L, done[i] - {_out('x', 'v')})), 0L, (a, n) -> a + n)")
    least = f"array_min(transform(sequence(if(k = 0, r, ends[greatest(k, 1) - 1] + 1), r), t -> t0 - t - {late}))"
    rooms = _let("ends", "array_sort(array_distinct(waiting.release))", f"transform(ends, (r, k) -> named_struct('t', r, 'n', {least}))")
    need = "named_struct('t', 0L, 'n', t0 - aggregate(done, 0L, (a, n) -> a + n))"
    rows = rows.withColumn("room", F.expr(f"concat(array({need}), {rooms})"))
    taken = """
        aggregate(waiting, named_struct('room', room, 'taken', cast(array() as array<int>)), (s, o) ->
            if(forall(s.room, r -> r.t > o.release or r.n > 0),
               named_struct('room', transform(s.room, r -> named_struct('t', r.t, 'n', r.n - if(r.t <= o.release, 1L, 0L))), 'taken', concat(s.taken, array(o.i))),
               s), s -> s.taken)"""
    rows = rows.withColumn("taken", F.expr(taken)).withColumn("next", F.expr(_let("some", "taken", f"transform(every, (x, i) -> {_let('j', 'done[i] + if(array_contains(some, i), 1L, 0L)', _job('x', 'j'))})")))
    best = "array_min(filter(transform(s.next, (o, i) -> if(o.release <= t, named_struct('due', o.due, 'i', i), null)), c -> c is not null)).i"
    moved = _let("x", "every[best]", _let("k", "s.next[best].j + 1", _job("x", "k")))
    step = _let("best", best, _let("new", moved, "named_struct('next', transform(s.next, (o, i) -> if(i = best, new, o)), 'slots', concat(s.slots, array(named_struct('i', best, 'j', s.next[best].j))))"))
    slots = f"aggregate(sequence(t0, least(t0 + {WINDOW}, {total}L) - 1), named_struct('next', next, 'slots', cast(array() as array<struct<i: int, j: bigint>>)), (s, t) -> {step}, s -> s.slots)"
    found = rows.select("t0", "every", F.expr(slots).alias("slots")).select("t0", "every", F.posexplode("slots").alias("no", "at"))
    return found.select(F.expr("every[at.i].src").alias("src"), F.col("at.j").alias("block"), (F.col("t0") + F.col("no")).alias("slot"))


def mixed(
    docs: DataFrame, targets: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", alpha: float = 0.5, resolution: int = 200, block_docs: int = 64, max_sources: int = 1000,
) -> DataFrame:
    """docs with mix_block (of its source), mix_slot (of all blocks) and mix_place (in the block).

    targets: (source, weight); without it, weights are the number of documents to the power alpha. More than max_sources
    sources have no tickets. Columns of docs that have the names of the new ones are replaced.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_place")
    sources = _tickets(docs, source_col, targets, alpha, resolution, block_docs)
    if sources is None:
        return docs.select("*", *[F.lit(None).cast("long").alias(c) for c in ("mix_block", "mix_slot", "mix_place")])
    total = docs.count()
    bits = math.ceil(math.log2(max(1, total / BUCKET_ROWS)))
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), _source(source_col).alias("src"), order.alias("h"), F.col(id_col).alias("id"))
    # the first bits of 60 of the hash, so that buckets are in its order
    keyed = keyed.withColumn("bucket", F.shiftrightunsigned(F.conv(F.substring("h", 1, 15), 16, 10).cast("long"), 60 - bits))
    counts = keyed.groupBy("src", "bucket").agg(F.count("*").alias("n_bucket"))
    before = F.sum("n_bucket").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("src", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("src", "bucket").orderBy("h", "id"))
    ranked = keyed.join(offsets, ["src", "bucket"]).withColumn("rank", F.col("before") + number - 1)
    every = sources.orderBy("src").collect()
    blocks = [-(-r.n // block_docs) for r in every]
    # what a weight that is none stands for
    none = sum(not r.w > 0 for r in every)
    least = (sum(r.w for r in every if r.w > 0) or 1.0) / resolution / max(1, none)
    w = [r.w if r.w > 0 else least for r in every]
    if len(every) > max_sources or _off(np.array(w), np.array([r.tickets for r in every]), np.array([r.periods for r in every])) >= 1:
        sizes = sources.select("src", "n", F.expr(f"(n + {block_docs - 1}) div {block_docs}").alias("blocks"), F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(least)).alias("w"))
        slots = _windows(sizes, sum(blocks)) if len(every) <= max_sources else _on_driver(docs.sparkSession, [r.src for r in every], w, blocks)
        sized = F.broadcast(sizes.drop("w")) if len(every) <= max_sources else sizes.drop("w")
        found = ranked.join(sized, "src").withColumn("block", F.expr("(rank * blocks) div n"))
        found = found.join(F.broadcast(slots) if sum(blocks) <= BROADCAST_SLOTS else slots, ["src", "block"], "left")
        slot = F.coalesce("slot", F.raise_error(F.lit("a block has no slot")).cast("long"))
        return found.select("row.*", F.col("block").alias("mix_block"), slot.alias("mix_slot"), F.expr("rank - (block * n + blocks - 1) div blocks").alias("mix_place"))
    # at most max_sources rows, which together hold at most max_sources * (resolution + max_sources) slots
    found = ranked.join(F.broadcast(_slots(sources)), "src")
    found = found.withColumn("block", F.expr("(rank * tickets * periods) div n")).withColumn("run", F.expr("filter(runs, r -> block div tickets >= r.low and block div tickets < r.high)[0]"))
    slot = F.expr("run.first + (block div tickets - run.low) * run.size + run.own[cast(block % tickets as int)]")
    # the first rank of block b is the least r with r * blocks div n = b
    place = F.expr("rank - (block * n + tickets * periods - 1) div (tickets * periods)")
    return found.select("row.*", F.col("block").alias("mix_block"), slot.cast("long").alias("mix_slot"), place.alias("mix_place"))


#: The same rows in DuckDB SQL, for the default weights.
def oracle(alpha: float = 0.5, resolution: int = 200, block_docs: int = 64) -> str:
    return f"""
    with recursive c as (select source as src, count(*)::bigint as n from documents group by source),
    k as (select src, n, greatest(1, round(pow(n, {alpha}) * {resolution} / (select sum(pow(n, {alpha})) from c)))::bigint as tickets from c),
    s as (select *, (n + tickets * {block_docs} - 1) // (tickets * {block_docs}) as periods from k),
    runs as (select periods as high, coalesce(lag(periods) over (order by periods), 0) as low from (select distinct periods from s)),
    part as (select high, low, src, tickets, row_number() over (partition by high order by src) as i, sum(tickets) over (partition by high)::bigint as size
             from runs join s on s.periods >= runs.high),
    lists as (select high, low, size, list(tickets order by i) as tk, list(src order by i) as names from part group by high, low, size),
    edf(high, t, done, best) as (
        select high, 0::bigint, list_transform(tk, lambda x: 0::bigint), 0::bigint from lists
        union all
        select high, t + 1, list_transform(done, lambda d, i: d + case when i = pick then 1 else 0 end), pick from (
            select l.high, e.t, e.done,
                   list_sort(list_filter(list_transform(l.tk, lambda a, i: case when e.done[i] < a and (e.done[i] * l.size) // a <= e.t
                       then [((e.done[i] + 1) * l.size + a - 1) // a, i] end), lambda c: c is not null))[1][2] as pick
            from edf e join lists l using (high) where e.t < l.size)),
    slots as (select e.high, l.names[e.best] as src, e.t - 1 as slot, row_number() over (partition by e.high, e.best order by e.t) - 1 as j
              from edf e join lists l using (high) where e.t > 0),
    firsts as (select r.high, r.low, l.size, (select coalesce(sum(s.tickets * least(s.periods, r.low)), 0) from s)::bigint as first from runs r join lists l using (high)),
    d as (select doc_id, source, row_number() over (partition by source order by md5(doc_id::varchar), doc_id) - 1 as rank from documents),
    b as (select d.*, s.n, s.tickets, s.periods, (rank * s.tickets * s.periods) // s.n as block from d join s on s.src = d.source)
    select doc_id, source, block as mix_block, f.first + (block // tickets - f.low) * f.size + slots.slot as mix_slot,
           rank - (block * n + tickets * periods - 1) // (tickets * periods) as mix_place
    from b join firsts f on block // tickets >= f.low and block // tickets < f.high
    join slots on slots.high = f.high and slots.src = b.source and slots.j = block % tickets"""
