"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

A passage of n characters that occurs with at most k = floor(rate * n) edits shares at least n - q + 1 - k * q of its
q-grams with the place where it occurs, on diagonals no more than k apart. Shared q-grams are counted in overlapping bands
of diagonals; bands that reach the bound are verified by alignment within the band.

Where the bound would be below 1, the passage is searched with the largest q that keeps it at 1 or more.

Texts are compared as letters and digits in lower case, every other run being one space. Null texts and passages match
nothing, nor do passages without such characters. Passages of fewer than min_chars such characters are found without edits
only, and as whole words where the script parts words by spaces. Equal passages are found each for itself; of several
places, the one with the fewest edits counts, then the first. Empty tables give no rows; extra columns are never looked at.

Items may be of any type that casts to text and back. Repeated documents are searched each for itself, and long ones whole:
memory is some 30 bytes a character of the longest text.

Passages are broadcast in blocks of at most block_chars characters, one at a time; documents are scanned once for each block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, small_batches

_PLAIN = np.arange(1 << 16, dtype=np.uint32)
for _c in range(1 << 16):
    _s = chr(_c)
    _PLAIN[_c] = ord(_s.lower()) if _s.isalnum() and len(_s.lower()) == 1 else _c if _s.isalnum() else 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_LOW = np.uint64((1 << _BITS) - 1)
_END = 0x110000  # ends each text; no character has this number
_NOWHERE = -(1 << 30)
_WINDOW = 1 << 18  # q-grams hashed at once
_PIECE = 400_000  # characters of several texts searched at once


def plain_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters compared of all texts, each text ended by _END; where each stands in its text; where each text ends)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes + 1) - 1
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(codes) and codes.max() >= 1 << 16:
        out = np.where(codes < 1 << 16, _PLAIN[np.minimum(codes, (1 << 16) - 1)], codes)
    else:
        out = _PLAIN[codes]
    solid = out != 32
    keep = solid.copy()
    keep[1:] |= solid[:-1]  # one space after a word
    out[ends] = _END
    keep[ends] = True
    at = np.flatnonzero(keep)
    out = out[at]
    last = np.flatnonzero(out == _END)
    spaces = last[out[last - 1] == 32] - 1 if len(last) else last  # but for the last word of a text
    spaces = spaces[spaces >= 0]
    if len(spaces):
        keep = np.ones(len(out), bool)
        keep[spaces] = False
        out, at = out[keep], at[keep]
        last = np.flatnonzero(out == _END)
    at -= np.repeat(ends - sizes, np.diff(last, prepend=-1))
    return out, at, last


def plain(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(characters compared, where each stands in the text)."""
    codes, at, _ = plain_all([text])
    return codes[:-1], at[:-1]


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, put together from runs of twice the length."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, length, step = codes.astype(np.uint64), 1, int(_STEP)
    out, done = None, 0
    while True:
        if q & length:
            out = run[done : done + n].copy() if out is None else out * np.uint64(step) + run[done : done + n]
            done += length
        if done == q:
            return out ^ (out >> np.uint64(31))
        run = run[:-length] * np.uint64(step) + run[length:]
        length, step = 2 * length, step * step & 0xFFFFFFFFFFFFFFFF


def align(passage: np.ndarray, region: np.ndarray, first: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of passage in region, or None over budget. Start and end are free.

    Only diagonals first .. first + width - 1 are looked at. For each number of edits and each diagonal, what counts is
    how far into the passage one gets; equal characters along a diagonal are passed in one step.
    """
    m, n = len(passage), len(region)
    diagonal = first + np.arange(width)
    shift = max(0, -first)
    padded = np.full(max(shift + n, first + shift + width + m), _END + 1, dtype=np.uint32)
    padded[shift : shift + n] = region
    rows = np.lib.stride_tricks.sliding_window_view(padded, m)[first + shift : first + shift + width]
    # for each diagonal and place in the passage: the next place at which characters differ
    stop = np.full((width, m + 1), m, dtype=np.int32)
    np.copyto(stop[:, :m], np.arange(m, dtype=np.int32), where=rows != passage)
    stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
    each, most = np.arange(width), np.minimum(n - diagonal, m)
    reach = np.where((diagonal >= 0) & (diagonal <= n), 0, _NOWHERE)
    start = diagonal.copy()
    for edits in range(budget + 1):
        if edits:
            up = np.append(reach[1:], _NOWHERE) + 1  # a character of the passage is skipped
            along = np.append(_NOWHERE, reach[:-1])  # one of the region
            best = np.maximum(np.maximum(reach + 1, up), along)
            start = np.where(best == reach + 1, start, np.where(best == up, np.append(start[1:], 0), np.append(0, start[:-1])))
            reach = np.minimum(best, most)
        there = reach >= 0
        reach[there] = stop[each[there], reach[there]]
        done = np.flatnonzero(reach == m)
        if len(done):
            k = done[np.lexsort((diagonal[done], start[done]))[0]]
            return edits, int(start[k]), m + int(diagonal[k])
    return None


class Table:
    """Passages by the hashes of their grams of q characters; `seen` spares the search for most that are in none."""

    def __init__(self, q: int, codes: list[np.ndarray]) -> None:
        self.q = q
        every = [grams(x, q) for x in codes]
        sizes = np.array([len(g) for g in every])
        h = np.concatenate(every)
        order = np.argsort(h, kind="stable")
        self.owner = np.repeat(np.arange(len(every)), sizes)[order]
        self.place = (np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
        self.hashes, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self.hashes & _LOW] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, place in it, place in codes) of each shared gram."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(codes) - self.q + 1, _WINDOW):
            g = grams(codes[a : a + _WINDOW + self.q - 1], self.q)
            maybe = np.flatnonzero(self.seen[g & _LOW])
            if len(maybe):
                some = g[maybe]
                k = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
                true = self.hashes[k] == some
                places.append(maybe[true] + a)
                found.append(k[true])
        at, k = np.concatenate(places), np.concatenate(found)
        sizes = self.first[k + 1] - self.first[k]
        entry = np.repeat(self.first[k] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.owner[entry], self.place[entry], np.repeat(at, sizes)


class Grams:
    """Passages (number, characters, edits allowed), searched by q-grams."""

    def __init__(self, passages: list[tuple[int, np.ndarray, int]], q: int) -> None:
        self.numbers, self.codes, self.budget = (list(x) for x in zip(*passages, strict=True))
        self.table = Table(q, self.codes)
        self.least = np.array([len(c) - q + 1 - k * q for c, k in zip(self.codes, self.budget, strict=True)], dtype=np.int64)
        self.band = max(self.budget) + 1

    def find(self, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        """(text, number, edits, start, end) of each passage that occurs; start and end count from codes' beginning."""
        item, place, at = self.table.hits(codes)
        text = np.searchsorted(ends, at)
        # the bound holds for the whole text first: most texts share too few grams with any passage
        pair, own, counts = np.unique(text * len(self.codes) + item, return_inverse=True, return_counts=True)
        enough = counts >= self.least[pair % len(self.codes)]
        if not enough.any():
            return
        mine = enough[own]
        own, place, at = own[mine], place[mine], at[mine]
        begins = np.append(0, ends[:-1] + 1)
        # a band holds 2 * self.band diagonals and starts every self.band: diagonals self.band apart or less share one
        lower = (at - begins[pair[own] // len(self.codes)] - place) // self.band
        key = np.concatenate([own * (1 << 40) + lower + (1 << 20), own * (1 << 40) + lower - 1 + (1 << 20)])
        where = np.tile(place, 2)
        order = np.lexsort((where, key))
        key, where = key[order], where[order]
        once = np.ones(len(key), bool)  # a q-gram of the passage counts once for each band
        once[1:] = (key[1:] != key[:-1]) | (where[1:] != where[:-1])
        keys, counts = np.unique(key[once], return_counts=True)
        pairs = pair[keys >> 40]
        good = counts >= self.least[pairs % len(self.codes)]
        best: dict[int, tuple] = {}
        for p, band in zip(pairs[good].tolist(), ((keys[good] & ((1 << 40) - 1)) - (1 << 20)).tolist(), strict=True):
            if p in best and best[p][0] == 0:  # further bands only begin later
                continue
            i, begin = p % len(self.codes), int(begins[p // len(self.codes)])
            own_codes = codes[begin : int(ends[p // len(self.codes)])]
            passage, budget = self.codes[i], self.budget[i]
            first = band * self.band - budget
            lo = max(0, first)
            hi = min(len(own_codes), (band + 2) * self.band + len(passage) + budget)
            found = align(passage, own_codes[lo:hi], first - lo, 2 * self.band + 2 * budget, budget)
            if found and (p not in best or (found[0], begin + lo + found[1]) < best[p][:2]):
                best[p] = (found[0], begin + lo + found[1], begin + lo + found[2])
        for p, place in best.items():
            yield p // len(self.codes), self.numbers[p % len(self.codes)], *place


class Short:
    """Passages (number, characters) of one length that are found without edits."""

    def __init__(self, passages: list[tuple[int, np.ndarray]]) -> None:
        self.numbers, self.codes = (list(x) for x in zip(*passages, strict=True))
        self.n = len(self.codes[0])
        self.table = Table(self.n, self.codes)

    def find(self, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        item, _, at = self.table.hits(codes)
        text = np.searchsorted(ends, at)
        seen = set()
        for t, i, start in zip(text.tolist(), item.tolist(), at.tolist(), strict=True):
            end = start + self.n
            if (t, i) in seen or not np.array_equal(codes[start:end], self.codes[i]) or _inside_word(codes, start) or _inside_word(codes, end):
                continue
            seen.add((t, i))
            yield t, self.numbers[i], 0, start, end


def _inside_word(codes: np.ndarray, at: int) -> bool:
    """Whether the place before codes[at] is within a word; scripts from Thai on need no spaces between words."""
    return 0 < at < len(codes) and all(c != 32 and c < 0x0E00 for c in codes[at - 1 : at + 1].tolist())


class Passages:
    """A block of passages: those of min_chars or more by q-grams, with q as large as the bound allows, shorter ones as they are."""

    def __init__(self, items: list[tuple], q: int, rate: float, min_chars: int) -> None:
        self.ids = [item_id for item_id, _ in items]
        long, short = defaultdict(list), defaultdict(list)
        for number, (_, text) in enumerate(items):
            codes, _ = plain(text)
            k = int(rate * len(codes))
            if len(codes) >= min_chars and len(codes) > k:
                long[min(q, len(codes) // (k + 1))].append((number, codes, k))  # n - q + 1 - k q is 1 or more up to this q
            elif len(codes):
                short[len(codes)].append((number, codes))
        self.parts = [Grams(own, x) for x, own in sorted(long.items())] + [Short(x) for _, x in sorted(short.items())]

    def find_all(self, texts: list[str | None]) -> Iterator[tuple]:
        """(text, item, edits, start, end) of each passage that occurs; start and end count the text's characters."""
        if not self.parts:
            return
        texts = [t or "" for t in texts]
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= _PIECE):
                size += len(texts[last])
                last += 1
            codes, at, ends = plain_all(texts[first:last])
            for t, number, edits, start, end in sorted(x for part in self.parts for x in part.find(codes, ends)):
                yield first + t, self.ids[number], edits, int(at[start]), int(at[max(start, end - 1)]) + 1
            first = last

    def find(self, text: str) -> Iterator[tuple]:
        """(item, edits, start, end) of each passage that occurs in one text."""
        for _, *found in self.find_all([text]):
            yield tuple(found)


def _passage_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[tuple[list[tuple], bool]]:
    """(passages of a block, whether it is the only one). Items are text here, so that they may be of any type."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    held, size, alone = [], 0, True
    for r in rows.toLocalIterator():
        if held and size + len(r.t) > block_chars:
            alone = False
            yield held, alone
            held, size = [], 0
        held.append((r.i, r.t))
        size += len(r.t)
    if held:
        yield held, alone


def _searched(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, q: int, rate: float, min_chars: int, block_chars: int, search: Callable, schema: T.StructType, chain: bool) -> list[DataFrame]:
    """What search(passages, batch) gives, for each block of passages; if chain, each block searches what the last one gave.

    A single block is searched lazily. Of several, each is written before the next one is sent, so that one is held at a time.
    """
    out: list[DataFrame] = []
    sc = rows.sparkSession.sparkContext
    for block, alone in _passage_blocks(benchmark, item_col, item_text_col, block_chars):
        shared = sc.broadcast(Passages(block, q, rate, min_chars))

        def run(batches, shared=shared):
            for batch in batches:
                yield search(shared.value, batch)

        found = (out[-1] if chain and out else rows).mapInArrow(run, schema)
        if not alone:
            found = materialize(found, "leaks")
            shared.destroy()
        out.append(found)
    return out


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    q: int = 8, rate: float = 0.1, min_chars: int = 24, block_chars: int = 4_000_000,
) -> DataFrame:
    """One row per document and passage that occurs in it: id, item, edits, start, end (characters of the text)."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("item", T.StringType()),
        T.StructField("edits", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ])
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def search(passages: Passages, batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = list(passages.find_all(batch.column(1).to_pylist()))
        cols = list(zip(*hits, strict=True)) or [()] * 5
        arrays = [pa.array(c, kind) for c, kind in zip(cols[1:], kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *arrays], names=schema.names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = _searched(rows, benchmark, item_col, item_text_col, q, rate, min_chars, block_chars, search, schema, chain=False)
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return out.select(F.col("id").alias(id_col), F.col("item").cast(benchmark.schema[item_col].dataType).alias(item_col), "edits", "start", "end")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = 8, rate: float = 0.1, min_chars: int = 24, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs in which no passage occurs, with all their columns."""
    small_batches(docs.sparkSession)
    held = fresh("text", docs.columns)
    rows = docs.withColumn(held, F.col(text_col).cast("string"))
    at = len(docs.columns)

    def search(passages: Passages, batch: pa.RecordBatch) -> pa.RecordBatch:
        dirty = {x[0] for x in passages.find_all(batch.column(at).to_pylist())}
        return batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)], pa.bool_()))

    parts = _searched(rows, benchmark, item_col, item_text_col, q, rate, min_chars, block_chars, search, rows.schema, chain=True)
    return parts[-1].drop(held) if parts else docs
