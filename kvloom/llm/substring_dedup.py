"""Substring dedup by prefix-partitioned suffix trees over words.

A word is removed when a window of `window` words that covers it also starts in a document with a smaller id. The
windows are the suffixes of the corpus cut at that depth, and the nodes of depth `window` give the repeats.

1. Documents are packed into blocks of some MB, written once as a table bucketed by block. Later passes read it in place,
   so texts are never shuffled.
2. Every window has an anchor: the run of ANCHOR words in it whose hash is least. Equal windows have equal anchors, so a
   window whose anchor occurs once cannot repeat. Blocks send the anchors' hashes, once each, and get back which recur.
   This only spares work: it drops no window that repeats.
3. Windows in a row with one anchor form a segment. Blocks send each different segment with a recurring anchor once,
   with the smallest id it has there, to the anchor's part. There, suffixes are split by prefixes of as many words as
   it takes for a group to fit memory; each group's subtree is built from its sorted suffixes, and each deep node gives
   the smallest id below it. Words are compared, not hashes.
4. Blocks get the smallest ids back and mark the words.

Ids are integers. Null texts have no words. A null id counts as larger than any other; rows with the same id do not
repeat each other. Long texts count whole. Extra columns are never looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .common import CHUNK_BYTES, binary_parts, bucketed, materialize, mix64, row_chunks, small_batches, span_hashes, word_spans

ANCHOR = 5
PART_BYTES = 4 << 20  # text to a part, about
NO_ID = np.iinfo(np.int64).max
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """The words of a block of documents, and its segments: runs of windows with one anchor."""

    def __init__(self, body: bytes, ends: np.ndarray, window: int) -> None:
        self.body = body
        self.offsets = np.concatenate([[0], ends]).astype(np.int64)
        buf = np.frombuffer(body, dtype=np.uint8)
        starts, stops, firsts, keys, seg_first, seg_last = [], [], [np.zeros(1, np.int64)], [], [], []
        base = 0
        for a, z in row_chunks(self.offsets, CHUNK_BYTES):
            lo = int(self.offsets[a])
            part = buf[lo : int(self.offsets[z])]
            s, e, first = word_spans(part, self.offsets[a : z + 1] - lo)
            if len(s):
                k, f, t = _segments(span_hashes(part, s, e), first, window)
                keys.append(k)
                seg_first.append(f + base)
                seg_last.append(t + base)
            starts.append(s + lo)
            stops.append(e + lo)
            firsts.append(first[1:] + base)
            base += len(s)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        #: Of each word; the first word of each document; and of each segment: anchor, first window, last window.
        self.starts, self.stops, self.firsts = join(starts, np.int64), join(stops, np.int64), np.concatenate(firsts)
        self.keys, self.seg_first, self.seg_last = join(keys, np.int64), join(seg_first, np.int64), join(seg_last, np.int64)
        self.anchors, self._which, self._count = np.unique(self.keys, return_inverse=True, return_counts=True)

    def cuts(self, parts: int) -> np.ndarray:
        """Where each part's anchors begin."""
        return np.searchsorted(self.anchors, (np.arange(parts + 1, dtype=object) * (1 << 47) // parts).astype(np.int64))

    def recurring(self, replies: list, parts: int) -> np.ndarray:
        """Whether each segment's anchor occurs again, here or elsewhere."""
        found = self._count > 1
        cuts = self.cuts(parts)
        for part, bits in replies:
            a, b = cuts[part], cuts[part + 1]
            found[a:b] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a).astype(bool)
        return found[self._which]

    def contents(self, chosen: np.ndarray, window: int, parts: int) -> tuple[dict[int, list[bytes]], np.ndarray, np.ndarray]:
        """Different segments by part; of each chosen segment, its part and its place there."""
        out: dict[int, dict[bytes, int]] = defaultdict(dict)
        bounds = (np.arange(1, parts + 1, dtype=object) * (1 << 47) // parts).astype(np.int64)
        part = np.searchsorted(bounds, self.keys[chosen], side="right")
        place = np.empty(len(chosen), np.int64)
        a = self.starts[self.seg_first[chosen]].tolist()
        b = self.stops[self.seg_last[chosen] + window - 1].tolist()
        for i, (s, e, p) in enumerate(zip(a, b, part.tolist(), strict=True)):
            own = out[p]
            place[i] = own.setdefault(b" ".join(self.body[s:e].split()), len(own))
        return {p: list(x) for p, x in out.items()}, part, place


def _segments(hashes: np.ndarray, firsts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each segment."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none
    grams = np.zeros(n - ANCHOR + 1, np.uint64)
    for j in range(ANCHOR):
        grams = grams * _STEP + hashes[j : n - ANCHOR + 1 + j]
    grams = mix64(grams)
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    if len(at) == 0:
        return none, none, none
    least = np.lib.stride_tricks.sliding_window_view(grams, window - ANCHOR + 1)[at].argmin(axis=1) + at
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return (grams[least[begin]] >> np.uint64(17)).astype(np.int64), at[begin], at[end]


def smallest_below(words: np.ndarray, starts: np.ndarray, ids: np.ndarray, window: int, group: int) -> np.ndarray:
    """For each suffix, the smallest id below its node of depth `window`.

    words: numbers of words; ids: of each suffix. Suffixes are split by one more word of prefix until `group` of them or
    fewer share it; a subtree comes from their sorted order, in which suffixes of one deep node are neighbours.
    """
    out = ids.copy()
    stack = [(np.arange(len(starts)), 0)]
    while stack:
        chosen, depth = stack.pop()
        if len(chosen) < 2:
            continue
        if len(chosen) > group and depth < window:
            head = words[starts[chosen] + depth]
            order = np.argsort(head, kind="stable")
            cut = np.flatnonzero(np.diff(head[order])) + 1
            if len(cut):
                # small neighbours share a subtree: all their suffixes are split by this word too
                held: list[np.ndarray] = []
                size = 0
                for piece in np.split(chosen[order], cut):
                    if len(piece) > group:
                        stack.append((piece, depth + 1))
                        continue
                    if size + len(piece) > group:
                        _subtree(words, starts, np.concatenate(held), out, window)
                        held, size = [], 0
                    held.append(piece)
                    size += len(piece)
                if held:
                    _subtree(words, starts, np.concatenate(held), out, window)
                continue
            stack.append((chosen, depth + 1))
            continue
        if depth >= window:
            out[chosen] = out[chosen].min()
            continue
        _subtree(words, starts, chosen, out, window)
    return out


def _subtree(words: np.ndarray, starts: np.ndarray, chosen: np.ndarray, out: np.ndarray, window: int) -> None:
    rows = words[starts[chosen][:, None] + np.arange(window)].astype(">u4")
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{4 * window}").ravel(), kind="stable")
    rows = rows[order]
    leaves = chosen[order]
    node = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    low = np.minimum.reduceat(out[leaves], node)
    out[leaves] = np.repeat(low, np.diff(np.append(node, len(leaves))))


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, buckets: int) -> DataFrame:
    """block, ids, ends, body: documents in blocks, bucketed by block."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        ids, ends, body, size = [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([b"".join(body)], pa.binary())], names=["block", "ids", "ends", "body"])

        for batch in batches:
            buf, off = binary_parts(batch.column(1))
            raw = memoryview(buf)
            for i, row_id in enumerate(batch.column(0).to_pylist()):
                body.append(bytes(raw[off[i] : off[i + 1]]))
                size += len(body[-1])
                ids.append(row_id)
                ends.append(size)
                if size >= block_bytes:
                    yield row()
                    ids, ends, body, size = [], [], [], 0
                    number += 1
        if ids:
            yield row()

    return bucketed(rows.mapInArrow(run, "block long, ids array<long>, ends array<long>, body binary"), "block", buckets, "blocks")


def _each(batches) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i] for c in batch.columns)
        pa.default_memory_pool().release_unused()  # workers stay, beside the JVM


def _block(ends, body, window: int) -> Block:
    return Block(body.as_py() or b"", ends.values.to_numpy().astype(np.int64), window)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block_bytes: int = 2 << 20, group: int = 200_000) -> DataFrame:
    """One row per input row: id, n_words, n_removed, spans (word ranges [start, end) removed), kept_text."""
    if window < ANCHOR:
        raise ValueError(f"window must be {ANCHOR} words or more")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(docs, id_col, text_col, block_bytes, buckets)
    # parts grow with the text, so that none outgrows a task
    parts = max(4 * buckets, int(blocks.agg(F.coalesce(F.sum(F.element_at("ends", -1)), F.lit(0))).first()[0]) // PART_BYTES)

    def send_anchors(batches):
        for number, ends, body in _each(batches):
            block = _block(ends, body, window)
            cuts = block.cuts(parts)
            out = [(p, pack(np.diff(block.anchors[cuts[p] : cuts[p + 1]], prepend=0))) for p in np.flatnonzero(np.diff(cuts)).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([number.as_py()] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["part", "block", "blob"])

    def recur(table: pa.Table) -> pa.Table:
        sets = [np.cumsum(unpack(b.as_py())) for b in table.column("blob")]
        keys = np.sort(np.concatenate(sets))
        again = np.unique(keys[1:][keys[1:] == keys[:-1]])
        bits = [np.packbits(np.isin(s, again, assume_unique=True)).tobytes() for s in sets]
        return pa.table({"part": table.column("part"), "block": table.column("block"), "bits": pa.array(bits, pa.binary())})

    sent = blocks.select("block", "ends", "body").mapInArrow(send_anchors, "part int, block long, blob binary")
    replies = sent.groupBy("part").applyInArrow(recur, "part int, block long, bits binary")
    known = materialize(replies.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("known")), "anchors")

    def pairs(x) -> list:
        return [] if not x.is_valid else [(r["part"], next(v for k, v in r.items() if k != "part")) for r in x.as_py()]

    def send_segments(batches):
        for number, ids, ends, body, said in _each(batches):
            block = _block(ends, body, window)
            chosen = np.flatnonzero(block.recurring(pairs(said), parts))
            if len(chosen) == 0:
                continue
            found, part, place = block.contents(chosen, window, parts)
            own = _ids(ids)[np.searchsorted(block.firsts, block.seg_first[chosen], side="right") - 1]
            out = []
            for p in np.unique(part).tolist():
                low = np.full(len(found[p]), NO_ID)
                here = part == p
                np.minimum.at(low, place[here], own[here])
                out.append((p, zstandard.compress(b"\n".join(found[p]), 3), pack(low)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([number.as_py()] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["part", "block", "segments", "low"])

    def trees(table: pa.Table) -> pa.Table:
        texts = [zstandard.decompress(x.as_py()).split(b"\n") for x in table.column("segments")]
        low = np.concatenate([unpack(x.as_py()) for x in table.column("low")])
        lists = pc.split_pattern(pa.array([t for ts in texts for t in ts], pa.large_binary()), b" ")
        words = lists.values.dictionary_encode().indices.to_numpy().astype(np.int64)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        n = np.diff(offsets) - window + 1
        until = np.cumsum(n)
        starts = np.arange(until[-1]) - np.repeat(until - n, n) + np.repeat(offsets[:-1], n)
        least = smallest_below(words, starts, np.repeat(low, n), window, group)
        ends = until[np.cumsum([len(t) for t in texts]) - 1]
        blobs = [pack(x) for x in np.split(least, ends[:-1])]
        return pa.table({"part": table.column("part"), "block": table.column("block"), "least": pa.array(blobs, pa.binary())})

    joined = blocks.join(known, "block", "left")
    segments = joined.select("block", "ids", "ends", "body", "known").mapInArrow(send_segments, "part int, block long, segments binary, low binary")
    least = segments.groupBy("part").applyInArrow(trees, "part int, block long, least binary")
    by_block = least.groupBy("block").agg(F.collect_list(F.struct("part", "least")).alias("lows"))

    def mark(batches):
        for ids, ends, body, said, lows in _each(batches):
            block = _block(ends, body, window)
            n = len(block.starts)
            change = np.zeros(n + 1, np.int64)
            chosen = np.flatnonzero(block.recurring(pairs(said), parts))
            if len(chosen):
                found, part, place = block.contents(chosen, window, parts)
                own = _ids(ids)
                for p, blob in pairs(lows):
                    least_ids = unpack(blob)
                    sizes = np.array([t.count(b" ") + 2 - window for t in found[p]])
                    at = np.cumsum(sizes) - sizes
                    for i in np.flatnonzero(part == p).tolist():
                        s, t = int(block.seg_first[chosen[i]]), int(block.seg_last[chosen[i]]) + 1
                        me = own[np.searchsorted(block.firsts, s, side="right") - 1]
                        k = at[place[i]]
                        hit = least_ids[k : k + t - s] < me
                        change[s:t] += hit
                        change[s + window : t + window] -= hit
            removed = np.cumsum(change[:n]) > 0
            yield from _marked(block, ids, removed)

    out = blocks.join(known, "block", "left").join(by_block, "block", "left").select("ids", "ends", "body", "known", "lows")
    return out.mapInArrow(mark, "id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept_text string").withColumnRenamed("id", id_col)


def _ids(ids) -> np.ndarray:
    return ids.values.fill_null(NO_ID).to_numpy().astype(np.int64)


def _marked(block: Block, ids, removed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the result, in batches of some MB."""
    names = ["id", "n_words", "n_removed", "spans", "kept_text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    row_ids = ids.as_py()
    for a, z in row_chunks(block.offsets, CHUNK_BYTES):
        rows: list[list] = [[], [], [], [], []]
        for i in range(a, z):
            f, t = int(block.firsts[i]), int(block.firsts[i + 1])
            gone = removed[f:t]
            n_gone = int(gone.sum())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist() if n_gone else []
            spans = [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2], strict=True)]
            kept, at = [], 0
            for x in [*spans, {"start": t - f, "end": t - f}]:
                if x["start"] > at:
                    kept += block.body[int(block.starts[f + at]) : int(block.stops[f + x["start"] - 1])].split()
                at = x["end"]
            for col, v in zip(rows, (row_ids[i], t - f, n_gone, spans, b" ".join(kept)), strict=True):
                col.append(v)
        arrays = [pa.array(c, type=k) for c, k in zip(rows, kinds, strict=True)]
        arrays[4] = pa.Array.from_buffers(pa.string(), len(arrays[4]), arrays[4].buffers())
        yield pa.RecordBatch.from_arrays(arrays, names=names)
