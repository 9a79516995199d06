"""SimHash near-dedup: pigeonhole blocks.

Fingerprints within r bits of each other, cut into m blocks, agree on at least m - r whole blocks. Each distinct
fingerprint is therefore filed under every choice of m - r blocks; files with two or more members are searched for pairs
within r bits. A search walks from member to member over those not yet reached, and gives only the links of a spanning
forest, never all pairs. Larger files are dealt as pairs of chunks, so no task holds a whole one. Components of the links
join the documents.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows are rows of their own, and long texts
count whole. Extra columns are never looked at. An empty
table gives an empty result. The smallest id names a component; null ids count only where there is no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_parts, join_groups, materialize, small_batches
from .components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of `size` lower-cased words, repeats included; of all words if there are fewer."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - size] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(joined)]
    parts = [joined[a:b] for a, b in zip(starts, ends, strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=len(parts))


def fingerprint(hashes: np.ndarray) -> int:
    """The 64 majority bits."""
    if len(hashes) == 0:
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))

    def run(batches):
        for batch in batches:
            buf, off = binary_parts(batch.column(1))
            raw = memoryview(buf)
            fps = np.array([fingerprint(shingle_hashes(bytes(raw[a:b]), shingle)) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(run, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())]))


def block_masks(bits: int, blocks: int, distance: int) -> list[int]:
    """For each choice of blocks - distance blocks, the mask of their bits, as signed longs."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    out = [sum(c) for c in combinations(masks, blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def walk(words: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links (member, members) of a spanning forest of the rows of words (n, w) within `distance` bits."""
    left = np.arange(len(words))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(words[left] ^ words[at]).sum(axis=1, dtype=np.int64) <= distance
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found.tolist())
                yield at, found


def shared_files(keyed: DataFrame, chunk: int) -> DataFrame:
    """Of keyed (node, t, key), the rows of files with several members, each with its chunk pair (p, q).

    Files with the same members are visited once. A file over `chunk` members is dealt as pairs of chunks, which together
    hold every pair of members.
    """
    files = (
        keyed.groupBy("t", "key")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        .where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("t", "key")).alias("f"))
        .select("f.t", "f.key", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("chunks"))
    )
    own = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks"))).otherwise(F.lit(0)).cast("int")
    return (
        keyed.join(files, ["t", "key"]).withColumn("i", own)
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("t", "key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "node")
    )


def hamming(distance: int) -> Callable:
    """Links between fingerprints, given as signed longs, within `distance` bits."""

    def links(values, cuts):
        words = values.to_numpy().view(np.uint64).reshape(-1, 1)
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        near = np.bitwise_count(words[two] ^ words[two + 1]).sum(axis=1, dtype=np.int64) <= distance
        yield two[near], two[near] + 1
        for i in np.flatnonzero(sizes > 2).tolist():
            s, e = int(cuts[i]), int(cuts[i + 1])
            for at, found in walk(words[s:e], distance):
                yield np.full(len(found), s + at), s + found

    return links


def linked(members: DataFrame, find: Callable) -> DataFrame:
    """Links (a, b) between nodes of one file. members: t, key, p, q, node, and the value that `find` compares.

    find(values, cuts) gives (rows, rows) of the links, none of which crosses a cut.
    """

    def run(batches):
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            batch = table.to_batches()[0]
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            cuts = np.flatnonzero(new)
            held = batch.slice(int(cuts[-1]))
            yield from links(batch, cuts)
        if held is not None:
            yield from links(held, np.array([0, held.num_rows]))

    def links(batch, cuts):
        if len(cuts) < 2:
            return
        node = batch.column(4).to_numpy()
        a, b = zip(*find(batch.column(5), cuts), (np.zeros(0, np.int64),) * 2, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(node[np.concatenate(a)]), pa.array(node[np.concatenate(b)])], names=["a", "b"])

    dealt = members.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q")
    return dealt.mapInArrow(run, "a long, b long")


def close(nodes: DataFrame, distance: int = 3, blocks: int = 6, chunk: int = 8192) -> DataFrame:
    """Links (a, b) between fingerprints, of nodes (fp) without repeats: those of spanning forests within `distance` bits."""
    masks = block_masks(64, blocks, distance)
    keyed = nodes.select(F.col("fp").alias("node"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("t", "key"))
    return linked(shared_files(keyed, chunk).withColumn("fp", F.col("node")), hamming(distance))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, blocks: int = 6, chunk: int = 8192) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links)."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("size")), "nodes")
    edges = close(nodes, distance, blocks, chunk)
    label = F.coalesce(F.col("label"), F.col("fp"))
    named = nodes.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "size", label.alias("label"))
    lows = named.groupBy("label").agg(F.min("low").alias("component_id"))
    of_fp = materialize(named.join(lows, "label").select("fp", "component_id", "size"), "named")
    return join_groups(fps, of_fp, ["fp"], "size", "inner").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, blocks: int = 6, chunk: int = 8192) -> DataFrame:
    """x, y (x < y): rows whose components are those of simhash_groups, a spanning forest and never all pairs. Ids are different and not null."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("size")), "nodes")
    same = join_groups(fps, nodes, ["fp"], "size", "inner").select(F.col("low").alias("a"), F.col("id").alias("b"))
    lows = nodes.select("fp", "low")
    other = close(nodes, distance, blocks, chunk).join(lows.withColumnRenamed("fp", "a"), "a").withColumnRenamed("low", "x").join(lows.withColumnRenamed("fp", "b"), "b").select(F.col("x").alias("a"), F.col("low").alias("b"))
    return same.unionByName(other).where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
