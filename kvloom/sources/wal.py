"""Binary logs: frames of a length, a CRC-32 and a payload, each payload one log entry, all little-endian.

Reading stops at the first frame that is cut short, damaged, or out of order, and keeps what came before. A file is read
by one task, as each frame begins where the last one ends; logs are many files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of operations, and the largest payload.
OPS = ["PUT", "DEL", "NONE", "ADD_LEARNER", "PROMOTE_VOTER", "REMOVE_MEMBER"]
MAX_PAYLOAD = 64 << 20
ENTRY_SCHEMA = "file string, idx long, term long, op string, k string, v string, node_id string, table_id int, shard_index int, replica_seq int, host string, port int, need_recover boolean"

#: The member that a configuration change is about, and what stands for none in a log.
MEMBER = {"node_id": "", "table_id": -1, "shard_index": -1, "replica_seq": -1, "host": "", "port": 0}
NOBODY = tuple(MEMBER.values())


def _text(s: str) -> bytes:
    data = s.encode()
    return struct.pack("<i", len(data)) + data


def encode(term: int, idx: int, op: str, key: str, value: str, member: tuple | None = None) -> bytes:
    """One frame. member: node_id, table_id, shard_index, replica_seq, host, port of a configuration change, else none."""
    node, table, shard, seq, host, port = member or NOBODY
    replica = struct.pack("<iii", table, shard, seq)
    change = _text(node) + replica + _text(host) + struct.pack("<i", port) + replica
    payload = struct.pack("<qqi", term, idx, OPS.index(op)) + _text(key or "") + _text(value or "") + change
    return struct.pack("<iI", len(payload), zlib.crc32(payload)) + payload


def decode(data: bytes) -> tuple[list[tuple], bool]:
    """((idx, term, op, key, value, member or None) of each good frame, whether what follows is damaged)."""
    out: list[tuple] = []
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            return out, True
        size, crc = struct.unpack_from("<iI", data, at)
        payload = data[at + 8 : at + 8 + size] if 0 < size <= MAX_PAYLOAD else b""
        if len(payload) != size or not payload or zlib.crc32(payload) != crc:
            return out, True
        try:
            entry = _entry(payload)
        except (struct.error, IndexError, UnicodeDecodeError, ValueError):
            return out, True
        if out and entry[0] != out[-1][0] + 1:
            return out, True
        out.append(entry)
        at += 8 + size
    return out, False


class _Reader:
    def __init__(self, payload: bytes) -> None:
        self.payload, self.at = payload, 0

    def numbers(self, layout: str) -> tuple:
        found = struct.unpack_from(layout, self.payload, self.at)
        self.at += struct.calcsize(layout)
        return found

    def text(self) -> str:
        (n,) = self.numbers("<i")
        if n < 0 or self.at + n > len(self.payload):
            raise ValueError("text beyond the payload")
        self.at += n
        return self.payload[self.at - n : self.at].decode()


def _entry(payload: bytes) -> tuple:
    r = _Reader(payload)
    term, idx, op = r.numbers("<qqi")
    key, value = r.text(), r.text()
    member = (r.text(), *r.numbers("<iii"), r.text(), *r.numbers("<i"))
    replica = r.numbers("<iii")
    if r.at != len(payload):
        raise ValueError("bytes after the entry")
    if not 0 <= op < len(OPS):
        raise ValueError("unknown operation")
    if member == NOBODY and replica != NOBODY[1:4]:
        member = (*NOBODY[:1], *replica, *NOBODY[4:])
    return idx, term, OPS[op], key, value, None if member == NOBODY else member


def frames(log: DataFrame, segment: int) -> DataFrame:
    """segment, content: the log's entries as binary files of `segment` entries each, with the columns of MEMBER where the log has them."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        members = zip(*(part[c].tolist() for c in MEMBER), strict=True)
        data = b"".join(encode(*x) for x in zip(part.term.tolist(), part.idx.tolist(), part.op, part.k, part.v, members, strict=True))
        return pd.DataFrame({"segment": [int(part.segment.iloc[0])], "content": [data]})

    change = [(F.coalesce(c, F.lit(none)) if c in log.columns else F.lit(none)).alias(c) for c, none in MEMBER.items()]
    rows = log.select("idx", "term", "op", "k", "v", *change, F.floor((F.col("idx") - 1) / segment).cast("long").alias("segment"))
    return rows.groupBy("segment").applyInPandas(pack, "segment long, content binary")


def entries(files: DataFrame) -> DataFrame:
    """Entries of files (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part.path, part.content, strict=True):
                good, damaged = decode(bytes(content))
                if good:
                    rows = [(path, *x[:5], *(x[5] or [None] * len(MEMBER)), damaged) for x in good]
                    yield pd.DataFrame(rows, columns=["file", "idx", "term", "op", "k", "v", *MEMBER, "need_recover"]).astype({c: "Int32" for c, none in MEMBER.items() if none != ""})

    return files.select("path", "content").mapInPandas(run, ENTRY_SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the binary logs under path."""
    return entries(spark.read.format("binaryFile").load(path))
