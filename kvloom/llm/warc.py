"""WARC archives: written from pages, and read by boundary-chain verification.

Writing: of records with equal payloads of at least `min_bytes` bytes, the one with the largest page id is a response and
the others revisit it; smaller ones are all responses. Rows that share that largest id are all responses. Blocks are HTTP
responses; a revisit's block is the HTTP header alone, whose Content-Length tells the payload's size.

Reading: each task looks for the record magic anywhere in its files and emits, for each place that parses as a record, the
offset of the record and of its successor. Pointer jumping from offset 0 of each file doubles the known part of the chain
in each round; what the chain does not reach was magic inside a payload.

Null html is an empty payload, a null URL gives no WARC-Target-URI, a null page id is written as `none` and read as null;
null ids come last. Page ids are integers. Extra columns do not matter. No pages give no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialize

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.I)
_BLANK = re.compile(rb"\r\n\r\n")
_END = b"\r\n\r\n"


def _base32(hex_digest):
    """Twenty bits at a time: five hex digits to four letters."""
    value = lambda i: F.conv(F.substring(hex_digest, i * 5 + 1, 5), 16, 10).cast("int")
    letter = lambda v, shift: F.substring(F.lit(_BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*[letter(value(i), shift) for i in range(8) for shift in (15, 10, 5, 0)])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, records_per_file: int = 1000, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write gzipped archives of at most records_per_file records each under path."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    # a payload that very many pages share, an empty one for instance, does not meet in one task
    largest = materialize(rows.groupBy("sha", "n").agg(F.max("id").alias("top"), F.count("*").alias("size")), "warc-payloads")
    rows = join_groups(rows, largest.hint("merge"), ["sha", "n"], "size", "inner")
    revisit = (F.col("n") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("top"))
    name = lambda c: F.concat(F.lit("<urn:kvloom:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    size = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")), F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), _base32(F.col("sha")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("top")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"), http,
    )
    record = F.concat(header.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    # the line separator is the end of a record
    rows.select(record.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def candidates(content: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(offset, successor, end of header, length of block) of each place that parses as a record."""
    lengths = [(m.start(), int(m[1])) for m in _LENGTH.finditer(content)]
    starts = [x for x, _ in lengths]
    blanks = [m.start() for m in _BLANK.finditer(content)]
    for m in _MAGIC.finditer(content):
        i = bisect_left(blanks, m.end() - 2)
        k = bisect_left(starts, m.end() - 2)
        if i == len(blanks) or k == len(starts) or starts[k] >= blanks[i]:
            continue
        body = blanks[i] + 4
        end = body + lengths[k][1]
        if content.startswith(_END, end) and content.find(b"\r\nWARC/1.", m.end() - 2, blanks[i]) < 0:
            yield m.start(), end + 4, body, lengths[k][1]


def _fields(header: bytes) -> dict[str, str]:
    lines = header.split(b"\r\n")[1:]
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}


def _page(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:kvloom:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


_SCHEMA = "file string, offset long, next long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, payload binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record: file, offset, next, page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact, payload.

    payload is null for revisits; intact tells whether a response's payload has the digest that its header gives.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def run(batches):
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, held = [], 0
                for offset, after, body, size in candidates(data):
                    fields = _fields(data[offset : body - 4])
                    http, _, payload = data[body : body + size].partition(_END)
                    said = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)", http)
                    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    kind = fields.get("warc-type", "")
                    if kind == "revisit":
                        n, digest, intact, kept = int(said[1]) if said else None, told, None, None
                    else:
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        n, intact, kept = len(payload), digest == told, payload if with_payload else None
                    rows.append((name.as_py(), offset, after, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, _page(fields.get("warc-refers-to")), n, digest, intact, kept))
                    held += size if with_payload else 0
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield _rows(rows, kinds, names)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows, kinds, names)

    found = materialize(files.mapInArrow(run, _SCHEMA), "warc-candidates")
    return found.join(reachable(found.select("file", "offset", "next")).hint("merge"), ["file", "offset"], "left_semi")


def _rows(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) on the chain of links (file, offset, next) from each file's offset 0, the end of the chain included."""
    longest = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    state = links.select("file", "offset", F.col("next").alias("jump"), (F.col("offset") == 0).alias("on"))
    for _ in range(math.ceil(math.log2(longest + 1))):
        ahead = state.select("file", F.col("offset").alias("jump"), F.col("jump").alias("beyond"))
        # compressed sizes of paths and offsets mislead the choice of joins, so that nothing is broadcast here
        doubled = state.join(ahead.hint("merge"), ["file", "jump"], "left").select("file", "offset", F.col("beyond").alias("jump"), "on")
        reached = state.where("on and jump is not null").select("file", F.col("jump").alias("offset"), F.lit(None).cast("long").alias("jump"), F.lit(True).alias("on"))
        state = doubled.unionByName(reached).groupBy("file", "offset").agg(F.max("jump").alias("jump"), F.max("on").alias("on"))
        state = materialize(state, "warc-chain")
    return state.where("on").select("file", "offset")
