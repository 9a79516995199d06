from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from kvloom.llm.warc import candidates, reachable, read_warc, write_warc

PAGES = "page_id long, url string, html string"
FAKE = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:kvloom:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n\r\nWARC/1.1\r\n"


@pytest.mark.parametrize(("min_bytes", "per_file"), [(0, 1000), (0, 2), (10, 3)])
def test_round_trip(spark, tmp_path, min_bytes, per_file):
    rows = [(1, "http://a", FAKE), (2, None, None), (3, "u\r\nx y", ""), (4, "http://b", FAKE), (5, "WARC/1.1", FAKE * 3), (6, "u", "é日"), (7, "u", "é日"), (8, "u", "a" * 3_000_000), (None, "n", FAKE)]
    write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/w", min_bytes=min_bytes, records_per_file=per_file)
    top: dict = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    got = {r.page_id: r for r in read_warc(spark, f"{tmp_path}/w").collect()}
    assert len(got) == len(rows)
    for i, url, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= min_bytes and top[h or ""] != (-1 if i is None else i)
        r = got[i]
        assert (r.record_type, r.refers_to, r.payload_bytes) == (("revisit", top[h or ""], len(data)) if revisit else ("response", None, len(data)))
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.payload == (None if revisit else data) and r.intact == (None if revisit else True)
        assert (url is None) == (r.url is None)


def test_magic_in_payloads_is_a_candidate_but_not_reached(spark, tmp_path):
    write_warc(spark.createDataFrame([(1, "u", FAKE * 20)], PAGES), f"{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    assert len(list(candidates(data))) > 1
    assert [r.page_id for r in read_warc(spark, f"{tmp_path}/w").collect()] == [1]


def test_damage_ends_the_chain(spark, tmp_path):
    write_warc(spark.createDataFrame([(i, "u", "t" * i) for i in range(1, 6)], PAGES).coalesce(1), f"{tmp_path}/w")
    (file,) = (tmp_path / "w").glob("*.gz")
    data = gzip.decompress(file.read_bytes())
    third = [x for x, *_ in candidates(data)][2]
    (tmp_path / "bad.warc").write_bytes(data[:third] + b"?" + data[third + 1 :])
    (tmp_path / "cut.warc").write_bytes(data[:-3])
    assert read_warc(spark, f"file://{tmp_path}/bad.warc").count() == 2
    assert read_warc(spark, f"file://{tmp_path}/cut.warc").count() == 4


def test_pointer_jumping_matches_a_walk(spark):
    links = [("f", i, i + 1) for i in range(37)] + [("f", 100, 5), ("f", 101, 100), ("g", 3, 9), ("h", 0, 7), ("h", 7, 7000)]
    got = sorted(tuple(r) for r in reachable(spark.createDataFrame(links, "file string, offset long, next long")).collect())
    assert got == [("f", i) for i in range(38)] + [("h", 0), ("h", 7), ("h", 7000)]


def test_repeated_rows_and_empty(spark, tmp_path):
    write_warc(spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (0, "u", "a")], PAGES), f"{tmp_path}/w")
    assert sorted((r.page_id, r.record_type) for r in read_warc(spark, f"{tmp_path}/w").collect()) == [(0, "revisit"), (1, "response"), (1, "response")]
    write_warc(spark.createDataFrame([], PAGES), f"{tmp_path}/e")
    assert read_warc(spark, f"{tmp_path}/e").count() == 0
