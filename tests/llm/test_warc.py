import gzip
import hashlib
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cdrlens.llm import warc


@given(st.binary(max_size=3000), st.integers(1, 50))
def test_chunked_round_trip(body, size):
    framed = warc.chunked(body, size)
    assert warc.dechunked(framed) == body
    assert warc.dechunked(framed[:-6]) is None or not body


def test_chunked_extensions_and_faults():
    assert warc.dechunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    assert warc.dechunked(b"zz\r\n") is None and warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n") is None


def test_hostile_chunk_sizes():
    for size in (b"-6", b"+5", b"0x10", b"1_0", b"", b" ", b"f" * 17, b"5 5"):
        assert warc.dechunked(b"5\r\nhello\r\n" + size + b"\r\n") is None, size
    assert warc.dechunked(b"ffffffffffffffff\r\nabc") is None


GOOD = [b"".join(warc.records_of("response", f"<urn:{k}>", [("WARC-Date", "2000-01-01T00:00:00Z")], b"HTTP/1.1 200 OK\r\n\r\nbody %d" % k, 1000)) + b"\r\n\r\n" for k in range(3)]


@settings(max_examples=400, deadline=2000)
@given(st.binary(max_size=200) | st.text("WARC/1.\r\n:Content-Length 0-9-", max_size=120).map(str.encode))
def test_any_bytes_between_records(junk):
    """No bytes make the reader fail or loop; whole records before them are read, those after unless the
    junk itself claims them as its block."""
    for data in (GOOD[0] + junk + b"\r\n" + GOOD[1] + GOOD[2], b"".join(map(warc.member, (GOOD[0], junk, GOOD[1], GOOD[2]))), warc.member(GOOD[0]) + junk + b"".join(map(warc.member, GOOD[1:]))):
        got = list(warc.parse(io.BufferedReader(warc.Inflated(data))))
        ids = [h.get("warc-record-id") for h, _, fault in got if fault is None]
        assert ids[0] == "<urn:0>" and len(got) < 300
        if b"WARC" not in junk and b"\x1f" not in junk:
            assert ids == ["<urn:0>", "<urn:1>", "<urn:2>"]


@settings(max_examples=300, deadline=2000)
@given(st.binary(max_size=400))
def test_random_bytes(data):
    list(warc.parse(io.BufferedReader(warc.Inflated(data))))
    list(warc.parse(io.BufferedReader(warc.Inflated(b"\x1f\x8b\x08" + data))))


def test_faults_are_told():
    bad = [b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"WARC/1.1\r\nContent-Length: -1\r\n\r\n", b"WARC/1.1\r\nContent-Length: 99999999999999999\r\n\r\nabc\r\n", b"WARC/1.1\r\nX: \xff\xfe\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"noise\r\n"]
    got = list(warc.parse(io.BytesIO(GOOD[0] + bad[0] + GOOD[1] + bad[4] + bad[3] + bad[1] + GOOD[2] + bad[2] + GOOD[0])))
    assert [f for _, _, f in got] == [None, "no length", None, "bytes outside of a record", None, "no length", None, "ends before its length", None]


def test_each_record_is_a_member_with_a_date(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    warc.write(warc.deduplicated(df), str(tmp_path / "w"), segment_bytes=300)
    n = 0
    for f in (tmp_path / "w").glob("part-*"):
        data = f.read_bytes()
        while data:
            d = zlib.decompressobj(31)
            (head, block, fault), *rest = warc.parse(io.BytesIO(d.decompress(data)))
            assert d.eof and not rest and fault is None and head["warc-date"] and len(block) <= 300
            data, n = d.unused_data, n + 1
    assert n > 100


def test_one_bad_record_does_not_stop_the_rest(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc.member(GOOD[0]) + b"\x1f\x8b\x08 broken" + warc.member(b"WARC/1.1\r\nContent-Length: x\r\n\r\n") + warc.member(GOOD[1]))
    (tmp_path / "b.warc").write_bytes(GOOD[2])
    (tmp_path / "c.warc.gz").write_bytes(b"")
    got = warc.read(spark, str(tmp_path)).collect()
    assert sorted(r.record_id for r in got if r.complete) == ["<urn:0>", "<urn:1>", "<urn:2>"] and all(r.record_type == "invalid" and r.fault for r in got if not r.complete)
    assert any(not r.complete for r in got)


def test_text_keys(spark):
    df = spark.createDataFrame([(f"p{p}" if p is not None else None, u, h) for p, u, h in pages()], "page_id string, url string, html string")
    got = warc.round_trip(df).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(f"p{p}" if p is not None else "None" for p, _, _ in pages()) and all(r.complete for r in got)


@given(st.binary(max_size=500), st.integers(1, 100))
def test_records_parse_back(block, size):
    pieces = list(warc.records_of("response", "<urn:x>", [("WARC-Target-URI", "http://x\r\ny")], block, size))
    stream = io.BytesIO(b"".join(p + b"\r\n\r\n" for p in pieces))
    got = list(warc.parse(stream))
    assert b"".join(b for _, b, _ in got) == block and not any(fault for _, _, fault in got)
    if len(got) > 1:
        assert [int(h["warc-segment-number"]) for h, _, _ in got] == list(range(1, len(got) + 1))
        assert got[-1][0]["warc-segment-total-length"] == str(len(block)) and got[1][0]["warc-segment-origin-id"] == "<urn:x>"


def pages():
    long = "<p>" + "é word " * 400 + "</p>"
    return [(5, "http://a", long), (2, "http://b", long), (9, None, long), (3, "http://c", None), (4, "http://d", ""), (7, "http://e", "short"), (6, "http://f", "short"),
            (2, "http://b", long), (None, "http://g", long), (8, "http://h", "é" * 40_000), (11, "http://i\r\nX: y", "\r\n\r\nWARC/1.1\r\n" * 40)]


def brute(rows):
    out, least = [], {}
    for p, _, h in rows:
        data = (h or "").encode()
        if len(data) >= 100 and p is not None:
            least[data] = min(p, least.get(data, p))
    used = set()
    for p, _, h in rows:
        data = (h or "").encode()
        first = len(data) < 100 or (p == least.get(data) and data not in used)
        if first and len(data) >= 100:
            used.add(data)
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "response" if first else "revisit", None if first else least[data]))
    return sorted(map(str, out))


@pytest.mark.parametrize("segment", [64, 16 << 10])
def test_round_trip(spark, segment):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("record_id", F.lit("clash")).repartition(3)
    got = warc.round_trip(df, segment_bytes=segment)
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got.collect()) == brute(pages())
    assert got.filter("not complete").count() == 0
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    warc.write(warc.deduplicated(df), str(tmp_path / "w"), segment_bytes=500)
    got = {r.fields["page-id"]: bytes(r.payload) for r in warc.read(spark, str(tmp_path / "w"), payloads=True).collect() if r.record_type == "response" and "page-id" in r.fields}
    assert got["8"] == ("é" * 40_000).encode() and got["11"] == b"\r\n\r\nWARC/1.1\r\n" * 40


def test_incomplete_records_are_told(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 300
    whole = list(warc.records_of("response", "<urn:a>", [], block, 100))
    gap = [p for k, p in enumerate(warc.records_of("response", "<urn:b>", [], block, 100)) if k != 1]
    cut = list(warc.records_of("response", "<urn:c>", [], block, 100))[:-1]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(p + b"\r\n\r\n" for p in [*whole[::-1], whole[1], *gap, *cut])))
    got = {r.record_id: (r.complete, r.payload_bytes) for r in warc.read(spark, str(tmp_path)).collect()}
    assert got == {"<urn:a>": (True, 300), "<urn:b>": (False, None), "<urn:c>": (False, None)}
