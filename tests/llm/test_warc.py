"""Archives: round trips, and records and archives that must be refused."""

import hashlib
import struct

import pytest
import zstandard

from millrace.llm import warc

BIG = "x" * 1000
ROWS = [(1, "http://a/", BIG), (2, "http://b/é path", BIG), (3, None, BIG), (3, "http://c/", BIG), (4, "http://d/", "short"), (5, "", "short"), (6, "u", None), (7, "u", ""), (None, "n", "y" * 2000), (8, "u", "é" * 700), *((100 + i, f"http://h/{i}", f"<html>{i}" + "body " * 300) for i in range(40))]


def expected():
    largest = {}
    for i, _, h in ROWS:
        if h and len(h.encode()) >= 1000 and i is not None:
            largest[h] = max(i, largest.get(h, i))
    for i, _, h in ROWS:
        body = (h or "").encode()
        to = largest.get(h) if len(body) >= 1000 else None
        yield (i, len(body), hashlib.sha1(body).hexdigest(), "response" if to in (None, i) else "revisit", None if to in (None, i) else to)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS refers_to", "2 AS payload_digest", "3 AS payload_bytes", "4 AS k", "5 AS __n", "6 AS __hot")
    got = warc.archive_round_trip(pages.repartition(3), f"file://{tmp_path}/w")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(), key=str)
    back = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert {r.payload.decode() for r in back if r.record_type == "response"} == {h or "" for _, _, h in ROWS}
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith(".pages")]


def test_nothing(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(pages, f"file://{tmp_path}/w").count() == 0


def records(n=60):
    return [warc.record_bytes("response", f"urn:page:{i}", "http://a/", b"payload %d " % i * 200, hashlib.sha1(b"payload %d " % i * 200).hexdigest(), len(b"payload %d " % i * 200), "2000-01-01T00:00:00Z") for i in range(n)]


def test_an_archive_has_a_dictionary_and_a_frame_for_each_record():
    own = records()
    data = warc.archive_bytes(own)
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_FRAME
    assert [c for _, c in warc.frames(data)] == own
    at = [a for a, _ in warc.frames(data)]
    with pytest.raises(zstandard.ZstdError):  # the dictionary is needed
        zstandard.ZstdDecompressor().decompress(data[at[0] : at[1]])


def test_dictionaries_may_be_raw_and_archives_may_have_none():
    own = records(3)
    assert [c for _, c in warc.frames(b"".join(zstandard.ZstdCompressor().compress(r) for r in own))] == own
    data = warc.archive_bytes(records())
    n = struct.unpack_from("<I", data, 4)[0]
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])
    plain = struct.pack("<II", warc.DICTIONARY_FRAME, len(raw)) + raw + data[8 + n :]
    assert [c for _, c in warc.frames(plain)] == records()


@pytest.mark.parametrize("spoil", [lambda d: d[:-3], lambda d: d[:6], lambda d: struct.pack("<II", warc.DICTIONARY_FRAME, 5) + b"abcde" + d, lambda d: d + b"rubbish-rubbish-rubbish"])
def test_broken_archives(spoil):
    with pytest.raises(warc.WarcError):
        for _, content in warc.frames(spoil(warc.archive_bytes(records()))):
            if isinstance(content, warc.WarcError):
                raise content


GOOD = records(1)[0]


@pytest.mark.parametrize(
    "record",
    [
        GOOD[:-1],
        GOOD + b"x",
        GOOD.replace(b"WARC/1.1", b"WARC/9.9"),
        GOOD.replace(b"WARC-Date: 2000-01-01T00:00:00Z\r\n", b""),
        GOOD.replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response"),
        GOOD.replace(b"Content-Length: ", b"Content-Length: 9", 1),
        GOOD.replace(b"Content-Length: ", b"Content-Length: x", 1),
        GOOD.replace(b"WARC-Type: response", b"no header"),
        GOOD.replace(b"payload 0", b"payload 1", 1),
        b"",
    ],
)
def test_broken_records(record):
    warc.parse_record(GOOD)
    with pytest.raises(warc.WarcError):
        warc.parse_record(record)


def test_errors_can_be_kept(spark, tmp_path):
    own = records(5)
    own[2] = own[2][:-1]
    (tmp_path / "a.warc.zst").write_bytes(b"".join(zstandard.ZstdCompressor().compress(r) for r in own))
    got = warc.read_archives(spark, f"file://{tmp_path}", on_error="keep").collect()
    assert len(got) == 5 and sum(r.error is not None for r in got) == 1
    with pytest.raises(Exception, match="Content-Length"):
        warc.read_archives(spark, f"file://{tmp_path}").collect()
