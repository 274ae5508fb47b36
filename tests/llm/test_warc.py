"""ZIP directories, ranges and WARC records."""

import gzip
import hashlib
import base64
import io
import random
import struct
import zipfile

import pytest

from shelfcast.llm import warc
from shelfcast.llm import zip_reader as zr
from shelfcast.session import scratch_path


def reader(data):
    return lambda at, n: data[at : at + n]


def test_members_of_ordinary_archives():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("a.txt", b"first")
        z.writestr("dir/\u00fc.bin", bytes(range(256)) * 9)
        z.writestr("packed", b"x" * 999, zipfile.ZIP_DEFLATED)
        z.writestr("empty", b"")
        z.comment = b"a comment with PK\x05\x06 inside"
    data = sink.getvalue()
    found = zr.members(reader(data), len(data))
    assert list(found) == ["a.txt", "dir/\u00fc.bin", "packed", "empty"]
    for name, content in (("a.txt", b"first"), ("dir/\u00fc.bin", bytes(range(256)) * 9), ("empty", b"")):
        at, n = zr.stored_range(reader(data), found[name])
        assert data[at : at + n] == content
    with pytest.raises(zr.BadZip):
        zr.stored_range(reader(data), found["packed"])


def test_streamed_members_with_wide_headers():
    class Stream(io.RawIOBase):
        """Cannot seek: sizes go behind the data."""

        def __init__(self):
            self.data = bytearray()

        def writable(self):
            return True

        def write(self, b):
            self.data += bytes(b)
            return len(b)

    sink = Stream()
    with zipfile.ZipFile(sink, "w") as z, z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as member:
        member.write(b"abc" * 100)
    data = bytes(sink.data)
    at, n = zr.stored_range(reader(data), zr.members(reader(data), len(data))["big"])
    assert data[at : at + n] == b"abc" * 100


def wide_archive(before, content=b"payload", name=b"far"):
    """An archive whose member lies behind ``before`` bytes, all of it in ZIP64 form; the gap is not stored."""
    full16, full32 = 0xFFFF, 0xFFFFFFFF
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, len(content), len(content), len(name), 0) + name + content
    extra = struct.pack("<HHQQQ", 1, 24, len(content), len(content), before)
    other = struct.pack("<HHI", 0x7777, 4, 1)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, full32, full32, len(name), len(other + extra), 0, 0, 0, 0, full32)
    central += name + other + extra
    at = before + len(local)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, full16, full16, full32, full32, 0)
    tail = local + central + end64 + locator + end

    def read_at(offset, n):
        return b"\0" * max(0, min(n, before - offset)) + tail[max(0, offset - before) : max(0, offset + n - before)]

    return read_at, before + len(tail)


@pytest.mark.parametrize("before", [0, 10, 5 << 32])
def test_zip64_directories(before):
    read_at, size = wide_archive(before)
    at, n = zr.stored_range(read_at, zr.members(read_at, size)["far"])
    assert read_at(at, n) == b"payload"


def test_more_members_than_the_short_form_counts():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"{i}"), b"")
    data = sink.getvalue()
    assert len(zr.members(reader(data), len(data))) == 66_000


@pytest.mark.parametrize("data", [b"", b"PK", b"x" * 100, b"PK\x05\x06" + b"\0" * 6 + b"\x01\0" + struct.pack("<II", 5, 0) + b"\0\0"])
def test_broken_archives(data):
    with pytest.raises(zr.BadZip):
        zr.members(reader(data), len(data))


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, payload string")


ROWS = [
    (7, "http://a/", "same"), (3, "http://b/", "same"), (3, "http://b/", "same"), (9, None, None), (8, "http://c/\r\nX: y", ""), (None, "http://d/", "same"),
    (None, "http://e/", "alone"), (11, "http://\u00fc/", "\u6f22\r\n\r\nWARC/1.1\r\n"), (12, "http://f/", "q" * 300_000), (13, "http://g/", "sam"),
]


def expected(rows, least):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        refers = first.get(html or "") if page is not None and len(data) >= least else None
        refers = refers if refers is not None and refers < page else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 4, 5])
def test_round_trip(spark, least):
    found = [tuple(r) for r in warc.round_trip(pages(spark, ROWS), least).collect()]
    assert sorted(found, key=repr) == expected(ROWS, least)


def test_payloads_and_small_packages(spark, monkeypatch):
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 600)
    monkeypatch.setattr(warc, "RANGE_BYTES", 500)
    rng = random.Random(1)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abc") for _ in range(rng.randrange(900)))) for i in range(40)]
    listed = warc.write_packages(pages(spark, rows).coalesce(2), scratch_path(spark, "warc"))
    assert listed.count() > 5 and listed.groupBy().sum("records").collect()[0][0] == 40
    found = warc.read_packages(spark, listed).collect()
    texts = {p: h for p, _, h in rows}
    for r in found:
        assert r.url == f"http://h/{r.page_id}"
        text = bytes(r.payload).decode() if r.record_type == "response" else texts[r.refers_to]
        assert text == texts[r.page_id]


def test_pages_of_one_payload_are_split_over_tasks(spark):
    """A third of the pages share a long payload: no task writes them all."""
    rng = random.Random(4)
    shared, hot = "".join(rng.choice("abcdefgh") for _ in range(20_000)), 400
    rows = [(i, "http://h/", shared if i % 3 == 0 else f"page {i // 2}" + "x" * (i % 50)) for i in range(3 * hot)]
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        listed = warc.write_packages(pages(spark, rows), scratch_path(spark, "warc"))
        records = [r["records"] for r in listed.collect()]
        found = [(r["page_id"], r["refers_to"]) for r in warc.read_packages(spark, listed, ["page_id", "refers_to"]).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(records) == len(rows) and max(records) < hot
    assert sorted(found, key=repr) == sorted(((p, r) for p, _, _, _, r in expected(rows, 0)), key=repr)


def test_a_changed_payload_is_noticed():
    data = warc.record(1, "http://x/", b"payload", None)
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"\r\n\r\npayload", b"\r\n\r\nPayload"))
    assert gzip.decompress(gzip.compress(data)) == data


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
