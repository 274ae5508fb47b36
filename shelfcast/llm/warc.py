"""WARC records in ZIP packages: written from pages, and read back in byte ranges.

A package holds two stored members: the records, each a gzip member of its own, and an index with a
line for each record (page, offset, length). The reader finds both through the central directory,
reads the index, and then only the ranges of records, a run of neighbours at a time; nothing is
unpacked to disk. Packages lie in the shared folder and are reached through Arrow's file systems.

A payload that occurs more than once is written once, by the page with the smallest id; the others
become revisit records that name it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.words import slices
from shelfcast.llm.zip_reader import members, stored_range
from shelfcast.session import scratch_path, settle

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Compressed records in a package, and in a range read at once, in bytes.
PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 1 << 20
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"  # pages carry no date
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:page:"


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records ---------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record that names another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = "" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{PAGE_URN}{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        # A line break in an address must not end the header.
        head.append("WARC-Target-URI: " + "".join(quote(c) if c in "\r\n" else c for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, rest


def _page(urn: str) -> int | None:
    number = urn.strip("<>").removeprefix(PAGE_URN)
    return int(number) if number else None


def parse(data: bytes) -> dict:
    """The fields of a record; of a response the payload is measured, not believed."""
    head, rest = _headers(data)
    http, payload = _headers(rest[: int(head["content-length"])])
    said = head["warc-payload-digest"].removeprefix("sha1:")
    out = {"page_id": _page(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"]}
    if head["warc-type"] == "revisit":
        return out | {"payload": None, "payload_bytes": int(http["content-length"]), "payload_digest": said, "refers_to": _page(head["warc-refers-to"])}
    if digest_of(payload) != said:
        raise ValueError(f"payload of page {out['page_id']} does not have the digest of its record")
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": said, "refers_to": None}


# ---- writing ---------------------------------------------------------------------------


class _Package:
    """One package being written: the records as they come, the index at the end."""

    def __init__(self, folder: str):
        context = TaskContext.get()
        name = f"{context.partitionId()}-{context.attemptNumber()}-{uuid.uuid4().hex}.wacz"
        self.path = f"{folder}/{name}"
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        packed = gzip.compress(data, LEVEL, mtime=0)
        self.member.write(packed)
        self.lines.append(json.dumps({"page": page_id, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> pa.RecordBatch:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.out.close()
        return pa.RecordBatch.from_pydict({"path": [self.path], "records": pa.array([len(self.lines)], pa.int64())})


def _write_packages(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    package = None
    for part in slices(batches, "html"):
        for row in part.to_pylist():
            package = package or _Package(folder)
            package.add(row["page_id"], record(row["page_id"], row["url"], (row["html"] or "").encode(), row["refers_to"]))
            if package.size >= PACKAGE_BYTES:
                yield package.close()
                package = None
    if package:
        yield package.close()


def _typed(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, html and refers_to, the page that a revisit names."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    # Payloads of several pages only. The table is settled, so that the join has plain exchanges on
    # both sides and the texts of a payload on very many pages can be split over tasks.
    ids = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    first = settle(ids.where("first < last").select("digest", "first"))
    revisits = (F.octet_length("html") >= least_bytes) & (F.col("page_id") > F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", F.when(revisits, F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for each page into packages under ``folder``; returns (path, records).

    Only packages of tasks that succeeded are listed: an attempt writes under a name of its own. Of
    pages with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id is a
    response (so are rows that repeat that id), and others revisit it. Pages without an id cannot be
    named and are responses.
    """
    listed = f"{folder}/packages.parquet"
    _typed(pages, least_bytes).mapInArrow(lambda it: _write_packages(it, f"{folder}/packages"), "path string, records long").write.parquet(listed)
    return pages.sparkSession.read.schema("path string, records long").parquet(listed)


# ---- reading ---------------------------------------------------------------------------


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring records in each package: where they begin in the file, and their lengths."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with _open(path) as file:
                read_at = lambda at, n: file.read_at(n, at)  # noqa: B023, E731
                found = members(read_at, file.size())
                begin, _ = stored_range(read_at, found[RECORDS])
                at, n = stored_range(read_at, found[INDEX])
                lines = read_at(at, n).decode().split("\n") if n else []
            start, lengths = None, []
            for entry in map(json.loads, lines):
                if lengths and sum(lengths) + entry["length"] > RANGE_BYTES:
                    yield _range(path, start, lengths)
                    lengths = []
                if not lengths:
                    start = begin + entry["offset"]
                lengths.append(entry["length"])
            if lengths:
                yield _range(path, start, lengths)


def _range(path: str, start: int, lengths: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"path": [path], "start": pa.array([start], pa.int64()), "lengths": pa.array([lengths], pa.list_(pa.int64()))}
    )


RECORD_SCHEMA = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
_FIELDS = pa.schema(
    {
        "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload": pa.binary(),
        "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(),
    }
)


def _read_records(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([_FIELDS.field(n) for n in names])
    for batch in batches:
        for row in batch.to_pylist():
            with _open(row["path"]) as file:
                data = file.read_at(sum(row["lengths"]), row["start"])
            out, at = [], 0
            for length in row["lengths"]:
                parsed = parse(gzip.GzipFile(fileobj=io.BytesIO(data[at : at + length])).read())
                out.append({n: parsed[n] for n in names})
                at += length
            yield pa.RecordBatch.from_pylist(out, schema)


def read_packages(spark: SparkSession, listed: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The records of the listed packages; ``columns`` of page_id, url, record_type, payload (null in
    a revisit), payload_bytes, payload_digest and refers_to, all by default."""
    names = columns or _FIELDS.names
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = listed.select("path").mapInArrow(_ranges, "path string, start long, lengths array<long>")
    types = dict(pair.split() for pair in RECORD_SCHEMA.split(", "))
    schema = ", ".join(f"{n} {types[n]}" for n in names)
    return ranges.repartition(parts, "path", "start").mapInArrow(lambda it: _read_records(it, names), schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages written to packages in the shared folder and read back: page_id, payload_bytes,
    payload_digest, record_type and refers_to of each.

    Defined results: a null text counts as an empty payload, which takes part like any other; a null
    address is left out of the record; repeated rows have a record each; extra columns are ignored.
    """
    spark = pages.sparkSession
    listed = write_packages(pages, scratch_path(spark, "warc"), least_bytes)
    return read_packages(spark, listed, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
