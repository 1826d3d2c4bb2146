"""WARC archives: a writer and a PySpark Python data source.

``spark.read.format("warc").load(uri)`` plans one partition per archive file.
Filters on the header columns (warc_type, record_id, target_uri, refers_to,
payload_digest) are pushed down: a record's header is parsed first, and the
block of a record that no filter wants is skipped by a seek, never read.  With
option ``payload`` = ``false`` no block's payload is read at all (the HTTP
header in front of it still is, as it tells the length).

``write`` stores one record per row.  Of records with equal payloads of at
least ``MIN_REVISIT`` bytes the one of smallest id is a ``response``; the
others are ``revisit`` records, which hold the HTTP header but no payload, the
payload's digest, and the id they refer to.

Edge cases: null html is an empty payload; a null url leaves out the
WARC-Target-URI header, and line ends in a url are percent-encoded; all rows
that hold the smallest id of their payload are responses; a null id is never
referred to, and where a payload has null ids only, all are responses; smaller
payloads are always responses; an empty table gives no file and no row; extra
columns are not read.
"""

from __future__ import annotations

import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition,
                                    IsNotNull, IsNull, StringContains, StringStartsWith)

from .common import maybe_broadcast, shared_path, staged
from .dac_files import filesystem, put

MIN_REVISIT = 100
FILE_BYTES = 64_000_000     # an archive is closed once it holds as many
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
           "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", http_length long, payload binary"


def record(kind: str, rid: str, url: str | None, digest: str, payload: bytes, refers: str | None) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: quote(m[0]), url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers is not None:
        head += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n"


def record_id(i) -> str:
    return f"<urn:page:{'null' if i is None else i}>"


def plan_records(pages: DataFrame) -> DataFrame:
    """Every page with its digest, and the id of the response it revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    narrow = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest")
    groups = staged(narrow.agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
                    .where("n > 1 and first is not null").select("digest", "first"), "warc-groups")
    # the right side is a written table, so both sides of a shuffled join are
    # plain exchanges, and Spark splits a digest that many pages share
    joined = rows.join(maybe_broadcast(groups, groups.count()), "digest", "left")
    joined = joined.withColumn("refers", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")))
    return joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest",
                         F.col("refers").cast("string").alias("refers"))


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives; returns uri, records and bytes of each."""
    folder = folder or shared_path(pages.sparkSession, "warc")

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        parts, size, n, number = [], 0, 0, 0

        def close():
            uri = f"{folder}/part-{part:06d}-{number:06d}.warc"
            put(uri, parts)
            return pd.DataFrame([(uri, n, size)], columns=["uri", "records", "bytes"])

        for b in batches:
            for i, url, html, digest, refers in zip(b["page_id"], b["url"], b["html"], b["digest"], b["refers"]):
                kind = "response" if refers is None else "revisit"
                x = record(kind, record_id(i), url, digest, html.encode("utf-8", "replace"),
                           None if refers is None else record_id(refers))
                parts.append(x)
                size, n = size + len(x), n + 1
                if size >= FILE_BYTES:
                    yield close()
                    parts, size, n, number = [], 0, 0, number + 1
        if parts:
            yield close()

    files = staged(plan_records(pages).mapInPandas(run, "uri string, records long, bytes long"), "warc-files")
    files._folder = folder
    return files


class WarcSource(DataSource):
    """Options: path (file or folder URI), payload (true by default)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


class WarcFile(InputPartition):
    def __init__(self, uri: str):
        super().__init__(uri)
        self.uri = uri


_TESTS = {
    EqualTo: lambda f, x: x is not None and x == f.value,
    EqualNullSafe: lambda f, x: x == f.value,
    In: lambda f, x: x is not None and x in f.value,
    IsNull: lambda f, x: x is None,
    IsNotNull: lambda f, x: x is not None,
    StringStartsWith: lambda f, x: x is not None and x.startswith(f.value),
    StringContains: lambda f, x: x is not None and f.value in x,
}


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.filters = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and name in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs
        system, path = filesystem(self.uri)
        if system.get_file_info(path).type == fs.FileType.File:
            return [WarcFile(self.uri)]
        scheme = re.match(r"[a-z0-9+.-]+:(//[^/]*)?(?=/)", self.uri)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        names = sorted(x.path for x in found if x.path.endswith(".warc"))
        return [WarcFile((scheme[0] if scheme else "") + n) for n in names]

    def wanted(self, row: dict) -> bool:
        return all(_TESTS[type(f)](f, row[f.attribute[0]]) for f in self.filters)

    def read(self, partition):
        if partition is None:           # no archive at all
            return
        system, path = filesystem(partition.uri)
        with system.open_input_file(path) as f:
            yield from records(f, self.wanted, self.payload)


def records(f, wanted, payload: bool = True):
    """Rows of one archive.  The header is parsed first; an unwanted block is
    skipped without being read."""
    at, end = 0, f.size()
    while at < end:
        raw, start = read_until(f, at, end, b"\r\n\r\n")
        lines = raw.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {}
        for x in lines[1:]:
            k, _, v = x.partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        at = start + size + 4
        row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        if not wanted(row):
            continue
        body, length = None, None
        if head.get("content-type", "").startswith("application/http"):
            http, body_at = read_until(f, start, start + size, b"\r\n\r\n")
            m = re.search(rb"(?i)content-length:\s*(\d+)", http)
            length = int(m[1]) if m else None
        else:
            body_at = start
        if payload and row["warc_type"] == "response":
            body = f.read_at(start + size - body_at, body_at)
        yield (*row.values(), length, body)


def read_until(f, at: int, end: int, mark: bytes, step: int = 1024) -> tuple[bytes, int]:
    """The bytes before ``mark``, and the place behind it."""
    got = b""
    while at + len(got) < end:
        got += f.read_at(min(step, end - at - len(got)), at + len(got))
        k = got.find(mark)
        if k >= 0:
            return got[:k], at + k + len(mark)
        step *= 2
    raise ValueError(f"record cut off at byte {at}")


def load(spark, uri: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(uri)


def _page_id(col: str):
    return F.regexp_extract(col, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def digests(spark, uri: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of all
    records: responses from their payloads, revisits from their headers."""
    whole = load(spark, uri).where(F.col("warc_type") == "response")
    again = load(spark, uri, payload=False).where(F.col("warc_type") == "revisit")
    a = whole.select(_page_id("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
                     F.sha2("payload", 256).alias("payload_digest"), F.col("warc_type").alias("record_type"),
                     F.lit(None).cast("long").alias("refers_to"))
    b = again.select(_page_id("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"),
                     F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
                     F.col("warc_type").alias("record_type"), _page_id("refers_to").alias("refers_to"))
    return a.unionByName(b)
