"""WARC archives as a Python data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans one partition for each run of whole files of about `splitBytes` together. Predicates on the record type and
on header columns are taken over from Spark and checked as soon as a record's headers are parsed; the content of records
that fail them, and all payloads if the option `payload` is false, are skipped by seeking, never read into strings.

Writing makes one file for each partition, beginning with a warcinfo record. Files count only once the driver has listed
them in `_FILES`, which it writes last; files of failed or repeated tasks are never listed. A response holds HTTP headers
and the payload, a revisit (identical-payload-digest) only the HTTP headers, so the payload's length can be read from both.

Paths go through pyarrow's file systems, so any store that these know will do.

Null urls have no header; line breaks within header values become %0D and %0A. Null payloads are empty. Null record ids
are allowed. An empty table gives files that hold a warcinfo record alone.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from gapweave.llm.common import materialise

SCHEMA = "record_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, refers_to string, payload_bytes long, payload binary"

#: The header that each column comes from (fixed values of the WARC standard).
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "_FILES"

#: How a value is held against a predicate's value, by predicate; a missing value passes none of them.
TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    IsNotNull: lambda x, v: True,
}


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    file: str


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() == "true"
        self.split_bytes = int(options.get("splitbytes", 64 << 20))
        self.batch_bytes = int(options.get("batchbytes", 8 << 20))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if (type(f) in TESTS or isinstance(f, IsNull)) and len(column) == 1 and (column[0] in HEADERS or column[0] == "payload_bytes"):
                self.tests.append((column[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = opened(self.path)
        listing = f"{root}/{FILES}"
        if store.get_file_info(listing).type == fs.FileType.File:
            with store.open_input_stream(listing) as f:
                names = [x for x in f.read().decode().split("\n") if x]
            found = store.get_file_info([f"{root}/{x}" for x in names])
        else:
            found = [x for x in store.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".warc")]
        out, size = [Files([])], 0
        for x in sorted(found, key=lambda x: x.path):
            if out[-1].paths and size + x.size > self.split_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(x.path)
            size += x.size
        return out

    def wanted(self, row: dict) -> bool:
        return all((row[c] is None) if kind is IsNull else row[c] is not None and TESTS[kind](row[c], v) for c, kind, v in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        types = [pa.string()] * 7 + [pa.int64(), pa.binary()]
        names = [*HEADERS, "payload_bytes", "payload"]
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with store.open_input_file(path) as raw:
                for row in self.records(io.BufferedReader(raw, 1 << 20)):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size >= self.batch_bytes:
                        yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names=names)
                        rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names=names)

    def records(self, f: io.BufferedReader) -> Iterator[dict]:
        """The wanted records of one archive."""
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            head = headers(f)
            end = f.tell() + int(head["content-length"])
            row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
            kind, content = row["record_type"], end - f.tell()
            is_http = (row["content_type"] or "").startswith("application/http")
            if is_http:
                f.readline()
                http = headers(f)
                content = int(http.get("content-length", end - f.tell()))
            row |= {"payload_bytes": content, "payload": None}
            if self.wanted(row):
                if self.payload and kind != "revisit":
                    row["payload"] = f.read(end - f.tell())
                yield row
            f.seek(end)


def headers(f: io.BufferedReader) -> dict[str, str]:
    """Header lines up to the blank one, by lower-case name."""
    out = {}
    while (line := f.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class WarcWriter(DataSourceArrowWriter):
    """Rows need the columns record_type (response or revisit), record_id, target_uri, date, payload_digest, refers_to, payload."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc"
        with store.open_output_stream(f"{root}/{name}", buffer_size=1 << 20) as out:
            about = b"format: WARC File Format 1.1\r\n"
            out.write(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "2000-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, about))
            for batch in iterator:
                for row in batch.to_pylist():
                    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    head = {h: row[c] for c, h in HEADERS.items() if c in row and row[c] is not None}
                    head |= {"Content-Type": "application/http; msgtype=response"} | ({"WARC-Profile": REVISIT_PROFILE} if revisit else {})
                    out.write(record(head, http if revisit else http + payload))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{FILES}") as out:
            out.write("\n".join(sorted(m.file for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.file}")


def record(head: dict[str, str], content: bytes) -> bytes:
    lines = "".join(f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n"



def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """payload, payload_digest, record_type and refers_to behind page_id, url and html.

    Of equal payloads of `least_bytes` or more the row with the largest page_id is the response, and others are revisits.
    Rows that share the largest id, and groups without ids, are all responses. Only digests are shuffled and summed
    before; the table of repeated ones is written first, so that Spark knows its size before it chooses the join.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    large = base.where(F.octet_length("payload") >= least_bytes)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 AND original IS NOT NULL")
    repeated = materialise(groups.select(F.col("payload_digest").alias("of_digest"), "original"), "repeated-payloads")
    both = base.join(repeated, F.col("payload_digest") == F.col("of_digest"), "left")
    is_revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    return both.select("page_id", "url", "payload", "payload_digest", F.when(is_revisit, "revisit").otherwise("response").alias("record_type"), F.when(is_revisit, F.col("original")).alias("refers_to"))


def urn(page_id):
    return F.when(page_id.isNotNull(), F.format_string("<urn:page:%d>", page_id))


def write(rows: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Archives of the rows of with_revisits()."""
    rows.sparkSession.dataSource.register(WarcDataSource)
    rows.select(
        "record_type",
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"),
        urn(F.col("refers_to")).alias("refers_to"),
        "payload",
    ).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records under a path; without payloads, their content is skipped."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_id_of(urn_column: str):
    return F.regexp_extract(urn_column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame, path: str, least_bytes: int = 1000) -> DataFrame:
    """Writes the pages' archives, reads their headers back and returns one row for each page."""
    write(with_revisits(pages, least_bytes), path)
    records = read(pages.sparkSession, path, payload=False).where(F.col("record_type").isin("response", "revisit"))
    return records.select(page_id_of("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page_id_of("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN original IS NULL OR original IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original IS NOT NULL AND original IS DISTINCT FROM page_id THEN original END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
"""
