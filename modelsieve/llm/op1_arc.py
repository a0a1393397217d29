"""Legacy web archives (ARC, versions 1 and 2) and their conversion to WARC.

An ARC file starts with a version block that names the fields of the header lines; every record is a header
line of those fields, the last one its declared length, and that many bytes. The converter reads records by
their declared lengths and makes up what WARC asks for: record ids from archive name and offset, ISO dates
from 14 or 12 digits, record types from scheme and content, SHA-1 digests of block and payload.

Of records with equal payloads one is the response and the others become revisits of it. That is decided
on an index (digests, no payloads); payloads are never shuffled. A file is read as a stream, by one task, in
bounded memory; what a task needs to know about its file is at most a list of that file's revisits. Files are written by
Spark's own text writer (rows are bytes, the line separator closes a record), so lost executors and repeated tasks
leave no half-written archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.llm.common import scratch, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Header fields by version, as the format defines them.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
NO_ADDRESS = "0.0.0.0"
RANK_HEADER = "X-Page-Id"     # of the archived response: its whole number ranks records with equal payloads
FLUSH = 8 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def open_archive(path: str) -> BinaryIO:
    """A byte stream of a plain or gzipped file, on any store pyarrow knows."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        source: BinaryIO = open(unquote(parts.path) if parts.scheme else path, "rb")
    else:
        store, _ = fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}/")
        source = io.BufferedReader(store.open_input_stream(f"{parts.netloc}{unquote(parts.path)}" if parts.scheme != "hdfs" else unquote(parts.path)))
    return io.BufferedReader(gzip.GzipFile(fileobj=source)) if path.endswith(".gz") else source


@dataclass
class ArcRecord:
    offset: int
    fields: dict[str, str]
    data: bytes
    problem: str | None = None
    http_end: int = field(init=False)

    def __post_init__(self) -> None:
        ends = [at + n for sep, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (at := self.data.find(sep)) >= 0]
        self.http_end = min(ends) if ends and self.data.startswith(b"HTTP/") else 0

    @property
    def kind(self) -> str:
        if self.fields["URL"].startswith("filedesc:"):
            return "warcinfo"
        return "response" if self.data.startswith(b"HTTP/") else "resource"

    @property
    def payload(self) -> bytes:
        return self.data[self.http_end:]

    def rank(self, header: str) -> int | None:
        found = re.search(rb"(?im)^" + re.escape(header.encode()) + rb":\s*(-?\d+)\s*$", self.data[:self.http_end])
        return int(found[1]) if found else None


def _header(line: bytes, version: int) -> dict[str, str] | None:
    """Fields of a header line; the URL, the first, may hold blanks. None if it is no header line."""
    names = FIELDS[version].split(" ")
    values = line.decode("utf-8", "replace").strip("\r\n").rsplit(" ", len(names) - 1)
    if len(values) != len(names) or not values[-1].isdigit() or not re.fullmatch(r"\d{12}|\d{14}", values[2]):
        return None
    return dict(zip(names, values))


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """Records in order, the version block first. Lines that are no header are skipped; a record cut off by
    the end of the file has the problem ``truncated``."""
    version, at = 1, 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        first = line.startswith(b"filedesc:")
        fields = _header(line, 1 if first else version)
        if fields is None and first:
            fields = _header(line, 2)
        if fields is None:
            continue
        size = int(fields["Archive-length"])
        data = stream.read(size)
        at += len(data)
        if first:
            version = 2 if data.split(b" ", 1)[0] == b"2" else 1
        yield ArcRecord(start, fields, data, None if len(data) == size else "truncated")


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 converter\n{FIELDS[version]}\n\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": NO_ADDRESS, "Archive-date": date, "Content-type": "text/plain",
              "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[f] for f in FIELDS[version].split(" ")).encode() + b"\n" + body


def arc_record(url: str, document: bytes, version: int, date: str, offset: int, name: str) -> bytes:
    values = {"URL": quote(url, safe="".join(map(chr, range(33, 127)))), "IP-address": NO_ADDRESS, "Archive-date": date,
              "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(document).hexdigest(), "Location": "-",
              "Offset": str(offset), "Filename": name, "Archive-length": str(len(document))}
    return " ".join(values[f] for f in FIELDS[version].split(" ")).encode() + b"\n" + document


def write_arcs(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """Archive (page_id, url, html) as HTTP responses: one gzipped ARC per task, versions 1 and 2 in turn.

    Null html is an empty payload, a null url an address that can't exist.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name, at = part % 2 + 1, f"pages-{part:06d}.arc", 0
        for batch in batches:
            out = [] if at else [arc_version_block(name, version, date)]
            at += len(out[0]) + 1 if out else 0
            for page, url, body in zip(*(c.to_pylist() for c in batch.columns)):
                rank = b"" if page is None else f"{RANK_HEADER}: {page}\r\n".encode()
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + rank + f"Content-Length: {len(body)}\r\n\r\n".encode()
                out.append(arc_record(url or "http://unknown.invalid/", head + body, version, date, at, name))
                at += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _write(rows.mapInArrow(work, "record binary"), path, "\n")


def _write(records: DataFrame, path: str, end: str) -> None:
    """Bytes of each row, then ``end``; gzipped at the fastest level, one file per task."""
    (records.select(F.col("record").cast("string")).write.option("lineSep", end).option("compression", "gzip")
     .option("zlib.compress.level", "BEST_SPEED").text(path))


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files in a folder, one task each; contents are not read here."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "length")
    return files.repartition(max(1, files.count()), "path").select("path")


def arc_index(files: DataFrame, rank_header: str = RANK_HEADER) -> DataFrame:
    """(path, offset, uri, date, kind, digest, size, rank, problem) of every record but version blocks."""
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("kind", pa.string()),
                        ("digest", pa.string()), ("size", pa.int64()), ("rank", pa.int64()), ("problem", pa.string())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[dict] = []
                with open_archive(path) as stream:
                    for r in read_arc(stream):
                        if r.kind != "warcinfo":
                            rows.append({"path": path, "offset": r.offset, "uri": r.fields["URL"], "date": iso_date(r.fields["Archive-date"]), "kind": r.kind,
                                         "digest": sha1_base32(r.payload), "size": len(r.payload), "rank": r.rank(rank_header), "problem": r.problem})
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.mapInArrow(work, "path string, offset long, uri string, date string, kind string, digest string, size long, rank long, problem string")


def iso_date(digits: str) -> str:
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(path: str, offset: int) -> str:
    """The same archive name and offset always give the same id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rsplit("/", 1)[-1]}#{offset}')}>"


def revisits(index: DataFrame, least: int = 0) -> DataFrame:
    """(path, revisits): for each file the records that repeat another's payload, with what they refer to.

    Of equal payloads of at least ``least`` bytes the original is that of the highest rank, then of the last path and offset.
    """
    able = index.filter((F.col("kind") == "response") & F.col("problem").isNull() & (F.col("size") >= least))
    best = able.groupBy("digest", "size").agg(F.max(F.struct("rank", "path", "offset", "uri", "date")).alias("best"))
    again = (able.join(best, ["digest", "size"])
             .filter((F.col("path") != F.col("best.path")) | (F.col("offset") != F.col("best.offset"))))
    # At most as many entries as the file has records.
    return again.groupBy(F.col("path").alias("_of")).agg(F.collect_list(F.struct("offset", "best")).alias("revisits"))


def warc_record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    """A whole record but for its last line end."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in fields.items() if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n"


def converted(record: ArcRecord, path: str, original: dict | None) -> bytes:
    """The WARC record for an ARC record; with ``original`` a revisit of it."""
    f = record.fields
    known = {"WARC-Record-ID": record_id(path, record.offset), "WARC-Date": iso_date(f["Archive-date"])}
    if record.kind == "warcinfo":
        block = f"software: arc converter\r\nformat: WARC File Format 1.1\r\nconverted-from: {f['URL']}\r\n".encode()
        return warc_record("warcinfo", {**known, "Content-Type": "application/warc-fields"}, block)
    known |= {"WARC-Target-URI": f["URL"], "WARC-IP-Address": None if f["IP-address"] == NO_ADDRESS else f["IP-address"],
              "WARC-Payload-Digest": f"sha1:{sha1_base32(record.payload)}", "WARC-Truncated": "length" if record.problem else None}
    block, kind = record.data, record.kind
    if original is not None:
        block, kind = record.data[:record.http_end], "revisit"
        known |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  "WARC-Refers-To": record_id(original["path"], original["offset"]), "WARC-Refers-To-Target-URI": original["uri"],
                  "WARC-Refers-To-Date": original["date"], "X-Payload-Length": str(len(record.payload))}
    content = "application/http; msgtype=response" if record.kind == "response" else "text/dns" if f["URL"].startswith("dns:") else f["Content-type"]
    return warc_record(kind, {**known, "WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Type": content}, block)


def convert(files: DataFrame, repeats: DataFrame, path: str) -> None:
    """Write one gzipped WARC per ARC file."""
    planned = files.join(repeats, files["path"] == repeats["_of"], "left").select("path", "revisits")
    planned = planned.repartition(files.rdd.getNumPartitions(), "path")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, again in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of = {x["offset"]: x["best"] for x in again or []}
                out, size = [], 0
                with open_archive(name) as stream:
                    for record in read_arc(stream):
                        out.append(converted(record, name, of.get(record.offset)))
                        size += len(out[-1])
                        if size > FLUSH:
                            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                            out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    _write(planned.mapInArrow(work, "record binary"), path, "\r\n")


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record, by declared lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip()] = value.strip()
        size = int(fields["Content-Length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("record cut off")
        yield fields, block


WARC_ROWS = ("record_id string, record_type string, uri string, date string, rank long, payload_bytes long, payload_digest string, "
             "refers_id string, intact boolean")


def read_warcs(files: DataFrame, rank_header: str = RANK_HEADER) -> DataFrame:
    """One row per record that has a target; ``intact``: the digests hold. A revisit's payload facts come from its header."""
    names = [c.split(" ")[0] for c in WARC_ROWS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in WARC_ROWS.split(", ")])

    def rows(path: str) -> Iterator[tuple]:
        with open_archive(path) as stream:
            for f, block in read_warc(stream):
                if "WARC-Target-URI" not in f:
                    continue
                own = ArcRecord(0, {"URL": f["WARC-Target-URI"]}, block)
                digest, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f.get("X-Payload-Length", len(own.payload)))
                intact = f["WARC-Block-Digest"] == f"sha1:{sha1_base32(block)}"
                if f["WARC-Type"] != "revisit":
                    intact = intact and digest == sha1_base32(own.payload)
                yield (f["WARC-Record-ID"], f["WARC-Type"], f["WARC-Target-URI"], f["WARC-Date"], own.rank(rank_header), size, digest,
                       f.get("WARC-Refers-To"), intact)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[tuple] = []
                for row in rows(path):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], names=names)

    return files.mapInArrow(work, WARC_ROWS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages as ARC, convert to WARC, read back: (page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id, intact).

    Repeated rows each give a record; of several with the largest page_id one is the response. Null page_ids rank last.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "archives")
    write_arcs(pages.select("page_id", "url", "html"), f"{folder}/arc")
    arcs = archives(spark, f"{folder}/arc")
    index = stored(arc_index(arcs), "arc-index")
    convert(arcs, revisits(index), f"{folder}/warc")
    found = stored(read_warcs(archives(spark, f"{folder}/warc")), "warc-rows")
    originals = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("rank").alias("refers_to"))
    return (found.join(originals, "refers_id", "left")
            .select(F.col("rank").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("uri").alias("url"),
                    "record_id", "intact"))


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


#: Five hexadecimal digits make four of base 32.
SQL = """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
hashed AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM payloads),
coded AS (
    SELECT page_id, payload_bytes, hex, list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform([15, 10, 5, 0],
        lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * k + 1, 5))::BIGINT >> b) & 31)::INT + 1, 1)),
        'string_agg', '')), 'string_agg', '') AS payload_digest FROM hashed),
first AS (SELECT hex, max(page_id) AS response FROM coded GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> response THEN response END AS refers_to, true AS intact
FROM coded JOIN first USING (hex)
"""
