"""Legacy archives: ARC files of both header versions are converted to WARC, with revisit records.

Archives are plain files of bounded size, written and read by Spark: a row is one archive (many
records), the text writer puts each into a file of its own, and the binary-file reader gives them
back whole. So any file system of the cluster will do, and lost tasks write their files again.

The converter reads an archive's version line, then record after record by the header fields of that
version and the declared length. It synthesises WARC record ids, timestamps, types and digests. Of
equal payloads (same SHA-1 and length) of at least ``least_bytes`` the record with the largest page_id
stays a response, the others become revisits of it.

Defined results: null html is an empty payload; rows without page_id keep none; repeated rows (equal
page_id and payload) are responses all; a null or blank url is written as ``unknown:``; white space in
urls is percent-encoded; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgatlas.llm.shared import materialize, salted, shared_folder, sliced

ARCHIVE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
LEAST_REVISIT = 1000
CAPTURED = "20000101000000"

#: The record header fields of the two ARC versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("captured", pa.string()), ("status", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
RECORD_TYPE = "page_id long, url string, captured string, status string, digest string, payload_bytes long, payload binary"
PLACE = pa.schema([("path", pa.string()), ("number", pa.int32()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64())])
PLACE_TYPE = "path string, number int, page_id long, digest string, payload_bytes long"
RESULT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
RESULT_TYPE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def arc_opening(version: int, name: str) -> bytes:
    body = f"{version} 0 legacy\n{' '.join(ARC_FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": "text/plain", "Result-code": "200", "Archive-length": str(len(body))}
    return " ".join(values.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n"
    body = head.encode() + payload
    where = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), (url or "").strip()) or "unknown:"
    values = {"URL": where, "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": "text/html", "Result-code": "200", "Archive-length": str(len(body))}
    return " ".join(values.get(f, "-") for f in ARC_FIELDS[version]).encode("utf-8", "surrogatepass") + b"\n" + body + b"\n"


def parse_arc(raw: bytes) -> Iterator[tuple[dict, memoryview]]:
    """(header fields, content block) of each record after the version block; an empty file has none."""
    if not raw:
        return
    end = raw.index(b"\n")
    opening = raw[:end].split(b" ")
    length = int(opening[-1])
    version = int(raw[end + 1 : end + 1 + length].split(b" ", 1)[0])
    fields, view, at = ARC_FIELDS[version], memoryview(raw), end + 1 + length
    while True:
        while at < len(raw) and raw[at] in b"\r\n":
            at += 1
        if at >= len(raw):
            return
        end = raw.index(b"\n", at)
        values = dict(zip(fields, raw[at:end].decode("utf-8", "surrogatepass").rsplit(" ", len(fields) - 1), strict=True))
        start, at = end + 1, end + 1 + int(values["Archive-length"])
        yield values, view[start:at]


def http_parts(block: memoryview) -> tuple[str, dict[str, str], memoryview]:
    """Status, headers and payload of an HTTP response; headers of any length."""
    size, cut = 1 << 12, -1
    while cut < 0:
        raw = bytes(block[:size])
        cut = raw.find(b"\r\n\r\n")
        if cut < 0 and size >= len(block):
            raise ValueError("an HTTP response without the end of its headers")
        size *= 4
    first, *lines = raw[:cut].decode("latin-1").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return first.split(" ")[1], headers, block[cut + 4 :]


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id} {digest}'.encode()).digest()[:16], version=5)}>"


def warc_time(captured: str) -> str:
    c = captured
    return f"{c[:4]}-{c[4:6]}-{c[6:8]}T{c[8:10]}:{c[10:12]}:{c[12:14]}Z"


def warc_block(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def warc_opening(name: str) -> bytes:
    block = b"software: archive converter\r\nformat: WARC File Format 1.1\r\n"
    return warc_block([("WARC-Type", "warcinfo"), ("WARC-Date", warc_time(CAPTURED)), ("WARC-Filename", name), ("WARC-Record-ID", record_id(None, name)), ("Content-Type", "application/warc-fields")], block)


def warc_record(page_id, url, captured, status, digest, payload, refers_to) -> bytes:
    head = f"HTTP/1.1 {status} OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Target-URI", url), ("WARC-Date", warc_time(captured)), ("WARC-Record-ID", record_id(page_id, digest)), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is None:
        return warc_block(headers, head + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to)), ("X-Payload-Length", str(len(payload)))]
    return warc_block(headers, head)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    view, at = memoryview(raw), 0
    while at < len(raw):
        cut = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:cut].decode("utf-8", "surrogatepass").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = cut + 4
        stop = start + int(headers["content-length"])
        yield headers, view[start:stop]
        at = stop + 4


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in sliced(batches):
        for row in range(batch.num_rows):
            yield tuple(column[row].as_py() for column in batch.columns)


def archives(rows: Iterator[tuple], opening, record, weight, cut: int) -> Iterator[pa.RecordBatch]:
    """One row per archive of at most ``ARCHIVE_BYTES``, or of a single record, without its last ``cut`` bytes."""
    parts, size, number = [], 0, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-cut]], pa.binary())], ["archive"])

    for row in rows:
        if parts and size + weight(row) > ARCHIVE_BYTES:
            yield done()
            parts, size, number = [], 0, number + 1
        if not parts:
            parts = [opening(number)]
        parts.append(record(row))
        size += len(parts[-1])
    if parts:
        yield done()


def write_archives(rows: DataFrame, path: str, separator: str) -> None:
    """One gzip file per row; ``separator`` ends each file and so is left out of the row."""
    rows.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, version: int | None = None) -> None:
    """Legacy archives of ``pages``; without ``version`` the archives alternate between both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = version or 1

        def opening(number: int) -> bytes:
            nonlocal current
            current = version or 1 + number % 2
            return arc_opening(current, f"legacy-{number}.arc")

        def record(row: tuple) -> bytes:
            return arc_record(current, row[0], row[1], row[2] or b"")

        yield from archives(rows_of(batches), opening, record, lambda row: len(row[2] or b""), 1)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("payload"))
    write_archives(rows.mapInArrow(run, "archive binary"), path, "\n")


def records_of(content: bytes) -> Iterator[tuple]:
    """(page_id, url, captured, status, digest, payload) of each record of a legacy archive, with synthesised digests."""
    for fields, block in parse_arc(gzip.decompress(content)):
        status, headers, payload = http_parts(block)
        own = headers.get("x-page-id")
        yield int(own) if own else None, fields["URL"], fields["Archive-date"], fields.get("Result-code", status), hashlib.sha1(payload).hexdigest(), bytes(payload)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of legacy archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows, size = [], 0
                for *head, payload in records_of(content.as_py()):
                    rows.append((*head, len(payload), payload))
                    size += len(payload)
                    if size > BATCH_BYTES:
                        yield rows_batch(rows, RECORD)
                        rows, size = [], 0
                yield rows_batch(rows, RECORD)

    return read_archives(spark, path).mapInArrow(run, RECORD_TYPE)


def index_arc(spark: SparkSession, path: str) -> DataFrame:
    """Where each record of legacy archives stands (path, number), whose it is, and its payload's digest and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield rows_batch([(name, number, r[0], r[4], len(r[5])) for number, r in enumerate(records_of(content.as_py()))], PLACE)

    return read_archives(spark, path).mapInArrow(run, PLACE_TYPE)


def rows_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = LEAST_REVISIT) -> None:
    """Legacy archives under ``arc_path`` become WARC archives under ``warc_path``.

    Only the index is shuffled: it gives each archive the list of its records that revisit another one. Payloads stay in their archive until it is converted.
    """
    index = materialize(index_arc(spark, arc_path).where(F.col("payload_bytes") >= least_bytes))
    kept = index.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = salted(index, materialize(kept), ["digest", "payload_bytes"], F.struct("path", "number")).where(F.coalesce(F.col("page_id"), F.lit(-1)) != F.col("kept"))
    lists = materialize(known.groupBy("path").agg(F.collect_list(F.struct("number", "kept")).alias("revisits")))  # as many entries as an archive has records

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content, revisits in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                refers = {r["number"]: r["kept"] for r in revisits or ()}
                for number, record in enumerate(records_of(content.as_py())):
                    yield *record, refers.get(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opening(number: int) -> bytes:
            return warc_opening(f"converted-{number}.warc.gz")

        yield from archives(rows(batches), opening, lambda row: warc_record(*row), lambda row: len(row[5]), 2)

    whole = read_archives(spark, arc_path).join(lists, "path", "left").select("path", "content", "revisits")
    write_archives(whole.mapInArrow(run, "archive binary"), warc_path, "\r\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all response and revisit records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for headers, block in parse_warc(gzip.decompress(content.as_py())):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    own, other = headers.get("x-page-id"), headers.get("x-refers-to-page")
                    if kind == "response":
                        _, _, payload = http_parts(block)
                        length, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    else:
                        length, digest = int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((int(own) if own else None, length, digest, kind, int(other) if other else None))
                yield rows_batch(rows, RESULT)

    return read_archives(spark, path).mapInArrow(run, RESULT_TYPE)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages to legacy archives, to WARC archives, and back to rows."""
    spark, folder = pages.sparkSession, shared_folder(pages.sparkSession)
    write_arc(pages, f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    return read_warc(spark, f"{folder}/warc")
