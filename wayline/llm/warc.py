"""Conversion of legacy ARC archives to WARC.

An ARC file begins with a version block that names the columns of its header lines (version 1 has five, version 2 ten);
each record is such a line, as many bytes as it declares, and a line feed. The converter reads both versions and makes
WARC records with synthesised identifiers, timestamps, types and digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import cut, shared_path

FILE_BYTES, FILE_RECORDS = 64 << 20, 1 << 14
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Fixed values of the ARC format: the columns of header lines by version.
ARC_COLUMNS = {
    "1": ["url", "ip", "date", "type", "length"],
    "2": ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length"],
}


def arc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and the body of each record of an ARC file but the version block.

    The version comes from the version block's second line. A header line with too few fields or a length that isn't a
    number ends the file: what follows can't be located. A body that is shorter than declared is given as it is.
    """
    at, columns = 0, None
    while at < len(content):
        end = content.find(b"\n", at)
        if end < 0:
            return
        line = content[at:end].decode("utf-8", "replace").strip("\r")
        if not line:
            at = end + 1
            continue
        fields = line.split(" ")
        if not fields[-1].isdigit():
            return
        start, size = end + 1, int(fields[-1])
        body = content[start : start + size]
        at = start + size + 1
        if columns is None:
            second = body.split(b"\n", 1)[0].decode("ascii", "replace").split(" ")
            columns = ARC_COLUMNS.get(second[0])
            if columns is None:
                return
            continue
        if len(fields) < len(columns):
            return
        # A URL may hold spaces; the other fields can't.
        spare = len(fields) - len(columns)
        yield dict(zip(columns, [" ".join(fields[: spare + 1]), *fields[spare + 1 :]])), body


def warc_time(date: str | None) -> str:
    """14 digits of an ARC date as a WARC timestamp; shorter ones are filled up, others give the epoch."""
    digits = (date or "")[:14]
    if digits.isdigit() and len(digits) >= 4:
        digits += "00000101000000"[len(digits) :]
        try:
            return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        except ValueError:
            pass
    return "1970-01-01T00:00:00Z"


def _split_http(body: bytes) -> tuple[bytes, bytes]:
    """The HTTP head with its blank line, and the payload; a body without a head is all payload."""
    if body.startswith(b"HTTP/"):
        for gap in (b"\r\n\r\n", b"\n\n"):
            end = body.find(gap)
            if end >= 0:
                return body[: end + len(gap)], body[end + len(gap) :]
    return b"", body


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


CONVERTED = "page_id long, url string, date string, mime string, head string, payload string, payload_bytes long, payload_digest string, record_id string"


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives to the fields of their WARC records; page_id is the number after #page= in the record's URL, if any."""
    for batch in batches:
        rows = []
        for archive, number in zip(batch.column("content"), batch.column("number").to_pylist()):
            for place, (fields, body) in enumerate(arc_records(archive.as_py() or b"")):
                head, payload = _split_http(body)
                url, mark, page_number = fields["url"].rpartition("#page=")
                page = int(page_number) if mark and page_number.lstrip("-").isdigit() else None
                digest = sha1_base32(payload)
                # Records that repeat differ by the number of their archive and their place in it.
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{fields['url']} {fields['date']} {digest} {number} {place}")
                texts = (head.decode("utf-8", "replace"), payload.decode("utf-8", "replace"))
                rows.append((page, url if mark else fields["url"], warc_time(fields["date"]), fields["type"], *texts, len(payload), digest, f"<urn:uuid:{name}>"))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], [c.split()[0] for c in CONVERTED.split(", ")])


def convert_arcs(archives: DataFrame, content_col: str = "content") -> DataFrame:
    """One row per record of ARC files (binary column, as the binaryFile reader gives it), ready to be written as WARC.

    Null or empty contents, and contents without a version block of version 1 or 2, give no rows. Columns: CONVERTED.
    """
    return archives.select(F.col(content_col).alias("content"), F.monotonically_increasing_id().alias("number")).mapInArrow(_convert, CONVERTED)


def as_arc(pages: DataFrame) -> DataFrame:
    """Every page as an ARC file of one record, version 1 for even and version 2 for odd ids.

    The URL carries the page's id after #page=, the date its place in seconds after 2008-01-01; white space in URLs is
    escaped, as the header line's fields are parted by spaces.
    """
    body = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit(RECORD_END), F.coalesce("html", F.lit("")),
    )
    url = F.concat(F.regexp_replace(F.coalesce("url", F.lit("")), r"\s", "%20"), F.lit("#page="), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    date = F.date_format(F.timestamp_seconds(F.lit(1199145600) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000))), "yyyyMMddHHmmss")
    odd = F.coalesce(F.col("page_id") % 2 != 0, F.lit(False))
    names_1, names_2 = "URL IP-address Archive-date Content-type Archive-length\n", "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    size = F.octet_length("body").cast("string")

    def block(version: str, names: str, middle: str, extra: str):
        about = f"{version} 0 wayline\n{names}"
        first = f"filedesc://pages.arc 0.0.0.0 20080101000000 text/plain {middle}{len(about)}\n{about}\n"
        return F.concat(F.lit(first), F.col("name"), F.lit(" 0.0.0.0 "), F.col("date"), F.lit(" text/html "), F.lit(extra), size, F.lit("\n"), F.col("body"), F.lit("\n"))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").select(body.alias("body"), url.alias("name"), date.alias("date"), odd.alias("odd"))
    return rows.select(F.when(F.col("odd"), block("2", names_2, "200 - - 0 pages.arc ", "200 - - 0 pages.arc ")).otherwise(block("1", names_1, "", "")).cast("binary").alias("content"))


def _holders(records: DataFrame) -> DataFrame:
    """Per payload (digest and size) the record with the largest page_id (holder) and the number of records (n)."""
    holder = F.max(F.struct("page_id", "record_id", "url", "date")).alias("holder")
    return cut(records.groupBy("payload_digest", "payload_bytes").agg(holder, F.count("*").alias("n")))


def with_revisits(records: DataFrame, holders: DataFrame | None = None) -> DataFrame:
    """Adds holder, the record (page_id, record_id, url, date) of the response that has a record's payload: among equal
    payloads that with the largest page_id.

    The choice is a pre-aggregated maximum per digest and size, joined back, so a payload that many pages share is never
    gathered; with the choice written first, adaptive execution can split the join. Records are made once for the choice
    and once for the join, which costs less than keeping the payloads. Records without a page_id are responses only if
    no equal payload has one; rows with the same page_id and payload have the same type.
    """
    holders = _holders(records) if holders is None else holders
    return records.join(holders.drop("n"), ["payload_digest", "payload_bytes"])


def _records_per_file(holders: DataFrame) -> int:
    """How many records have about FILE_BYTES of payload."""
    total, n = holders.agg(F.sum(F.col("payload_bytes") * F.col("n")), F.sum("n")).first()
    return max(1, min(FILE_RECORDS, FILE_BYTES * (n or 1) // max(1, total or 0)))


def as_warc(records: DataFrame) -> DataFrame:
    """One string column: each record's WARC text but the two line breaks that end it."""
    revisit = ~F.col("page_id").eqNullSafe(F.col("holder.page_id"))
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    mark = F.coalesce(F.col("page_id").cast("string"), F.lit("-"))
    plain = lambda url: F.regexp_replace(url, r"[\r\n]", "%20")
    refers = F.concat(
        line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.col("holder.record_id")), line("WARC-Refers-To-Target-URI", plain("holder.url")),
        line("WARC-Refers-To-Date", F.col("holder.date")), line("X-Refers-To-Page", F.coalesce(F.col("holder.page_id").cast("string"), F.lit("-"))),
    )
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", plain("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("X-Page", mark),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block,
    )
    return records.select(text.alias("value"))


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an uncompressed WARC file."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        yield fields, content[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    number = lambda x: None if x in (None, "-") else int(x)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
            content = raw.as_py()
            rows = []
            for fields, block in warc_records(gzip.decompress(content) if path.endswith(".gz") else content):
                head, payload = _split_http(block)
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response":
                    size = len(payload)
                    if sha1_base32(payload) != digest:
                        raise ValueError(f"digest of {fields['warc-record-id']} in {path} doesn't match its payload")
                else:  # the head still declares the payload's size
                    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                rows.append((number(fields.get("x-page")), size, digest, kind, number(fields.get("x-refers-to-page"))))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], [c.split()[0] for c in READ.split(", ")])


def write_warcs(records: DataFrame, path: str, per_file: int = FILE_RECORDS) -> None:
    """Write records (CONVERTED with holder) as gzipped WARC files of at most so many, on any file system Spark can write.

    The text sink with the record end as its line separator writes exactly a WARC file, so no file passes through Python.
    """
    as_warc(records).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def read_warcs(frame_path: str, spark) -> DataFrame:
    """One row per record of the WARC files in a folder, digests of responses verified: READ."""
    files = spark.read.format("binaryFile").load(frame_path).where("length > 0").select("path", "content")
    return files.mapInArrow(_read, READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages by way of ARC to WARC files and back: one row per page, READ.

    A null html is an empty payload; equal payloads share one response. A null page_id stays null. Repeated rows each
    get a record. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    records = convert_arcs(as_arc(pages))
    holders = _holders(records)
    write_warcs(with_revisits(records, holders), path, _records_per_file(holders))
    return read_warcs(path, spark)
