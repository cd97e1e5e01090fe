"""Web archives: a legacy archive converter, and a writer and reader of WARC.

ARC, the legacy format, has a version record first and then records that begin
with one header line: URL, IP address, date, content type and length in version
1, with result code, checksum, location, offset and file name between them in
version 2. The converter reads header lines by the version that the file
declares and takes payloads by their declared lengths. It synthesises what WARC
asks for and ARC lacks: record identifiers, ISO timestamps, record types and
payload digests.

Archives are written as text, one record per row, with blank lines between
records, and read whole file by whole file; a file holds RECORDS_PER_FILE
records at most. Spark's writers and readers do both, so any store that Spark
reaches will do.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.llm.common import materialize, scratch_path

RECORDS_PER_FILE = 2000
MIN_REVISIT = 1000
_CRLF = "\r\n"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "legacy-archive-record")
# Fields of an ARC header line by version.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "mime", "length"),
    "2": ("url", "ip", "date", "mime", "code", "checksum", "location", "offset", "filename", "length"),
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(url: Column) -> Column:
    """A URL that fits in a header field: no white space or control characters."""
    return F.when(F.length(F.trim(F.coalesce(url, F.lit("")))) > 0, F.regexp_replace(url, r"[\s\p{Cntrl}]", "%20")).otherwise(F.lit("unknown:"))


def http_block(page_id: Column, html: Column) -> Column:
    """An HTTP response whose body is the page."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"),
        F.when(page_id.isNotNull(), F.concat(F.lit("X-Page-Id: "), page_id.cast("string"), F.lit(_CRLF))).otherwise(F.lit("")),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(_CRLF + _CRLF))
    return F.concat(head, body)


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20240101000000") -> None:
    """One ARC record per row of ``pages`` (page_id, url, html), in gzip files of one version record and many others."""
    block = http_block(F.col("page_id"), F.col("html"))
    size = F.octet_length(block).cast("string")
    fields = {
        "url": _clean(F.col("url")), "ip": F.lit("0.0.0.0"), "date": F.lit(date), "mime": F.lit("text/html"), "code": F.lit("200"),
        "checksum": F.lit("-"), "location": F.lit("-"), "offset": F.lit("0"), "filename": F.lit("pages.arc"), "length": size,
    }
    line = F.concat_ws(" ", *(fields[f] for f in ARC_FIELDS[str(version)]))
    # a version record in front of every record keeps each file readable wherever the writer starts a new one
    about = f"{version} 0 pages\n{' '.join(ARC_FIELDS[str(version)])}\n"
    declared = f"filedesc://pages.arc 0.0.0.0 {date} text/plain {len(about)}\n{about}\n"
    pages.select(F.concat(F.lit(declared), line, F.lit("\n"), block).alias("value")).write.mode("errorifexists").option("lineSep", "\n").option(
        "compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _content(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":  # members one after the other
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an ARC file; a damaged header ends the file.

    A version record sets the fields of the lines after it. Blank lines between records are skipped.
    """
    fields, at = ARC_FIELDS["1"], 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            return
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        described = parts[0].startswith("filedesc:")
        names = ARC_FIELDS["1"] if described and len(parts) == 5 else ARC_FIELDS["2"] if described else fields
        # a URL may hold spaces in old files; the other fields never do
        extra = len(parts) - len(names)
        if extra < 0 or not parts[-1].isdigit():
            return
        header = dict(zip(names, [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]))
        block = data[end + 1 : end + 1 + int(header["length"])]
        at = end + 1 + int(header["length"])
        if described:
            declared = block.split(b"\n", 1)[0].split(b" ", 1)[0].decode("ascii", "replace")
            fields = ARC_FIELDS.get(declared, ARC_FIELDS["1"])
        yield header, block


def iso_date(date: str) -> str:
    """An ISO timestamp of an ARC date of 8 to 14 digits; the epoch for others."""
    if not (date.isdigit() and 8 <= len(date) <= 14):
        return "1970-01-01T00:00:00Z"
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head and payload of an HTTP block; a block without a head is all payload."""
    if block[:5] != b"HTTP/":
        return b"", block
    for gap in (b"\r\n\r\n", b"\n\n"):
        end = block.find(gap)
        if end >= 0:
            return block[: end + len(gap)], block[end + len(gap) :]
    return block, b""


def _header(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        if line.lower().startswith(name.lower() + b":"):
            return line.split(b":", 1)[1].strip().decode("utf-8", "replace")
    return None


CONVERTED = "page_id long, url string, date string, kind string, record_id string, head string, payload string, payload_bytes long, digest string"


def _batches(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _read(spark: SparkSession, path: str, run, schema: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, schema)


def convert_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the ARC files under ``path`` with what WARC needs (columns of CONVERTED), version records left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for header, block in arc_records(_content(content.as_py())):
                    if header["url"].startswith("filedesc:"):
                        continue
                    head, payload = _split_http(block)
                    page = _header(head, b"X-Page-Id")
                    digest = hashlib.sha1(payload).hexdigest()
                    date = iso_date(header["date"])
                    name = f"{header['url']} {date} {page} {digest}"
                    kind = "response" if head else "resource"
                    rows.append((
                        int(page) if page is not None else None, header["url"], date, kind, f"urn:uuid:{uuid.uuid5(_NAMESPACE, name)}",
                        head.decode("utf-8", "replace"), payload.decode("utf-8", "surrogatepass"), len(payload), digest))
                    if len(rows) >= 500:
                        yield _batches(rows, CONVERTED)
                        rows = []
                if rows:
                    yield _batches(rows, CONVERTED)

    return _read(spark, path, run, CONVERTED)


def mark_revisits(records: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``records`` with ``original_id``: null, or the record that a revisit refers to.

    Of records with equal payloads of ``min_bytes`` or more the one with the
    largest page_id is the original, ties to the larger identifier; only keys of
    repeated payloads are gathered.
    """
    last = F.max(F.struct("page_id", "record_id"))
    groups = records.filter(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(F.count("*").alias("n"), last.alias("last"))
    groups = materialize(groups.filter("n > 1").select("digest", "payload_bytes", F.col("last.record_id").alias("original_id")), "repeated_payloads")
    marked = records.join(groups, ["digest", "payload_bytes"], "left")
    return marked.withColumn("original_id", F.when(F.col("original_id") != F.col("record_id"), F.col("original_id")))


def write_warc(records: DataFrame, path: str) -> None:
    """One WARC record per row of ``records`` (columns of CONVERTED, and original_id), in gzip files."""
    revisit = F.col("original_id").isNotNull()
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    http = F.length("head") > 0
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.col("kind"))
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    head = F.concat(
        F.lit(WARC_VERSION + _CRLF), header("WARC-Type", kind), header("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        header("WARC-Date", F.col("date")), header("WARC-Target-URI", F.col("url")), header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(header("WARC-Profile", F.lit(REVISIT_PROFILE)), header("WARC-Refers-To", F.concat(F.lit("<"), F.col("original_id"), F.lit(">"))))).otherwise(F.lit("")),
        header("Content-Type", F.when(http, F.lit("application/http; msgtype=response")).otherwise(F.lit("text/html"))),
        header("Content-Length", F.octet_length(block).cast("string")), F.lit(_CRLF))
    # the writer ends each row with lineSep: the two line ends that close a record
    records.select(F.concat(head, block).alias("value")).write.mode("errorifexists").option("lineSep", _CRLF + _CRLF).option(
        "compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of a WARC file, by declared lengths."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split(_CRLF)[1:]
        header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = header.get("content-length", "")
        if not size.isdigit():
            return
        yield header, data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)


RECORDS = "record_id string, record_type string, date string, url string, page_id long, payload string, payload_bytes long, payload_digest string, " \
    "refers_to_id string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``.

    A revisit has no payload; its length is the one its HTTP head declares, its
    digest the one of its header. Digests of payloads are computed anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for header, block in warc_records(_content(content.as_py())):
                    head, payload = _split_http(block)
                    page = _header(head, b"X-Page-Id")
                    revisit = header.get("warc-type") == "revisit"
                    declared = header.get("warc-payload-digest", "").removeprefix("sha1:")
                    if len(declared) == 32:  # base 32 in archives of others
                        declared = base64.b32decode(declared).hex()
                    rows.append((
                        header.get("warc-record-id", "").strip("<>"), header.get("warc-type"), header.get("warc-date"), header.get("warc-target-uri"),
                        int(page) if page is not None else None, None if revisit else payload.decode("utf-8", "replace"),
                        int(_header(head, b"Content-Length") or 0) if revisit else len(payload),
                        declared if revisit else hashlib.sha1(payload).hexdigest(),
                        header["warc-refers-to"].strip("<>") if "warc-refers-to" in header else None))
                    if len(rows) >= 500:
                        yield _batches(rows, RECORDS)
                        rows = []
                if rows:
                    yield _batches(rows, RECORDS)

    return _read(spark, path, run, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``: the page_id of the record that a revisit refers to."""
    pages = records.select("record_id", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id")
    wanted = pages.filter("refers_to_id IS NOT NULL").select(F.col("refers_to_id").alias("record_id")).distinct()
    originals = pages.filter("refers_to_id IS NULL").join(wanted, "record_id", "left_semi").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).dropDuplicates(["refers_to_id"])
    return pages.join(originals, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) through ARC files, the converter and WARC files, and what is read back.

    One row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Null html is an empty payload; null and blank URLs are
    ``unknown:``. Repeated rows give a record each with the same identifier, so
    all of them are the original of their payload. Extra columns are ignored.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    write_arc(texts, arc)
    write_warc(mark_revisits(convert_arc(spark, arc)), warc)
    return resolve(read_warc(spark, warc))


#: DuckDB SQL for the result of ``archive``, over a view ``pages``.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT page_id, n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {MIN_REVISIT} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_REVISIT} AND page_id <> last THEN last END AS refers_to
FROM g
"""
