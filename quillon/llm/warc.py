"""Web archives: pages to legacy ARC blocks, ARC to WARC, WARC files written and read back.

An ARC file opens with a version block that names its header fields; version 1 lines have five, version
2 lines ten, always from the URL to the declared length. The converter reads each line by its version,
takes the declared number of bytes and gives the record a WARC identifier, timestamp, type and digest.
A record's block is an HTTP response; its payload is the body. Of records with equal payloads (SHA-1) of
at least REVISIT_BYTES the one with the largest page_id is a response, the others revisit it and keep
only the HTTP header.

Archives are rows of about ARCHIVE_BYTES, one text file each (Spark's text writer ends a row with the
line feed that ends a WARC record), compressed, in the shared folder.

Cases: a null html is an empty payload; a null url becomes about:blank; blanks in a url are escaped; a null
page_id is kept as such and revisits a known one; rows repeated under the largest page_id are all
responses; an empty table gives no archive and an empty result; extra columns are ignored; a payload may
hold header lines or line feeds of any kind, since only declared lengths count; a longer page makes an
archive of its own. A truncated or malformed archive raises ValueError.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import SALTS, arrow_batches, project, run_dir, salted, table

ARCHIVE_BYTES = 8 << 20
REVISIT_BYTES = 1000
CAPTURED = "20200101000000"
_PAGE = b"X-Page-Id"

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


# --- ARC ---------------------------------------------------------------------------------------


def arc_header(version: int, name: str, date: str = CAPTURED) -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 quillon\n{ARC_FIELDS[version]}\n".encode()
    middle = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, block: bytes, date: str = CAPTURED) -> bytes:
    middle = "" if version == 1 else f" 200 - - {offset} {name}"
    line = f"{quote(url, safe=_SAFE)} 0.0.0.0 {date} text/html{middle} {len(block)}\n"
    return line.encode() + block + b"\n"


_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def read_arc(data: bytes):
    """Records of an archive as (fields by name, block); the version block itself is not one."""
    at, names = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        line = data[at:end].decode("utf-8")
        if not line:  # blank lines may stand between records
            at = end + 1
            continue
        parts = line.split(" ")
        try:
            length = int(parts[-1])
        except ValueError:
            raise ValueError(f"an ARC header line has no length: {line[:80]!r}") from None
        block = data[end + 1 : end + 1 + length]
        if length < 0 or len(block) < length:
            raise ValueError("an ARC record is shorter than declared")
        at = end + 1 + length
        if names is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC file must open with its version block")
            head = block.decode("utf-8").split("\n")
            version = int(head[0].split(" ")[0])
            if version not in ARC_FIELDS or head[1] != ARC_FIELDS[version]:
                raise ValueError(f"unknown ARC version: {head[0]!r}")
            names = ARC_FIELDS[version].split(" ")
            continue
        if len(parts) != len(names):
            raise ValueError(f"an ARC header line has {len(parts)} fields, not {len(names)}: {line[:80]!r}")
        yield dict(zip(names, parts)), block


# --- WARC --------------------------------------------------------------------------------------


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header with its blank line, and body; without an HTTP header all is body."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return b"", block
    return block[: end + 4], block[end + 4 :]


def http_field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode() if found else None


def record_id(page: str | None, url: str, date: str, digest: str) -> str:
    """By page where the record names one, else a name-based UUID of what the record holds."""
    if page is not None:
        return f"<urn:page:{page}>"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest}')}>"


def warc_date(date: str) -> str:
    if not re.fullmatch("[0-9]{14}", date):
        raise ValueError(f"not an ARC date: {date!r}")
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:]}Z"


def convert(arc: bytes, revisits: dict[int, str]) -> bytes:
    """A WARC archive of an ARC archive's records; revisits: page that the n-th record revisits."""
    out = []
    for i, (fields, block) in enumerate(read_arc(arc)):
        head, payload = split_http(block)
        digest = hashlib.sha1(payload).hexdigest()
        date = fields["Archive-date"]
        lines = [
            WARC_VERSION,
            f"WARC-Type: {'revisit' if i in revisits else 'response' if head else 'resource'}",
            f"WARC-Record-ID: {record_id(http_field(head, _PAGE), fields['URL'], date, digest)}",
            f"WARC-Date: {warc_date(date)}",
            f"WARC-Target-URI: {fields['URL']}",
            f"WARC-IP-Address: {fields['IP-address']}",
            f"WARC-Payload-Digest: sha1:{digest}",
        ]
        if i in revisits:
            lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(revisits[i], '', '', '')}"]
            block = head
        else:
            lines.append(f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}")
        lines += [f"Content-Type: {'application/http; msgtype=response' if head else fields['Content-type']}", f"Content-Length: {len(block)}"]
        out.append("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    return b"".join(out)


def read_warc(data: bytes):
    """Records of an archive as (fields by lower-case name, block)."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a WARC header has no end")
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        at = end + 4 + length
        if len(block) < length or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record is shorter than declared")
        at += 4
        yield fields, block


# --- tables ------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the page that a record revisits, else null."""
    pages = pages.withColumn("html", F.coalesce("html", F.lit("")))
    is_long = F.octet_length("html") >= REVISIT_BYTES
    none = F.lit(None).cast("long").alias("refers_to")
    short = pages.where(~is_long).select("page_id", "url", "html", none)  # these don't travel
    long = pages.where(is_long).withColumn("digest", F.sha1("html"))
    shared = long.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    long, shared = salted(long, shared, SALTS, "digest", without="html")
    joined = long.join(shared.hint("shuffle_hash"), ["digest", "salt"], "left")
    target = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("top")), F.col("top")).alias("refers_to")
    return joined.select("page_id", "url", "html", target).union(short)


def archives(pages: DataFrame) -> DataFrame:
    """Rows of with_revisits() as WARC archives, a row each, by way of ARC archives of both versions in turn."""

    def convert_all(batches):
        number = 0
        for arc, revisits in _arcs(batches):
            number += 1
            data = convert(arc, revisits)
            yield (data[:-1].decode("utf-8"),)  # the writer adds the last line feed

    def run(batches):
        yield from arrow_batches(convert_all(batches), {"value": pa.large_string()}, 1)

    return pages.mapInArrow(run, "value string")


def _arcs(batches):
    """ARC archives of about ARCHIVE_BYTES and the pages that their records revisit."""
    version, parts, size, revisits, n = 1, [], 0, {}, 0
    for batch in batches:
        for page, url, html, target in zip(*batch.columns):
            page, url, target = page.as_py(), url.as_py(), target.as_py()
            body = html.as_py().encode("utf-8")
            if not parts:
                parts, size, revisits, n = [arc_header(version, f"v{version}.arc")], 0, {}, 0
            named = b"" if page is None else b"%s: %d\r\n" % (_PAGE, page)
            block = b"HTTP/1.1 200 OK\r\n%sContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (named, len(body)) + body
            parts.append(arc_record(version, f"v{version}.arc", size, "about:blank" if url is None else url, block))
            if target is not None:
                revisits[n] = str(target)
            n += 1
            size += len(block)
            if size >= ARCHIVE_BYTES:
                yield b"".join(parts), revisits
                version, parts = 3 - version, []
    if parts:
        yield b"".join(parts), revisits


def convert_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, warc) of the legacy archives *.arc and *.arc.gz in a folder: each as the bytes of a WARC archive, whatever its payloads hold.

    A file is one row and is converted at once, so it must fit into a task's memory.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(*batch.columns):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([convert(data, {})], pa.binary())], names=["path", "warc"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc*").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, warc binary")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write pages (page_id, url, html) as compressed WARC files in a folder."""
    pages = project(pages, page_id="page_id", url="url", html="html").withColumn("page_id", F.col("page_id").cast("long"))
    archives(with_revisits(pages)).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record in a folder."""
    columns = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def page_of(identifier: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", identifier or "")
        return int(found[1]) if found else None

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                for fields, block in read_warc(gzip.decompress(content.as_py())):
                    head, payload = split_http(block)
                    kind = fields["warc-type"]
                    if kind == "revisit":
                        n, digest = int(http_field(head, b"Content-Length")), fields["warc-payload-digest"].removeprefix("sha1:")
                    else:
                        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if fields["warc-payload-digest"] != f"sha1:{digest}":
                            raise ValueError(f"the payload of {fields['warc-record-id']} does not fit its digest")
                    yield page_of(fields["warc-record-id"]), fields["warc-target-uri"], n, digest, kind, page_of(fields.get("warc-refers-to"))

    def run(batches):
        yield from arrow_batches(rows(batches), columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{run_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("url")


ORACLE_SQL = """with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
    t as (select d, max(page_id) as top from p where n >= 1000 group by d)
    select page_id, cast(n as bigint) as payload_bytes, d as payload_digest, case when page_id < top or page_id is null and top is not null then 'revisit' else 'response' end as record_type,
        case when page_id < top or page_id is null then top end as refers_to
    from p left join t using (d)"""
