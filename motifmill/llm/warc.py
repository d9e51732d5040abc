"""Legacy web archives: ARC to WARC conversion, revisit records, and reading WARC files back.

ARC files of version 1 and 2 are parsed by their version block's number and the length that each header line declares;
a WARC record with an identifier, timestamp, type and digest is synthesised for each document. Archives are written as
gzip'ed WARC text files by Spark's own writer and read back as binary files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, new_path, small_batches, stored

#: Payloads from this size on are replaced by revisits of an equal one.
REVISIT_BYTES = 1000
#: Bytes of records of one archive file before compression; a longer record has its own.
FILE_BYTES = 32 << 20
ARC_DATE = "19960101000000"
# Fixed values of the ARC formats: the field names of a version's header lines.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
# Fixed value of the WARC format: the profile of a revisit of an equal payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes


def arc_archive(records: Iterable[ArcRecord], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file: the version block, then each document after its header line."""
    about = f"{version} 0 motifmill\n{ARC_FIELDS[version]}\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 {ARC_DATE} text/plain ".encode() + (b"200 - - 0 %s " % name.encode() if version == 2 else b"") + b"%d\n" % len(about), about, b"\n"]
    at = sum(map(len, out))
    for r in records:
        more = f" 200 {hashlib.md5(r.block).hexdigest()} - {at} {name}" if version == 2 else ""
        line = f"{r.url} {r.ip} {r.date} {r.content_type}{more} {len(r.block)}\n".encode()
        out += [line, r.block, b"\n"]
        at += len(line) + len(r.block) + 1
    return b"".join(out)


def arc_records(stream: BinaryIO) -> Iterator[ArcRecord]:
    """The documents of an ARC file. Raises ValueError where a header line or a declared length doesn't hold."""
    names: list[str] = []
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8").rstrip("\r\n").split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"no length in the ARC header line {line[:80]!r}")
        block = stream.read(int(parts[-1]))
        if len(block) != int(parts[-1]):
            raise ValueError(f"an ARC record declares {parts[-1]} bytes and has {len(block)}")
        if not names:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("an ARC file must begin with its version block")
            names = ARC_FIELDS[int(block.split(b" ", 1)[0])].split(" ")
            continue
        if len(parts) != len(names):
            raise ValueError(f"an ARC header line has {len(parts)} fields instead of {len(names)}")
        field = dict(zip(names, parts, strict=True))
        yield ArcRecord(field["URL"], field["IP-address"], field["Archive-date"], field["Content-type"], block)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header, with its blank line, and payload; all is payload if there is no such header."""
    head, blank, payload = block.partition(b"\r\n\r\n")
    return (head + blank, payload) if blank and block.startswith(b"HTTP/") else (b"", block)


def record_id(page_id: object, digest_hex: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'urn:page:{page_id}:{digest_hex}')}>"


def warc_record(arc: ArcRecord, page_id: int | None, refers_to: int | None = None) -> bytes:
    """The WARC record of an ARC document, a revisit without its payload if `refers_to` is given."""
    head, payload = split_http(arc.block)
    digest = hashlib.sha1(payload)
    block = arc.block if refers_to is None else head
    d = arc.date.ljust(14, "0")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest.hexdigest()),
        "WARC-Target-URI": arc.url,
        "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "WARC-IP-Address": arc.ip,
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(digest.digest()).decode()}",
        "Content-Type": "application/http;msgtype=response" if head else arc.content_type,
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        fields["WARC-Page-ID"] = str(page_id)
    if refers_to is not None:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to, digest.hexdigest()), "WARC-Refers-To-Page-ID": str(refers_to)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record; ValueError if one is damaged."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("a WARC record is shorter than it declares")
        yield fields, block


def page_arc(url: str | None, page_id: int | None, html: bytes) -> ArcRecord:
    """A page as a document of an ARC file; white space in a URL is percent-encoded, a null URL becomes a name."""
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else f"urn:page:{page_id}"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    return ArcRecord(url, "0.0.0.0", ARC_DATE, "text/html", head + html)


def write_archives(pages: DataFrame, path: str, version_of=lambda page_id: 1 + (page_id or 0) % 2) -> None:
    """Write WARC files of all rows of `pages` (page_id, url, html), each made from an ARC archive of the row's batch. Revisits are
    found by ids and digests alone, and joined to the pages by both, so no payload is dealt out by a digest that many share."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.select("*", F.sha1("html").alias("digest"), F.col("page_id").isNull().alias("lost"), F.coalesce("page_id", F.lit(0)).alias("page"))
    large = stored(rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest", "page_id", "lost", "page").agg(F.count(F.lit(1)).alias("n")), "payloads")
    groups = stored(large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.sum("n").alias("n")).where("n > 1").drop("n"), "groups")
    revisits = stored(large.join(groups, "digest").where("lost or page_id < refers_to").select("page", "lost", "digest", "refers_to"), "revisits")
    rows = rows.join(revisits, ["page", "lost", "digest"], "left").select("page_id", "url", "html", "refers_to")
    small_batches(pages.sparkSession)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, filled = 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256).to_pylist()
                out, files = [], []
                for version in (1, 2):
                    mine = [r for r in batch if version_of(r["page_id"]) == version]
                    archive = arc_archive((page_arc(r["url"], r["page_id"], r["html"]) for r in mine), version)
                    for r, arc in zip(mine, arc_records(io.BytesIO(archive)), strict=True):
                        out.append(warc_record(arc, r["page_id"], r["refers_to"])[:-2])  # the writer ends it
                        if filled and filled + len(out[-1]) > FILE_BYTES:
                            file, filled = file + 1, 0
                        filled += len(out[-1])
                        files.append(file)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(files, pa.int32())], ["value", "file"])

    rows.mapInArrow(convert, "value string, file int").write.partitionBy("file").option("lineSep", "\r\n").text(path, compression="gzip")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of each record.
    Payloads are held against their digests."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(value: str | None) -> int | None:
        return None if value is None else int(value)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for fields, block in warc_records(gzip.open(io.BytesIO(data.as_py()))):
                    head, payload = split_http(block)
                    kind, digest = fields["warc-type"], base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't match its digest")
                    size = len(payload) if kind == "response" else int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    rows.append((number(fields.get("warc-page-id")), fields.get("warc-target-uri"), payload if kind == "response" else None, size, digest, kind, number(fields.get("warc-refers-to-page-id"))))
                    held += len(block)
                    if len(rows) == 500 or held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow)

    small_batches(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(read, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages as WARC files in the shared folder and return what reading them back finds, without the payloads.

    Of pages with equal payloads of REVISIT_BYTES or more, that with the largest page_id is a response and the others revisit
    it; rows that repeat that page_id too are responses. Null html is an empty payload, a null page_id stays null and never
    is the response of others. An empty table gives no rows. Columns other than page_id, url and html aren't read.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).drop("payload", "url")
