"""WARC archives: a writer of gzip members and a salvage reader.

Writing: pages of equal payloads (``least`` bytes at least) are one response, that of the smallest
page_id, and revisits that refer to it. Records are gzip members of their own, written by Spark's text
sink through the Hadoop file system: its rows are members without their last byte, a zero (the top byte
of a member's length; a larger member is followed by an empty one), and zero is its line separator.

Reading: a file is taken member by member (or, uncompressed, record by record). Where a check fails - the
member's checksum, the version line, lengths, the payload's digest - the reader searches the bytes behind
for the next ``1f 8b 08`` or version line from which a whole record passes the checks, goes on from there
and logs the gap of bytes as quarantined. Every candidate place is tried once. A member that ends badly, or
holds a bad record, is salvaged record by record from what it unpacks to; the gap is then logged with the
place and length of the member, like its records.

Records of any type and of other writers are read: ``X-Payload-Length`` is optional, block and payload digests
are checked where they are sha256 or sha1 (in hex or base32; other ones are returned unchecked), except a
segment's payload digest, which is that of the whole. Digests other than sha256 in hex keep their prefix.

Edge cases: a null or empty html is an empty payload; null urls and ids are left out of the record's
header and come back null; repeated rows are records of their own (rows that share the smallest page_id
are all responses); extra columns are ignored; an empty table writes no record and reads none.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VERSION = b"WARC/1.1"
#: Bytes that are unpacked at once.
SLICE = 16 << 10
#: An empty gzip member; it ends with a zero.
EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
SCHEMA = "file string, offset long, length long, kind string, reason string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


# ---------------------------------------------------------------- writing


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, kind: str) -> bytes:
    """One WARC record. A revisit holds no payload; its header tells the payload's digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    head = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Length: %d" % size]
    if page_id is not None:
        head.append(b"WARC-Record-ID: <urn:page:%d>" % page_id)
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.encode().replace(b"%", b"%25").replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 4) -> bytes:
    """A gzip member that ends with a zero byte."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(raw) + packer.flush()
    return out if out[-1] == 0 else out + EMPTY


def typed(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to of every page."""
    raw = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), raw.alias("html"), F.octet_length(raw).cast("long").alias("payload_bytes"), F.sha2(raw, 256).alias("payload_digest"))
    # only digests that more than one page has: partial sums first, then a settled table of checked size
    first = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "first")
    rows = common.join_checked(rows, common.settle(first, "payloads"), ["payload_digest"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, *, records_per_file: int = 20000, **columns) -> None:
    """Writes a record per row of pages to archives below path."""
    common.ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "html"):
            out = []
            for i, u, h, n, d, k, r in zip(*[block.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")], strict=True):
                out.append(member(record(i, u, h, d, n, r, k))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = typed(pages, **columns).mapInArrow(common.tidy(run), "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.options(lineSep="\0", compression="none", maxRecordsPerFile=records_per_file).text(path)


# ---------------------------------------------------------------- reading


class Bad(Exception):
    """A check that failed."""


def _parse(raw: bytes, at: int) -> tuple[dict, int]:
    """The record at a place of plain bytes, and its end."""
    if not START.match(raw, at) or raw[at : at + 4] != b"WARC":
        raise Bad("version line")
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        raise Bad("header end")
    head = {}
    for line in raw[at:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        head[name.strip().lower()] = value.strip()
    try:
        size, own = int(head[b"content-length"]), b"x-payload-length" in head
        full = int(head[b"x-payload-length"]) if own else None
    except (KeyError, ValueError):
        raise Bad("length") from None
    body, stop = end + 4, end + 4 + size
    if size < 0 or raw[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("record end")
    block = raw[body:stop]
    kind = head.get(b"warc-type", b"").decode("latin-1")
    if not kind:
        raise Bad("record type")
    payload = block
    if kind in ("response", "request", "revisit") and (own or head.get(b"content-type", b"application/http").lower().startswith(b"application/http")):
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4 :] if cut >= 0 else b""
    if b"warc-block-digest" in head:
        _check(head[b"warc-block-digest"], block, "block digest")
    digest = head.get(b"warc-payload-digest")
    if digest is not None:
        # a revisit's payload is elsewhere, and a segment's digest is that of all segments
        digest = _check(digest, None if kind == "revisit" or b"warc-segment-number" in head else payload, "payload digest")
    if kind == "revisit":
        payload = None
    elif full is None:
        full = len(payload)
    elif len(payload) != full:
        raise Bad("payload digest")
    page = lambda k: int(m[1]) if (m := re.search(rb"<urn:page:(-?\d+)>", head.get(k, b""))) else None
    url = head.get(b"warc-target-uri")
    if url is not None:
        # only this writer escapes
        url = (url.replace(b"%0D", b"\r").replace(b"%0A", b"\n").replace(b"%25", b"%") if own else url).decode("utf-8", "replace")
    return {"page_id": page(b"warc-record-id"), "url": url, "record_type": kind, "payload_bytes": full, "payload_digest": digest, "refers_to": page(b"warc-refers-to"), "payload": payload}, stop + 4


def _check(digest: bytes, data: bytes | None, what: str) -> str:
    """The digest as it is returned, once it is that of data (where there are data and the algorithm is known)."""
    text = digest.decode("latin-1")
    name, _, value = text.rpartition(":")
    name = name.lower().replace("-", "") or "sha256"
    if name not in ("sha256", "sha1"):
        return text
    size = 32 if name == "sha256" else 20
    try:
        want = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except (ValueError, binascii.Error):
        raise Bad(what) from None
    if len(want) != size or (data is not None and hashlib.new(name, data).digest() != want):
        raise Bad(what)
    return value if name == "sha256" and len(value) == 64 else text


def _unpacked(data: bytes, at: int) -> tuple[bytes, int]:
    """What a damaged member unpacks to, and where that ends."""
    opener, out = zlib.decompressobj(31), []
    while at < len(data) and not opener.eof:
        before, part = opener.copy(), data[at : at + 4096]
        try:
            out.append(opener.decompress(part))
            at += len(part) - len(opener.unused_data)
        except zlib.error:
            try:
                for k in range(len(part)):
                    out.append(before.decompress(part[k : k + 1]))
                    at += 1
            except zlib.error:
                pass
            break
    return b"".join(out), at


def _inside(raw: bytes) -> tuple[list[dict], str | None]:
    """The records in a member's bytes, wherever they begin, and the first failure."""
    place, found, reason = 0, [], None
    while place < len(raw):
        try:
            row, place = _parse(raw, place)
            found.append(row)
        except Bad as bad:
            reason = reason or str(bad)
            m = VERSION_LINE.search(raw, place + 1)
            place = m.start() if m else len(raw)
    return found, reason


def _at(data: bytes, at: int) -> tuple[list[dict], int, str | None]:
    """The records of the member or plain record at a place, the end of it, and what fails in it although it has records."""
    if data[at : at + 2] != b"\x1f\x8b":
        found, end = _parse(data, at)
        return [found], end, None
    # in slices: what stands behind a member is copied into unused_data, so that must stay short
    opener, out, end = zlib.decompressobj(31), [], at
    try:
        while end < len(data) and not opener.eof:
            part = data[end : end + SLICE]
            out.append(opener.decompress(part))
            end += len(part) - len(opener.unused_data)
        raw, bad = b"".join(out), None if opener.eof else "member cut short"
    except zlib.error:
        bad = "member"
    if bad:
        raw, end = _unpacked(data, at)
    found, reason = _inside(raw)
    if not found and (bad or reason):
        raise Bad(bad or reason)
    return found, end, bad or reason


def salvage(data: bytes) -> Iterator[dict]:
    """Records (kind ``record``) and quarantined gaps (kind ``gap``, with the reason of the first failure) of an archive's bytes."""
    at, n = 0, len(data)
    while at < n:
        if data[at] in b"\0\r\n" and not START.match(data, at):
            at += 1
            continue
        try:
            found, end, failed = _at(data, at)
        except Bad as first:
            start, reason, end, found, failed = at, str(first), n, [], None
            for m in START.finditer(data, at + 1):
                try:
                    found, end, failed = _at(data, m.start())
                except Bad:
                    continue
                at = m.start()
                break
            else:
                at = n
            yield {"kind": "gap", "offset": start, "length": at - start, "reason": reason}
        for row in found:
            yield row | {"kind": "record", "offset": at, "length": end - at}
        if failed:
            yield {"kind": "gap", "offset": at, "length": end - at, "reason": failed}
        at = max(end, at)


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below path. A file is read whole; the writer bounds its records."""
    common.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], k) for c, k in zip(_NAMES, kinds, strict=True)], names=_NAMES)

        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                file = batch.column(0)[k].as_py()
                for row in salvage(batch.column(1)[k].as_py()):
                    row["file"] = file
                    if payload:
                        held += len(row.get("payload") or b"")
                    else:
                        row["payload"] = None
                    rows.append(row)
                    if len(rows) >= 4096 or held > common.BLOCK_BYTES:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(common.tidy(run), SCHEMA)


def op1_warc_salvage(spark, sf_dir: str) -> DataFrame:
    """Writes archives of all pages to the shared folder and reads them back; gaps, if any, show as rows with a null page_id and their reason."""
    path = common.settled_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    got = read_warc(spark, path, payload=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
