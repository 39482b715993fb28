"""WARC files: a writer with revisit records, and a reader that salvages what it can.

The reader checks every member and record: the gzip checksum, the version line, the content length, the block digest. Where a
check fails it looks for the next gzip member (or, in plain files, the next version line) that passes, goes on from there, and
reports the bytes between as a quarantined gap with the reason. A gzip member may hold several records: they are read like those
of a plain file.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shards
from .common import batch, bounded, cut, tidied

#: Payloads shorter than this are never revisits.
LEAST_SHARED = 1000
#: A file is closed once it has this many bytes.
FILE_BYTES = 16 << 20
#: Bytes in which a record's headers must end.
HEADER_BYTES = 1 << 20

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"


def _value(x: object) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(x))


def _record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", _value(uri)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", _PROFILE)]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Bad(ValueError):
    """A failed check."""


def _parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """The record at `at`: headers (lower case), block, end."""
    if not re.compile(rb"WARC/1\.\d\r\n").match(data, at):
        raise Bad("no version line")
    end = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    if end < 0:
        raise Bad("headers don't end")
    head = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", data[at:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("bad header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise Bad("no content length")
    start, stop = end + 4, end + 4 + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Bad("content length doesn't fit")
    block = data[start:stop]
    digest = head.get("warc-block-digest", "")
    if digest.startswith("sha1:") and len(digest) == 45 and digest[5:] != hashlib.sha1(block).hexdigest():
        raise Bad("block digest differs")
    return head, block, stop + 4


def _inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """The gzip member at `at` and where it ends, fed in steps so that a member never costs the rest of the file."""
    d, out, pos = zlib.decompressobj(31), [], at
    try:
        while not d.eof and pos < len(data):
            out.append(d.decompress(data[pos : pos + step]))
            pos += step
    except zlib.error as e:
        raise Bad(f"gzip: {e}") from None
    if not d.eof:
        raise Bad("gzip: member is cut off")
    return b"".join(out), min(pos, len(data)) - len(d.unused_data)


def _walk(data: bytes, mark: bytes, read) -> Iterator[tuple]:
    """(start, end, what read gives) of every unit that read passes, and (start, end, reason) of what lies between: after a failed check the next mark is tried."""
    at, bad_at, why = 0, -1, ""
    while at < len(data):
        try:
            got, end = read(data, at)
        except Bad as e:
            if bad_at < 0:
                bad_at, why = at, str(e)
            nxt = data.find(mark, at + 1)
            at = len(data) if nxt < 0 else nxt
            continue
        if bad_at >= 0:
            yield bad_at, at, why
            bad_at = -1
        yield at, end, got
        at = end
    if bad_at >= 0:
        yield bad_at, len(data), why


def _read_record(data: bytes, at: int) -> tuple[tuple[dict, bytes], int]:
    head, block, end = _parse(data, at)
    return (head, block), end


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", offset, length, headers, block) of every sound record and ("gap", offset, length, reason, None) of what lies between.

    No bytes, no rows. Offsets and lengths are those of the file: in gzip files, of the member that a record or gap is in; a gap
    within a member says where in the reason.
    """
    if not (data[:2] == b"\x1f\x8b" or (data.find(b"\x1f\x8b\x08") >= 0 and data.find(b"WARC/1.") < 0)):
        for a, b, got in _walk(data, b"WARC/1.", _read_record):
            yield ("gap", a, b - a, got, None) if isinstance(got, str) else ("record", a, b - a, *got)
        return
    for a, b, member in _walk(data, b"\x1f\x8b\x08", _inflate):
        if isinstance(member, str):
            yield "gap", a, b - a, member, None
            continue
        for i, j, got in _walk(member, b"WARC/1.", _read_record):
            if isinstance(got, str):
                yield "gap", a, b - a, f"{got} (bytes {i} to {j} of the member's {len(member)})", None
            else:
                yield "record", a, b - a, *got


def split_http(block: bytes) -> tuple[dict, bytes]:
    """HTTP headers (lower case) and payload of a response block; a block without HTTP headers is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    return {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}, payload


_FILES = "path string, records long, bytes long"


def write_warc(pages: DataFrame, folder: str, least: int = LEAST_SHARED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one record a row into gzip WARC files under folder; returns one row per file: path, records, bytes.

    Null html is an empty payload, a null url an empty one. Of equal payloads of at least `least` bytes, rows with the largest
    id are responses (of repeated rows all), the others revisit that id; rows without id can only revisit.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = bounded(pages).select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"), F.encode(body, "utf-8").alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    shared = rows.filter("key is not null").groupBy("key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # small payloads go round the join. The groups' files' size tells Spark whether to broadcast them; else hot payloads are split as the plan runs
    found = rows.filter("key is not null").join(cut(shared.select("key", "first"), "payloads"), "key", "left")
    found = found.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    rows = found.unionByName(rows.filter("key is null").select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, size, n = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush():
            nonlocal count, held, size, n
            done = batch([(shards.put(folder, f"pages-{part:06d}-{count:05d}-{{}}.warc.gz", b"".join(held)), n, size)], _FILES)
            count, held, size, n = count + 1, [], 0, 0
            return done

        for b in batches:
            for page_id, url, payload, ref in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("payload"), b.column("refers_to").to_pylist()):
                payload = payload.as_py()
                name = "urn:x-page:" + ("none" if page_id is None else str(page_id))
                made = gzip_member(_record("response" if ref is None else "revisit", name, url, payload, hashlib.sha1(payload).hexdigest(), None if ref is None else f"urn:x-page:{ref}"))
                held.append(made)
                size, n = size + len(made), n + 1
                if size >= FILE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(tidied(run), _FILES)


_RECORDS = "path string, offset long, length long, gap string, record_type string, record_id string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all WARC files under path. A gap has its reason in `gap` and nulls after it.

    payload_bytes and payload_digest are those of the whole payload; revisits have them from their headers and no payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content")):
                out = []
                for kind, at, size, head, block in salvage(data.as_buffer().to_pybytes()):
                    if kind == "gap":
                        out.append((name, at, size, head, *[None] * 7))
                        continue
                    record = head.get("warc-type")
                    http, payload = split_http(block)
                    if record == "revisit":
                        digest, n, payload = head.get("warc-payload-digest", "").removeprefix("sha1:").lower(), int(http.get("content-length", "0")), b""
                    else:
                        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
                    ids = [x.strip("<>") if x else None for x in (head.get("warc-record-id"), head.get("warc-refers-to"))]
                    out.append((name, at, size, None, record, ids[0], head.get("warc-target-uri"), ids[1], n, digest, payload if payloads else None))
                    if len(out) >= 1000:
                        yield batch(out, _RECORDS)
                        out = []
                if out:
                    yield batch(out, _RECORDS)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(path).select("path", "content").mapInArrow(tidied(run), _RECORDS)


def round_trip(pages: DataFrame, least: int = LEAST_SHARED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages as WARC files in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Files that other attempts of a task left behind don't count. A gap in the files raises. For nulls see write_warc.
    """
    spark = pages.sparkSession
    folder = shards.new_folder(spark, "warc")
    files = cut(write_warc(pages, folder, least, id_col, url_col, html_col), "warcs")
    name = F.element_at(F.split("path", "/"), -1)
    found = read_warc(spark, folder, payloads=False).withColumn("file", name).join(files.select(name.alias("file")), "file", "left_semi")
    number = lambda c: F.expr(f"nullif(regexp_extract({c}, '^urn:x-page:(-?[0-9]+)$', 1), '')").cast("long")
    gap = F.raise_error(F.concat(F.lit("gap in "), "path", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "gap")).cast("long")
    return found.select(F.when(F.col("gap").isNotNull(), gap).otherwise(number("record_id")).alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
