"""WARC archives: pages written as records with revisits and segments, and read back by reassembling them.

Writing: of pages with equal payloads the one with the largest page_id is a ``response``; the others are ``revisit``
records that refer to it (payloads shorter than ``min_revisit`` bytes are always responses).  A response's block is an
HTTP message in chunked transfer framing.  Blocks longer than ``segment_bytes`` go into a first record with segment
number 1 and ``continuation`` records with the numbers that follow, which name their origin; the last one states the
total length.  Every record is a gzip member of its own.

Reading: files yield records.  A record without a segment number is judged where it is read; segments of one origin are
brought together, ordered by segment number, checked for gaps and for the total length, joined.  The HTTP message is parsed, its
chunked framing decoded, and the payload's digest compared.  Archives of other writers are read as well, compressed by
record, as a whole or not at all: fields that they lack are null (the length of a revisit that states none, too).

Rows: null html is an empty payload.  A null page_id is less than any other; a group of null ids only is all responses.
Rows that share the largest page_id and the payload are all responses.  An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.files import read_range, write_file
from gristmill.operators.skew import lookup
from gristmill.storage import materialize, remove, scratch_path

SEGMENT_BYTES = 32_768
#: pages that refer to others, of some 80 bytes each, which are sent to all tasks; more are joined
FEW_REFS = 100_000
#: what the query writes: pages have some 3 KB
QUERY_SEGMENT = 2048
CHUNK_BYTES = 4096
FILE_BYTES = 32_000_000
FEED_BYTES = 16_384
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


# --- records --------------------------------------------------------------------------------------------------------


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def chunked(data: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (data[i : i + size] for i in range(0, len(data), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """Decodes chunked framing: hexadecimal sizes, optional extensions, a last chunk of size 0 and trailers."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(data) or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(data[at : at + size])
        at += size + 2


def page_records(page_id: int | None, url: str, payload: bytes, refers_to: int | None, segment_bytes: int) -> Iterator[bytes]:
    digest, name = base32_sha1(payload), f"<urn:uuid:{uuid.uuid4()}>"
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", " ".join((url or "about:blank").split())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else str(page_id))]
    if refers_to is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to)), ("Content-Type", "application/http;msgtype=response"), *common], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = range(0, len(block), segment_bytes)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("Content-Type", "application/http;msgtype=response"), *common]
    yield record(first + ([("WARC-Segment-Number", "1")] if len(cuts) > 1 else []), block[:segment_bytes])
    for n, at in enumerate(cuts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(cuts) else []
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", common[1][1]), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(n)), *total], block[at : at + segment_bytes])


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, decompressed; one that isn't compressed comes as it is.

    Input is fed in small slices, as what a member leaves over is copied: the time stays linear in the file's size.
    """
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            part = view[at : at + FEED_BYTES]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        if not z.eof:
            raise ValueError("a gzip member ends early")
        yield b"".join(out)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive."""
    for raw in members(data):
        stream = io.BytesIO(raw)
        while start := stream.readline():
            if not start.strip():
                continue
            if not start.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            headers, last = {}, None
            while (line := stream.readline()).strip():
                if line[:1] in b" \t" and last:  # a folded header goes on
                    headers[last] += " " + line.decode("utf-8", "replace").strip()
                    continue
                k, _, v = line.decode("utf-8", "replace").partition(":")
                last = k.strip().lower()
                headers[last] = v.strip()
            if not line:
                raise ValueError("a record's headers end early")
            size = _number(headers.get("content-length"))
            block = stream.read() if size is None else stream.read(size)
            if size is not None and len(block) < size:
                raise ValueError("a record ends early")
            yield headers, block


def _number(text: str | None) -> int | None:
    """A decimal number of a header, null where there is none."""
    return int(text) if text and text.isascii() and text.isdigit() else None


# --- writing --------------------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) into archives below ``folder``; returns the stored manifest (path, size, n)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    # one row a payload that occurs again
    again = rows.where(F.length("payload") >= min_revisit).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("rep")).where("n > 1")
    again = materialize(again.select("sha", "rep"), "warc-again")
    # who refers to whom by digests alone, a payload of many pages in groups; then by page, which no payload makes hot
    refs = lookup(rows.select("page_id", "sha"), again, ["sha"], "page_id").where("page_id is null or page_id <> rep").distinct()
    refs = materialize(refs.select(F.col("page_id").alias("r_page"), F.col("sha").alias("r_sha"), "rep"), "warc-refs")
    few = refs.count() <= FEW_REFS  # then no payload is shuffled
    rows = rows.join(F.broadcast(refs) if few else refs, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("sha") == F.col("r_sha")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], b"software: gristmill\r\nformat: WARC File Format 1.1\r\n")

        def flush() -> pa.RecordBatch:
            nonlocal held, size, n
            path, data = f"{folder}/{uuid.uuid4().hex}.warc.gz", info + b"".join(held)
            write_file(path, data)
            row = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(data)], pa.int64()), pa.array([n], pa.int64())], ["path", "size", "n"])
            held, size, n = [], 0, 0
            return row

        for b in batches:
            for page, url, body, ref in zip(*(b.column(i) for i in range(4)), strict=True):
                for r in page_records(page.as_py(), url.as_py(), body.as_py(), ref.as_py(), segment_bytes):
                    held.append(r)
                    size += len(r)
                    n += 1
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return materialize(rows.select("page_id", "url", "payload", F.col("rep").alias("ref")).mapInArrow(write, "path string, size long, n long"), "warc-manifest")


# --- reading --------------------------------------------------------------------------------------------------------


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, status string"
_SEGMENT = [("origin", pa.string()), ("seg", pa.int64()), ("total", pa.int64()), ("kind", pa.string()), ("page", pa.string()), ("ref", pa.string()), ("digest", pa.string()), ("block", pa.binary())]
_JUDGED = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("status", pa.string())]


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def judge(status: str, first: dict, block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, status of a whole record."""
    head, _, body = block.partition(b"\r\n\r\n")
    digest, size = (first["digest"] or "").removeprefix("sha1:"), None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    if status == "ok" and first["kind"] == "revisit":
        size = _number(fields.get("content-length"))
    elif status == "ok":
        try:
            body = dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body
            size, found = len(body), base32_sha1(body)
            status, digest = ("ok" if not digest or found == digest else "wrong digest"), found
        except ValueError:
            status = "broken framing"
    return _page(first["page"]), size, digest, first["kind"], _page(first["ref"]), status


def _page(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.removeprefix("-").isdigit() else None


def fragments(manifest: DataFrame) -> DataFrame:
    """A row for each record or segment, stored: what RESULT names for whole records, else origin, seg, total, headers, block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, blank = (None,) * len(_SEGMENT), (None,) * len(_JUDGED)
        for b in batches:
            for r in b.to_pylist():
                rows, size = [], 0
                for h, block in records(read_range(r["path"], 0, r["size"])):
                    kind = h.get("warc-type")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    seg, info = _number(h.get("warc-segment-number")), {"kind": kind, "page": h.get("x-page-id"), "ref": h.get("x-refers-to-page"), "digest": h.get("warc-payload-digest")}
                    if seg is None and kind != "continuation":
                        rows.append((*none, *judge("ok", info, block)))
                        size += 200
                    else:
                        origin = h.get("warc-segment-origin-id") or h.get("warc-record-id")
                        rows.append((origin, seg, _number(h.get("warc-segment-total-length")), *info.values(), block, *blank))
                        size += 200 + len(block)
                    if size > 4_000_000:
                        yield _batch(rows, _SEGMENT + _JUDGED)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, _SEGMENT + _JUDGED)

    files = max(1, manifest.count())
    return materialize(manifest.select("path", "size").repartition(files).mapInArrow(read, "origin string, seg long, total long, kind string, page string, ref string, digest string, block binary, " + RESULT), "warc-fragments")


def assemble(segments: list[dict]) -> tuple[str, dict, bytes]:
    """status, the first record's fields, and the whole block."""
    segments = sorted(segments, key=lambda s: s["seg"] or 0)
    first = segments[0]
    if [s["seg"] for s in segments] != list(range(1, len(segments) + 1)) or segments[-1]["total"] is None:
        return "segment missing", first, b""
    block = b"".join(s["block"] for s in segments)
    return ("ok" if len(block) == segments[-1]["total"] else "wrong length"), first, block


def reassemble(parts: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, status of every response or revisit."""
    names = [n for n, _ in _JUDGED]
    grouped = parts.where("origin is not null").groupBy("origin").agg(F.collect_list(F.struct(*[n for n, _ in _SEGMENT[1:]])).alias("s"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 64):
                yield _batch([judge(*assemble(cell.as_py())) for cell in b.column(0).slice(i, 64)], _JUDGED)

    return parts.where("origin is null").select(*names).unionByName(grouped.select("s").mapInArrow(join, RESULT))


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of ``QUERY_SEGMENT`` bytes, so that most pages come in several records."""
    folder = scratch_path(spark, "warc")
    parts = fragments(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, segment_bytes=QUERY_SEGMENT))
    remove(spark, folder)  # read to the end; what follows works on the stored records
    return reassemble(parts)
