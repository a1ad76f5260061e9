"""WARC archives: writing with segmentation, and reading with reassembly.

Writer: a page becomes a response record whose block is an HTTP message in
chunked transfer coding, or a revisit record that names an equal payload.  Blocks
longer than ``SEGMENT`` bytes go on in continuation records.  The files are
written by Spark's text writer, whose line separator is the end of a record.

Reader: files are parsed record by record.  Continuation records and their
origins are grouped by origin identifier, ordered by segment number and joined;
the total length is verified, then the chunked framing is decoded.  Records that
are whole go straight to decoding.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from siftbase.llm.common import broadcast_hot, split_by_ids
from siftbase.llm.registry import query, table
from siftbase.session import shared_dir, written

#: Bytes of a block in one record, bytes of an HTTP chunk, records of a file.
SEGMENT, CHUNK, FILE_RECORDS = 16 << 10, 4 << 10, 2000

#: Payloads from this size on are written once.
MIN_REVISIT = 1000

END = "\r\n\r\n"

_DATE = "2024-01-01T00:00:00Z"


def _pieces(data: bytes, size: int):
    """``data`` in pieces of at most ``size`` bytes, none of which ends within a UTF-8 character."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and end > start + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[start:end]
        start = end


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer coding of a payload."""
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in _pieces(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; extensions and trailers are skipped, a broken frame is an error."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:line].split(b";")[0].strip() or b"x", 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length than told")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without its end."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _header_value(text: str) -> str:
    return "".join(c if c > " " else "%%%02X" % ord(c) for c in text)


def records_of(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> list[bytes]:
    """The records of one page: a response with its continuations, or a revisit."""
    name = f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"
    told = base64.b32encode(bytes.fromhex(digest)).decode()
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", _header_value(url or f"urn:x-page:{page_id}")), ("WARC-Payload-Digest", f"sha1:{told}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        common.append(("X-Page-Id", str(page_id)))
    if record_type == "revisit":
        extra = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{'' if refers_to is None else refers_to}:{digest}>")]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *common, *extra], b"")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http; msgtype=response")]
    parts = list(_pieces(block, SEGMENT))
    if len(parts) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _DATE), ("WARC-Target-URI", common[1][1]), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(n))]
        if n == len(parts):
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(headers, part))
    return out


def revisits(pages: DataFrame) -> DataFrame:
    """Add ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` to (page_id, url, html).

    Of equal payloads of at least MIN_REVISIT bytes the row with the largest
    page_id is the response (one of them, if rows repeat), the others revisit it.
    Only pages whose digest may repeat are shuffled.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    large = known.where(F.col("payload_bytes") >= MIN_REVISIT)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
    groups = written(groups, "payloads")
    maybe, certain = split_by_ids(known, groups.select("payload_digest"), "payload_digest")
    met = broadcast_hot(maybe.where(F.col("payload_bytes") >= MIN_REVISIT), groups, "payload_digest", "_n", pages.count(), "left")
    nth = F.row_number().over(Window.partitionBy("payload_digest", "page_id").orderBy("url"))
    again = F.col("_n").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("_keep")) & (F.col("_nth") == 1))
    told = met.withColumn("_nth", nth).withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("_keep")))
    columns = [*known.columns, "record_type", "refers_to"]
    single = certain.unionByName(maybe.where(F.col("payload_bytes") < MIN_REVISIT)).withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("bigint"))
    return single.select(*columns).unionByName(told.select(*columns))


def _written_records(batches):
    for batch in batches:
        out, size = [], 0
        for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "payload_digest", "record_type", "refers_to")), strict=True):
            page_id, url, html, digest, kind, refers_to = (x.as_py() for x in row)
            new = records_of(page_id, url, (html or "").encode(), digest, kind, refers_to)
            out, size = out + new, size + sum(map(len, new))
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Write gzip WARC files of at most FILE_RECORDS records, which hold at most SEGMENT bytes of block each."""
    records = revisits(pages).mapInArrow(_written_records, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


_FIELDS = {
    "warc-type": "type", "warc-record-id": "record_id", "warc-segment-number": "segment", "warc-segment-origin-id": "origin", "warc-segment-total-length": "total",
    "warc-payload-digest": "digest", "warc-refers-to": "refers_to", "x-page-id": "page_id", "x-payload-length": "told_bytes", "warc-target-uri": "uri",
}
_RECORD = "type string, record_id string, segment string, origin string, total string, digest string, refers_to string, page_id string, told_bytes string, uri string, block binary"


def parsed(stream):
    """Records of a WARC stream: (header fields in lower case, block)."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        headers, last = {}, None
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and last:
                headers[last] += " " + line.strip().decode()
                continue
            name, _, value = line.decode().partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends before its length")
        yield headers, block


def _parsed_files(batches):
    names = list(_FIELDS.values())

    def packed(rows):
        return pa.RecordBatch.from_arrays([*[pa.array([r[0].get(k) for r in rows], pa.string()) for k in _FIELDS], pa.array([r[1] for r in rows], pa.binary())], names=[*names, "block"])

    for batch in batches:
        for content in batch.column("content"):
            raw = content.as_py()
            stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
            rows, size = [], 0
            for row in parsed(stream):
                rows.append(row)
                size += len(row[1]) + 500
                if size > 4 << 20:
                    yield packed(rows)
                    rows, size = [], 0
            yield packed(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``, as it stands there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_parsed_files, _RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: ``type``, ``record_id``, ``digest``, ``refers_to``, ``page_id``, ``told_bytes``, ``uri``, ``blocks`` in order, ``complete``.

    A segmented record is complete if its segments are numbered 1 to n without a
    gap and their lengths sum to the total that the last one tells.  A group holds
    the segments of one record; a segment that was read twice counts once.
    """
    whole = records.where("segment IS NULL")
    first = ["type", "record_id", "digest", "refers_to", "page_id", "told_bytes", "uri"]
    single = whole.select(*first, F.array("block").alias("blocks"), F.lit(True).alias("complete"))
    parts = records.where("segment IS NOT NULL").withColumn("segment", F.col("segment").cast("int")).withColumn("_origin", F.coalesce("origin", "record_id"))
    head = F.max(F.when(F.col("segment") == 1, F.struct(*first))).alias("_head")
    grouped = parts.groupBy("_origin").agg(head, F.sort_array(F.array_distinct(F.collect_list(F.struct("segment", "block")))).alias("_parts"), F.max(F.col("total").cast("bigint")).alias("_total"))
    numbers = F.transform("_parts", lambda p: p["segment"])
    length = F.aggregate("_parts", F.lit(0).cast("bigint"), lambda s, p: s + F.octet_length(p["block"]))
    complete = (numbers == F.sequence(F.lit(1), F.size("_parts"))) & (length == F.col("_total")) & F.col("_head").isNotNull()
    joined = grouped.select("_head.*", F.transform("_parts", lambda p: p["block"]).alias("blocks"), F.coalesce(complete, F.lit(False)).alias("complete"))
    return single.unionByName(joined)


def _decoded(batches):
    columns = ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "error"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            page_id = int(r["page_id"]) if r["page_id"] else None
            digest = base64.b32decode(r["digest"].removeprefix("sha1:")).hex() if r["digest"] else None
            if r["type"] == "revisit":
                target = (r["refers_to"] or "").removeprefix("<urn:x-page:").split(":")[0]
                rows.append((page_id, None, int(r["told_bytes"]), digest, "revisit", int(target) if target else None, r["uri"], None))
                continue
            try:
                if not r["complete"]:
                    raise ValueError("segments are missing or of another total length")
                head, _, body = b"".join(r["blocks"]).partition(b"\r\n\r\n")
                payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                found = hashlib.sha1(payload).hexdigest()
                if digest is not None and found != digest:
                    raise ValueError("payload of another digest than told")
                rows.append((page_id, payload, len(payload), found, "response", None, r["uri"], None))
            except ValueError as e:
                rows.append((page_id, None, None, digest, r["type"], None, r["uri"], str(e)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=columns)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives: id, payload (null for a revisit), its length and SHA-1, type, what it revisits, URI, and an error if it is damaged."""
    schema = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, error string"
    return reassembled(read_records(spark, path)).mapInArrow(_decoded, schema)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back.

    A null html is an empty payload, repeated rows are records of their own, a
    null page_id stays null, and an empty table gives archives without a record.
    """
    path = f"{shared_dir(pages.sparkSession)}/siftbase/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, payload_bytes >= {MIN_REVISIT} AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC) > 1 AS again, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keep END AS refers_to FROM r
"""


@query("op7_warc", _SQL)
def op7_warc(spark, sf_dir):
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
