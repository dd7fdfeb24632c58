"""WARC archives: writer with revisit records, and a salvaging reader.

Writing. Of records with equal payloads (SHA-256) of at least ``min_revisit_bytes``,
the one with the smallest id is a ``response`` and the others are ``revisit`` records
that name it; smaller payloads are all ``response``. The first of each payload is a
map-side combined ``min`` per digest, joined back on the digest (a hot payload is
split by the skew join; payloads too small to be shared get a key of their own,
so they spread). Records are written by Spark's text sink, so many in a file that it has
at most about ``FILE_BYTES`` before compression (a larger record is a file of its own): pages are
written by size, each of ``SIZES`` with its own number of records in a file, so the reader's memory has a
bound. The sink writes strings and does not look into them: compressed bytes pass it as strings made
of them (a test holds it to that). With ``gzip`` (the default) each record is
a member of its own, compressed in the tasks; the sink wants a line separator, and an
empty member serves. File names end in ``.txt``, as the sink does not compress. Otherwise
the record separator is the line separator, and the codec is the sink's.

Reading. Each file is scanned from its start. A record holds if its version line,
headers, ``Content-Length``, closing separator and payload digest check out. After a
failed check the reader logs a quarantined gap, searches for the next gzip
member (compressed files) or version line, and goes on with the first one that
holds; so a torn or overwritten stretch costs its own records only. Of a damaged member
all that comes out before the damaged byte is looked through; in an archive of others
with many records in a member, those behind the damage in their member are lost. Gaps carry file,
stream, offset and length: they count in the decompressed bytes of the stream at
``member`` or, where a member does not decompress, in the file's own bytes.

Defined results: a NULL payload is empty; a NULL uri reads ''; a NULL id is written
as empty and read back as NULL (with an equal payload of a known id it is a revisit);
repeated rows with one id and payload are all the response; an empty table gives no
records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure

MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 4096
FILE_BYTES = 256 << 20
# Payload sizes up to which so many records go into a file: FILE_BYTES divided by them.
SIZES = (64 << 10, 1 << 20, 16 << 20)
SEPARATOR = "\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_EMPTY_MEMBER = _MEMBER + bytes(6) + b"\xff\x03" + bytes(9)

RECORD = (
    "file string, member long, offset long, length long, kind string, record_type string, id long, uri string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def records(pages: DataFrame, *, id: str = "page_id", uri: str = "url", payload: str = "html",  # noqa: A002
            min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: the WARC record of each row, without its closing separator."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(uri), F.lit("")).alias("uri"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("n", F.octet_length("body").cast("long"))
    large = F.col("n") >= min_revisit_bytes
    first = (
        rows.where(large).groupBy("digest").agg(F.min("id").alias("first")).select(F.col("digest").alias("shared"), "first")
    )
    keyed = rows.withColumn(
        "share", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("-"), "digest"))
    )
    known = keyed.join(first, F.col("share") == F.col("shared"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(SEPARATOR))
    block = F.when(revisit, http).otherwise(F.concat(http, "body"))
    safe_uri = F.regexp_replace("uri", r"[\x00-\x20\x7f]", "%20")
    return known.select(
        F.concat(
            line("WARC/1.1"),
            line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID: ", name(F.col("id"))),
            line("WARC-Date: ", date),
            line("WARC-Target-URI: ", safe_uri),
            line("WARC-Payload-Digest: sha256:", F.col("digest")),
            F.when(
                revisit,
                F.concat(
                    line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    line("WARC-Refers-To: ", name(F.col("first"))),
                ),
            ).otherwise(F.lit("")),
            line("Content-Type: application/http; msgtype=response"),
            line("Content-Length: ", F.octet_length(block).cast("string")),
            F.lit("\r\n"), block,
        ).alias("value"), "n"
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record, closed, as a gzip member."""
    for batch in batches:
        out = []
        for value in batch.column("value"):
            engine = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.append(engine.compress(value.as_buffer()) + engine.compress(SEPARATOR.encode()) + engine.flush())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write(pages: DataFrame, folder: str, *, records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip", payload: str = "html", **options) -> None:
    """Archive ``pages`` into ``folder`` (on shared storage)."""
    if compression == "gzip":
        configure(pages.sparkSession)
    largest = pages.agg(F.coalesce(F.max(F.octet_length(F.col(payload).cast("string"))), F.lit(0))).first()[0]
    rows = records(pages, payload=payload, **options)
    low = -1
    for high in (*SIZES, None):
        per_file = min(records_per_file, max(1, FILE_BYTES // (high or FILE_BYTES)))
        part = rows if low < 0 and (high is None or largest <= high) else rows.where((F.col("n") > low) & (F.col("n") <= (high or 2**62)))
        out = part.select("value")
        if compression == "gzip":
            out = out.mapInArrow(_members, "value binary").select(F.col("value").cast("string"))
            sink = out.write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("compression", "none")
        else:
            sink = out.write.option("lineSep", SEPARATOR).option("compression", compression)
        sink.mode("append" if low >= 0 else "errorifexists").option("maxRecordsPerFile", per_file).text(folder)
        if high is None or largest <= high:
            break
        low = high


def _int(text: bytes | None) -> int | None:
    return int(text) if text and re.fullmatch(rb"-?[0-9]{1,18}", text) else None


def _page(name: bytes | None) -> int | None:
    return _int(name[len(b"<urn:page:") : -1]) if name and name.startswith(b"<urn:page:") and name.endswith(b">") else None


def parse_record(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record that starts at ``at`` and its end, or None if any check fails."""
    version = _VERSION.match(data, at)
    head_end = data.find(b"\r\n\r\n", at) if version else -1
    if head_end < 0:
        return None
    fields: dict[bytes, bytes] = {}
    for row in data[version.end() : head_end].split(b"\r\n"):
        key, colon, value = row.partition(b":")
        if not colon or not key or key.strip() != key:
            return None
        fields[key.lower()] = value.strip()
    size = _int(fields.get(b"content-length"))
    kind = fields.get(b"warc-type")
    begin = head_end + 4
    if size is None or size < 0 or not kind or data[begin + size : begin + size + 4] != b"\r\n\r\n":
        return None
    block = data[begin : begin + size]
    payload, length = block, size
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        http_head, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            return None
        told = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", http_head)
        length = int(told.group(1)) if told else len(payload)
    digest = hashlib.sha256(payload).hexdigest().encode()
    declared = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha256:")
    if kind == b"revisit":
        digest = declared
    elif len(payload) != length or declared and re.fullmatch(rb"[0-9a-f]{64}", declared) and declared != digest:
        return None
    return {
        "record_type": kind.decode("latin-1"), "id": _page(fields.get(b"warc-record-id")),
        "uri": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
        "refers_to": _page(fields.get(b"warc-refers-to")), "payload_bytes": length,
        "payload_digest": digest.decode("latin-1"), "payload": None if kind == b"revisit" else payload,
    }, begin + size + 4


def _salvage_stream(data: bytes, member: int) -> Iterator[dict]:
    """Records and gaps of one decompressed stream."""
    at = gap = 0
    while at < len(data):
        found = parse_record(data, at)
        if found:
            if at > gap:
                yield {"kind": "gap", "member": member, "offset": gap, "length": at - gap}
            record, end = found
            yield {"kind": "record", "member": member, "offset": at, "length": end - at, **record}
            at = gap = end
        else:
            nxt = _VERSION.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
    if at > gap:
        yield {"kind": "gap", "member": member, "offset": gap, "length": at - gap}


def _inflate(data: bytes, start: int) -> tuple[bytes, int | None]:
    """What comes out of the member at ``start`` before any damaged byte, and the member's end if it is whole."""
    engine, out, pos, step = zlib.decompressobj(31), [], start, 4096
    try:
        while pos < len(data) and not engine.eof:
            out.append(engine.decompress(data[pos : pos + step]))
            pos, step = min(pos + step, len(data)), min(2 * step, 65536)
    except zlib.error:
        # the failing call gave nothing: up to it once more, then by single bytes
        engine = zlib.decompressobj(31)
        for k in range(start, pos, 65536):
            engine.decompress(data[k : min(k + 65536, pos)])
        try:
            for k in range(pos, min(pos + step, len(data))):
                out.append(engine.decompress(data[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(out), None
    return b"".join(out), pos - len(engine.unused_data) if engine.eof else None


def salvage(data: bytes) -> Iterator[dict]:
    """Records and quarantined gaps of an archive file, compressed (any number of members) or not."""
    if not data.startswith(_MEMBER) and _VERSION.search(data):
        yield from _salvage_stream(data, 0)
        return
    at = gap = 0
    while at < len(data):
        start = data.find(_MEMBER, at)
        if start < 0:
            break
        text, end = _inflate(data, start)
        whole = end is not None
        if not text and not whole:
            at = start + 1
            continue
        if start > gap:
            yield {"kind": "gap", "member": gap, "offset": 0, "length": start - gap}
        yield from _salvage_stream(text, start)
        if whole:
            at = gap = end
        else:
            nxt = data.find(_MEMBER, start + 1)
            at = nxt if nxt >= 0 else len(data)
            gap = at
            yield {"kind": "gap", "member": start, "offset": len(text), "length": at - start}
    if gap < len(data):
        yield {"kind": "gap", "member": gap, "offset": 0, "length": len(data) - gap}


def read(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """Rows of `RECORD`: ``kind`` is ``record`` or ``gap``; ``payload`` is NULL for revisits and without ``payloads``."""
    configure(spark)
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    names = [f.split()[0] for f in RECORD.split(", ")]
    schema = spark.createDataFrame([], RECORD).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"file": pa.string(), "kind": pa.string(), "record_type": pa.string(), "uri": pa.string(), "payload_digest": pa.string(), "payload": pa.binary()}
        arrow = pa.schema([(n, types.get(n, pa.int64())) for n in names])
        for batch in batches:
            for i in range(batch.num_rows):
                file, rows, size = batch.column("path")[i].as_py(), [], 0
                for row in salvage(batch.column("content")[i].as_py()):
                    size += row.get("payload_bytes") or 0
                    rows.append({"file": file, **row, **({} if payloads else {"payload": None})})
                    if len(rows) == 1024 or payloads and size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.mapInArrow(run, schema)
