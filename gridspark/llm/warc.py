r"""WARC: archives of gzip members, one record each, and a splittable reader.

``write_archives`` turns page rows into records; of records with equal payloads one is a
response and the others revisit it.  Spark's own writer commits the files, so lost tasks are
simply run again on any shared store: it writes each record's bytes but the last, and the last
byte of a member, always ``\0`` (an empty member is added where it would not be), as the row's end.

``read_archives`` lists the files and cuts them into byte ranges.  A task searches its range for
the gzip magic, accepts a candidate when its headers decode as a WARC record and the member
ends at another member or at the file's end, and owns the records that start in its range,
reading past the range's end for the last one.

Defined results: a null html is an empty payload, a null url an empty target.  Rows with the
same largest id among equal payloads are all responses; a null id is written as an empty one,
read back as null, and is never the largest unless the group has no other.  Further columns are
ignored.  An empty table writes no record and reads back none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import urllib.parse
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm.common import fresh_path, query, settle, table

MIN_REVISIT_BYTES = 0  #: smaller payloads are always written whole
RANGE_BYTES = 8 << 20
RANGES_PER_TASK = 16
MAGIC = b"\x1f\x8b\x08"
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: urllib.parse.quote(m[0]), text)


def record(page_id, url, payload: bytes | None, n_bytes: int, sha1_hex: str, refers_to) -> bytes:
    """One gzip member; ``payload`` is None for a revisit."""
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (payload or b"")
    name = "" if page_id is None else urllib.parse.quote(str(page_id))
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {_header_value(url or '')}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{urllib.parse.quote(str(refers_to))}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def _members(batches):
    for batch in batches:
        held, size = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(record(*row)[:-1])
            size += len(held[-1])
            if size > BATCH_BYTES:
                yield pa.record_batch([pa.array(held, pa.binary())], names=["member"])
                held, size = [], 0
        yield pa.record_batch([pa.array(held, pa.binary())], names=["member"])


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, id_col="page_id", url_col="url", html_col="html") -> None:
    """Write one record per row below ``path``."""
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html")).withColumns({"n_bytes": F.octet_length("html"), "sha1": F.sha1("html")})
    several = rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select("sha1", "n_bytes", "largest")
    linked = rows.join(settle(several, "warc-equal-payloads"), ["sha1", "n_bytes"], "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    ready = linked.select("page_id", "url", F.when(refers_to.isNull(), F.col("html")).alias("html"), "n_bytes", "sha1", refers_to.alias("refers_to"))
    ready.mapInArrow(_members, "member binary").select(F.col("member").cast("string")).write.option("lineSep", "\0").text(path)


class _Range:
    """Bytes of a file from an offset on, read in pieces as they are asked for."""

    def __init__(self, file, start: int, stop: int):
        self.file, self.start, self.size = file, start, file.size()
        self.data = bytearray(file.read_at(min(stop + len(MAGIC) - 1, self.size) - start, start))

    def get(self, at: int, n: int) -> bytes:
        """``n`` bytes at file offset ``at``, fewer at the end of the file."""
        end = min(at + n, self.size)
        have = self.start + len(self.data)
        if end > have:
            return bytes(self.data[at - self.start :]) + self.file.read_at(end - max(have, at), max(have, at))
        return bytes(self.data[at - self.start : end - self.start])


def _member(source: _Range, at: int) -> tuple[bytes, int] | None:
    """The content and end of the member at ``at``; None where no WARC record is."""
    unpack, out, pos, piece = zlib.decompressobj(31), bytearray(), at, 1 << 16
    try:
        while not unpack.eof:
            got = source.get(pos, piece)
            if not got:
                return None
            out += unpack.decompress(got)
            pos, piece = pos + len(got), min(piece * 2, 1 << 22)
            if not b"WARC/1.".startswith(out[:7]) and out[:7] != b"WARC/1.":
                return None
    except zlib.error:
        return None
    end = pos - len(unpack.unused_data)
    head = out.partition(b"\r\n\r\n")
    if not head[1] or out[:7] != b"WARC/1.":
        return None
    follows = source.get(end, len(MAGIC))
    return (bytes(out), end) if not follows or follows == MAGIC else None


def _parsed(content: bytes) -> dict:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]))
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, found, payload = block.partition(b"\r\n\r\n") if "http" in fields.get("content-type", "") else (b"", b"", block)
    kind = fields.get("warc-type", "")
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        n, digest, payload = int(length[1]) if length else None, fields.get("warc-payload-digest", "").removeprefix("sha1:"), None
    else:
        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = lambda x: urllib.parse.unquote(x.strip("<>").removeprefix("urn:page:")) or None if x else None
    return {"record_type": kind, "record_id": name(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"), "refers_to": name(fields.get("warc-refers-to")), "payload_bytes": n, "payload_digest": digest, "payload": payload}


_RECORD = "path string, start long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def records_in(file, start: int, stop: int):
    """(offset, content) of the records of an open file that start in ``[start, stop)``."""
    source = _Range(file, start, stop)
    at = start
    while 0 <= (found := source.data.find(MAGIC, at - start)) and start + found < stop:
        at = start + found
        if got := _member(source, at):
            yield at, got[0]
            at = got[1]
            if at >= stop:
                return
        else:
            at += 1


def _read(with_payload: bool):
    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
                held, size = [], 0
                with store.open_input_file(inner) as file:
                    for at, content in records_in(file, start, stop):
                        row = {"path": path, "start": at, **_parsed(content)}
                        if not with_payload:
                            row["payload"] = None
                        held.append(row)
                        size += len(row["payload"] or b"")
                        if size > BATCH_BYTES or len(held) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(held, _ARROW)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, _ARROW)

    return run


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """Every record below ``path``; a task holds one range and one record at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "length")
    ranges = settle(files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"), F.col("length")), "warc-ranges")
    n = ranges.count()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), -(-n // RANGES_PER_TASK))  # grows with the bytes
    dealt = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("stop")).repartition(tasks)
    return dealt.mapInArrow(_read(with_payload), _RECORD)


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(floor(CAST('0x' || substr(s, {1 + 5 * g}, 5) AS INTEGER) / {32 ** (3 - i)}) AS INTEGER) % 32, 1)" for g in range(8) for i in range(4))


@query(
    "op10_warc_roundtrip",
    f"""WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS s FROM pages),
    q AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS largest FROM p)
    SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
      CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> largest THEN largest END AS refers_to FROM q""",
)
def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, with_payload=False).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )
