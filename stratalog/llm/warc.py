"""WARC archives with revisit records instead of repeated payloads.

Headers are shuffled by payload digest, which combines before the shuffle; the record with the
largest id of a digest becomes the response and the others revisits that refer to it. Payloads stay
where they are unless their digest may have several records. Archives are written by Spark's own
text writer with the record separator as line separator, so they can go to any store Spark writes to,
and are read back as binary files, record by record, with payloads held against their digests.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bit_marks, may_hold, written

#: A file holds about this much payload on average; a reader has one compressed file in memory and
#: of the text a record and a chunk.
FILE_BYTES = 16 << 20
CHUNK = 1 << 20
BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS = "record_id string, record_type string, key long, url string, date string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 form of a payload's SHA-1: every five hex digits are four digits."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    sha = F.sha1(payload)
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(sha, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8))), digits, BASE32)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def originals(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(d, original)``: the digests that several records of ``least_bytes`` bytes or more have, with
    the largest key of each. A null key is never the largest, unless all are null."""
    large = headers.where(F.col("payload_bytes") >= least_bytes)
    counted = large.groupBy(F.col("payload_digest").alias("d")).agg(F.max("key").alias("original"), F.count("*").alias("n"))
    return counted.where("n > 1").drop("n")


def resolve(headers: DataFrame, least_bytes: int = 0, of: DataFrame | None = None) -> DataFrame:
    """``headers(key, payload_digest, payload_bytes, ...)`` with ``record_type`` and ``refers_to``.

    Rows that repeat a digest's largest key are responses too, since nothing tells them apart.
    """
    of = originals(headers, least_bytes) if of is None else of
    joined = headers.drop("record_type", "refers_to").join(of, (F.col("payload_bytes") >= least_bytes) & (F.col("payload_digest") == F.col("d")), "left")
    revisit = F.col("d").isNotNull() & ~F.col("key").eqNullSafe(F.col("original"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("original"))).drop("d", "original")


def _split(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Rows with ``several``, whether their digest may be in ``of``, told without a shuffle."""
    return may_hold(rows, "payload_digest", written(bit_marks(of, "d"), "marks"), "several")


def record(date: str) -> Column:
    """The text of one record of resolved rows ``(key, url, html, ...)``, without the separator."""
    response = F.col("record_type") == "response"
    url = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:row:"), F.coalesce(F.col("key").cast("string"), F.lit("none")))), r"[\x00-\x20\x7f]", "%20")
    body = F.when(response, F.coalesce("html", F.lit(""))).otherwise("")
    block = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL + EOL), body)
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL))).otherwise("")
    return F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uuid(F.col("key"), F.col("payload_digest"), F.col("record_type"))),
        F.lit(f"WARC-Date: {date}{EOL}"),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(response, "").otherwise(F.concat(F.lit(f"WARC-Profile: {PROFILE}{EOL}WARC-Refers-To: "), _uuid(F.col("refers_to"), F.col("payload_digest"), F.lit("response")), F.lit(EOL))),
        line("X-Row-Key", F.col("key")),
        line("X-Refers-To-Row-Key", F.col("refers_to")),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit(EOL),
        block,
    )


def _write(rows: DataFrame, sizes: DataFrame, path: str, date: str, compression: str) -> None:
    n, size = sizes.agg(F.count("*"), F.sum("payload_bytes")).first()
    per_file = max(1, min(100_000, int(FILE_BYTES / max(1, (size or 0) / max(1, n)))))
    rows.select(record(date).alias("value")).write.option("lineSep", EOL * 2).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)


def _slim(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    slim = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return slim.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.col("html").cast("binary"))})


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "2025-01-01T00:00:00Z", compression: str = "gzip", revisits: bool = True) -> None:
    """Write one record per row: a response with its payload, or a revisit without; without
    ``revisits`` all are responses.

    A null payload is empty, a null url becomes a ``urn:row:`` one, a null key leaves its header
    out; control characters and spaces in a url are escaped. Payloads are whole, however long. An
    empty table makes an archive without records. Other columns are not looked at.
    """
    slim = _slim(pages, key, url, html)
    response = lambda rows: rows.select(*slim.columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    if not revisits:
        _write(response(slim), slim.select("payload_bytes"), path, date, compression)
        return
    headers = written(slim.select("key", "payload_digest", "payload_bytes"), "headers")
    of = written(originals(headers, least_bytes), "originals")
    told = _split(slim, of)
    fresh = resolve(told.where("several").drop("several"), least_bytes, of)
    _write(fresh.unionByName(response(told.where("NOT several"))), headers, path, date, compression)


class Damaged(ValueError):
    """An archive that does not hold what it says."""


def _plain(data: bytes) -> Iterator[bytes]:
    """The text of an archive, compressed as a whole or by record or not at all, chunk by chunk."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    member, rest = zlib.decompressobj(31), memoryview(data)
    while len(rest):
        part, rest = rest[:CHUNK], rest[CHUNK:]
        text = member.decompress(part, CHUNK)
        while True:
            if text:
                yield text
            if member.eof:
                left = member.unused_data
                if not left:
                    break
                member = zlib.decompressobj(31)
                text = member.decompress(left, CHUNK)
            elif member.unconsumed_tail:
                text = member.decompress(member.unconsumed_tail, CHUNK)
            else:
                break
        if member.eof and len(rest):
            member = zlib.decompressobj(31)
    if not member.eof:
        raise Damaged("the archive is cut off")


def parse(data: bytes, payloads: bool = True) -> Iterator[dict]:
    """The records of one archive by their lengths. A response's length and digest are those of its
    payload, and must be those its header names; a revisit has those of its header."""
    chunks, held, done = _plain(data), bytearray(), False

    def more() -> bool:
        nonlocal done
        text = next(chunks, None)
        done = text is None
        held.extend(text or b"")
        return not done

    while held or more():
        sought = 0
        while (end := held.find(b"\r\n\r\n", sought)) < 0:
            sought = max(0, len(held) - 3)
            if not more():
                raise Damaged("a header is cut off")
        version, *lines = held[:end].decode().split(EOL)
        if not version.startswith("WARC/1."):
            raise Damaged("no WARC record")
        head = dict(x.split(": ", 1) for x in lines)
        stop = end + 4 + int(head["Content-Length"])
        while len(held) < stop + 4:
            if not more():
                raise Damaged("a record is cut off")
        if held[stop : stop + 4] != b"\r\n\r\n":
            raise Damaged("no record end")
        number = lambda name: int(head[name]) if name in head else None  # noqa: E731, B023
        digest, size = head.get("WARC-Payload-Digest", "").removeprefix("sha1:"), number("X-Payload-Length")
        payload = None
        if head["WARC-Type"] == "response":
            payload = bytes(held[held.index(b"\r\n\r\n", end + 4, stop) + 4 : stop])
            named, digest = digest, base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if named and named != digest or size is not None and size != len(payload):
                raise Damaged(f"record {head['WARC-Record-ID']} has another payload than its header names")
            size = len(payload)
        del held[: stop + 4]
        yield {
            "record_id": head["WARC-Record-ID"],
            "record_type": head["WARC-Type"],
            "key": number("X-Row-Key"),
            "url": head.get("WARC-Target-URI"),
            "date": head.get("WARC-Date"),
            "payload_digest": digest,
            "payload_bytes": size,
            "refers_to": number("X-Refers-To-Row-Key"),
            "payload": payload if payloads else None,
        }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder, checked against their headers; a damaged archive is
    an error. Revisits have a null payload, all records without ``payloads``."""
    schema = spark.createDataFrame([], RECORDS).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                for r in parse(batch.column("content")[i].as_py(), payloads):
                    held.append(r)
                    size += 500 + len(r["payload"] or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)


def dedup_archives(spark: SparkSession, source: str, target: str, least_bytes: int = 0, date: str = "2025-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Read archives and write them again with fresh headers, repeated payloads as revisits.

    Of each digest the record with the largest key becomes the response; if it was a revisit, it
    gets the payload of the response it is joined to by digest. A revisit whose response is in none
    of the archives stays one, with its reference. Only headers are shuffled, and the payloads of
    digests that several records may have.
    """
    headers = read_archives(spark, source, payloads=False).select("key", "record_type", "payload_digest", "payload_bytes", "refers_to")
    headers = written(headers, "headers")
    of = written(originals(headers, least_bytes), "originals")
    found = read_archives(spark, source).withColumn("html", F.col("payload").cast("string")).select("key", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")
    told = _split(found, of)
    several = written(told.where("several").drop("several"), "several")  # these are parsed once for all that follows
    single = told.where("NOT several")
    payloads = several.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("pd")).agg(F.first("html").alias("original_html"))
    fresh = resolve(several.withColumnsRenamed({"record_type": "was", "refers_to": "referred"}), least_bytes, of)
    moved = (F.col("was") == "revisit") & (F.col("record_type") == "response")
    joined = fresh.where(moved).join(payloads, F.col("payload_digest") == F.col("pd"), "left")
    dangling = F.col("original_html").isNull() & F.col("referred").isNotNull()
    joined = joined.withColumns({"html": F.col("original_html"), "record_type": F.when(dangling, "revisit").otherwise("response"), "refers_to": F.when(dangling, F.col("referred"))})
    names = ["key", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = fresh.where(~moved).select(*names).unionByName(joined.select(*names)).unionByName(single.select(*names))
    _write(rows, headers, target, date, compression)
