"""WARC archives with revisit records (ISO 28500).

``resolve`` shuffles headers alone (id, length, digest): of records with equal payloads the
smallest id is the response, the others revisit it.  ``write`` stores responses whole and
revisits as a header with profile, digest and the record they refer to, each with fresh headers;
``read`` parses archives; ``rejoin`` joins revisits to their originals again.

A record is UTF-8 text between fixed separators, so Spark's text writer with the separator as
line end writes it: to any file system, committed like any table.  Archives are gzip files of
about ``file_bytes`` of records, a size at which one is read by one task.  Payloads may hold
anything: reading goes by Content-Length.

Each archive begins with a warcinfo record.  It is one gzip stream, as Spark's writers make it, and not one
member a record: it is read from its beginning.

Defined cases: null payloads are empty; empty payloads are equal payloads like any other; rows
that repeat both id and payload are all responses; null ids come after all others and refer to
the smallest id, or are all responses where no equal payload has an id; a null url is written as empty; very
long payloads are one record each; an empty table gives an archive without records, which reads as no rows; only page_id,
url and html are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.store import staged

FILE_BYTES = 32 << 20
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: each five hex digits are four digits of base 32."""
    h = F.sha1(data)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, i * 5 + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url and html of the pages, with payload_bytes and payload_digest."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("page_id", "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))


def resolve(heads: DataFrame) -> DataFrame:
    """Rows (page_id, payload_digest, ...) with record_type and refers_to.

    Originals are aggregated before the shuffle and written; the join back has one row per payload on that
    side, so Spark can split a payload that very many records share over tasks."""
    first = staged(heads.groupBy("payload_digest").agg(F.min("page_id").alias("original")), "originals")
    out = heads.join(first, "payload_digest")
    same = F.col("page_id").eqNullSafe(F.col("original"))
    return out.withColumns({"record_type": F.when(same, "response").otherwise("revisit"), "refers_to": F.when(~same, F.col("original"))}).drop("original")


def record(url: Column, date: str = DATE) -> Column:
    """One record as text, without the separator behind it, from the columns of ``write``."""
    uri = lambda c: F.concat(F.lit("<urn:quern:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    answer = F.concat(F.lit(_HEAD), F.col("payload_bytes").cast("string"), F.lit(END))
    whole = F.col("record_type") == "response"
    block = F.when(whole, F.concat(answer, F.coalesce("html", F.lit("")))).otherwise("")
    size = F.when(whole, F.octet_length(answer) + F.col("payload_bytes")).otherwise(0)
    refers = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", uri(F.col("refers_to"))))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.when(whole, "").otherwise(refers),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", size.cast("string")), F.lit("\r\n"), block,
    )


def _info(date: str) -> str:
    block = "software: quern\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:quern:info>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n{block}{END}"


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, date: str = DATE) -> None:
    """Writes one record per row (page_id, url, html), payloads once, all with the date given."""
    heads = headers(pages)
    total = heads.agg(F.sum("payload_bytes")).first()[0] or 0
    spark = pages.sparkSession
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    # rows without an id are told apart by their url, or many with one payload would meet in one task
    keys = {"key": F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "salt": F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("url"), F.lit(256))).otherwise(0)}
    heads = heads.withColumns(keys)
    kinds = resolve(heads.select("page_id", "key", "salt", "payload_digest").distinct()).drop("page_id")
    # dealt by id and digest once: the join and the files keep that partitioning
    on = ["key", "salt", "payload_digest"]
    joined = heads.repartition(files, *on).join(kinds, on)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of a file
    one = joined.select("page_id", "html", "payload_bytes", "payload_digest", "record_type", "refers_to", "url").select(F.concat(F.when(first, F.lit(_info(date))).otherwise(""), record(F.col("url"), date)).alias("value"))
    one.write.option("lineSep", END).option("compression", "gzip").text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one archive, decompressed."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        begin, size = end + 4, int(fields["Content-Length"])
        yield fields, data[begin : begin + size]
        at = begin + size + 4


def unpacked(raw: bytes) -> bytes:
    """All gzip members of a file, or the file itself if it isn't compressed."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw))
        raw = d.unused_data
    return b"".join(out) if out else raw


_ID = re.compile(r"<urn:quern:page:(-?\d+|null)>")
_READ = "page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long, actual_digest string, payload string"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record.  For responses payload_bytes, actual_digest and (if asked) the payload
    come from the block read; for revisits they are null."""

    def number(uri: str | None) -> int | None:
        found = _ID.fullmatch(uri or "")
        return int(found[1]) if found and found[1] != "null" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[tuple] = []
                for f, block in records(unpacked(batch.column("content")[i].as_py())):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    body = block[block.index(b"\r\n\r\n") + 4 :] if f["WARC-Type"] == "response" else None
                    known = (None, None, None) if body is None else (len(body), b32encode(hashlib.sha1(body).digest()).decode(), body.decode("utf-8", "replace") if payloads else None)
                    rows.append((number(f["WARC-Record-ID"]), f["WARC-Type"], number(f.get("WARC-Refers-To")), f["WARC-Target-URI"], f["WARC-Payload-Digest"].removeprefix("sha1:"), *known))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, _READ)


def rejoin(found: DataFrame) -> DataFrame:
    """Revisits get length and digest of the payload from the response they refer to."""
    originals = found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("_bytes"), F.max("actual_digest").alias("_digest"))
    out = found.join(staged(originals, "payloads"), "payload_digest", "left")
    return out.withColumns({"payload_bytes": F.coalesce("payload_bytes", "_bytes"), "payload_digest": F.coalesce("actual_digest", "_digest")}).drop("_bytes", "_digest", "actual_digest")
