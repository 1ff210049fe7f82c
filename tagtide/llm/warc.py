"""WARC archives: writing, reading, and revisit resolution.

Archives hold WARC/1.1 records, each in a gzip member of its own, in a folder that all executors share.
Records are compressed in Arrow batches and put together to files of about `FILE_BYTES`, one file per row,
so a file's size is bounded by that and its last record. Spark's own text writer puts the rows there, so any
file system that Spark can write will do: a row lacks its last byte, which the writer adds as line separator.
That byte is always 0, being the top one of a member's length, or of the empty member that follows a
record of 16 MB or more. Readers inflate member by member and walk from record to record by
Content-Length, never by searching for separators; members may hold any number of records.

`resolve` shuffles headers only: by payload digest, with map-side aggregation, it finds the original of
each digest that occurs twice, joins the others to it and turns them into revisits. `write_archives` then
writes one record per row with fresh headers: responses with their payload, revisits without.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtide.llm.common import shared_folder

# The WARC profile of a revisit, and the two base-32 alphabets.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes after which a file ends.
FILE_BYTES = 8 << 20
#: Bytes of an archive that are inflated at a time.
FEED = 4 << 10
CRLF = "\r\n"
_RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_length", pa.int64()), ("payload", pa.string())])


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base-32 SHA-1: each 5 hexadecimal digits of the digest are 4 of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS, BASE32)


def _record_id(page_id: Column, copy: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), copy.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def resolve(headers: DataFrame) -> DataFrame:
    """(key, page_id, payload_digest, n): n equal rows -> one row per record with record_type and refers_to.

    Of each digest, the record with the greatest page_id is the response and the others revisit it
    (a null page_id is less than any other). `key` passes; it stands for page_id where nulls are no keys.
    """
    rows = headers.withColumn("copy", F.explode(F.expr("sequence(1L, n)")))
    groups = headers.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.sum("n").alias("m")).filter("m > 1")
    # upper() hides that the groups are partitioned by digest: with an exchange of its own for them, AQE can split a hot one
    groups = groups.select(F.upper("payload_digest").alias("payload_digest"), "original", F.lit(True).alias("shared"))
    rows = rows.join(groups, "payload_digest", "left").withColumn("original", F.when(F.col("shared"), F.col("original")).otherwise(F.col("page_id")))
    first = F.col("page_id").eqNullSafe(F.col("original")) & (F.col("copy") == 1)
    return rows.select("key", "page_id", "payload_digest", "copy", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("original")).alias("refers_to"))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> resolved records: headers, and the payload of responses only."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    headers = resolve(rows.groupBy("key", "page_id", "payload_digest").agg(F.count(F.lit(1)).alias("n")))
    # payloads meet their headers under (key, digest), of which a hot digest has as many as rows; grouping and
    # join have the same keys, so payloads are shuffled once
    bodies = rows.groupBy("key", "payload_digest").agg(F.first("payload").alias("payload"), F.min("url").alias("url"))
    joined = headers.join(bodies, ["key", "payload_digest"])
    return joined.select("page_id", "copy", "record_type", "refers_to", "payload_digest", "url", F.when(F.col("record_type") == "response", F.col("payload")).otherwise("").alias("payload"), F.octet_length("payload").cast("long").alias("payload_length"))


def member(record: bytes) -> bytes:
    """The record as a gzip member, and an empty member after it if it is so long that the last byte would not be 0."""
    out = gzip.compress(record, 6, mtime=0)
    return out if len(record) < 1 << 24 else out + gzip.compress(b"", 6, mtime=0)


def _files(file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for head, payload in zip(batch.column("head"), batch.column("payload")):
                held.append(member(head.as_buffer().to_pybytes() + payload.as_buffer().to_pybytes() + b"\r\n\r\n"))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

    return run


def write_archives(recs: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """One WARC record per row of `records`, in files that end with the record that takes them to file_bytes."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    safe = F.regexp_replace(F.col("url"), r"[\r\n]", " ")
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("copy"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.lit(1)))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        line("X-Payload-Length", F.col("payload_length").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length("payload").cast("string")),
        F.lit(CRLF),
    )
    packed = recs.select(head.alias("head"), "payload").mapInArrow(_files(file_bytes), "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)


def members(data) -> Iterator[bytes]:
    """What each gzip member of a file holds; zeros between and after members are padding.

    A member is fed in pieces: what follows its end in the last one is all that zlib copies, not the rest of the file.
    """
    rest, at = memoryview(data), 0
    while at < len(rest):
        if rest[at] == 0:
            at += 1
            continue
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof:
            if at >= len(rest):
                raise ValueError("archive ends inside a gzip member")
            piece = rest[at : at + FEED]
            out.append(unzip.decompress(piece))
            at += len(piece) - len(unzip.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an uncompressed archive, or of a part with whole records: headers by lower-case name, and the block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(head["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at byte {stop}")
        yield head, data[start:stop]
        at = stop + 4


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in a folder; without payloads, headers only. Headers that a record lacks are null."""
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _RECORD)], schema=_RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for part in members(content.as_buffer()):
                    for head, block in parse(part):
                        number = lambda name: int(head[name]) if name in head else None  # noqa: E731, B023
                        digest = head.get("warc-payload-digest")
                        rows.append((number("x-page-id"), head.get("warc-type"), head.get("warc-target-uri"), digest and digest.removeprefix("sha1:"), number("x-refers-to-page-id"), number("x-payload-length"), block.decode("utf-8", "replace") if payloads else None))
                        size += len(block) if payloads else 0
                        if size >= FILE_BYTES or len(rows) >= 10_000:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, record_type string, url string, payload_digest string, refers_to long, payload_length long, payload string")


def deduplicated(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write deduplicated archives of `pages` and read them back, without payloads.

    -> (page_id, payload_bytes, payload_digest, record_type, refers_to), one row per page row. A null
    html is an empty payload, and empty payloads are equal to each other like any. A null page_id is
    written without that header and read back as null; of rows that repeat a page_id and payload, one
    can be the response and the others revisit it. Digest and bytes are those of the full payload, for
    revisits too. An empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(records(pages), folder)
    back = read_archives(spark, folder, payloads=False)
    return back.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def sql() -> str:
    parts = " || ".join(f"lpad(to_base(('0x' || substr(h, {1 + 5 * i}, 5))::BIGINT, 32), 4, '0')" for i in range(8))
    return f"""
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
d as (select page_id, strlen(html)::BIGINT payload_bytes, translate(upper({parts}), '{DIGITS}', '{BASE32}') payload_digest, max(page_id) over (partition by h) m from p)
select page_id, payload_bytes, payload_digest, case when page_id = m then 'response' else 'revisit' end record_type, case when page_id <> m then m end refers_to from d"""
