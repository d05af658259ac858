"""A content-addressed web archive.

Payload bytes are stored once under their SHA-256 digest, compressed, in one table; the exact header of every record is
kept in another. Joining the two gives back the records byte for byte, and each payload read is checked against its
digests. Among records with equal payloads of at least ``REVISIT_FROM`` bytes the one with the largest page id is the
response and the others are revisits that refer to it; shorter payloads are always responses.

The header table joins the payload table by a plain join: adaptive execution splits a digest that many records share.

The rebuilt records are written as WARC files of about ``VOLUME_BYTES`` (before compression), each read back whole by one
task; a longer record has a file of its own. In the files a revisit has no payload: its length and digest are those
of the response with its strong digest. Records whose payload is missing or damaged are not exported: that is an error.

Defined results: a null html is an empty payload; a null url is left out of the header; a page without an id can only be
a response; repeated rows are records of their own; no pages give an empty archive. Extra columns are left alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.plans.storage import scratch_path, written

REVISIT_FROM = 1000
#: A WARC file holds about so many bytes.
VOLUME_BYTES = 16_000_000
#: Records carry this date unless the pages have one.
DATE = "2024-01-01T00:00:00Z"
_DIGESTS = "page_id long, url string, strong string, payload_digest string, payload_bytes long"


def _digested(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        payloads = [p or b"" for p in batch.column("html").cast(pa.binary()).to_pylist()]
        if keep:
            yield pa.RecordBatch.from_arrays([
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([pack(p) for p in payloads], pa.binary()),
            ], names=["strong", "packed"])
        else:
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                pa.array([hashlib.sha1(p).hexdigest() for p in payloads], pa.string()),
                pa.array([len(p) for p in payloads], pa.int64()),
            ], names=["page_id", "url", "strong", "payload_digest", "payload_bytes"])


def _header(date: str) -> Column:
    """The header bytes of a record up to and with the empty line."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Strong-Digest: sha256:"), F.col("strong")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).cast("binary")


def write_archive(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, date: str = DATE) -> None:
    """Write the tables ``path``/records (page_id, strong, header) and ``path``/payloads (strong, packed)."""
    html = pages.select("page_id", "url", "html")
    digests = html.mapInArrow(lambda b: _digested(b, False), _DIGESTS)
    answers = (
        digests.where(F.col("payload_bytes") >= revisit_from)
        .groupBy("strong").agg(F.max("page_id").alias("answer"))
    )
    differs = ~F.coalesce(F.col("page_id") == F.col("answer"), F.col("answer").isNull() | F.col("page_id").isNull())
    typed = (
        digests.join(answers, "strong", "left")
        .withColumn("record_type", F.when(differs, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(differs, F.col("answer")))
    )
    typed.select("page_id", "strong", "record_type", _header(date).alias("header")).write.parquet(f"{path}/records")
    packed = html.select("html").mapInArrow(lambda b: _digested(b, True), "strong string, packed binary")
    # equal digests have equal bytes; copies collapse before the shuffle
    packed.groupBy("strong").agg(F.first("packed").alias("packed")).write.parquet(f"{path}/payloads")


def parse_header(header: bytes) -> dict[str, str]:
    fields = (line.partition(":") for line in header.decode("utf-8").split("\r\n")[1:] if line)
    return {name.strip().lower(): value.strip() for name, _, value in fields}


def _reconstructed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    names = ["page_id", "record", "record_type", "refers_to", "payload_bytes", "payload_digest", "sound"]
    for batch in batches:
        rows = []
        for header, packed in zip(batch.column("header").to_pylist(), batch.column("packed").to_pylist()):
            fields = parse_header(header)
            payload = unpack(packed) if packed is not None else b""
            digest, response = hashlib.sha1(payload).hexdigest(), fields["warc-type"] == "response"
            sound = packed is not None and "sha256:" + hashlib.sha256(payload).hexdigest() == fields["x-payload-strong-digest"]
            sound &= "sha1:" + digest == fields["warc-payload-digest"] and len(payload) == int(fields["x-payload-length"])
            block = payload if response else b""  # a revisit's own block is empty: its payload is the one it refers to
            sound &= len(block) == int(fields["content-length"])
            own, other = (re.sub(r"[^0-9-]", "", fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
            rows.append((
                int(own) if own else None, header + block + b"\r\n\r\n", fields["warc-type"],
                int(other) if other else None, len(payload) if packed is not None else None,
                digest if packed is not None else None, sound,
            ))
        types = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names
        )


_RECORDS = "page_id long, record binary, record_type string, refers_to long, payload_bytes long, payload_digest string, sound boolean"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records as bytes with the fields of their headers, and length and digest of their payloads, all rebuilt from
    the payload table, those of revisits too; ``sound`` where length and digests agree with the header. A record
    whose payload is missing has neither and is not sound."""
    records = spark.read.schema("page_id long, strong string, record_type string, header binary").parquet(f"{path}/records")
    payloads = spark.read.schema("strong string, packed binary").parquet(f"{path}/payloads")
    joined = records.select("strong", "header").join(payloads, "strong", "left").select("header", "packed")
    return joined.mapInArrow(_reconstructed, _RECORDS)


def _volumes(batches: Iterator[pa.RecordBatch], volume_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records put together to files; the writer adds the last record's two line ends."""
    def volume(records):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(records)[:-4]], pa.binary())], names=["volume"])

    records, size = [], 0
    for batch in batches:
        for record, sound in zip(batch.column("record").to_pylist(), batch.column("sound").to_pylist()):
            if not sound:
                raise ValueError(f"the payload of a record is missing or damaged: {record[:300]!r}")
            if records and size + len(record) > volume_bytes:
                yield volume(records)
                records, size = [], 0
            records.append(record)
            size += len(record)
    if records:
        yield volume(records)


def export_warc(records: DataFrame, path: str, volume_bytes: int = VOLUME_BYTES) -> None:
    """The records of ``read_archive`` as compressed WARC files, each one row of text to the writer.

    Payloads that came from text columns are valid UTF-8, which the text writer keeps as it is.
    """
    rows = records.select("record", "sound").mapInArrow(lambda b: _volumes(b, volume_bytes), "volume binary")
    writer = rows.select(F.col("volume").cast("string").alias("value")).write
    writer = writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).text(path)


def _split_records(data: bytes) -> Iterator[bytes]:
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        length = int(parse_header(data[at : end + 4])["content-length"])
        stop = end + 4 + length + 4
        yield data[at:stop]
        at = stop


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files as bytes; a file is read by one task, so files should be of moderate size."""
    def read(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                data = gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data
                yield pa.RecordBatch.from_arrays([pa.array(list(_split_records(data)), pa.binary())], names=["record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "record binary")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fields of records, with length and digests of the payloads they hold."""
    for batch in batches:
        rows = []
        for record in batch.column("record").to_pylist():
            header, _, rest = record.partition(b"\r\n\r\n")
            fields, payload = parse_header(header + b"\r\n\r\n"), rest[:-4]
            response = fields["warc-type"] == "response"
            own, other = (re.sub(r"[^0-9-]", "", fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
            sound = len(payload) == int(fields["content-length"])
            if response:
                sound &= "sha256:" + hashlib.sha256(payload).hexdigest() == fields["x-payload-strong-digest"]
            rows.append((
                int(own) if own else None, fields["warc-type"], int(other) if other else None,
                fields["x-payload-strong-digest"], fields["warc-payload-digest"], int(fields["x-payload-length"]),
                len(payload) if response else None, hashlib.sha1(payload).hexdigest() if response else None, sound,
            ))
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)],
            names=["page_id", "record_type", "refers_to", "strong", "said_digest", "said_bytes", "own_bytes", "own_digest", "own_sound"],
        )


_OPENED = "page_id long, record_type string, refers_to long, strong string, said_digest string, said_bytes long, own_bytes long, own_digest string, own_sound boolean"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, sound of the records of WARC files. A revisit has the
    payload of the responses with its strong digest; ``sound`` where what was read agrees with the header."""
    opened = written(import_warc(spark, path).mapInArrow(_opened, _OPENED), "opened")  # fields only; read by both sides
    held = opened.where("record_type = 'response' and own_sound").groupBy("strong")
    held = held.agg(F.any_value("own_bytes").alias("bytes"), F.any_value("own_digest").alias("digest"))
    rows = opened.join(held, "strong", "left")
    length, digest = F.coalesce("own_bytes", "bytes"), F.coalesce("own_digest", "digest")
    agrees = (length == F.col("said_bytes")) & (F.concat(F.lit("sha1:"), digest) == F.col("said_digest")) & F.col("own_sound")
    return rows.select(
        "page_id", length.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to",
        F.coalesce(agrees, F.lit(False)).alias("sound"),
    )


def block_digest(payload: bytes) -> str:
    """The usual printed form of a payload digest: base 32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    export_warc(read_archive(spark, path), f"{path}/warc")
    return read_warc(spark, f"{path}/warc")


ORACLE = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
answers AS (SELECT html, max(page_id) AS answer FROM rows WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(rows.html) AS payload_digest,
       CASE WHEN answer <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN answer <> page_id THEN answer END AS refers_to, true AS sound
FROM rows LEFT JOIN answers ON rows.html = answers.html AND n >= 1000
"""
