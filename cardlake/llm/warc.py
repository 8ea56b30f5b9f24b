"""Content-addressed web archive: payload bytes once, exact headers apart, records through joins.

The store has two tables. ``payloads`` holds the bytes of every distinct payload once, compressed, under their
SHA-256; ``headers`` holds for every record its exact header lines and the digest of its payload. Joined, they give the
records, each payload verified against its digest. They are written as WARC 1.1 files, compressed as a whole, and read
back by their content lengths. Payloads are compressed before they are first shuffled and stay so until a record is
written.

Of records with equal payloads of at least 100 bytes the one with the smallest id is the response, the others are
revisits of it; smaller payloads are always responses. Null html is an empty payload. Rows without an id are responses
that nothing refers to, unless a row with an id holds the payload; of rows that repeat the smallest id, all are
responses. Other columns than page_id, url and html are not read.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.llm.common import NO_ID, id_of, ship, stored, text_of
from cardlake.session import scratch_dir

MIN_REVISIT = 100
# Bytes of records in one archive file: a reader holds one file at a time.
FILE_BYTES = 16_000_000
BATCH_BYTES = 4_000_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, header string, payload binary"


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Every page with its digest, its record type and the page that it refers to; no payload."""
    html = text_of("html")
    rows = pages.select(
        id_of("page_id").alias("id"), text_of("url").alias("url"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes")
    )
    firsts = rows.filter(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first"))
    # A hot digest is split by the adaptive join: its other side has one row.
    joined = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("first") != F.col("id"))
    return joined.select(
        "id", "url", "digest", "bytes",
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def header_lines(id_column, url, kind, refers_to, digest, length):
    """The exact header of a record, without the empty line that ends it. Line breaks in a URL are percent-encoded."""
    target = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    identity = F.when(id_column == NO_ID, F.lit("none")).otherwise(id_column.cast("string"))
    revisit = F.when(
        kind == "revisit",
        F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">\r\n")),
    ).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <urn:page:"), identity,
        F.lit(">\r\nWARC-Target-URI: "), target, F.lit("\r\nWARC-Payload-Digest: sha256:"), digest, F.lit("\r\n"), revisit,
        F.lit("Content-Length: "), length.cast("string"), F.lit("\r\n"),
    )


def store(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> tuple[DataFrame, DataFrame]:
    """The content-addressed store: headers and payloads, each a written table."""
    typed = records(pages, min_revisit)
    length = F.when(F.col("type") == "revisit", F.lit(0)).otherwise(F.col("bytes"))
    headers = stored(
        typed.select(
            "digest", "bytes", "type",
            header_lines(F.col("id"), F.col("url"), F.col("type"), F.col("refers_to"), F.col("digest"), length).alias("header"),
        ),
        "warc-headers",
    )
    ship(pages.sparkSession)
    packed = pages.select(text_of("html").alias("html")).mapInArrow(_pack, "digest string, packed binary")
    # Equal payloads have equal compressed bytes; they are merged before the shuffle.
    payloads = stored(packed.groupBy("digest", "packed").agg(F.count(F.lit(1)).alias("uses")), "warc-payloads")
    return headers, payloads


def _parts(names: list[str], rows: Iterator[tuple[list, int]]):
    """Batches of rows whose sizes add up to a bounded number of bytes."""
    some, size = [], 0
    for row, own in rows:
        some.append(row)
        size += own
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*some)], names=names)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*some)], names=names)


def _pack(batches):
    compress = zstandard.ZstdCompressor(level=6).compress

    def rows():
        for batch in batches:
            for html in batch.column("html"):
                payload = html.as_py().encode()
                yield (hashlib.sha256(payload).hexdigest(), compress(payload)), len(payload)

    return _parts(["digest", "packed"], rows())


def _unpack(batches):
    decompress = zstandard.ZstdDecompressor().decompress

    def rows():
        for batch in batches:
            for header, digest, packed in zip(*(batch.column(c).to_pylist() for c in ("header", "digest", "packed"))):
                payload = decompress(packed)
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload differs from its digest {digest}")
                yield (f"{header}\r\n{payload.decode()}",), len(payload) + len(header)

    return _parts(["record"], rows())


def restored(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Whole records as text: the header, an empty line, and the payload of responses. Each payload is verified."""
    ship(headers.sparkSession)
    full = headers.filter("type = 'response'").select("header", "digest").join(payloads.select("digest", "packed"), "digest")
    return full.mapInArrow(_unpack, "record string").unionByName(
        headers.filter("type = 'revisit'").select(F.concat("header", F.lit("\r\n")).alias("record"))
    )


def write_archives(headers: DataFrame, payloads: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Compressed WARC files below ``path``, of ``file_bytes`` of records each on average. A record ends with two line ends."""
    length = F.octet_length("header") + F.when(F.col("type") == "response", F.col("bytes")).otherwise(0)
    total, rows = headers.agg(F.sum(length), F.count(F.lit(1))).first()
    most = max(1, int(file_bytes * rows / total)) if total else 1
    writer = restored(headers, payloads).write.mode("overwrite").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most)
    writer.option("compression", "gzip").text(path)


def parse(data: bytes) -> Iterator[dict]:
    """Records of an archive, in order; a payload's length comes from its header, never from its content."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        header = data[at : end + 2].decode()
        named = dict(line.split(": ", 1) for line in header.split("\r\n")[1:-1])
        length, start = int(named["Content-Length"]), end + 4
        payload = data[start : start + length]
        if len(payload) != length or data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"record {named['WARC-Record-ID']} is cut off")
        digest = named["WARC-Payload-Digest"].removeprefix("sha256:")
        if named["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record {named['WARC-Record-ID']} differs from its digest")
        identity, refers = (named.get(key, "").removeprefix("<urn:page:").removesuffix(">") for key in ("WARC-Record-ID", "WARC-Refers-To"))
        yield {
            "page_id": None if identity == "none" else int(identity),
            "url": named["WARC-Target-URI"], "record_type": named["WARC-Type"], "refers_to": int(refers) if refers else None,
            "payload_digest": digest, "header": header, "payload": payload if named["WARC-Type"] == "response" else None,
        }
        at = start + length + 4


def _parsed(batches):
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_digest", pa.string()), ("header", pa.string()), ("payload", pa.binary()),
    ])
    for batch in batches:
        for content in batch.column("content"):
            some, size = [], 0
            for record in parse(gzip.decompress(content.as_buffer())):
                some.append(record)
                size += len(record["payload"] or b"") + 1000
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(some, schema=schema)
                    some, size = [], 0
            if some:
                yield pa.RecordBatch.from_pylist(some, schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``. One file is parsed at a time."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, PARSED)


def with_full_payload(read: DataFrame) -> DataFrame:
    """Each record with its full payload's length and digest; those of a revisit come from the record it refers to."""
    responses = read.filter("record_type = 'response'")
    sizes = responses.groupBy("payload_digest").agg(F.max(F.octet_length("payload")).cast("long").alias("payload_bytes"))
    return read.select("page_id", "payload_digest", "record_type", "refers_to").join(sizes, "payload_digest")


def archive(pages: DataFrame, path: str | None = None, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives of ``pages`` and return their records as read back."""
    path = path or scratch_dir(pages.sparkSession, "warc")
    headers, payloads = store(pages, min_revisit)
    write_archives(headers, payloads, path, file_bytes)
    return read_archives(pages.sparkSession, path)
