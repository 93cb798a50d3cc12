"""Content-addressed WARC archive: payload bytes once by strong digest, record headers apart, records by joins.

An archive is two Parquet tables below one folder: payloads (sha256, payload_bytes, payload) and
headers (page_id, sha256, payload_bytes, header). A header is the record's exact header block up to and
with the empty line. Reading recomputes every payload's digest, rebuilds the records' bytes by joins, parses those and fails on a mismatch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import arrow_schema, batch_of, documents, materialise

#: The date that records carry, and the digits of radix 32 with their base32 letters.
DATE, RADIX_32, BASE_32 = "2024-01-01T00:00:00Z", "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_sha1(hex40: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five of these are four of those."""
    parts = [F.lpad(F.conv(F.substring(hex40, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*parts)), RADIX_32, BASE_32)


def _record_id(page_id: Column) -> Column:
    """A name-based UUID of the page."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if i > 1 else ()) + (F.substring(h, i, n),)], F.lit(">"))


def write_archive(pages: DataFrame, root: str, dedupe_min_bytes: int = 0) -> None:
    """Write the pages (page_id, url, html) as records.

    Of records with equal payloads of at least dedupe_min_bytes bytes, that with the smallest
    page_id is the response and the others revisit it; smaller ones are all responses. A null html is an
    empty payload. A null page_id is never the smallest: it revisits another record, or is a
    response where no equal payload has an identifier. Repeated rows of the smallest are all responses.
    A null url is an empty target. Only digests and identifiers are shuffled, and each payload once.
    """
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    records = documents(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), raw.alias("payload"))
    records = records.select("page_id", "url", "payload", F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    records.groupBy("sha256", "payload_bytes").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{root}/payloads")
    light = materialise(records.select("page_id", "url", "sha256", "payload_bytes", base32_of_sha1(F.sha1("payload")).alias("sha1")), "warc-light")
    # written, so that the join below has bare shuffles on both sides: only then is a payload that many pages share dealt to several tasks
    firsts = materialise(light.groupBy("sha256", "payload_bytes").agg(F.min("page_id").alias("first_id")), "warc-firsts")
    dealt = light.join(firsts, ["sha256", "payload_bytes"])
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("payload_bytes") >= dedupe_min_bytes)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("first_id"))), line("X-Refers-To-Page", F.col("first_id").cast("string")), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        F.when(F.col("page_id").isNotNull(), line("X-Page", F.col("page_id").cast("string"))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"),
    )
    dealt.select("page_id", "sha256", "payload_bytes", F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{root}/headers")


def _payloads(spark: SparkSession, root: str) -> DataFrame:
    """The payloads, each proved to have its digest and length."""
    stored = spark.read.parquet(f"{root}/payloads")
    good = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("payload_bytes"))
    proved = F.when(good, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))))
    return stored.select(proved.alias("sha256"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def reconstruct(spark: SparkSession, root: str, full: bool = False) -> DataFrame:
    """page_id and the record's exact bytes; full: revisits too with the payload they refer to.

    Fails where a payload is damaged or missing.
    """
    heads = spark.read.parquet(f"{root}/headers")
    revisits = F.decode("header", "UTF-8").contains("\r\nWARC-Type: revisit\r\n")
    end = F.lit(b"\r\n\r\n")
    joined = (heads if full else heads.where(~revisits)).join(_payloads(spark, root), ["sha256", "payload_bytes"], "left")
    body = F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("missing payload "), F.col("sha256"))))
    whole = joined.select("page_id", F.concat("header", body, end).alias("record"))
    return whole if full else whole.union(heads.where(revisits).select("page_id", F.concat("header", end).alias("record")))


def parsed(records: DataFrame) -> DataFrame:
    """Per rebuilt record what its own bytes say: page_id, record_type, refers_to, told (its digest field), body_bytes, body_digest.

    The header ends at the first empty line, the body has Content-Length bytes and an end mark behind it; others fail.
    """
    at = F.instr(F.decode("record", "ISO-8859-1"), "\r\n\r\n")
    cut = records.select("record", at.alias("at")).select("record", "at", F.decode(F.expr("substring(record, 1, at + 3)"), "UTF-8").alias("h"))
    cut = cut.select("record", "at", "h", _field(F.col("h"), "Content-Length").cast("int").alias("n"))
    sound = (F.col("at") > 0) & (F.octet_length("record") == F.col("at") + F.col("n") + 7) & (F.expr("substring(record, at + n + 4)") == F.lit(b"\r\n\r\n"))
    body = F.when(sound, F.expr("substring(record, at + 4, n)")).otherwise(F.raise_error(F.lit("a record's length does not fit its header")))
    cut = cut.select("h", body.alias("body"))
    return cut.select(
        _field(F.col("h"), "X-Page").cast("long").alias("page_id"),
        _field(F.col("h"), "WARC-Type").alias("record_type"),
        _field(F.col("h"), "X-Refers-To-Page").cast("long").alias("refers_to"),
        F.regexp_extract("h", "\r\nWARC-Payload-Digest: sha1:([A-Z2-7]*)\r\n", 1).alias("told"),
        F.octet_length("body").cast("long").alias("body_bytes"),
        base32_of_sha1(F.sha1("body")).alias("body_digest"),
    )


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, all from the records rebuilt byte by byte.

    A response's size and digest are those of its own body, and its header has to tell that digest. A revisit has those of the
    response that it refers to, which has to be there with the digest that the revisit tells.
    """
    read = materialise(parsed(reconstruct(spark, root)), "warc-read")
    proved = F.when(F.col("told") == F.col("body_digest"), F.col("told")).otherwise(F.raise_error(F.lit("a response's body has another digest")))
    responses = read.where("record_type = 'response'").select("page_id", F.col("body_bytes").alias("payload_bytes"), proved.alias("payload_digest"), "record_type", "refers_to")
    # written, as in write_archive: many records may revisit one
    known = materialise(responses.where("page_id is not null").groupBy("page_id", "payload_digest").agg(F.min("payload_bytes").alias("payload_bytes")), "warc-known")
    known = known.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("told"), "payload_bytes")
    revisits = read.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "told").join(known, ["refers_to", "told"], "left")
    size = F.when(F.col("payload_bytes").isNotNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a revisit's response is missing")))
    return responses.union(revisits.select("page_id", size.alias("payload_bytes"), F.col("told").alias("payload_digest"), "record_type", "refers_to"))


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header block and body of each record of a WARC file's bytes (plain or gzip members); a cut-off end is left out."""
    if data[:2] == b"\x1f\x8b":
        import zlib

        plain = bytearray()
        while data[:2] == b"\x1f\x8b":
            unzip = zlib.decompressobj(31)
            plain += unzip.decompress(data)
            data = unzip.unused_data
        data = bytes(plain)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            return
        header = data[start : end + 4]
        length = next((int(x.split(b":", 1)[1]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
        if end + 4 + length > len(data):
            return
        yield header, data[end + 4 : end + 4 + length]
        at = end + 4 + length


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """header and body of each record of the WARC files below a path."""
    fields = spark.createDataFrame([], "path string, header binary, body binary").schema
    out_schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for header, body in parse_warc(content):
                    yield batch_of(out_schema, [[name], [header], [body]])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, fields)
