"""WARC archives through a chunked record table.

An archive is written from rows (record, chunk number, text of the chunk). A payload
longer than a chunk becomes a first record and `continuation` records, which is how
the WARC standard segments a record, so no step holds more than a chunk beside the
row that Spark reads. Each record ends with two line breaks and that is the line
separator of Spark's text writer: archives are written and read by Spark alone,
wherever its file systems reach.

Reading streams the pieces between separators through a parser that trusts only
Content-Length; payload bytes are never searched for record boundaries. The SHA-1 of
a payload is carried along its chunks and compared with the digest in the header.

Equal payloads of at least `least` bytes (by SHA-1 and length): the row with the
largest page id keeps the payload as `response`, the others become `revisit`.

Defined results: a null or empty html is an empty payload (of 0 bytes, equal to each
other); rows tied for the largest id are all responses; a null page id counts as
smaller than any other; a null url is written as an empty target; other columns are
ignored; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

SEPARATOR = "\r\n\r\n"
#: Characters of a payload in one record.
CHUNK = 1 << 16
NAMES = ("WARC-Record-ID", "WARC-Type", "WARC-Payload-Digest", "X-Payload-Length", "WARC-Refers-To", "WARC-Segment-Number", "Content-Length")


def base32_sha1(hex_digest):
    """Upper-case base32 of a hexadecimal SHA-1, as a Column: 160 bits are 32 letters of 5 bits."""
    letter = lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring(bits, i + 1, 5), 2, 10).cast("int") + 1, F.lit(1))
    bits = F.concat(*[F.lpad(F.conv(F.substring(hex_digest, 8 * k + 1, 8), 16, 2), 32, "0") for k in range(5)])
    return F.concat(*[letter(5 * k) for k in range(32)])


def assign(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, digest (hexadecimal SHA-1) and refers_to, null for responses."""
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = lambda df: df.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    shared = keyed(rows).groupBy(F.col("digest").alias("d"), F.col("payload_bytes").alias("b")).agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    # only payloads that occur twice take part in the join; skewed ones are split by AQE
    shared = shared.where(F.col("n") > 1).select("d", "b", "holder")
    rows = keyed(rows)
    joined = rows.join(shared, (rows.digest == shared.d) & (rows.payload_bytes == shared.b), "left")
    revisit = (F.col("payload_bytes") >= least) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select("page_id", "url", "html", "payload_bytes", "digest", F.when(revisit, F.col("holder")).alias("refers_to"))


def chunk_table(assigned: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each WARC record: page_id, chunk_no from 1, n_chunks and its text (revisits have one empty chunk)."""
    html = F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(F.lit(""))
    sized = assigned.select("page_id", "url", "payload_bytes", "digest", "refers_to", html.alias("html"))
    sized = sized.withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.length("html") / F.lit(chunk))).cast("int"))
    each = sized.withColumn("chunk_no", F.explode(F.sequence(F.lit(1), F.col("n_chunks"))))
    text = F.when(F.col("n_chunks") == 1, F.col("html")).otherwise(F.substring(F.col("html"), (F.col("chunk_no") - 1) * chunk + 1, F.lit(chunk)))
    return each.withColumn("text", text).drop("html")


def records(chunks: DataFrame) -> DataFrame:
    """The chunk table as WARC records in text, each without its final separator."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    kind = F.when(F.col("chunk_no") > 1, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    target = F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "")
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("digest")))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("refers_to").isNotNull(), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        F.when(F.col("n_chunks") > 1, line("WARC-Segment-Number", F.col("chunk_no").cast("string"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length("text").cast("string")),
        F.lit("\r\n"),
    )
    return chunks.select(F.concat(head, F.col("text")).alias("value"))


def write_archives(pages: DataFrame, to: str, least: int = 0, chunk: int = CHUNK) -> None:
    """Write the pages as gzipped WARC files in the folder `to`; a record's chunks follow one another in one file."""
    out = records(chunk_table(assign(pages, least), chunk))
    out.write.option("lineSep", SEPARATOR).option("compression", "gzip").text(to)


class Parser:
    """Turns a stream of pieces into records; holds one piece, one header and a digest."""

    def __init__(self):
        self.head, self.left, self.fields, self.open = b"", 0, None, None

    def feed(self, piece: bytes) -> Iterator[dict]:
        """piece: bytes up to a separator. Yields each record when its payload has ended."""
        data = piece + SEPARATOR.encode()
        while data:
            if self.left:
                part, data = data[: self.left], data[self.left :]
                self.left -= len(part)
                self.open["sha1"].update(part)
                self.open["seen"] += len(part)
                if self.left:
                    return
                yield from self._whole()
                continue
            if self.fields is None:
                if not self.head:
                    data = data.lstrip(b"\r\n")
                self.head += data
                data = b""
                head, found, rest = self.head.partition(SEPARATOR.encode())
                if found:
                    self.head, data = b"", rest
                    yield from self._begin(head)

    def _begin(self, head: bytes) -> Iterator[dict]:
        lines = head.decode("utf-8").split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        self.left = int(fields["Content-Length"])
        if fields["WARC-Type"] == "continuation":
            if self.open is None or self.open["fields"]["WARC-Record-ID"] != fields["WARC-Record-ID"]:
                raise ValueError(f"a segment of {fields['WARC-Record-ID']} has no first record before it")
        else:
            yield from self.end()
            self.open = {"fields": fields, "sha1": hashlib.sha1(), "seen": 0}
        if not self.left:
            yield from self._whole()

    def _whole(self) -> Iterator[dict]:
        """The open record, if its payload is complete."""
        f = self.open["fields"]
        if f["WARC-Type"] == "revisit" or self.open["seen"] == int(f["X-Payload-Length"]):
            yield from self.end()

    def end(self) -> Iterator[dict]:
        if self.open is None:
            return
        f, got = self.open["fields"], self.open
        self.open = None
        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if f["WARC-Type"] == "response" and (base64.b32encode(got["sha1"].digest()).decode() != digest or got["seen"] != int(f["X-Payload-Length"])):
            raise ValueError(f"the payload of {f['WARC-Record-ID']} is damaged")
        number = lambda urn: None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])
        yield {"page_id": number(f["WARC-Record-ID"]), "payload_bytes": int(f["X-Payload-Length"]), "payload_digest": digest, "record_type": f["WARC-Type"], "refers_to": number(f.get("WARC-Refers-To"))}


def read_archives(spark: SparkSession, at: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, payloads checked."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, file, rows = Parser(), None, []
        for b in batches:
            for piece, name in zip(b.column(0).cast(pa.binary()), b.column(1)):
                if (n := name.as_py()) != file:
                    rows += parser.end()
                    parser, file = Parser(), n
                rows += parser.feed(piece.as_py() or b"")
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        rows += parser.end()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    pieces = spark.read.option("lineSep", SEPARATOR).option("recursiveFileLookup", "true").schema("value string").text(at)
    return pieces.select("value", F.col("_metadata.file_path").alias("file")).mapInArrow(parse, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), at)
    return read_archives(spark, at)
