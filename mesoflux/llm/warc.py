"""WARC archives with revisit resolution.

``write_archive`` lays records out as WARC/1.1 text and has Spark's text writer put them into gzip files of the shared store;
``read_archive`` has Spark stream the files back, cut at version lines, and joins what was cut within a payload by its Content-Length,
so no file is held as a whole. ``resolve`` shuffles the headers, never the payloads, by payload digest, finds each digest's original
response and joins the others to it; ``deduplicate`` writes the archive anew, with fresh headers, revisit records without payload.

Every record has an id of its own, repeated rows included; a revisit names its original's record and page. A file holds whole records
in one gzip stream, so a reader goes through it in order.

Odd input: a null payload counts as empty and an empty one as any other payload. Line breaks in a url are percent-encoded, since
they would end its header. Of equal payloads the least page_id is the original; rows that repeat that page_id with that payload
are all responses; a null page_id is never an original unless all of its group are null, and then every row is a response. An
empty table gives an empty archive and result. Only page_id, url and html are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, rekey

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_BYTES = 0
RECORDS_PER_FILE = 1000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

SCHEMA = "record_id string, page_id long, uri string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, payload string"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: 40 hex digits are 8 groups of 20 bits, each 4 digits of base 32."""
    hexed = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.upper(F.conv(F.substring(hexed, 1 + 5 * k, 5), 16, 32)), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _CONV32, _BASE32)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def record() -> Column:
    """One record, from columns of ``SCHEMA``, without its very last line break, which the text writer adds."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    safe = F.replace(F.replace(text("uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    original = F.concat(
        _header("WARC-Profile", F.lit(PROFILE)), _header("WARC-Refers-To", F.concat(F.lit("<"), text("refers_to_record"), F.lit(">"))), _header("WARC-Refers-To-Page", text("refers_to"))
    )
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        _header("WARC-Page", text("page_id")),
        _header("WARC-Date", F.col("date")),
        _header("WARC-Target-URI", safe),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, original).otherwise(F.lit("")),
        _header("WARC-Full-Payload-Length", text("payload_bytes")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _header("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
        F.lit("\r\n\r"),
    )


def write_archive(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """``records``: columns of ``SCHEMA``."""
    (
        records.select(record().alias("value")).write.option("lineSep", "\n").option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", per_file).text(path)
    )


def parse(pieces):
    """(headers, payload) of each record; ``pieces`` are what lies between version lines, in order, a payload's own ones included."""
    mark, whole = f"{VERSION}\r\n".encode(), None
    for piece in pieces:
        whole = piece if whole is None else whole + mark + piece
        if not whole.strip():
            whole = None
            continue
        head, gap, rest = whole.partition(b"\r\n\r\n")
        headers = {}
        for line in head.split(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.removeprefix(" ")
        size = int(headers["Content-Length"])
        if len(rest) < size + 2 * gap.count(b"\r\n"):
            continue  # the payload holds a version line
        yield headers, rest[:size]
        whole = None
    if whole is not None:
        raise ValueError("a record is cut short")


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``SCHEMA`` rows; without ``payloads`` only headers, the payload being null."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in SCHEMA.split(", ")]
    number = lambda text: int(text) if text else None

    def run(batches):
        rows, held = [], 0
        for h, body in parse(v.encode() for b in batches for v in b.column("value").to_pylist()):
            original = h.get("WARC-Refers-To")
            rows.append((h["WARC-Record-ID"][1:-1], number(h["WARC-Page"]), h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Type"], int(h["WARC-Full-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"),
                         number(h.get("WARC-Refers-To-Page")), original and original[1:-1], body.decode("utf-8", "replace") if payloads else None))
            held += 1000 + len(body) * payloads
            if held > 1 << 24:
                yield _batch(rows, names, kinds)
                rows, held = [], 0
        if rows:
            yield _batch(rows, names, kinds)

    return spark.read.option("lineSep", f"{VERSION}\r\n").text(path).mapInArrow(run, SCHEMA)


def _batch(rows, names, kinds):
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def crawl_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A response record for every page. Record ids come from the row's number, so that equal rows have different ones."""
    html = F.coalesce("html", F.lit(""))
    uuid = F.regexp_replace(F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.monotonically_increasing_id())), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    return pages.select(
        F.concat(F.lit("urn:uuid:"), uuid).alias("record_id"), F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("uri"), F.lit(date).alias("date"), F.lit("response").alias("record_type"),
        F.octet_length(html).cast("long").alias("payload_bytes"), base32_sha1(html).alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_to_record"), html.alias("payload"),
    )


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(record_id, page_id, payload_digest, payload_bytes, original, original_record) of every revisit record.

    Headers alone are shuffled. The least page_id of a digest is found with map-side aggregation, and digests that occur once are
    gone before the join; adaptive execution splits a hot digest there.
    """
    big = headers.where(F.col("payload_bytes") >= min_bytes).select("record_id", "page_id", "payload_digest", "payload_bytes")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id")))
    least = big.groupBy("payload_digest", "payload_bytes").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    least = least.select(rekey(F.col("payload_digest")).alias("d"), F.col("payload_bytes").alias("b"), F.col("first.page_id").alias("original"), F.col("first.record_id").alias("original_record"))
    joined = big.join(least, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")))
    return joined.where(F.coalesce(F.col("page_id") != F.col("original"), F.col("original").isNotNull())).drop("d", "b")


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES) -> None:
    """Read the archive at ``source``, write it at ``target`` with revisit records in place of repeated payloads.

    The revisits, found from headers alone, are joined back by record id; that is the one step that moves payloads.
    """
    headers = materialize(digested(read_archive(spark, source)).drop("payload"), "headers")
    marks = resolve(headers, min_bytes).select(F.col("record_id").alias("of"), "original", "original_record")
    joined = digested(read_archive(spark, source)).join(marks, F.col("record_id") == F.col("of"), "left")
    fresh = {"record_type": F.when(F.col("of").isNull(), "response").otherwise("revisit"), "refers_to": F.col("original"), "refers_to_record": F.col("original_record")}
    write_archive(joined.withColumns(fresh), target)


def digested(records: DataFrame) -> DataFrame:
    """Digest and size are taken from the payload itself, not from what a header says."""
    return records.withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
