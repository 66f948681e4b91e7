"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, bucketed by digest, apart
from a table with the exact header bytes of every record (WARC header and, in
front of the payload, the HTTP head). A record is header + payload + two line
ends; ``reconstruct`` joins the two tables by digest. The reader recomputes every
digest and length from the stored bytes and fails on a difference.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with
the smallest id is the response and the others revisit it; smaller payloads are
all responses, though their bytes too are stored once.

Defined cases: a null html is an empty payload; payloads of any length are stored whole; a null url is
written as an empty target, and control characters of a url percent-encoded, so no url can end a header line; rows with a null id are never the response that others refer to unless
their payload has no other id (then all are responses); rows that repeat with the smallest id are all
responses; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.llm._shared import Scratch

REVISIT_BYTES = 100
#: Fixed values of the WARC 1.1 format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "1970-01-01T00:00:00Z"

_HEADERS = "record_id long, header binary, digest string, refers_to long"
_CONTROLS = [*range(0x20), 0x7F]
_PAYLOADS = "digest string, payload binary"


def _uuid(record_id: Column) -> Column:
    """A stable record URN from the id."""
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(record_id.cast("string"), F.lit("null"))))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">"))


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in pairs))


def _target(url: Column) -> Column:
    """A url as it may stand in a header: control characters, line ends among them, percent-encoded."""
    out = url
    for code in _CONTROLS:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x1F\x7F]"), out).otherwise(url)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", scratch: Scratch | None = None) -> None:
    """Write ``path``/payloads and ``path``/headers."""
    scratch = scratch or Scratch(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(f"`{body_col}`").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("record_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))

    # headers: one small row a record; the largest table that moves has no payload
    index = scratch.write(rows.select("record_id", "url", "digest", "bytes"), "index")
    long = index.where(F.col("bytes") >= REVISIT_BYTES)
    first = scratch.write(long.groupBy("digest").agg(F.min("record_id").alias("first")), "first")
    # small payloads, the empty one of a third of all pages among them, need no join
    short = index.where(F.col("bytes") < REVISIT_BYTES).withColumn("first", F.lit(None).cast("long"))
    known = long.join(first, "digest").unionByName(short)
    revisit = (F.col("bytes") >= REVISIT_BYTES) & F.coalesce(F.col("record_id") != F.col("first"), F.col("first").isNotNull())
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("bytes").cast("string"))), F.lit("\r\n"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    refers = F.when(revisit, F.concat(_lines(("WARC-Refers-To", _uuid(F.col("first"))), ("WARC-Profile", F.lit(PROFILE))), _lines(("X-Refers-To-Record", F.col("first").cast("string"))))).otherwise(F.lit(""))
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _lines(
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", _uuid(F.col("record_id"))),
            ("WARC-Date", F.lit(WARC_DATE)),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", length.cast("string")),
        ),
        refers,
        _lines(("WARC-Target-URI", _target(F.col("url")))),
        F.lit("\r\n"),
        http,
    )
    known.select("record_id", F.encode(header, "utf-8").alias("header"), "digest", F.when(revisit, F.col("first")).alias("refers_to")).write.option("compression", "zstd").parquet(f"{path}/headers")

    # payloads: rows of one digest fold into one before they move, so copies cost no shuffle
    stored = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload, payload_bytes, payload_digest) with every digest verified."""
    rows = spark.read.schema(_PAYLOADS).parquet(f"{path}/payloads").withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    bad = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest")))
    return rows.withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("digest"), F.col("payload_digest")).otherwise(bad.cast("string")))


def _agree(value: Column, ok: Column, what: str) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"{what} of record "), F.coalesce(F.col("record_id").cast("string"), F.lit("null"))))
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(bad.cast("string"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header table with the fields parsed from the header bytes; they have to agree with the
    digest and the reference that the table keeps beside them."""
    rows = spark.read.schema(_HEADERS).parquet(f"{path}/headers")
    text = F.decode("header", "utf-8")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    digest, refers = F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", ""), field("X-Refers-To-Record").cast("long")
    same = (digest == F.col("digest")) & refers.eqNullSafe(F.col("refers_to")) & ((field("WARC-Type") == "revisit") == F.col("refers_to").isNotNull())
    return rows.select("record_id", "header", "digest", _agree(field("WARC-Type"), same, "header contradicts the index").alias("record_type"), "refers_to", field("Content-Length").cast("long").alias("content_length"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: its parsed fields, its payload and, as ``record``, its
    exact bytes (a revisit's own bytes end with its header). A payload that is not there, or a record whose
    length is not the one that its header states, fails."""
    joined = read_headers(spark, path).join(read_payloads(spark, path), "digest", "left")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    joined = joined.withColumn("record", F.concat(F.col("header"), body, F.lit(b"\r\n\r\n")))
    block = F.octet_length("record") - F.instr(F.decode("header", "iso-8859-1"), "\r\n\r\n") - 3 - 4
    there = F.col("payload").isNotNull() & (block == F.col("content_length"))
    return joined.withColumn("payload_digest", _agree(F.col("payload_digest"), there, "no payload, or one of another length,")).drop("content_length")
