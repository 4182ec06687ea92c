"""Content-addressed WARC archive (operator 11).

An archive is a folder of two tables.  ``payloads`` holds each distinct payload once, under
its address: the SHA-256 of the bytes, with a number behind it where different bytes share
the digest.  ``headers`` holds the exact header bytes of every record and the address of its
payload.  A record is put together again by joining the two.

Equal digests are verified: payloads whose digest repeats are grouped by their bytes, and on
reading every stored payload is hashed again and held against its address and its headers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlake.llm.common import join_copies, shared_path, small_side, stage

# Headers of one payload that meet in a task when records are put together.
SALT_ROWS = 10_000
CRLF = "\r\n"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def sha256(payload: Column) -> Column:
    return F.sha2(payload, 256)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 bytes (10 hex digits) are 8 digits of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _header(date: str) -> Column:
    """Header of a record and of the HTTP response in it, from the columns of a linked record."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("refers")
    body = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        # a line break inside an address would end its header line
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")),
                                                       F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("holder")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), body.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http)


def write_archive(records: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
                  least: int = 0, date: str = "1970-01-01T00:00:00Z", digest: Callable[[Column], Column] = sha256) -> None:
    """Write one record a row of ``records`` into the archive at ``path``.

    Of records with equal payloads of at least ``least`` bytes the one with the largest id is
    the response and the others revisit it; smaller payloads are all responses.  Every payload
    is stored once.  Null payloads are empty ones; a null id counts as smallest, and rows that
    repeat the largest id are all responses.  Line breaks in addresses are written as %0D and
    %0A.  Payloads may have any length that a row can hold; an empty table gives an empty
    archive.  Further columns are not looked at.
    """
    rows = records.select(F.col(id_col).cast("long").alias("page_id"),
                          F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
                          F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumn("sha", digest(F.col("payload")))
    marks = stage(rows.select("page_id", "url", "sha", F.octet_length("payload").cast("long").alias("n_bytes"),
                              base32_sha1(F.col("payload")).alias("digest")))
    total = marks.count()
    again = stage(marks.groupBy("sha").agg(F.count("*").alias("copies")).where("copies > 1"))

    # payloads whose digest repeats are told apart by their bytes; copies meet in a task before the shuffle
    same = Window.partitionBy("sha")
    equal = stage(join_copies(rows, again, "sha", "left_semi", total)
                  .groupBy("sha", "payload").agg(F.max("page_id").alias("holder"), F.count("*").alias("copies"))
                  .withColumn("slot", F.row_number().over(same.orderBy("payload")))
                  .withColumn("slots", F.count("*").over(same)))
    address = F.when(F.col("slots") > 1, F.concat("sha", F.lit("."), F.col("slot"))).otherwise(F.col("sha"))
    once = join_copies(rows, again, "sha", "left_anti", total)
    (once.select(F.col("sha").alias("address"), "payload", F.lit(1).cast("long").alias("copies"))
     .unionByName(equal.select(address.alias("address"), "payload", "copies"))
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))

    narrow = equal.select("sha", "payload", address.alias("address"), "slots", "holder", "copies")
    collided = narrow.where("slots > 1")
    linked = marks
    if collided.limit(1).count():  # different bytes under one digest: their records are found by the bytes
        linked = marks.join(small_side(stage(collided.select("sha").distinct())), "sha", "left_anti")
    side = stage(narrow.where("slots = 1").select("sha", "address", "holder", "copies"))
    linked = join_copies(linked, side, "sha", "left", total)
    if collided.limit(1).count():
        by_bytes = (rows.join(collided, ["sha", "payload"])
                    .select("page_id", "url", "sha", F.octet_length("payload").cast("long").alias("n_bytes"),
                            base32_sha1(F.col("payload")).alias("digest"), "address", "holder", "copies"))
        linked = linked.unionByName(by_bytes)
    shared = F.col("copies").isNotNull() & (F.col("n_bytes") >= F.lit(least))
    linked = linked.withColumn("refers", shared & ~F.col("page_id").eqNullSafe(F.col("holder")))
    salts = F.ceil(F.coalesce("copies", F.lit(1)) / F.lit(SALT_ROWS))
    (linked.select(F.encode(_header(date), "UTF-8").alias("header"), F.coalesce("address", "sha").alias("address"),
                   F.floor(F.rand(11) * salts).cast("int").alias("salt"))
     .write.option("compression", "zstd").parquet(f"{path}/headers"))


def read_archive(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row a record: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, record``.

    ``payload`` is the whole payload, of revisits too; ``record`` holds the record's own bytes,
    in which a revisit has none.  Bytes that do not fit their address or the digest in the
    header are an error.  A payload that many records share is dealt to as many tasks as its
    records ask for.
    """
    payload, wrong = F.col("payload"), lambda what: F.raise_error(F.concat(F.lit(f"{what} differs at "), F.col("address")))
    stored = (spark.read.parquet(f"{path}/payloads")
              .withColumn("payload_digest", F.when(F.substring_index("address", ".", 1) == digest(payload),
                                                   base32_sha1(payload)).otherwise(wrong("payload")))
              .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("copies") / F.lit(SALT_ROWS)) - 1).cast("int")))))
    rows = spark.read.parquet(f"{path}/headers").join(stored, ["address", "salt"])
    text = F.decode("header", "UTF-8")

    def field(name: str, value: str = "([^\r\n]*)") -> Column:
        return F.nullif(F.regexp_extract(text, f"(?md)^{name}: {value}\r$", 1), F.lit(""))
    named = F.coalesce(field("WARC-Payload-Digest", "sha1:(.*)"), F.lit(""))
    kind = field("WARC-Type")
    return rows.select(
        field("WARC-Record-ID", "<urn:page:(.*)>").cast("long").alias("page_id"), field("WARC-Target-URI").alias("url"),
        kind.alias("record_type"), field("WARC-Refers-To", "<urn:page:(.*)>").cast("long").alias("refers_to"), "payload_bytes",
        F.when(named == F.col("payload_digest"), named).otherwise(wrong("digest")).alias("payload_digest"), "payload",
        F.concat("header", F.when(kind == "response", payload).otherwise(F.lit(b"")), F.lit(CRLF.encode() * 2)).alias("record"))


def op11_warc_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all ``pages`` under the shared folder and reads the archive back."""
    path = shared_path(spark)
    write_archive(pages(spark, sf_dir), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder FROM pages
), d AS (
  SELECT *, sha1(payload) AS h FROM p
)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
         ((CAST('0x' || substr(h, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '')
         AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM d
"""
