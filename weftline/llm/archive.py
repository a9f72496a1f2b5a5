"""Content-addressed WARC archive: payload bytes once by strong digest, exact record headers beside them, records back by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import shared_path

#: RFC 4648 alphabet (fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def base32_sha1(content: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four letters."""
    digits = F.sha1(content)
    letter = lambda v, shift: F.substring(F.lit(BASE32), (F.shiftright(v, shift).bitwiseAND(F.lit(31).cast("long")) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substring(digits, g * 5 + 1, F.lit(5)), 16, 10).cast("long")), lambda v: F.concat(*(letter(v, s) for s in (15, 10, 5, 0)))), "")


def record_id(page: Column) -> Column:
    """A repeatable urn:uuid from the page id."""
    h = F.md5(F.coalesce(page.cast("string"), F.lit("null")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def headers(page: Column, url: Column, kind: Column, refers_to: Column, digest: Column, length: Column, date: str) -> Column:
    """The exact header block of a record, with the empty line that ends it."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    one_line = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", "")
    return F.concat(
        F.lit(f"WARC/1.1{END}"), field("WARC-Type", kind), field("WARC-Record-ID", record_id(page)), field("WARC-Date", F.lit(date)), field("WARC-Target-URI", one_line),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(refers_to.isNotNull(), F.concat(field("WARC-Refers-To", record_id(refers_to)), field("WARC-Refers-To-Page", refers_to.cast("string")), field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        F.when(page.isNotNull(), field("WARC-Page-ID", page.cast("string"))).otherwise(F.lit("")),
        field("Content-Type", F.lit("text/html; charset=utf-8")), field("Content-Length", length.cast("string")), F.lit(END))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write `path`/payloads (digest, payload) and `path`/records (digest, header).

    Payloads are grouped by SHA-256 and by their bytes, so two payloads never share an entry by their digest alone; one digest with
    two payloads ends the job. Map tasks fold copies before the shuffle. Of records with equal payloads of at least
    `min_revisit_bytes`, the one with the largest page id is the response and the others refer to it; smaller payloads make no
    revisits, and every record still finds its bytes.

    Defined results: null html is the empty payload; a null page id can only be the response where all ids of its group are null;
    repeated rows of the largest id are all responses; line breaks are taken out of urls, a null url is empty.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("_page"), F.col(url).alias("_url"), payload.alias("payload"))
    stored = rows.groupBy(F.sha2("payload", 256).alias("digest"), "payload").agg(F.max("_page").alias("_response")).select(
        "digest", "payload", "_response", F.octet_length("payload").alias("_bytes"), base32_sha1(F.col("payload")).alias("_sha1"))
    stored.write.parquet(f"{path}/payloads")
    entries = pages.sparkSession.read.parquet(f"{path}/payloads").groupBy("digest").agg(
        F.when(F.count(F.lit(1)) == 1, F.struct(F.max("_response").alias("response"), F.max("_bytes").alias("bytes"), F.max("_sha1").alias("sha1"))).otherwise(F.raise_error(F.lit("two payloads share a SHA-256 digest"))).alias("_e"))
    found = rows.select("_page", "_url", F.sha2("payload", 256).alias("digest")).join(entries, "digest")
    is_revisit = (F.col("_e.bytes") >= min_revisit_bytes) & ~F.col("_page").eqNullSafe(F.col("_e.response"))
    refers = F.when(is_revisit, F.col("_e.response"))
    block = headers(F.col("_page"), F.col("_url"), F.when(is_revisit, "revisit").otherwise("response"), refers, F.col("_e.sha1"), F.col("_e.bytes"), date)
    found.select("digest", block.cast("binary").alias("header")).write.parquet(f"{path}/records")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: exact header block, payload, and the whole `record` in WARC form (a revisit carries no block of its own).

    The payload's length, SHA-1 and SHA-256 are taken from the bytes read back, once per stored payload; they must agree with every header
    and with the digest under which the payload is stored.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    stored = payloads.withColumn("_bytes", F.octet_length("payload").cast("long")).withColumn("_sha1", base32_sha1(F.col("payload"))).withColumn("_sha256", F.sha2("payload", 256))
    rows = spark.read.parquet(f"{path}/records").join(stored, "digest")
    text = F.col("header").cast("string")
    named = lambda name: F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    agree = (named("Content-Length").cast("long") == F.col("_bytes")) & (named("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("_sha1"))) & (F.col("digest") == F.col("_sha256"))
    revisit = named("WARC-Type") == "revisit"
    end = F.lit(f"{END}{END}").cast("binary")
    return rows.select(
        named("WARC-Page-ID").cast("long").alias("page_id"), named("WARC-Target-URI").alias("url"),
        F.when(agree, F.col("_bytes")).otherwise(F.raise_error(F.lit("a stored payload does not match its record header"))).alias("payload_bytes"),
        F.col("_sha1").alias("payload_digest"), named("WARC-Type").alias("record_type"), named("WARC-Refers-To-Page").cast("long").alias("refers_to"),
        "header", "payload", F.concat(F.col("header"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), end).alias("record"))


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write an archive of `pages` to the shared folder and read its records back."""
    path = shared_path(pages.sparkSession, "archive")
    write_archive(pages, path, **options)
    return read_records(pages.sparkSession, path)
