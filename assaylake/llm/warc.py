"""Content-addressed WARC archive.

``write_archive`` stores two Parquet tables below one folder: ``payloads``, where the bytes of each distinct payload stand
once under their SHA-256, and ``headers``, where every record keeps the exact bytes of its own header block. Equal
payloads are one response, the record with the largest page_id, and revisits that refer to it. ``read_archive`` puts the
records together again: it compares each stored payload with its address and joins headers to payloads by address.
``archive_index`` reads its columns from these records alone: a response's length and digest are those of the bytes behind
its header, and have to be what the header says; a revisit takes them from the record that it refers to.

Only SQL functions run. Equal payloads are folded where they are read before they are moved, and a digest that a third of
all pages share is one row on the payload side; revisits of one response are dealt over shares.

Defined cases: a null html is the empty payload; a null url is the empty URI; a record with a null page_id comes after all
others, so it revisits where an equal payload has a page_id, and where none has one of them is the response and the others
refer to it with no page_id; rows that repeat a page_id and payload give one response, the first by url, and revisits,
each with its own url; every record has an id of its own; payloads of any length are kept whole;
an empty table gives empty archives; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import join_hot, shared_folder, written

CRLF = "\r\n"


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 given in hex: 20 bits are five hex digits and four of base32."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _addressed(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        payload.alias("payload"),
    ).withColumn("address", F.sha2("payload", 256))


def _header(kind: str, date: Column) -> Column:
    """The header block up to and with its empty line. A revisit's own block is empty.

    The id of a response that revisits may refer to (``named``) follows from its page and address; all others are random."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    response = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("-")), F.lit(":"), F.substring("address", 1, 32), F.lit(">"))
    own = F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    lines = [
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.lit(kind)),
        line("WARC-Record-ID", F.when(F.col("named"), response(F.col("page_id"))).otherwise(own)),
        line("WARC-Date", date),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
    ]
    if kind == "revisit":
        lines += [
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", response(F.col("owner"))),
            line("Content-Length", F.lit("0")),
        ]
    else:
        lines += [line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("payload_bytes").cast("string"))]
    return F.concat(*lines, F.lit(CRLF))


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, date: str | None = None) -> None:
    """Payloads below ``least_bytes`` are responses of their own. ``date`` is the records' WARC-Date, by default now."""
    rows = _addressed(pages)
    shared = F.octet_length("payload") >= least_bytes
    small = written(rows.select("page_id", "url", "address", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("digest"), shared.alias("shared")), "warc-rows")
    owners = small.filter("shared").groupBy("address").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("k"))
    joined = join_hot(small.filter("shared"), owners, "address", "k", small.count())
    # rows that repeat the owner's page_id and payload: the first by url is the response; equal rows are counted, so that no
    # group is ranked in one task, and each keeps its own url
    tied = joined.filter("page_id <=> owner").groupBy("address", "owner", "url", "payload_bytes", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = tied.groupBy("address").agg(F.min("url").alias("first"))
    mine = tied.join(first, "address").select(F.col("owner").alias("page_id"), "url", "address", "payload_bytes", "digest", "owner", (F.col("url") == F.col("first")).alias("leads"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    names = ["page_id", "url", "address", "payload_bytes", "digest", "owner"]
    records = (
        mine.select(*names, F.when(F.col("leads") & (F.col("k") == 1), "response").otherwise("revisit").alias("record_type"), (F.col("leads") & (F.col("k") == 1)).alias("named"))
        .unionByName(joined.filter("not page_id <=> owner").select(*names, F.lit("revisit").alias("record_type"), F.lit(False).alias("named")))
        .unionByName(small.filter(~F.col("shared")).withColumn("owner", F.col("page_id")).select(*names, F.lit("response").alias("record_type"), F.lit(False).alias("named")))
    )
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())  # formatted in the session's zone, it reads as UTC
    when = F.lit(date) if date else F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.when(F.col("record_type") == "revisit", _header("revisit", when)).otherwise(_header("response", when))
    records.select("page_id", "address", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{folder}/headers")
    # each distinct payload once; equal ones are folded before they are moved
    stored = rows.groupBy("address").agg(F.max("payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{folder}/payloads")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """address, payload of the store; fails where bytes do not hash to their address."""
    stored = spark.read.schema("address string, payload binary").parquet(f"{folder}/payloads")
    return stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))).cast("binary")))


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, address, header and the fields parsed from the header's bytes."""
    rows = spark.read.schema("page_id long, address string, header binary").parquet(f"{folder}/headers")
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return rows.select(
        "*",
        field("WARC-Type").alias("record_type"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
        F.expr("try_cast(regexp_extract(decode(header, 'UTF-8'), 'WARC-Refers-To: <urn:page:([^:>]*):', 1) as bigint)").alias("refers_to"),
    )


def with_bodies(heads: DataFrame, bodies: DataFrame) -> DataFrame:
    """Response headers joined with their payloads. Where small payloads aren't shared an address may have many responses: those
    of over a thousandth of all, fewer than 1000, are dealt over shares."""
    shares = F.ceil(F.col("k") * 1000 / F.lit(max(heads.count(), 1))).cast("int")
    hot = F.broadcast(heads.groupBy("address").agg(F.count(F.lit(1)).alias("k")).select("address", shares.alias("shares")).filter("shares > 1"))
    n = F.coalesce("shares", F.lit(1))
    dealt = heads.join(hot, "address", "left").withColumn("share", F.pmod(F.xxhash64("page_id", "header"), n).cast("int")).drop("shares")
    copies = bodies.join(hot, "address", "left").select("address", "payload", F.explode(F.sequence(F.lit(0), n - 1)).alias("share"))
    return dealt.join(copies, ["address", "share"])


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record: the original WARC records, header block, payload (none in a revisit) and the two closing line ends."""
    heads, end = read_headers(spark, folder), F.encode(F.lit(CRLF * 2), "UTF-8")
    full = with_bodies(heads.filter("record_type = 'response'"), read_payloads(spark, folder)).select("page_id", F.concat("header", "payload", end).alias("record"))
    return full.unionByName(heads.filter("record_type = 'revisit'").select("page_id", F.concat("header", end).alias("record")))


def parsed(records: DataFrame) -> DataFrame:
    """page_id, kind, id, refers, stated (digest), length and digest of the block, from the bytes of records (page_id, record).

    Fails where a block is not as long as its header says, or a response's digest is another."""
    latin = F.decode("record", "ISO-8859-1")  # one character a byte
    cut = records.select("page_id", "record", (F.instr(latin, CRLF * 2) - 1).alias("at")).withColumn("head", F.decode(F.substring("record", F.lit(1), F.col("at") + 2), "UTF-8"))
    field = lambda name: F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    body = F.substring("record", F.col("at") + 5, F.octet_length("record") - F.col("at") - 8)
    got = cut.select("page_id", field("WARC-Type").alias("kind"), field("WARC-Record-ID").alias("id"), field("WARC-Refers-To").alias("refers"), F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("stated"), field("Content-Length").cast("long").alias("length"), body.alias("body"))
    right = (F.octet_length("body") == F.col("length")) & ((F.col("kind") == "revisit") | (base32(F.sha1("body")) == F.col("stated")))
    stated = F.when(right, F.col("stated")).otherwise(F.raise_error(F.concat(F.lit("header and payload differ: "), F.col("id"))).cast("string"))
    return got.select("page_id", "kind", "id", "refers", stated.alias("stated"), "length")


def archive_index(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read from the records as they are put together again."""
    rows = written(parsed(read_archive(spark, folder)), "warc-records")
    out = ["page_id", F.col("length").alias("payload_bytes"), F.col("stated").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"]
    own = rows.filter("kind = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    again = rows.filter("kind = 'revisit'").select("page_id", "kind", "stated", F.col("refers").alias("id"))
    times = again.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    facts = rows.filter("kind = 'response'").select("id", F.col("page_id").alias("refers_to"), "length", F.col("stated").alias("full")).join(times, "id")
    j = join_hot(again, facts, "id", "k", rows.count())
    same = F.when(F.col("stated") == F.col("full"), F.col("stated")).otherwise(F.raise_error(F.concat(F.lit("revisit of other bytes: "), F.col("id"))).cast("string"))
    return own.select(*out).unionByName(j.withColumn("stated", same).select(*out))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archive to the shared folder and returns its index as read back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archive(pages, folder)
    return archive_index(spark, folder)


ORACLE_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages
), d as (
  select *, row_number() over (partition by html order by page_id desc) as k, max(page_id) over (partition by html) as owner from p
)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(1 + ((cast('0x' || substr(h, cast(1 + 5 * (i // 4) as integer), 5) as bigint) >> cast(15 - 5 * (i % 4) as integer)) & 31) as integer), 1)), '') as payload_digest,
  case when k = 1 then 'response' else 'revisit' end as record_type,
  case when k = 1 then null else owner end as refers_to
from d
"""
