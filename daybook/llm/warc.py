"""WARC archives with revisit records.

``resolve`` shuffles headers (page, digest, length; no payloads) by payload
digest and finds, for each digest of at least ``least`` bytes, the response
and the pages that revisit it. ``write`` puts one WARC/1.1 record per page, and a
warcinfo record, into gzip text files: a record is one row of Spark's text writer
whose line separator is the blank line that ends a WARC record, so tasks write,
commit and retry as in any Spark job. Revisit records are written from headers
alone. Payloads only move where a page's place shares a hash slot with a revisit
(``SLOTS`` bound what is broadcast); all others are written by the task that read
them. ``read`` splits the files at the archive's own record start, checks length
and digest of every record, and joins revisit records by record id to their
responses.

Of equal payloads the row with the largest page id is the response, among equal
ids the first in the scan; a null id is smaller than all others. Record ids
follow from a row's place in the scan, so repeated rows have their own. The
table must be one whose scan keeps its order, as files do. A null payload is
empty; a null URL gives an empty target. Line breaks and control characters in a
URL are percent-encoded. An empty table writes an archive with a warcinfo record
alone, which reads back empty. Other columns are not read.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.store import cut, place
from daybook.session import shared_folder

LEAST = 1000
#: Hash slots of places: at most so many numbers are broadcast.
SLOTS = 1 << 20
CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``place``, ``page_id``, ``url``, payload, ``payload_digest`` (hex SHA-1) and ``payload_bytes`` of every page."""
    body = F.coalesce(F.col(html), F.lit(""))
    return pages.select(
        place().alias("place"),
        F.col(page).cast("long").alias("page_id"),
        F.coalesce(F.col(url), F.lit("")).alias("url"),
        body.alias("payload"),
        F.sha1(F.encode(body, "utf-8")).alias("payload_digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
    )


def resolve(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``heads`` that revisit another one, with its ``refers_to`` (page id) and ``refers_place``.

    Grouping by digest is a partial and a final aggregate; the join back moves
    headers only, and splits a digest that a large part of all pages share,
    because the groups come from a written table.
    """
    large = heads.where(F.col("payload_bytes") >= least)
    groups = large.groupBy("payload_digest").agg(F.max(F.struct("page_id", (-F.col("place")).alias("back"))).alias("_r"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.where("n > 1").select("payload_digest", F.col("_r.page_id").alias("refers_to"), (-F.col("_r.back")).alias("refers_place")), "warc-groups")
    return large.join(groups, "payload_digest").where(F.col("place") != F.col("refers_place"))


def _record_id(archive: str, at: Column) -> Column:
    """A UUID from archive and place: a retried task writes the same record."""
    h = F.md5(F.concat_ws("|", F.lit(archive), at.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _start(archive: str) -> str:
    """What every record of one archive starts with: no payload can hold the fresh id by chance."""
    return f"WARC/1.1{CRLF}WARC-Warcinfo-ID: <urn:uuid:{archive}>{CRLF}"


def _info(archive: str) -> str:
    """What the record about the archive starts with."""
    return CRLF.join(("WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{archive}>", ""))


def _record(rows: DataFrame, archive: str, date: str, revisit: bool) -> DataFrame:
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")
    lines = [
        F.lit(f"WARC-Type: {'revisit' if revisit else 'response'}"),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(archive, F.col("place"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Source-Page: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))),
    ]
    if revisit:
        lines += [F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), _record_id(archive, F.col("refers_place")))]
    lines += [
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.lit(len(HTTP)) if revisit else F.lit(len(HTTP)) + F.col("payload_bytes")),
    ]
    block = F.lit(HTTP) if revisit else F.concat(F.lit(HTTP), F.col("payload"))
    return rows.select(F.concat(F.lit(_start(archive)), F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block).alias("value"))


def records(pages: DataFrame, archive: str, date: str, least: int = LEAST, **names: str) -> DataFrame:
    """One column ``value``: the whole record of a page, and one about the archive, without the blank line behind it."""
    full = headers(pages, **names)
    revisits = cut(resolve(cut(full.drop("payload"), "warc-heads"), least), "warc-revisits")
    slot = F.pmod(F.xxhash64("place"), F.lit(SLOTS))
    near = F.broadcast(cut(revisits.select(slot.alias("slot")).distinct(), "warc-slots"))
    # A place whose slot no revisit has is a response; only the rest is compared by a shuffle.
    clear = full.withColumn("slot", slot).join(near, "slot", "left_anti")
    others = full.withColumn("slot", slot).join(near, "slot", "left_semi").join(revisits.select("place"), "place", "left_anti")
    columns = ["place", "page_id", "url", "payload", "payload_digest", "payload_bytes"]
    about = CRLF.join(("software: daybook", "format: WARC File Format 1.1", "conformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/", ""))
    info = _info(archive) + CRLF.join((f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(about)}", "", about))
    pages_ = _record(clear.select(*columns).unionByName(others.select(*columns)), archive, date, False).unionByName(_record(revisits, archive, date, True))
    return pages_.unionByName(pages.sparkSession.range(1).select(F.lit(info).alias("value")))


def write(pages: DataFrame, path: str | None = None, date: str | None = None, least: int = LEAST, **names: str) -> tuple[str, str]:
    """Write the archive; returns its folder and id, which ``read`` needs. ``date`` is the time of the call unless given."""
    archive = str(uuid.uuid4())
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    path = path or shared_folder(pages.sparkSession, "warc")
    out = records(pages, archive, date, least, **names)
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
    return path, archive


def parse(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Every record of an archive: its named headers, its payload and the checks of length and digest."""
    raw = spark.read.option("lineSep", _start(archive)).text(path)
    # The warcinfo record has no such start: it is a row of its own, or behind another record.
    raw = raw.select(F.substring_index("value", _info(archive), 1).alias("value")).where("value != ''")
    at = F.instr("value", CRLF * 2)
    cut_up = raw.select(F.substring_index("value", CRLF * 2, 1).alias("head"), F.expr("encode(substr(value, {0}), 'utf-8')".format("instr(value, '\\r\\n\\r\\n') + 4")).alias("rest"), at.alias("at"))

    def header(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))

    length = header("Content-Length").cast("long")
    heads = cut_up.select(
        header("WARC-Type").alias("record_type"),
        header("WARC-Record-ID").alias("record_id"),
        header("WARC-Refers-To").alias("refers_to_id"),
        header("WARC-Target-URI").alias("url"),
        F.when(header("WARC-Source-Page") != "null", header("WARC-Source-Page")).cast("long").alias("page_id"),
        F.regexp_extract("head", "WARC-Payload-Digest: sha1:([0-9a-f]{40})", 1).alias("payload_digest"),
        (F.octet_length("rest") == length + 4).alias("length_ok"),
        F.expr(f"substring(rest, {len(HTTP) + 1}, octet_length(rest) - {len(HTTP) + 4})").alias("payload"),
    )
    digest = F.sha1("payload") == F.col("payload_digest")
    return heads.withColumn("digest_ok", (F.col("record_type") == "revisit") | digest)


def read(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, intact`` of every record.

    A revisit record gets the length from the response it refers to, found by
    record id; ``intact`` is false where length, digest or that response fail.
    """
    found = parse(spark, path, archive).withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload", "url")
    found = cut(found, "warc-headers")
    revisits = found.where("record_type = 'revisit'")
    originals = found.where("record_type = 'response'").join(revisits.select(F.col("refers_to_id").alias("record_id")).distinct(), "record_id", "left_semi")
    originals = cut(originals.groupBy("record_id").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("_bytes"), F.max("payload_digest").alias("_digest")), "warc-originals")
    resolved = revisits.join(originals.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left").select(
        "page_id", F.col("_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to",
        (F.col("length_ok") & F.coalesce(F.col("_digest") == F.col("payload_digest"), F.lit(False))).alias("intact"),
    )
    responses = found.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"),
        (F.col("length_ok") & F.col("digest_ok")).alias("intact"),
    )
    return responses.unionByName(resolved)
