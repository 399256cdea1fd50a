"""WARC archives with revisit resolution.

``write_archive`` puts records into WARC/1.1 files, ``read_archive`` parses them by their Content-Length, and
``deduplicate`` turns repeated payloads into revisit records: record *headers* alone are shuffled by payload digest, the
largest key of a digest keeps its response, and new archives are written in which the others are revisits that refer to
it. ``resolve`` joins revisits read from archives back to their responses.

Files are written by Spark's own writer, so that any store Spark reaches will do; each record is a gzip member of its own.
Writers commit by task, so a lost executor leaves no half archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import fresh_path, mapped, written

#: Payloads below this many bytes stay responses.
MIN_REVISIT_BYTES = 1000
#: Bounds the size of one archive file, which a reader's task holds compressed.
RECORDS_PER_FILE = 2_000
#: Fixed value: the WARC revisit profile for equal payload digests.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stated in each record; the tables hold no crawl time.
DATE = "1970-01-01T00:00:00Z"

HEADER_FIELDS = "archive string, place long, record_id string, record_key string, record_type string, target_uri string, refers_to_id string, header_digest string, payload_bytes long, payload_digest string"


def _record(record_type: str, record_id, key, uri, body, length, digest, refers=None, refers_uri=None):
    """Columns head and body of a record; ``refers``: id of the record that a revisit refers to."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    parts = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {record_type}\r\n"),
        line("WARC-Record-ID", record_id),
        line("WARC-Date", F.lit(DATE)),
        F.when(uri.isNotNull(), line("WARC-Target-URI", uri)).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(key.isNotNull(), line("Record-Key", key)).otherwise(""),
    ]
    if refers is not None:
        parts += [
            F.lit(f"WARC-Profile: {PROFILE}\r\n"),
            line("WARC-Refers-To", refers),
            F.when(refers_uri.isNotNull(), line("WARC-Refers-To-Target-URI", refers_uri)).otherwise(""),
            line("WARC-Refers-To-Date", F.lit(DATE)),
        ]
    return F.concat(*parts, F.lit("Content-Type: text/html\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n")).alias("head"), body.cast("binary").alias("body")


def _urn(key, digest):
    """A record id that follows from key and payload: name-based, so that a task run again writes the same, and rows that
    repeat a key with another payload are records of their own."""
    h = F.sha2(F.concat(digest, F.coalesce(F.concat(F.lit("|"), key), F.lit(""))), 256)
    return F.concat(F.lit("<urn:uuid:"), *(x for i, n, s in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, "")) for x in (F.substring(h, i, n), F.lit(s))), F.lit(">"))


def _clean(uri):
    """A URI without characters that would end its header line."""
    return F.regexp_replace(uri, "[\\r\\n]+", " ")


def _member(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def write_archive(records: DataFrame, path: str) -> None:
    """Write records (head, body) as WARC files, two line ends after each record, and a gzip member for each.

    The text writer takes bytes as they are and ends each row by a separator. A member's last byte is the highest one of
    its length, so zero below 16 MB: that byte is the separator. A longer record has an empty member behind it.
    """
    empty = _member(b"")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for at in range(0, x.num_rows, 64):
                part = x.slice(at, 64)
                made = [_member(b"".join((h.as_py().encode(), b.as_py(), b"\r\n\r\n"))) for h, b in zip(part.column(0), part.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array([(m + empty if m[-1] else m)[:-1] for m in made], pa.binary())], names=["member"])

    packed = mapped(records.select("head", "body"), pack, "member binary").select(F.col("member").cast("string"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "none").text(path)


def responses(pages: DataFrame, key_col: str, uri_col: str, payload_col: str) -> DataFrame:
    """A response record for each row; a null payload is empty, a null URI is left out of the header."""
    body = F.coalesce(F.col(payload_col), F.lit(""))
    key, digest = F.col(key_col).cast("string"), F.sha1(body.cast("binary"))
    return pages.select(*_record("response", _urn(key, digest), key, _clean(F.col(uri_col)), body, F.octet_length(body), digest))


def _pieces(raw: bytes, size: int = 1 << 20, feed: int = 1 << 16) -> Iterator[bytes]:
    """An archive's bytes, decompressed a part at a time; gzip members may follow one another."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[i : i + size] for i in range(0, len(raw), size))
        return
    view, at = memoryview(raw), 0
    while at < len(view):
        unzip = zlib.decompressobj(31)
        while not unzip.eof:
            some = view[at : at + feed]
            out = unzip.decompress(some, size)
            at += len(some) - len(unzip.unused_data if unzip.eof else unzip.unconsumed_tail)
            if out:
                yield out
            elif not some and not unzip.eof:
                raise ValueError("archive ends inside a gzip member")


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers (names in lower case), body, and the header block as it stands, of each record of an archive."""
    source, held = _pieces(raw), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("archive ends inside a record header")
                return
        lines = bytes(held[:end]).decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("archive ends inside a record body")
        yield head, bytes(held[end + 4 : end + 4 + size]), bytes(held[: end + 4])
        del held[: end + 4 + size + 4]


def bare_digest(value: str) -> str:
    """Hex of a payload digest field, which may be hex or base32."""
    value = value.partition(":")[2] if ":" in value else value
    return value.lower() if re.fullmatch(r"[0-9a-fA-F]{40}", value) else base64.b32decode(value.upper()).hex()


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """Archive files under ``path``: archive (where it is), content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("archive"), "content")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archive files under ``path``: archive and place (which file, and the record's number in it), the header
    fields, and digest and size of the body that was read. A response whose digest differs from its header's is an error."""
    return _records(_archives(spark, path).withColumn("left_out", F.lit(None).cast("array<long>")), False)


def _records(files: DataFrame, bodies: bool) -> DataFrame:
    """Records of ``files`` (archive, content, left_out: places that are passed over, or null), with ``bodies`` also body and block
    (the header block as it stands)."""
    names = ["archive", "place", "record_id", "record_key", "record_type", "target_uri", "refers_to_id", "header_digest", "payload_bytes", "payload_digest"]
    types = [pa.string(), pa.int64()] + [pa.string()] * 6 + [pa.int64(), pa.string()]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for where, raw, passed in zip(*x.columns):
                rows: list[tuple] = []
                held, out_of, name = 0, frozenset(passed.as_py() or ()), where.as_py()
                for place, (head, body, block) in enumerate(parse(raw.as_py())):
                    if place in out_of:
                        continue
                    kind, own = head["warc-type"], hashlib.sha1(body).hexdigest()
                    digest = bare_digest(head["warc-payload-digest"]) if "warc-payload-digest" in head else own
                    if kind == "response" and own != digest:
                        raise ValueError(f"{head['warc-record-id']}: payload differs from its digest")
                    rows.append((name, place, head["warc-record-id"], head.get("record-key"), kind, head.get("warc-target-uri"), head.get("warc-refers-to"), digest, len(body), own, *([body, block] if bodies else [])))
                    held += len(body) * bodies
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types + [pa.binary()] * 2 * bodies)], names=names + ["body", "block"] * bodies)

    return mapped(files.select("archive", "content", "left_out"), records, HEADER_FIELDS + ", body binary, block binary" * bodies)


def revisit_plan(headers: DataFrame, key_type: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """The responses that become revisits: columns of ``headers`` plus keeper (the record id of the response that stays) and
    keeper_uri.

    Headers are summed up by digest before they are shuffled; the join back may have a digest with a third of all rows,
    which adaptive execution splits, as nothing after the join needs the rows of a digest together.
    """
    key = F.col("record_key").cast(key_type)
    large = headers.where((F.col("payload_bytes") >= min_bytes) & (F.col("record_type") == "response"))
    best = large.groupBy(F.col("header_digest").alias("digest")).agg(F.max(F.struct(key.alias("k"), F.col("record_id").alias("id"), F.col("target_uri").alias("u"))).alias("best"), F.count("*").alias("n")).where("n > 1")
    best = written(best, "warc-keepers")  # so that both sides of the join are dealt by it alone, and a hot digest can be split
    joined = large.join(best, F.col("header_digest") == F.col("digest")).where("best.id <> record_id")
    return joined.select(*headers.columns, F.col("best.id").alias("keeper"), F.col("best.u").alias("keeper_uri"))


def deduplicate(spark: SparkSession, source: str, target: str, key_type: str = "string", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Read the archives under ``source`` and write deduplicated ones, with fresh headers, under ``target``.

    Equal payloads of at least ``min_bytes`` bytes keep one response, that of the largest record key (in the order of
    ``key_type``; a null key is below all); the others become revisits without a body. Rows that repeat a key as well as a
    payload stay responses if the payload is that key's to keep, all of them; so do rows of a null key where no other row
    has the payload. No record goes.
    """
    plan = written(revisit_plan(written(read_archive(spark, source), "warc-headers"), key_type, min_bytes), "warc-revisits")
    uri = F.col("target_uri")
    write_archive(plan.select(*_record("revisit", F.col("record_id"), F.col("record_key"), uri, F.lit(""), F.lit(0), F.col("header_digest"), F.col("keeper"), F.col("keeper_uri"))), f"{target}/revisits")
    # Bodies stay in their archives: what meets them is, for each archive, the places of its records that became revisits.
    gone = plan.groupBy("archive").agg(F.collect_list("place").alias("left_out"))
    kept = _records(_archives(spark, source).join(gone, "archive", "left"), True)
    head, body = _record("response", F.col("record_id"), F.col("record_key"), uri, F.col("body"), F.col("payload_bytes"), F.col("header_digest"))
    write_archive(kept.select(F.when(F.col("record_type") == "response", head).otherwise(F.col("block").cast("string")).alias("head"), body), f"{target}/kept")


def resolve(records: DataFrame) -> DataFrame:
    """Revisits joined to the responses they refer to.

    Returns record_key, target_uri, record_type, payload_bytes and payload_digest of the full payload, refers_to (the
    response's key). A revisit whose response is missing has null payload_bytes and refers_to.
    """
    answer = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("answer_id")).agg(F.first("record_key").alias("answer_key"), F.first("payload_bytes").alias("answer_bytes"))
    answer = written(answer, "warc-answers")
    plain = records.where("record_type <> 'revisit'").select("record_key", "target_uri", "record_type", "payload_bytes", F.col("header_digest").alias("payload_digest"), F.lit(None).cast("string").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").join(answer, F.col("refers_to_id") == F.col("answer_id"), "left")
    return plain.unionByName(revisits.select("record_key", "target_uri", "record_type", F.col("answer_bytes").alias("payload_bytes"), F.col("header_digest").alias("payload_digest"), F.col("answer_key").alias("refers_to")))


def archived(pages: DataFrame, key_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record for each page, deduplicate the archives, read those back and resolve their revisits.

    One row per page: record_key (cast back to the key's type), target_uri, record_type, payload_bytes, payload_digest
    (lower-case hex SHA-1), refers_to. An empty table gives no rows; null payloads are empty, null keys stay null and
    null URIs too. Repeated and null keys keep a row each. Other columns are left out.
    """
    spark, key_type = pages.sparkSession, pages.schema[key_col].dataType.simpleString()
    raw, slim = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc-dedup")
    write_archive(responses(pages, key_col, uri_col, payload_col), raw)
    deduplicate(spark, raw, slim, key_type, min_bytes)
    return resolve(written(read_archive(spark, slim), "warc-headers")).withColumn("record_key", F.col("record_key").cast(key_type)).withColumn("refers_to", F.col("refers_to").cast(key_type))
