"""WARC archives: writing pages as request, response and metadata records, and assembling captures from archives.

Records are built by SQL expressions and written by Spark's text writer, so an archive goes to any file system Spark
reaches, gzip-compressed. Spark's text reader streams archives record by record, so neither an archive nor its size is ever
held. The records of a transaction are brought together by all their WARC-Concurrent-To identifiers: most name one record and
meet in one grouped aggregation; where these groups name each other, their connected components are found first.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import SALTS, components, salted
from ._store import Scratch, prepared

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Most pages an archive file holds; an archive is read by one task, record by record.
FILE_PAGES = 5000
#: What separates records in the reader (a record may hold it, too), and the most bytes of a header and of a record that are put together.
BETWEEN, MOST_HEADER, MOST_RECORD = b"\r\n\r\nWARC/1.", 1 << 20, 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS = "type string, record_id string, concurrent_to array<string>, target_uri string, page_id bigint, refers_to bigint, content_type string, payload_digest string, payload_bytes bigint, computed_digest string, payload binary"


def _record(kind: str, rid, extra: list, content_type: str, body):
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <"), rid, F.lit(">\r\n"), *extra]
    size = F.octet_length(body).cast("string")
    return F.concat(*lines, F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), size, F.lit("\r\n\r\n"), body, F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Writes each row as a response (or revisit), a request and a metadata record that name the first by WARC-Concurrent-To.

    Of rows with equal payloads of at least REVISIT_BYTES bytes, those with the largest id are responses and the others
    revisits that refer to it. A null payload is empty, a null url is an empty target, a null id is written as such and
    its row is a response. Repeated rows are captures of their own. Line breaks in urls are percent-encoded. Other columns are ignored,
    whatever their names.
    """
    scratch = Scratch(pages.sparkSession)
    uri = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "\r", "%0D"), "\n", "%0A")
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), uri.alias("uri"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha1(F.col("body").cast("binary"))).withColumn("size", F.octet_length("body"))
    # only payloads that occur more than once need a partner; partial aggregates keep a common one small
    first = rows.where((F.col("size") >= REVISIT_BYTES) & F.col("id").isNotNull()).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # a written table has a known size, by which Spark broadcasts it or not; else each digest waits in SALTS places, and rows that need no partner look up a key of their own
    first = scratch.save(first, "first").select(F.col("digest").alias("key"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    key = F.when(F.col("size") >= REVISIT_BYTES, F.col("digest")).otherwise(F.xxhash64("id", "uri").cast("string"))
    rows = salted(rows.withColumn("key", key), "id").join(first, ["key", "salt"], "left")
    number = F.monotonically_increasing_id()
    seed = F.sha1(F.concat_ws(":", number.cast("string"), F.col("id").cast("string"), F.col("digest")).cast("binary"))
    rows = rows.withColumn("seed", seed)

    def rid(tail: str):
        return F.concat(F.lit("urn:uuid:"), F.substring("seed", 1, 8), F.lit("-"), F.substring("seed", 9, 4), F.lit("-"), F.substring("seed", 13, 4), F.lit("-"), F.substring("seed", 17, 4), F.lit("-"), F.substring("seed", 21, 11), F.lit(tail))

    target = [F.lit("WARC-Target-URI: "), F.col("uri"), F.lit("\r\n")]
    to = [F.lit("WARC-Concurrent-To: <"), rid("0"), F.lit(">\r\n")]
    digest = [F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n")]
    revisit = F.coalesce(F.col("first") != F.col("id"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    response = _record("response", rid("0"), [*target, *digest], "application/http; msgtype=response", F.concat(http, F.col("body")))
    again = _record("revisit", rid("0"), [*target, *digest, F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To-Page: "), F.coalesce(F.col("first").cast("string"), F.lit("")), F.lit("\r\n")], "application/http; msgtype=response", http)
    request = _record("request", rid("1"), [*target, *to], "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n")))
    meta = _record("metadata", rid("2"), [*target, *to], "application/warc-fields", F.concat(F.lit("pageId: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\npayloadLength: "), F.col("size").cast("string"), F.lit("\r\n")))
    # a record ends with two line breaks: one of its own and the line separator
    rows.select(F.concat_ws("\r\n", F.when(revisit, again).otherwise(response), request, meta).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_PAGES).mode("overwrite").text(path)


def _headers(block: bytes) -> dict[str, list[str]]:
    """All values of each header field, by its name in lower case."""
    out: dict[str, list[str]] = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("latin-1"), []).append(value.strip().decode("utf-8", "replace"))
    return out


def _whole(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


def whole_records(pieces):
    """(header, block) of each record from what lies between separators in one archive; a record that cannot be read whole comes as (header, None).

    A record is as long as its Content-Length says, whatever separators it holds. Without a usable length, or cut off, it is
    not whole; what follows a record up to the next version line is skipped.
    """
    held, header_end, need = bytearray(), -1, -1
    for piece in pieces:
        held += BETWEEN + piece if held else piece
        while held:
            if header_end < 0:
                start = re.match(rb"(?:\s*WARC/1\.)?[0-9]\r\n", held)
                header_end = held.find(b"\r\n\r\n")
                if start is None or (header_end < 0 and len(held) > MOST_HEADER):
                    held.clear()
                    header_end = -1
                    break
                if header_end < 0:
                    break  # a block that starts like a record: the next piece goes on
                lengths = _headers(bytes(held[:header_end])).get("content-length", [])
                size = _whole(lengths[0]) if lengths else None
                if size is None or not 0 <= size <= MOST_RECORD:
                    yield bytes(held[:header_end]), None
                    held.clear()
                    header_end = -1
                    break
                need = header_end + 4 + size
            if len(held) < need:
                break
            yield bytes(held[:header_end]), bytes(held[header_end + 4 : need])
            rest = held.find(b"WARC/1.", need)
            held = held[rest:] if rest >= 0 else bytearray()
            header_end = -1
    if held:
        yield bytes(held[: header_end if header_end >= 0 else MOST_HEADER]), None


def _row(header: bytes, block: bytes | None, payloads: bool) -> tuple:
    """A row of RECORDS. A record that is not whole, or has no id or type, is of type malformed."""
    head = _headers(header)

    def one(name: str) -> str | None:
        return head[name][0] if head.get(name) else None

    ids = [x.strip().strip("<>") for x in head.get("warc-concurrent-to", [])]
    kind, rid = one("warc-type"), (one("warc-record-id") or "").strip("<>") or None
    if block is None or kind is None or rid is None:
        return "malformed", rid, ids, one("warc-target-uri"), None, None, one("content-type"), None, None, None, None
    page = refers = digest = length = computed = payload = None
    if kind in ("response", "revisit"):
        digest = (one("warc-payload-digest") or "").rpartition(":")[2] or None
        refers = _whole(one("warc-refers-to-page"))
        if kind == "response":
            at = block.find(b"\r\n\r\n") if (one("content-type") or "").lower().startswith("application/http") or block[:5] == b"HTTP/" else -4
            body = block[at + 4 :] if at != -1 else b""
            computed, length = hashlib.sha1(body).hexdigest(), len(body)
            payload = body if payloads else None
    elif kind == "metadata":
        fields = _headers(block)
        page, length = (_whole(fields[n][0]) if n in fields else None for n in ("pageid", "payloadlength"))
    return kind, rid, [x for x in ids if x], one("warc-target-uri"), page, refers, one("content-type"), digest, length, computed, payload


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the gzip-compressed archives (of any number of members) under path.

    Records that are cut off, or lack a usable length, a type or an id, come as type malformed, with what their header says; the
    records after them are read. So do records of more than MOST_RECORD bytes (1 GiB), whose payloads are not put together. Empty archives and folders without any give no rows. concurrent_to holds all identifiers
    that a record names, in order.
    """
    prepared(spark)
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").option("lineSep", BETWEEN.decode()).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    schema = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("content_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("computed_digest", pa.string()), ("payload", pa.binary())])

    def run(batches):
        rows, held = [], 0
        for header, block in _by_archive(batches):
            row = _row(header, block, payloads)
            rows.append(row)
            held += len(row[-1] or b"")
            if len(rows) >= 4096 or held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return raw.mapInArrow(run, RECORDS)


def _by_archive(batches):
    """The records of all archives of a partition: an archive is not split, so its pieces follow each other."""
    pieces = ((f, v.as_py()) for batch in batches for f, v in zip(batch["file"].to_pylist(), batch["value"], strict=True))
    first = next(pieces, None)
    while first is not None:
        file, piece = first
        first = None

        def own():
            nonlocal first
            yield piece
            for f, v in pieces:
                if f != file:
                    first = f, v
                    return
                yield v

        yield from whole_records(own())


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each transaction: capture_id, record_type, the structs capture (the response or revisit), request and
    metadata, and related: all its records but the capture, by type and id.

    Records belong together if one names another in WARC-Concurrent-To, in whatever direction and over any number of records. Of
    several records of one part the one with the smallest id is in its place, the others are in related; a missing part is null.
    Records that name nothing and are not named are transactions of their own; identifiers that no record has are
    shared by those that name them. Malformed records take no part. An empty table gives an empty result.
    A transaction is one row, so its records must fit in a task.
    records is read several times, so it should be a written table.
    """
    scratch = Scratch(records.sparkSession)
    names = [c for c in records.columns if c not in ("type", "concurrent_to")]
    one = F.struct("type", *[F.col(c) for c in names])
    sound = records.where("type <> 'malformed'")
    # a record goes to the first record it names, else to itself; such groups are joined where their records name each other
    keyed = sound.withColumn("key", F.coalesce(F.get("concurrent_to", F.lit(0)), "record_id"))
    more = F.array_union(F.array("record_id"), F.coalesce("concurrent_to", F.array().cast("array<string>")))
    edges = keyed.select(F.col("key").alias("a"), F.explode(more).alias("b")).where("a <> b")
    edges = edges.join(keyed.select(F.col("key").alias("b")).distinct(), "b", "left_semi")
    roots = components(edges, scratch, "transactions").withColumnRenamed("node", "key")
    tagged = keyed.join(roots, "key", "left").select(F.coalesce("root", "key").alias("capture_id"), "type", "record_id", one.alias("r"))
    is_capture = F.col("type").isin("response", "revisit")

    def part(which):
        return F.min_by("r", F.when(which, F.col("record_id")))

    found = tagged.groupBy("capture_id").agg(part(is_capture).alias("capture"), part(F.col("type") == "request").alias("request"), part(F.col("type") == "metadata").alias("metadata"), F.collect_list("r").alias("all"))
    related = F.array_sort(F.filter("all", lambda r: F.col("capture").isNull() | (r["record_id"] != F.col("capture.record_id")) | (r["type"] != F.col("capture.type"))))
    return found.select(F.coalesce("capture.record_id", "capture_id").alias("capture_id"), F.col("capture.type").alias("record_type"), "capture", "request", "metadata", related.alias("related"))


def read_captures(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Captures of the archives under path: page_id, target_uri, record_type, payload_bytes, payload_digest, refers_to, and the nested
    records. The digest of a response is computed from the payload that was read."""
    records = Scratch(spark).save(read_records(spark, path, payloads), "records")
    found = assemble(records)
    own = F.when(F.col("record_type") == "response", F.col("capture.payload_bytes")).otherwise(F.col("metadata.payload_bytes"))
    return found.select(F.col("metadata.page_id").alias("page_id"), F.col("capture.target_uri").alias("target_uri"), "record_type", own.alias("payload_bytes"), F.coalesce("capture.computed_digest", "capture.payload_digest").alias("payload_digest"), F.col("capture.refers_to").alias("refers_to"), "capture_id", "capture", "request", "metadata", "related")
