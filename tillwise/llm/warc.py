"""WARC archives: pages to records, and records back to one nested row per capture.

Written are three records per page: a response, or a revisit where another page has the same payload, and a request and a metadata
record that name it in ``WARC-Concurrent-To``. Spark's own text writer puts them out, with the end of a record as its line
separator, so archives appear with the commit of the job and survive lost executors.

Reading is transaction assembly. Archives are read as streams of pieces between blank lines, and every record is cut out by
its ``Content-Length``, whatever its block holds; one record is in memory at a time. Records are then joined to captures through
their concurrent-to identifiers, wherever in the archives they stand, and revisits find their payload by ``WARC-Refers-To``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.sources.shared import stage

# The format's version, separators, profile and alphabet.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "

#: Records, or bytes of their payloads, that a task puts out at once.
RECORDS_AT_ONCE, BYTES_AT_ONCE = 1000, 16 << 20

RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "declared_digest string, payload_bytes long, payload_digest string, fields array<struct<name:string,value:string>>, payload binary"
)
_RECORD = pa.schema(
    [
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("declared_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
        ("payload", pa.binary()),
    ]
)


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in upper-case base32: four characters for every five hexadecimal digits."""
    digits = F.sha1(data)
    chars = []
    for at in range(1, 41, 5):
        number = F.conv(F.substring(digits, at, 5), 16, 10).cast("int")
        chars += [F.substr(F.lit(BASE32), F.shiftright(number, bits).bitwiseAND(31) + 1, F.lit(1)) for bits in (15, 10, 5, 0)]
    return F.concat(*chars)


def _urn(*parts: Column) -> Column:
    """A record id that follows from some texts."""
    name = F.md5(F.concat_ws("/", *parts))
    cuts = [F.substring(name, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _one_line(value: Column) -> Column:
    """A header value with its blanks and control characters percent-encoded."""
    encoded = value
    for code in (*range(0x21), 0x7F):
        encoded = F.replace(encoded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(value.rlike(r"[\x00-\x20\x7F]"), encoded).otherwise(value)


def _record(headers: dict[str, Column], block: Column) -> Column:
    """A record without its end; headers whose value is null are left out."""
    lines = [F.lit(VERSION), *[F.concat(F.lit(f"{name}: "), value) for name, value in headers.items()]]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", *lines, length), F.lit(END), block)


def archive_records(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """(value): the records of all pages, three per row.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the largest id is the response and all others
    revisit it; a null id counts as smaller than any other, and of rows with the same id one is the response. Smaller
    payloads are all responses. A null payload is empty. A null url leaves out the target's address, a null id the field ``page_id`` of
    the metadata. Other columns are not read.

    The payloads are shuffled once, equal ones as one; who revisits whom is found on rows without payloads, which are staged.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("").cast(pages.schema[payload_col].dataType)).cast("binary")
    key = F.unhex(F.sha2(payload, 256))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        _one_line(F.col(url_col).cast("string")).alias("url"),
        key.alias("key"),
        base32_sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    rows = stage(rows, "archive_rows")
    first = rows.groupBy("key").agg(F.max(F.struct("id", (-F.col("row")).alias("row"))).alias("first"))
    written = F.lit(uuid.uuid4().hex)
    decided = rows.join(first.select("key", (-F.col("first.row")).alias("first")), "key").select(
        "*",
        _urn(written, F.lit("capture"), F.col("row").cast("string")).alias("urn"),
        _urn(written, F.lit("capture"), F.col("first").cast("string")).alias("first_urn"),
        ((F.col("row") == F.col("first")) | (F.col("bytes") < least_bytes)).alias("is_response"),
    )
    payloads = pages.select(key.alias("key"), payload.cast("string").alias("payload")).groupBy("key").agg(F.first("payload").alias("payload"))
    responses = decided.filter("is_response").join(payloads, "key")
    revisits = decided.filter("not is_response").withColumn("payload", F.lit(""))

    day, row = F.lit(date), F.col("row").cast("string")
    common = {"WARC-Date": day, "WARC-Target-URI": F.col("url")}
    http = F.concat(F.lit(HTTP_OK), F.col("bytes").cast("string"), F.lit(END), F.col("payload"))
    capture = _record(
        {
            "WARC-Type": F.when(F.col("is_response"), F.lit("response")).otherwise(F.lit("revisit")),
            "WARC-Record-ID": F.col("urn"),
            **common,
            "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
            "WARC-Profile": F.when(~F.col("is_response"), F.lit(IDENTICAL_PAYLOAD)),
            "WARC-Refers-To": F.when(~F.col("is_response"), F.col("first_urn")),
            "Content-Type": F.lit("application/http;msgtype=response"),
        },
        http,
    )
    host = F.regexp_extract("url", r"^[^:]*://([^/?#]*)", 1)
    target = F.regexp_extract("url", r"^[^:]*://[^/?#]*([^#]*)", 1)
    asked = F.concat(
        F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)
    )
    request = _record(
        {
            "WARC-Type": F.lit("request"),
            "WARC-Record-ID": _urn(written, F.lit("request"), row),
            **common,
            "WARC-Concurrent-To": F.col("urn"),
            "Content-Type": F.lit("application/http;msgtype=request"),
        },
        F.coalesce(asked, F.lit(f"GET / HTTP/1.1{END}")),
    )
    metadata = _record(
        {
            "WARC-Type": F.lit("metadata"),
            "WARC-Record-ID": _urn(written, F.lit("metadata"), row),
            **common,
            "WARC-Concurrent-To": F.col("urn"),
            "Content-Type": F.lit("application/warc-fields"),
        },
        F.coalesce(F.concat(F.lit("page_id: "), _one_line(F.col("id").cast("string")), F.lit("\r\n")), F.lit("")),
    )
    return responses.unionByName(revisits.select(responses.columns)).select(F.explode(F.array(request, capture, metadata)).alias("value"))


def write_archives(records: DataFrame, path: str) -> None:
    """Records as archives, one gzip stream per task."""
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


class RecordStream:
    """Cuts records out of one archive's pieces between blank lines."""

    def __init__(self, name: str) -> None:
        self._name = name
        self._header: bytes | None = None
        self._need, self._have = 0, 0
        self._parts: list[bytes] = []

    def add(self, piece: bytes) -> Iterator[tuple[bytes, bytes]]:
        """The records, as header and block, that end with this piece."""
        while True:
            if self._header is None:
                piece = piece.lstrip(b"\r\n")
                if not piece:
                    return
                if not piece.startswith(b"WARC/"):
                    raise ValueError(f"{self._name}: no record starts with {piece[:40]!r}")
                self._header, self._need, self._have, self._parts = piece, _content_length(piece, self._name), -len(END), []
                return
            self._parts.append(piece)
            self._have += len(END) + len(piece)
            if self._have < self._need:
                return
            data = END.encode().join(self._parts)
            header, block, piece = self._header, data[: self._need], data[self._need :]
            self._header = None
            yield header, block
            # What follows a block that ends like a separator begins in the same piece.

    def close(self) -> None:
        if self._header is not None:
            raise ValueError(f"{self._name}: the archive ends inside of a record")


def _headers(header: bytes) -> list[tuple[str, str]]:
    """Names, in lower case, and values of a record's or document's fields; a line that begins with a blank goes on with the one before."""
    fields: list[tuple[str, str]] = []
    for line in header.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
            continue
        name, colon, value = line.partition(":")
        if colon:
            fields.append((name.strip().lower(), value.strip()))
    return fields


def _content_length(header: bytes, name: str) -> int:
    for field, value in _headers(header):
        if field == "content-length" and value.isdigit():
            return int(value)
    raise ValueError(f"{name}: a record without Content-Length")


def parse_record(header: bytes, block: bytes, keep_payload: bool) -> tuple:
    """A record as a row of ``RECORD``. The payload of a response is what follows the HTTP header; its digest is computed here."""
    named: dict[str, str] = {}
    concurrent = []
    for name, value in _headers(header):
        if name == "warc-concurrent-to":
            concurrent.append(value)
        else:
            named.setdefault(name, value)
    kind, payload, fields = named.get("warc-type"), None, None
    if kind == "response":
        payload = block.partition(END.encode())[2] if named.get("content-type", "").startswith("application/http") else block
    elif kind == "metadata" and named.get("content-type", "").startswith("application/warc-fields"):
        fields = [{"name": name, "value": value} for name, value in _headers(block)]
    elif kind != "revisit":
        payload = block
    return (
        named.get("warc-record-id"),
        kind,
        named.get("warc-target-uri"),
        named.get("warc-date"),
        concurrent,
        named.get("warc-refers-to"),
        named.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        None if payload is None else len(payload),
        None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        fields,
        payload if keep_payload else None,
    )


def read_records(spark: SparkSession, path: str, *, keep_payload: bool = True) -> DataFrame:
    """The records of gzip archives as rows of ``RECORD``, whether they are one gzip stream or one member per record.

    An archive is a single stream, as gzip cannot be split; many archives are read at once. A broken archive
    fails the read with its name. Without ``keep_payload`` the payloads are hashed and left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, name, rows, size = None, None, [], 0

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_RECORD)

        for batch in batches:
            for file, piece in zip(batch.column(0), batch.column(1), strict=True):
                if (own := file.as_py()) != name:
                    if stream is not None:
                        stream.close()
                    stream, name = RecordStream(own), own
                for header, block in stream.add(piece.as_py()):
                    rows.append(parse_record(header, block, keep_payload))
                    size += len(block) if keep_payload else 0
                    if len(rows) >= RECORDS_AT_ONCE or size >= BYTES_AT_ONCE:
                        yield out()
                        size = 0
        if stream is not None:
            stream.close()
        if rows:
            yield out()

    pieces = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).text(path)
    return pieces.select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, capture, requests, metadata).

    A capture is a response, revisit or resource record with the request and metadata records that are concurrent to it;
    either side may name the other. ``requests`` and ``metadata`` are ordered by record id, empty where there is none. Records that name
    no capture that exists are kept under the identifier that they name, or their own, with a null ``capture``. ``records`` are read
    three times; stage them first.
    """
    is_capture = F.col("type").isin("response", "revisit", "resource")
    found = records.filter(is_capture).select(F.col("record_id").alias("capture_id"), F.struct(*records.columns).alias("capture"))
    others = records.filter(F.col("type").isin("request", "metadata"))
    named = found.select(F.explode("capture.concurrent_to").alias("record_id"), F.col("capture_id").alias("named_by"))
    own = others.join(named.dropDuplicates(["record_id"]), "record_id", "left").select(
        F.coalesce("named_by", F.get("concurrent_to", F.lit(0)), "record_id").alias("capture_id"), F.struct(*records.columns).alias("record")
    )
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("record.type") == kind, F.struct("record.record_id", "record.target_uri", "record.date", "record.fields"))))
    grouped = own.groupBy("capture_id").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    joined = found.join(grouped, "capture_id", "full_outer")
    return joined.select("capture_id", "capture", *[F.coalesce(c, F.array().cast(grouped.schema[c].dataType)).alias(c) for c in ("requests", "metadata")])


def resolved(found: DataFrame) -> DataFrame:
    """Captures with (page_id, kind, refers_to, payload_bytes, payload_digest), those of a revisit from the response that it refers to.

    ``page_id`` is that field of the capture's metadata, null without one; ``refers_to`` is the page of the response. A revisit whose response
    is not there keeps the digest that it declares. ``found`` is read twice; stage it first.
    """
    fields = F.flatten(F.transform("metadata", lambda record: F.coalesce(record["fields"], F.array().cast("array<struct<name:string,value:string>>"))))
    page = F.get(F.filter(fields, lambda field: field["name"] == "page_id"), F.lit(0))["value"]
    flat = found.filter("capture is not null").select(
        "capture_id", page.alias("page_id"), F.col("capture.type").alias("kind"), "capture.refers_to", "capture.declared_digest", "capture.payload_bytes", "capture.payload_digest"
    )
    responses = flat.filter("kind <> 'revisit'").select(
        F.col("capture_id").alias("refers_to"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest")
    )
    revisits = flat.filter("kind = 'revisit'").drop("payload_bytes", "payload_digest").join(responses, "refers_to", "left")
    columns = ["capture_id", "page_id", "kind"]
    return (
        flat.filter("kind <> 'revisit'")
        .select(*columns, F.lit(None).cast("string").alias("refers_to"), "payload_bytes", "payload_digest")
        .unionByName(
            revisits.select(
                *columns,
                F.col("of_page").alias("refers_to"),
                F.col("of_bytes").alias("payload_bytes"),
                F.coalesce("of_digest", "declared_digest").alias("payload_digest"),
            )
        )
    )
