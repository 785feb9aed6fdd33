"""Legacy ARC archives converted to WARC.

ARC: a file opens with a version block (``filedesc://`` record) that names
version 1 or 2; every record is a header line with that version's fields, of
which the last is the declared length of what follows. WARC: each ARC record
becomes a ``response`` or, if a payload of at least ``MIN_REVISIT`` bytes was
seen before, a ``revisit`` record, with an identifier, date, target and digest
made from the ARC fields.

Archives are written by Spark's own text writer (one gzip stream per task's
file, any file system) and read by ``binaryFile``, decompressed as a stream
and parsed by declared lengths, so payloads may hold anything. A file is as
large as one task's input; a reader holds one compressed file at a time.

Null urls are written as "-", blanks in urls as %20; null payloads are empty;
rows without id sort last when the first of equal payloads is chosen; rows of
equal id are told apart by file and offset. A damaged or cut record gives a
row with ``error`` set, which the conversion returns, and reading goes on at the
next header line; only a file without a version block ends at once. Dates of
fewer than 14 digits become the first instant that they may mean. A payload is
read whole, however long. An empty table gives empty archives; other columns
are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybars.llm.common import materialize

MIN_REVISIT = 100
ID_HEADER = "X-Page-Id"
# fixed values: the field names of the two ARC versions
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
ARC_SCHEMA = ("file string, offset long, version int, url string, ip string, arc_date string, mime string, id long, "
              "http binary, payload binary, payload_bytes long, payload_digest string, error string")
WARC_SCHEMA = ("file string, offset long, type string, record_id string, date string, uri string, refers_to string, "
               "id long, payload binary, payload_bytes long, payload_digest string, error string")


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id") -> None:
    """One ARC file per task; even tasks write version 1, odd ones version 2."""
    payload = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(payload).cast("string"),
                    F.coalesce(F.concat(F.lit(f"\r\n{ID_HEADER}: "), F.col(id_col).cast("string")), F.lit("")),
                    F.lit("\r\n\r\n"))
    url = F.coalesce(F.nullif(F.regexp_replace("url", r"[\s\p{Cntrl}]", "%20"), F.lit("")), F.lit("-"))
    date = F.date_format(F.timestamp_seconds(F.lit(1_262_304_000) + F.pmod(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(500_000_000))), "yyyyMMddHHmmss")
    v2 = F.spark_partition_id() % 2 == 1
    head = F.concat(url, F.lit(" 192.0.2.1 "), date, F.lit(" text/html "), F.when(v2, F.lit("200 - - 0 - ")).otherwise(F.lit("")))
    block = F.concat(http, payload)
    record = F.concat(head, F.octet_length(block).cast("string"), F.lit("\n"), block)
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    opening = F.when(v2, F.lit(_version_block(2))).otherwise(F.lit(_version_block(1)))
    line = F.when(first, F.concat(opening, record)).otherwise(record)
    pages.select(line.alias("value")).write.options(**_GZIP).option("lineSep", "\n").text(path)


def _version_block(version: int) -> str:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n"
    extra = " 200 - - 0 -" if version == 2 else ""
    return f"filedesc://pages.arc 0.0.0.0 20100101000000 text/plain{extra} {len(body)}\n{body}\n"


def arc_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one ARC file. A damaged one gives a row with ``error`` set, and
    reading goes on at the next line that is a header.

    A length is believed if a line end or the file's end follows the record. If
    not, the record is damaged, and what its length would have swallowed is read
    again.
    """
    names: list[str] = []
    version, lost = None, False
    while True:
        offset, line = stream.tell(), stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        head = line.rstrip(b"\r\n")
        if version is None:
            fields = head.split(b" ")
        else:
            fields = head.rsplit(b" ", len(names) - 1)     # a url may hold blanks
        if not fields[-1].isdigit() or (version is not None and not _is_header(fields, names)):
            if version is None:
                yield {"offset": offset, "error": "no version block"}
                return
            if not lost:                                   # one row for all lines up to the next header
                yield {"offset": offset, "error": "bad header line"}
            lost = True
            continue
        start, size = stream.tell(), int(fields[-1])
        body = stream.read(size)
        if version is not None and (len(body) < size or stream.read(1) not in (b"", b"\n", b"\r")):
            yield {"offset": offset, "error": "declared length does not fit"}
            lost = True
            stream.seek(start)
            continue
        lost = False
        if version is None:
            declared = body.split(b"\n", 1)[0].split(b" ")[0]
            if len(body) < size or not head.startswith(b"filedesc:") or declared not in (b"1", b"2"):
                yield {"offset": offset, "error": "no version block"}
                return
            version = int(declared)
            names = ARC_FIELDS[version].split(" ")
            continue
        field = dict(zip(names, (x.decode("utf-8", "replace") for x in fields), strict=True))
        http, payload = split_http(body)
        yield {"offset": offset, "version": version, "url": field["URL"], "ip": field["IP-address"],
               "arc_date": field["Archive-date"], "mime": field["Content-type"], "id": _id_of(http), "http": http,
               "payload": payload}


def _is_header(fields: list[bytes], names: list[str]) -> bool:
    """As many fields as the version says, and a date where it must be."""
    if len(fields) != len(names):
        return False
    date = fields[names.index("Archive-date")]
    return date.isdigit() and 4 <= len(date) <= 14


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header (with its blank line) and payload; no header if it isn't HTTP."""
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    return (block[:end + 4], block[end + 4:]) if end >= 0 else (b"", block)


def _id_of(http: bytes) -> int | None:
    m = re.search(rb"(?im)^" + ID_HEADER.encode() + rb": (-?[0-9]{1,19})\r$", http)
    return int(m[1]) if m else None


def warc_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    while True:
        offset, line = stream.tell(), stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        head: dict[str, str] = {}
        while line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
            line = stream.readline()
        if not any(k.startswith("warc/") for k in head) or not head.get("content-length", "").isdigit():
            yield {"offset": offset, "error": "bad header"}
            return
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) < n:
            yield {"offset": offset, "error": "shorter than declared"}
            return
        http, payload = split_http(block)
        row = {"offset": offset, "type": head.get("warc-type"), "record_id": head.get("warc-record-id"),
               "date": head.get("warc-date"), "uri": head.get("warc-target-uri"),
               "refers_to": head.get("warc-refers-to"), "id": _id_of(http)}
        if row["type"] == "revisit":
            row |= {"payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:"),
                    "payload_bytes": int(head.get("x-payload-length", 0)), "payload": None}
        else:
            row |= {"payload": payload}
            if head.get("warc-payload-digest") not in (None, "sha256:" + hashlib.sha256(payload).hexdigest()):
                row["error"] = "digest differs"
        yield row


def _reader(parse, schema: pa.Schema, payloads: bool, batch_bytes: int = 16 << 20):
    names = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                raw, rows, held = content.as_py(), [], 0
                stream = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                for r in parse(stream):
                    p = r.get("payload")
                    if p is not None:
                        r |= {"payload_bytes": len(p), "payload_digest": hashlib.sha256(p).hexdigest()}
                        if not payloads:
                            r["payload"] = None
                        else:
                            held += len(p)
                    rows.append({k: r.get(k) for k in names} | {"file": path.as_py().rsplit("/", 1)[-1]})
                    if held >= batch_bytes or len(rows) >= 5_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
    return read


def _archive(spark: SparkSession, path: str, parse, ddl: str, payloads: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(parse, schema, payloads), ddl)


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    return _archive(spark, path, arc_records, ARC_SCHEMA, payloads)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    return _archive(spark, path, warc_records, WARC_SCHEMA, payloads)


def arc_to_warc(spark: SparkSession, arc: str, warc: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Convert all ARC files of a folder to WARC files in another. Returns a
    row (file, offset, error) for every damaged place; all other records are
    converted."""
    read = materialize(read_arc(spark, arc, payloads=False).select(
        "file", "offset", "url", "arc_date", "payload_digest", "payload_bytes", "id",
        _record_id().alias("record_id"), "error"), "arc-seen")
    seen = read.where("error IS NULL").drop("error")
    order = F.struct(F.col("id").isNull().alias("void"), "id", "file", "offset", "record_id")
    firsts = (seen.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest")
              .agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
              .select("payload_digest", F.col("first.record_id").alias("refers_to")))
    # Written first, so its size is known: while few records are revisits Spark
    # broadcasts them, and the payloads are not shuffled.
    again = materialize(seen.select("payload_digest", "record_id").join(firsts, "payload_digest").where(
        "record_id <> refers_to").select("record_id", "refers_to"), "arc-again")
    full = read_arc(spark, arc).where("error IS NULL").withColumn("record_id", _record_id())
    rows = full.join(again, "record_id", "left")
    rows.select(_warc_text().alias("value")).write.options(**_GZIP).option("lineSep", "\r\n\r\n").text(warc)
    return read.where("error IS NOT NULL").select("file", "offset", "error")


def _record_id() -> Column:
    """A name-based identifier from what the ARC record says and where it is."""
    h = F.md5(F.concat_ws("\n", "file", F.col("offset").cast("string"), "url", "arc_date", "payload_digest"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        h, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5"), F.lit(">"))


def _warc_text() -> Column:
    revisit = F.col("refers_to").isNotNull()
    # a date of fewer than 14 digits is the first instant it may mean
    whole = F.concat("arc_date", F.expr("substring('00000101000000', length(arc_date) + 1)"))
    date = F.regexp_replace(whole, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    http = F.col("http").cast("string")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload").cast("string")))
    kind = F.when(F.octet_length("http") > 0, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).when(
            F.octet_length("http") > 0, F.lit("response")).otherwise(F.lit("resource")),
        F.lit("\r\nWARC-Record-ID: "), F.col("record_id"), F.lit("\r\nWARC-Date: "), date,
        F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-IP-Address: "), F.col("ip"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                  "\r\nWARC-Refers-To: "), F.col("refers_to"),
            F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: "), kind, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block)


def report(pages: DataFrame, arc: str, warc: str) -> DataFrame:
    """Pages to ARC, ARC to WARC, and what the WARC files say of each page."""
    spark = pages.sparkSession
    write_arc(pages.select("page_id", "url", "html"), arc)
    arc_to_warc(spark, arc, warc)
    rows = materialize(read_warc(spark, warc).select(
        "id", "type", "record_id", "refers_to", "payload_bytes", "payload_digest", "error"), "warc-rows")
    origin = rows.where("type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("id").alias("first_id"))
    # only revisits have a partner; the others would all meet under the null key
    plain = rows.where("refers_to IS NULL").withColumn("first_id", F.lit(None).cast("bigint"))
    again = rows.where("refers_to IS NOT NULL").join(origin, "refers_to", "left").select(*plain.columns)
    return plain.unionByName(again).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("first_id").alias("refers_to"), "error")
