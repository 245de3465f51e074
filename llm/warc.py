"""WARC: writing pages as archives, reading archives, and assembling transactions.

Writing goes through Spark's own text writer with the record separator as line
separator and gzip compression, so files are committed per task (a lost executor leaves no half file)
and may lie in any store that Spark writes to. Reading is driven by
Content-Length, so payloads may hold anything, separators included.

Method: transaction assembly. A capture is a response (or revisit) record, a
request and a metadata record; the latter two name the former in
WARC-Concurrent-To. Records are joined through those identifiers into one nested
row per capture.

Null payloads are empty payloads. Of pages with equal payloads of at least
``least`` bytes the one with the largest id is the response, the others revisit
it; of several rows with that id, one. Every row is a capture of its own, whatever
rows repeat its id; a null id is the smallest, and its capture names no page.

Pages are written by classes of size, the larger ones fewer to a file, so that a file
that a task reads whole holds about 32 MB, or one page.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import ship, table, work_dir, written

LEAST = 1000
_SEPARATOR = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages with a row number, their payload digest and, for revisits, the response's page id and row number.

    The largest id of a digest is a partial aggregate, so a payload shared by
    very many pages costs one row per task.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    pages = pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("row"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    last = F.max(F.struct("page_id", "row"))  # nulls come first
    groups = pages.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(last.alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("refers_row"))
    joined = pages.join(groups, "payload_digest", "left")
    revisits = (F.col("payload_bytes") >= least) & (F.col("refers_row") != F.col("row"))
    return joined.withColumns({c: F.when(revisits, F.col(c)) for c in ("refers_to", "refers_row")})


def _urn(kind: str, page, row: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{kind}/{page}/{row}')}"


def _record(kind: str, record: str, uri: str, body: bytes, content: str, more: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), *more, ("Content-Type", content), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split()) or "about:blank"


def _make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for k in range(0, batch.num_rows, 200):
            out = []
            for r in batch.slice(k, 200).to_pylist():
                page, row, uri, body = r["page_id"], r["row"], _one_line(r["url"]), (r["html"] or "").encode()
                digest = "sha1:" + base64.b32encode(bytes.fromhex(r["payload_digest"])).decode()
                main = _urn("capture", page, row)
                path = uri.split("://", 1)[-1].partition("/")
                request = f"GET /{path[2]} HTTP/1.1\r\nHost: {path[0]}\r\n\r\n".encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                if r["refers_row"] is None:
                    out.append(_record("response", main, uri, http + body, "application/http;msgtype=response", [("WARC-Payload-Digest", digest)]))
                else:
                    first = _urn("capture", r["refers_to"], r["refers_row"])
                    out.append(_record("revisit", main, uri, http, "application/http;msgtype=response", [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", f"<{first}>")]))
                out.append(_record("request", _urn("request", page, row), uri, request, "application/http;msgtype=request", [("WARC-Concurrent-To", f"<{main}>")]))
                out.append(_record("metadata", _urn("metadata", page, row), uri, f"{'' if page is None else f'page-id: {page}\r\n'}payload-length: {len(body)}\r\n".encode(), "application/warc-fields", [("WARC-Concurrent-To", f"<{main}>")]))
            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out], pa.string())], ["value"])


#: Payloads of at most so many bytes, and records of them in a file.
CLASSES = ((1 << 14, 6000), (1 << 20, 96), (1 << 62, 3))


def write_archives(spark: SparkSession, pages: DataFrame, path: str, least: int = LEAST, classes: tuple = CLASSES) -> None:
    """Write each page as a capture of three records, in a folder for each class of size (equal payloads are in one)."""
    ship(spark)
    begin, size = -1, F.coalesce(F.octet_length("html"), F.lit(0))
    largest = pages.agg(F.max(size)).first()[0] or 0
    for k, (most, records) in enumerate(classes):
        if k and largest <= begin:
            break  # no larger pages
        planned = plan_records(pages.where((size > begin) & (size <= most)), least).select("page_id", "row", "url", "html", "payload_digest", "refers_to", "refers_row")
        planned.mapInArrow(_make, "value string").write.option("lineSep", _SEPARATOR).option("maxRecordsPerFile", records).option("compression", "gzip").text(f"{path}/size{k}")
        begin = most


def unzipped(content: bytes) -> bytes:
    """The bytes of an archive, whether or not it is compressed (as a whole or record by record)."""
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def parse(content: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (lower-case names) and block of each record of an archive."""
    view, at = memoryview(content), 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            if content[at:].strip():
                raise ValueError("a record's header does not end")
            return
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(head["content-length"])
        if stop > len(content):
            raise ValueError("a record's block is cut short")
        yield head, view[start:stop]
        at = stop + 4


def _bare(urn: str | None) -> str | None:
    return urn.strip("<>") if urn else None


RECORD = "record_id string, record_type string, uri string, date string, concurrent_to string, refers_to string, payload_digest string, computed_digest string, payload_bytes long, http_head string, payload string, fields map<string,string>"


def _read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "uri", "date", "concurrent_to", "refers_to", "payload_digest", "computed_digest")] + [("payload_bytes", pa.int64()), ("http_head", pa.string()), ("payload", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])
    for batch in it:
        for content in batch.column(0):
            rows, size = [], 0
            for head, block in parse(unzipped(content.as_py())):
                body = bytes(block)
                http, payload, fields, digest = None, None, None, None
                if head.get("content-type", "").startswith("application/http"):
                    first, _, rest = body.partition(b"\r\n\r\n")
                    http = first.decode("utf-8", "replace")
                    if head["warc-type"] == "response":
                        payload, digest = rest, hashlib.sha1(rest).hexdigest()
                elif head.get("content-type") == "application/warc-fields":
                    fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in body.decode("utf-8", "replace").split("\r\n") if x)]
                stated = head.get("warc-payload-digest", "")
                stated = base64.b32decode(stated[5:]).hex() if stated.startswith("sha1:") else None
                rows.append({"record_id": _bare(head.get("warc-record-id")), "record_type": head.get("warc-type"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "concurrent_to": _bare(head.get("warc-concurrent-to")), "refers_to": _bare(head.get("warc-refers-to")), "payload_digest": stated, "computed_digest": digest, "payload_bytes": None if payload is None else len(payload), "http_head": http, "payload": None if payload is None else payload.decode("utf-8", "replace"), "fields": fields})
                size += len(body)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record."""
    ship(spark)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt*").load(path).select("content").mapInArrow(_read, RECORD)


def assemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """One nested row per capture: its main record, request and metadata.

    A capture without request or metadata has null there; records that name no
    known capture are left out.
    """
    main = records.where(F.col("record_type").isin("response", "revisit"))
    columns = ["record_id", "record_type", "uri", "date", "refers_to", "payload_digest", "computed_digest", "payload_bytes", "http_head"] + (["payload"] if payloads else [])
    main = main.select(F.col("record_id").alias("capture"), F.struct(*columns).alias("main"))
    side = records.where(F.col("concurrent_to").isNotNull() & F.col("record_type").isin("request", "metadata")).select(F.col("concurrent_to").alias("capture"), "record_type", F.struct("record_id", "http_head", "fields").alias("x"))
    # one exchange by capture identifier for all kinds of records: a capture has a handful
    both = main.select("capture", "main", F.lit(None).cast("string").alias("record_type"), F.lit(None).cast(side.schema["x"].dataType).alias("x")).unionByName(side.select("capture", F.lit(None).cast(main.schema["main"].dataType).alias("main"), "record_type", "x"))
    return both.groupBy("capture").agg(
        F.first("main", ignorenulls=True).alias("main"),
        F.first(F.when(F.col("record_type") == "request", F.col("x")), ignorenulls=True).alias("request"),
        F.first(F.when(F.col("record_type") == "metadata", F.col("x")), ignorenulls=True).alias("metadata"),
    ).where("main is not null")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/llm-warc-{uuid.uuid4().hex}"
    write_archives(spark, table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    got = assemble(read_archives(spark, path), payloads=False).select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.coalesce("main.payload_bytes", F.col("metadata.fields")["payload-length"].cast("long")).alias("payload_bytes"),
        F.coalesce("main.computed_digest", "main.payload_digest").alias("payload_digest"),
        F.col("main.record_type").alias("record_type"),
        "capture",
        F.col("main.refers_to").alias("first"),
    )
    got = written(spark, got, "warc-captures")
    # what a revisit refers to is a record; its page is that record's own
    first = got.where("record_type = 'response' and payload_bytes >= " + str(LEAST)).select(F.col("capture").alias("first"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = got.where("record_type = 'revisit'").join(first, "first", "left").select(*columns)
    return got.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits)
