"""WARC archives: pages written as request, response (or revisit) and metadata records, and read back as captures.

``write_archives`` turns every page into three records bound by WARC-Concurrent-To and writes them with Spark's text
writer. Every record ends with an empty line twice over (CR LF CR LF), which is the writer's line separator, so files
are plain WARC/1.1. ``read_records`` reads archives file by file and cuts records by their Content-Length, never by
what a payload holds. ``captures`` joins the records of a transaction: one nested row per response or revisit.

A payload of at least ``least_bytes`` that several pages share is stored once, with the page of the largest id; the others revisit it. Of rows that repeat
that page and payload each is stored, and the first is the one referred to.
Only digests, lengths and ids are grouped for that, so a payload that a third of the pages share costs no more than a number.

Files are bounded by ``file_bytes`` (and one record), so a task that reads one needs that much memory.

Defined results: a null html is an empty payload; a null url is written as ``about:blank``; white space and control characters in a url are
percent-encoded. Pages of one id get records of their own, told apart by a number. Pages without an id are written and read
with a null id. A response without request or metadata records has nulls there; of several, the one of the smallest record
id stays, with their number beside it. Extra columns of pages are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import stored_table
from tidewatch.sources.storage import scratch_path

_LINE, _END = "\r\n", "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x01", *parts).cast("binary"))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _record(headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """A whole record but for the empty lines at its end; a null header is left out."""
    lines = [F.lit("WARC/1.1" + _LINE)]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(_LINE)), F.lit("")))
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END))
    return F.concat(*lines, length, block)


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Digest and length of the payloads that several pages share, with the page that keeps each and how many rows of it have it."""
    each = pages.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes", "page_id").agg(F.count("*").alias("rows"))
    shared = each.groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.max_by("rows", "page_id").alias("repeats"), F.sum("rows").alias("n"))
    return stored_table(shared.filter("n > 1").select(F.col("digest").alias("of_digest"), F.col("bytes").alias("of_bytes"), "keeper", "repeats"), "shared")


def _one_lead(pages: DataFrame) -> DataFrame:
    """Rows that repeat a keeper with its payload: the first is its lead, their numbers are fixed by storing these rows alone."""
    repeated = (F.col("repeats") > 1) & ~F.col("again")
    doubled = pages.filter(repeated).withColumn("place", F.monotonically_increasing_id())
    doubled = stored_table(doubled.withColumn("nth", F.concat(F.lit("r"), F.col("place").cast("string"))), "repeated")
    first = stored_table(doubled.groupBy(F.col("digest").alias("first_digest"), F.col("bytes").alias("first_bytes")).agg(F.min("place").alias("first")), "leads")
    doubled = doubled.join(first, (F.col("digest") == F.col("first_digest")) & (F.col("bytes") == F.col("first_bytes")))
    doubled = doubled.withColumn("lead", F.col("place") == F.col("first")).select(*pages.columns)
    return pages.filter(~F.coalesce(repeated, F.lit(False))).unionByName(doubled)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, file_bytes: int = 32 << 20, compression: str | None = "gzip") -> None:
    """Pages (page_id, url, html) as WARC files in a new folder."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    pages = pages.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    known = revisits(pages, least_bytes)
    # the table of shared payloads is stored, so its size is known: Spark broadcasts it if small, else splits what is skewed
    pages = pages.join(known, (F.col("digest") == F.col("of_digest")) & (F.col("bytes") == F.col("of_bytes")), "left")
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    bad = r"[\x00-\x20\x7f]"
    target = F.coalesce(F.when(F.length("url") > 0, F.regexp_replace("url", bad, "%20")), F.lit("about:blank"))
    own = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    nth = F.monotonically_increasing_id().cast("string")
    pages = pages.withColumns({"again": again, "target": target, "own": own, "nth": nth, "lead": F.col("keeper").isNotNull() & ~again})
    if not known.filter("repeats > 1").isEmpty():
        pages = _one_lead(pages)
    keeper = _uuid(F.lit("response"), F.col("keeper").cast("string"), F.col("digest"))
    ids = {kind: _uuid(F.lit(kind), F.col("own"), F.col("digest" if kind == "response" else "nth")) for kind in ("response", "request", "metadata")}
    # the record others refer to is named by its page and payload; every other response also by its place, so no name is given twice
    answer = F.when(F.col("lead"), ids["response"]).otherwise(_uuid(F.lit("answer"), F.col("own"), F.col("nth")))
    pages = pages.withColumn("answer", answer)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_LINE}Content-Type: text/html; charset=utf-8{_LINE}Content-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    after_host = F.regexp_extract("target", r"^[^:]*://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract("target", r"^[^:]*://([^/?#]*)", 1)
    start = F.when(after_host.startswith("/"), after_host).otherwise(F.concat(F.lit("/"), after_host))
    asked = F.concat(F.lit("GET "), start, F.lit(f" HTTP/1.1{_LINE}Host: "), host, F.lit(_END))
    about = F.concat(F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(_LINE)), F.lit("")), F.lit("fetched: yes" + _LINE))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", F.col("target"))]
    response = _record(
        [
            ("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
            ("WARC-Record-ID", F.col("answer")),
            *common,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(F.col("again"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(F.col("again"), keeper)),
            ("Content-Type", "application/http;msgtype=response"),
        ],
        F.when(F.col("again"), http).otherwise(F.concat(http, F.col("html"))),
    )
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", ids["request"]), *common, ("WARC-Concurrent-To", F.col("answer")), ("Content-Type", "application/http;msgtype=request")],
        asked,
    )
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), *common, ("WARC-Concurrent-To", F.col("answer")), ("Content-Type", "application/warc-fields")],
        about,
    )
    total = pages.select(F.sum("bytes").alias("b"), F.count("*").alias("n")).first()
    records = pages.select(F.explode(F.array(request, response, metadata)).alias("value"))
    options = {"compression": compression} if compression else {}
    records.write.option("lineSep", _END).option("maxRecordsPerFile", _records_per_file(total, file_bytes)).options(**options).text(path)


def _records_per_file(total, file_bytes: int) -> int:
    each = ((total["b"] or 0) / max(total["n"], 1) + 1500) / 3
    return max(3, int(file_bytes / each))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of whole files; a file that ends inside a record fails, for nothing would tell what is missing."""
    import zlib

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = memoryview(content.as_buffer())
            if bytes(data[:2]) == b"\x1f\x8b":
                parts, rest = [], bytes(data)
                while rest:  # one member per file or per record
                    member = zlib.decompressobj(31)
                    parts.append(member.decompress(rest) + member.flush())
                    rest = member.unused_data
                data = memoryview(b"".join(parts))
            whole, at, rows, held = data.tobytes() if not isinstance(data.obj, bytes) else data.obj, 0, [], 0
            while at < len(whole):
                end = whole.index(b"\r\n\r\n", at)
                lines = whole[at:end].decode("utf-8").split(_LINE)
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"{path}: no record at byte {at}")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                length = int(fields["content-length"])
                block = whole[end + 4 : end + 4 + length]
                if len(block) < length:
                    raise ValueError(f"{path}: the record at byte {at} is cut off")
                at = end + 4 + length + 4
                rows.append((fields, block))
                held += length
                if held >= 4 << 20:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    heads, bodies = [], []
    for fields, block in rows:
        http = fields.get("content-type", "").startswith("application/http") and fields.get("warc-type") in ("response", "revisit")
        head, _, body = block.partition(b"\r\n\r\n") if http else (None, None, block)
        heads.append(head.decode("iso-8859-1") if http else None)
        bodies.append(body)
    names = {"type": "warc-type", "id": "warc-record-id", "concurrent_to": "warc-concurrent-to", "refers_to": "warc-refers-to", "uri": "warc-target-uri", "date": "warc-date", "digest": "warc-payload-digest"}
    columns = [pa.array([f.get(h) for f, _ in rows], type=pa.string()) for h in names.values()]
    return pa.RecordBatch.from_arrays([*columns, pa.array(heads, type=pa.string()), pa.array(bodies, type=pa.binary())], names=[*names, "http_head", "body"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: type, id, concurrent_to, refers_to, uri, date, digest, http_head (of responses and
    revisits) and body (what follows; for other records the whole block)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parsed, "type string, id string, concurrent_to string, refers_to string, uri string, date string, digest string, http_head string, body binary")


def captures(records: DataFrame) -> DataFrame:
    """One row per response or revisit: its struct ``response`` (http length, payload length, digest of the payload read,
    digest declared, what it refers to), the structs ``request`` and ``metadata`` and how many there are of each."""
    is_http = F.col("type").isin("response", "revisit")
    text = F.when(~is_http, F.decode("body", "UTF-8"))
    rows = records.select(
        "type",
        "id",
        F.coalesce("concurrent_to", "id").alias("transaction"),
        "refers_to",
        "uri",
        F.regexp_replace("digest", "^sha1:", "").alias("digest"),
        F.when(is_http, F.regexp_extract(F.col("http_head"), r"(?i)content-length: *(\d+)", 1).cast("long")).alias("http_length"),
        F.when(F.col("type") == "response", F.octet_length("body")).cast("long").alias("payload_bytes"),
        F.when(F.col("type") == "response", F.sha1("body")).alias("payload_digest"),
        text.alias("text"),
    )
    rows = stored_table(rows, "records")
    answers = rows.filter(F.col("type").isin("response", "revisit"))

    def of(kind: str) -> DataFrame:
        own = rows.filter(F.col("type") == kind).groupBy("transaction")
        return own.agg(F.min(F.struct("id", "uri", "text")).alias(kind), F.count("*").alias(f"{kind}s")).withColumnRenamed("transaction", f"{kind}_of")

    joined = answers.join(of("request"), F.col("id") == F.col("request_of"), "left").join(of("metadata"), F.col("id") == F.col("metadata_of"), "left")
    response = F.struct("id", "type", "uri", "refers_to", "digest", "http_length", "payload_bytes", "payload_digest")
    return joined.select(response.alias("response"), "request", "metadata", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("metadatas", F.lit(0)).alias("metadatas"))


def page_id_of(metadata: Column) -> Column:
    return F.regexp_extract(metadata["text"], r"pageId: (-?\d+)", 1)


def archived(pages: DataFrame, **options) -> DataFrame:
    """Pages written as archives into scratch space and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    found = captures(read_records(spark, path))
    page = F.when(F.length(page_id_of(F.col("metadata"))) > 0, page_id_of(F.col("metadata"))).cast("long")
    r = F.col("response")
    flat = stored_table(
        found.select(
            page.alias("page_id"),
            F.coalesce(r["payload_bytes"], r["http_length"]).alias("payload_bytes"),
            F.coalesce(r["payload_digest"], r["digest"]).alias("payload_digest"),
            r["type"].alias("record_type"),
            r["id"].alias("record_id"),
            r["refers_to"].alias("refers_id"),
        ),
        "flat",
    )
    # responses that some record refers to; the reference is followed by id, as any reader of the archives would
    wanted = flat.filter("refers_id is not null").select(F.col("refers_id").alias("record_id")).distinct()
    kept = flat.select("record_id", F.col("page_id").alias("refers_to")).join(wanted, "record_id").withColumnRenamed("record_id", "kept_id")
    return flat.join(kept, F.col("refers_id") == F.col("kept_id"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
