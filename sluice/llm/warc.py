"""WARC archives: written from pages, read back, and assembled into one nested row per capture.

Every page gives a request, a response (or a revisit of an equal payload) and a metadata record.
Request and metadata name the capture in WARC-Concurrent-To; the assembly groups the records by
that identifier.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import own_folder, settle
from sluice.session import table

#: Payloads below this size are never written as revisits.
REVISIT_BYTES = 1000
#: Payload of one archive, about: a task unpacks one at a time.
FILE_BYTES = 64_000_000
_BREAK = "\r\n"
_FIELDS = [
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("headers", pa.map_(pa.string(), pa.string())), ("http_header", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
]
RECORDS = "record_id string, record_type string, concurrent_to string, target_uri string, refers_to string, headers map<string,string>, http_header string, payload binary, payload_bytes long, payload_digest string"


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(digest, keep, repeated) of payloads that several rows share: the largest page_id where they have `least` bytes or
    more, and whether a page_id is there more than once."""
    small = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").alias("bytes"))
    each = small.groupBy("digest", "bytes", "page_id").agg(F.count("*").alias("n"))
    shared = each.groupBy("digest", "bytes").agg(F.max("page_id").alias("keep"), F.sum("n").alias("n"), F.max(F.when(F.col("page_id").isNotNull(), F.col("n"))).alias("most")).filter("n > 1")
    return shared.select("digest", F.when(F.col("bytes") >= least, F.col("keep")).alias("keep"), (F.coalesce("most", F.lit(0)) > 1).alias("repeated"))


def _record(kind: str, headers: list[tuple[str, Column | str]], block: Column) -> Column:
    lines: list[Column] = [F.lit(f"WARC/1.1{_BREAK}WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind]
    for name, value in headers:
        lines += [F.lit(f"{_BREAK}{name}: "), value if isinstance(value, Column) else F.lit(value)]
    return F.concat(*lines, F.lit(f"{_BREAK}Content-Length: "), F.octet_length(block).cast("string"), F.lit(_BREAK * 2), block, F.lit(_BREAK))


def captures_text(pages: DataFrame, shared: DataFrame) -> DataFrame:
    """(value): the three records of each page; each ends with one line break, the writer adds the other.

    A capture's id is made of page_id, digest and a number: 1 for the page's first row with that payload, by url, so that a
    revisit can name the response that it repeats. Rows without page_id, to which nothing refers, take any number.
    """
    row = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A").alias("url"), "html", F.sha1(F.encode("html", "UTF-8")).alias("digest"))
    joined = row.join(shared, "digest", "left")
    numbered = F.when(F.col("page_id").isNull(), F.monotonically_increasing_id()).otherwise(1)
    if shared.filter("repeated").isEmpty():
        marked = joined.withColumn("seq", numbered)
    else:
        again = F.col("page_id").isNotNull() & F.coalesce("repeated", F.lit(False))
        counted = joined.filter(again).withColumn("seq", F.row_number().over(W.partitionBy("page_id", "digest").orderBy("url")).cast("long"))
        marked = joined.filter(~again).withColumn("seq", numbered).unionByName(counted)
    again = F.col("keep").isNotNull() & ~F.col("keep").eqNullSafe(F.col("page_id"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    own = F.concat(F.lit("<urn:page:"), page, F.lit(":"), F.col("digest"), F.lit(":"), F.col("seq").cast("string"), F.lit(">"))
    date = "2024-01-01T00:00:00Z"
    host, path = F.regexp_extract("url", r"^.*?://([^/?#]*)", 1), F.regexp_extract("url", r"^.*?://[^/?#]*(.*)$", 1)
    request = _record(
        "request",
        [("WARC-Record-ID", F.replace(own, F.lit("urn:page"), F.lit("urn:request"))), ("WARC-Concurrent-To", own), ("WARC-Target-URI", F.col("url")), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=request")],
        F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{_BREAK}Host: "), host, F.lit(_BREAK * 2)),
    )
    head = F.lit(f"HTTP/1.1 200 OK{_BREAK}Content-Type: text/html; charset=UTF-8{_BREAK * 2}")
    common = [("WARC-Record-ID", own), ("WARC-Target-URI", F.col("url")), ("WARC-Date", date), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("Content-Type", "application/http; msgtype=response")]
    response = _record("response", common, F.concat(head, F.col("html")))
    profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    revisit = _record("revisit", [*common, profile, ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("keep").cast("string"), F.lit(":"), F.col("digest"), F.lit(":1>")))], head)
    facts = F.concat(F.lit("page-id: "), page, F.lit(f"{_BREAK}payload-bytes: "), F.octet_length("html").cast("string"), F.lit(_BREAK))
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", F.replace(own, F.lit("urn:page"), F.lit("urn:metadata"))), ("WARC-Concurrent-To", own), ("WARC-Target-URI", F.col("url")), ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
        facts,
    )
    return marked.select(F.concat_ws(_BREAK, request, F.when(again, revisit).otherwise(response), metadata).alias("value"))


def write_warc(pages: DataFrame, path: str, per_file: int = 2000, file_bytes: int = FILE_BYTES, compression: str = "gzip") -> None:
    """Write page_id, url and html as WARC files below path, of at most per_file captures and about file_bytes of payload each.

    Pages are written in classes of payload size, each with as many captures a file as fit; a larger payload has a file of its
    own. A null html is an empty payload, a null url an empty target. Of pages that share a payload of
    REVISIT_BYTES or more, those with the largest page_id carry it; pages without page_id only
    revisit. Repeated rows each give a capture of their own; other columns are ignored.
    """
    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    shared = settle(revisits(chosen), "revisits")  # its size is then known, which decides the join
    least = max(1, file_bytes // per_file)
    size_class = F.when(F.octet_length("html") <= least, 0).otherwise(F.ceil(F.log2(F.octet_length("html") / F.lit(least))).cast("int"))
    for k in sorted(r[0] for r in chosen.select(size_class).distinct().collect()) or [0]:
        rows = captures_text(chosen.filter(size_class == k), shared)
        rows.write.mode("append").option("lineSep", _BREAK).option("compression", compression).option("maxRecordsPerFile", max(1, per_file >> k)).text(path)


def _read(stream: io.BufferedIOBase, size: int) -> bytes:
    """So many bytes of a stream, or what there is before it ends or breaks off."""
    parts = []
    while size > 0:
        try:
            part = stream.read(min(size, 1 << 20))
        except (EOFError, zlib.error):
            break
        if not part:
            break
        parts.append(part)
        size -= len(part)
    return b"".join(parts)


def parse_records(content: bytes) -> Iterator[dict]:
    """The records of one archive; a gzip file, of one member or many, is unpacked as a stream, a record at a time.

    A header that was cut off ends the archive; a body that was cut off comes as far as it goes.
    """
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw

    def line() -> bytes:
        try:
            return stream.readline()
        except (EOFError, zlib.error):
            return b""

    while True:
        while (start := line()) and not start.startswith(b"WARC/"):
            pass
        headers: dict[str, str] = {}
        while (text := line()) and text.strip(b"\r\n"):
            name, _, value = text.partition(b":")
            headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        if not text:
            return  # the end, or a header that was cut off
        size = headers.get("content-length", "0")
        block = _read(stream, int(size) if size.isdigit() else 0)
        kind = headers.get("warc-type", "")
        http, payload = (None, block)
        if headers.get("content-type", "").startswith("application/http"):
            first, _, payload = block.partition(b"\r\n\r\n")
            http = first.decode("utf-8", "replace")
        yield {
            "record_id": headers.get("warc-record-id"), "record_type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "target_uri": headers.get("warc-target-uri"),
            "refers_to": headers.get("warc-refers-to"), "headers": list(headers.items()), "http_header": http, "payload": payload,
            "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(),
        }


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below path; payloads=False leaves the bodies of responses out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in _FIELDS], [n for n, _ in _FIELDS])

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for row in parse_records(content.as_py()):
                    if not payloads and row["record_type"] == "response":
                        row["payload"] = None
                    rows.append(row)
                    held += row["payload_bytes"]
                    if held > 4_000_000 or len(rows) >= 4000:
                        yield made(rows)
                        rows, held = [], 0
                yield made(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, target_uri, record_type, response, requests and metadata.

    Records of other types than the four are left out. A request or metadata record whose capture is
    missing gives a row with a null response; a capture without them has empty arrays. Records that
    were repeated in the archives stay repeated inside the arrays; of responses with one id that counts which comes
    first by type, digest and target.
    """
    known = records.filter(F.col("record_type").isin("request", "response", "revisit", "metadata"))
    whole = F.struct("record_id", "record_type", "refers_to", "headers", "http_header", "payload", "payload_bytes", "payload_digest")
    is_capture = F.col("record_type").isin("response", "revisit")
    grouped = known.groupBy(F.coalesce(F.when(is_capture, F.col("record_id")).otherwise(F.col("concurrent_to")), F.col("record_id")).alias("capture_id")).agg(
        F.max("target_uri").alias("target_uri"),
        F.min_by(whole, F.when(is_capture, F.struct("record_type", "payload_digest", "target_uri"))).alias("response"),
        F.collect_list(F.when(F.col("record_type") == "request", whole)).alias("requests"),
        F.collect_list(F.when(F.col("record_type") == "metadata", whole)).alias("metadata"),
    )
    return grouped.select("capture_id", "target_uri", F.col("response.record_type").alias("record_type"), "response", "requests", "metadata")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}/warc"
    write_warc(table(spark, sf_dir, "pages"), path)
    captures = assemble(read_warc(spark, path)).filter("response is not null")
    facts = F.decode(F.get("metadata", F.lit(0))["payload"], "UTF-8")
    page = F.regexp_extract(facts, r"page-id: (-?\d+)", 1)
    size = F.regexp_extract(facts, r"payload-bytes: (\d+)", 1).cast("long")
    revisit = F.col("record_type") == "revisit"
    said = F.regexp_replace(F.element_at("response.headers", F.lit("warc-payload-digest")), "^sha1:", "")
    return captures.select(
        F.when(page != "", page).cast("long").alias("page_id"),
        F.when(revisit, size).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, said).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, F.regexp_extract("response.refers_to", r"<urn:page:(-?\d+):", 1)).cast("long").alias("refers_to"),
    )


QUERIES = {"op7_warc": op7_warc}

ORACLES = {
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        k AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN keep IS NULL OR keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN keep <> page_id THEN keep END AS refers_to
        FROM p LEFT JOIN k USING (payload_digest)""",
}
