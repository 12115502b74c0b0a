"""WARC archives: writing captures, reading archives, and assembling transactions.

A capture is a request, a response (or a revisit of an earlier response) and a
metadata record; the other records name the response in WARC-Concurrent-To, and
assembly joins all three through it into one nested row per capture.

Archives are written by Spark's own writer and commit protocol, so a retried task
leaves nothing twice: a row's records are one value and the record end is the
line separator.  They are read as whole files of a bounded number of captures,
and parsed by Content-Length, so that nothing in a payload can be mistaken for a
record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, shared_path

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, "
    "payload_digest string, payload_bytes long, computed_digest string, fields map<string,string>, payload binary"
)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing blank lines; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    return F.concat_ws(END, F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")), F.lit(""), block)


def _numbered(rows: DataFrame, counts: DataFrame, run: int = 1000) -> DataFrame:
    """rows with row: 0, 1, ... among rows that are equal throughout, of which counts tells how many (n) there are.

    Rows that repeat come back as copies of one, run at a time, so that many of them
    are many tasks' work; where none does, there is nothing to join.
    """
    if counts.where("n > 1").isEmpty():
        return rows.withColumn("row", F.lit(0).cast("long"))
    same = ["page_id", "url", "digest", "bytes"]
    plain = rows.withColumns({"none": F.col("page_id").isNull(), "page_id": F.coalesce("page_id", F.lit(0).cast("long"))})
    key = [*same, "none"]
    again = counts.where("n > 1").select(F.coalesce("page_id", F.lit(0).cast("long")).alias("page_id"), "url", "digest", "bytes", F.col("page_id").isNull().alias("none"), "n")
    once = plain.join(again, key, "left_anti").withColumn("row", F.lit(0).cast("long"))
    runs = plain.join(again, key).groupBy(*key, "n").agg(F.min("html").alias("html")).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(run).cast("long"))))
    copies = runs.repartition(*key, "from").withColumn("row", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + run, F.col("n")) - 1)))
    both = once.select(*key, "html", "row").unionByName(copies.select(*key, "html", "row"))
    return both.select(F.when(~F.col("none"), F.col("page_id")).alias("page_id"), "url", "html", "digest", "bytes", "row")


def plan_captures(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """pages(page_id, url, html) with digest, bytes, row and winner: the response that a revisit refers to, null for a response.

    Of rows with equal payloads of min_bytes or more the largest page_id is the
    response; among repeated rows of that id the greatest url, then the last row.
    row numbers rows that are equal throughout, so it is the same whenever a lost
    part is computed again.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", "").alias("url"), body.alias("html"),
        F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("bytes"),
    )
    # pages are read once for this small table, which tells winners and repeated rows, and once to be written
    counts = materialize(rows.groupBy("page_id", "url", "digest", "bytes").agg(F.count("*").alias("n")), "counts")
    rows = _numbered(rows, counts)
    groups = counts.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.sum("n").alias("n"), F.max(F.struct(F.col("page_id"), F.col("url"), (F.col("n") - 1).alias("row"))).alias("winner"))
    # written first, so that its size is known where the join is planned: small is broadcast, large is dealt out and split where it is skewed
    repeated = materialize(groups.where("n > 1").drop("n"), "repeated")
    at = F.struct(F.col("page_id"), F.col("url"), F.col("row"))
    joined = rows.join(repeated, ["digest", "bytes"], "left")
    return joined.withColumn("winner", F.when(F.col("winner").isNotNull() & (at != F.col("winner")), F.col("winner")))


def write_captures(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 1000, per_file: int = 1000) -> None:
    """Archives of the captures of pages(page_id, url, html) under path, gzipped, per_file captures each at most.

    Null html is an empty payload, a null url an empty target; repeated rows are
    captures of their own.
    """
    rows = plan_captures(pages, min_bytes)
    own = _urn(F.lit("response"), F.col("page_id"), F.col("url"), F.col("digest"), F.col("row"))
    target = F.when(F.col("url") != "", F.col("url"))
    revisit = F.col("winner").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END + END))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(F.lit("request"), own)), ("WARC-Concurrent-To", own), ("WARC-Target-URI", target), ("WARC-Date", F.lit(date)), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(F.col("url") == "", "/").otherwise(F.col("url")), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END + END)),
    )
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", own), ("WARC-Target-URI", target), ("WARC-Date", F.lit(date)),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(revisit, _urn(F.lit("response"), F.col("winner.page_id"), F.col("winner.url"), F.col("digest"), F.col("winner.row")))),
            ("WARC-Profile", F.when(revisit, F.lit(PROFILE))), ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(F.lit("metadata"), own)), ("WARC-Concurrent-To", own), ("WARC-Target-URI", target), ("WARC-Date", F.lit(date)), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat_ws(END, F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string")), F.lit("")),
    )
    value = F.concat_ws(END + END, request, response, metadata).alias("value")
    rows.select(value).write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: io.BufferedIOBase, payload: bool = True) -> Iterator[dict]:
    """The records of one archive, plain or gzipped (in any number of members)."""
    if stream.read(2) == b"\x1f\x8b":
        stream.seek(0)
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    else:
        stream.seek(0)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # blank lines between records
        head: dict[str, str] = {}
        while (line := stream.readline().strip(b"\r\n")) != b"":
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        block = stream.read(int(head.get("content-length") or 0))
        kind = head.get("warc-type", "")
        out = {
            "record_type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"),
            "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "content_type": head.get("content-type"), "payload_digest": head.get("warc-payload-digest"),
            "payload_bytes": None, "computed_digest": None, "fields": {}, "payload": None,
        }
        body = block
        if out["content_type"] and out["content_type"].startswith("application/http"):
            top, _, body = block.partition(b"\r\n\r\n")
            out["fields"] = _fields(top.split(b"\r\n")[1:])
        elif out["content_type"] == "application/warc-fields":
            out["fields"] = _fields(block.split(b"\r\n"))
        if kind != "revisit":
            out["payload_bytes"], out["computed_digest"] = len(body), hashlib.sha1(body).hexdigest()
            out["payload"] = body if payload else None
        yield out


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.partition(b":") for x in lines if b":" in x)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the archives under path; without payload only its length and SHA-1 leave the parser."""
    names = [c.strip().split(" ")[0] for c in RECORD.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary(), "fields": pa.map_(pa.string(), pa.string())}

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for r in parse(io.BytesIO(content.as_py()), payload):
                    held.append(r)
                    size += 500 + len(r["payload"] or b"")
                    if size > 4 << 20:
                        yield table(held)
                        held, size = [], 0
                if held:
                    yield table(held)

    def table(rows: list[dict]) -> pa.RecordBatch:
        get = lambda n: [list(r[n].items()) if n == "fields" else r[n] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(get(n), kinds.get(n, pa.string())) for n in names], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (a response or revisit), requests and metadata.

    Requests and metadata meet their response through WARC-Concurrent-To in one
    shuffle.  Records whose response is missing make a capture without one; of several
    responses with one id the greatest counts; requests and metadata are ordered by id.
    """
    aside = F.col("record_type").isin("request", "metadata")
    whole = F.struct(*[c for c in records.columns if c != "fields"], F.map_entries("fields").alias("fields"))
    grouped = (
        records.where(F.col("record_type").isin("request", "metadata", "response", "revisit"))
        .withColumn("capture_id", F.when(aside, F.coalesce("concurrent_to", "record_id")).otherwise(F.col("record_id")))
        .groupBy("capture_id")
        .agg(
            F.max(F.when(~aside, whole)).alias("response"),
            F.array_sort(F.collect_list(F.when(F.col("record_type") == "request", whole))).alias("requests"),
            F.array_sort(F.collect_list(F.when(F.col("record_type") == "metadata", whole))).alias("metadata"),
        )
    )
    return grouped


def roundtrip(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write pages(page_id, url, html) as WARC, read the archives back, and report each page's record from them.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url).  A response's
    length and SHA-1 are those of the payload read back; a revisit has no payload, its
    digest is the record's and its length the metadata's.  refers_to is the page_id of
    the response that the revisit names.  Other columns of pages are ignored; an empty
    table gives no rows.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_captures(pages, path, min_bytes=min_bytes)
    field = lambda name: F.try_element_at(F.map_from_entries(F.element_at("metadata", 1).getField("fields")), F.lit(name))
    read = assemble(read_records(spark, path, payload=False))
    flat = read.where(F.col("response").isNotNull()).select(
        "capture_id", F.nullif(field("page-id"), F.lit("")).cast("long").alias("page_id"), field("payload-bytes").cast("long").alias("stated"), F.col("response.record_type").alias("record_type"),
        F.col("response.payload_bytes").alias("read"), F.col("response.computed_digest").alias("computed"), F.regexp_replace("response.payload_digest", "^sha1:", "").alias("digest"),
        F.col("response.refers_to").alias("ref"), F.col("response.target_uri").alias("url"),
    )
    flat = materialize(flat, "captures")
    first = flat.where("record_type = 'response'").select(F.col("capture_id").alias("ref"), F.col("page_id").alias("refers_to"))
    return flat.join(first, "ref", "left").select(
        "page_id", F.coalesce("read", "stated").alias("payload_bytes"), F.coalesce("computed", "digest").alias("payload_digest"), "record_type", "refers_to", "url"
    )


#: What roundtrip() gives, in SQL over pages (for rows that do not repeat an id).
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to, nullif(url, '') AS url
FROM w
"""
