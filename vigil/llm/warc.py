"""WARC archives: writing, reading and transaction assembly (operator 9).

A page becomes a request, a response (or a revisit without payload) and a metadata record. Request and
metadata name the response in ``WARC-Concurrent-To``; assembly joins the three by it into one nested row
per capture. Of pages with equal payloads of at least ``least`` bytes the one with the largest page id is
stored, the others are revisits that refer to it.

Archives are gzip files of records one after the other, written and read by Spark, so they may be in any
store. Reading splits the stream at ``WARC/1.1`` lines and then trusts ``Content-Length`` alone: a
payload that has such a line itself is put together again.

Results for special input: a null html is an empty payload; a null url gives ``urn:page:`` and the id;
line breaks in a url become spaces; a null page id stays null; repeated rows are captures of their own,
of which one is the response; of rows with the
largest id and equal payloads but several urls the last url is it. Payloads of any length are kept whole. Only the page id, url and html are read,
so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import written

VERSION = "WARC/1.1"
LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, fields map<string,string>, http_head string, payload binary, payload_bytes long, payload_sha1 string"
)
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest")]
    + [("fields", pa.map_(pa.string(), pa.string())), ("http_head", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string())]
)


def _urn(kind: str, *parts: Column) -> Column:
    """A record id from the kind of record and what tells its page from others."""
    h = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("")) for p in parts)))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def _record(head: dict[str, Column], block: Column) -> Column:
    """Headers, those that are null left out, an empty line, and the block. The writer ends it with two line breaks."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in head.items()]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit(VERSION), *lines, size), F.lit("\r\n\r\n"), block)


#: Repeated rows up to which their keys are broadcast.
MOST_REPEATS = 100_000
_KEYS = ["_sha1", "_bytes", "_page", "_url"]


def plan_captures(pages: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """Id, url, payload, its size and digest, the number among equal rows, and the capture that each revisit refers to.

    Everything is told by content, so a task that runs again gives the same. Keys without payloads are counted and written
    down first; payloads are shuffled once, by digest, and a digest that many rows have is split by adaptive execution.
    Rows equal in all three columns are brought together, counted, and numbered; there are none in most tables.
    """
    rows = pages.select(F.col(page).alias("_page"), F.col(url).cast("string").alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_payload"))
    rows = rows.withColumn("_bytes", F.octet_length("_payload").cast("long")).withColumn("_sha1", F.sha1(F.col("_payload").cast("binary")))
    keys = written(rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_copies")), "warc-keys")
    stored = keys.where(F.col("_bytes") >= least).groupBy("_sha1", "_bytes").agg(F.max(F.struct(F.col("_page").alias("page"), F.col("_url").alias("url"))).alias("_stored"), F.sum("_copies").alias("_n"))
    stored = stored.where("_n > 1").select("_sha1", "_bytes", "_stored")
    repeats = keys.where("_copies > 1")
    n_repeats = repeats.count()
    single = rows.withColumn("_nth", F.lit(1))
    if n_repeats:
        repeats = F.broadcast(repeats) if n_repeats <= MOST_REPEATS else repeats
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in _KEYS]
        which = same[0] & same[1] & same[2] & same[3]
        many = rows.alias("r").join(repeats.alias("k"), which).select("r.*", "k._copies").groupBy(*_KEYS).agg(F.first("_payload").alias("_payload"), F.first("_copies").alias("_copies"))
        many = many.select("_page", "_url", "_payload", "_bytes", "_sha1", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_nth"))
        single = rows.alias("r").join(repeats.alias("k"), which, "left_anti").withColumn("_nth", F.lit(1)).unionByName(many)
    first = (F.col("_nth") == 1) & F.col("_page").eqNullSafe(F.col("_stored.page")) & F.col("_url").eqNullSafe(F.col("_stored.url"))
    return single.join(stored, ["_sha1", "_bytes"], "left").withColumn("_revisit", F.col("_stored").isNotNull() & ~first)


def write(pages: DataFrame, path: str, *, page: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Writes three records for each page."""
    rows = plan_captures(pages, page=page, url=url, html=html, least=least)
    uri = F.coalesce(F.regexp_replace(F.col("_url"), r"[\r\n]", " "), F.concat(F.lit("urn:page:"), F.coalesce(F.col("_page").cast("string"), F.lit(""))))
    of = lambda kind: _urn(kind, F.col("_page"), F.col("_url"), F.col("_sha1"), F.col("_nth"))
    response = of("response")
    digest = F.concat(F.lit("sha1:"), F.col("_sha1"))
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": uri}
    host, rest = F.regexp_extract(uri, r"^[^:]*://([^/?#]*)", 1), F.regexp_extract(uri, r"^[^:]*://[^/?#]*([^#]*)", 1)
    request = _record(
        {"WARC-Type": F.lit("request"), "WARC-Record-ID": of("request"), **common, "WARC-Concurrent-To": response, "Content-Type": F.lit("application/http; msgtype=request")},
        F.concat(F.lit("GET "), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
    )
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    refers = _urn("response", F.col("_stored.page"), F.col("_stored.url"), F.col("_sha1"), F.lit(1))
    captured = _record(
        {
            "WARC-Type": F.when(F.col("_revisit"), "revisit").otherwise("response"), "WARC-Record-ID": response, **common, "WARC-Payload-Digest": digest,
            "WARC-Profile": F.when(F.col("_revisit"), PROFILE), "WARC-Refers-To": F.when(F.col("_revisit"), refers), "Content-Type": F.lit("application/http; msgtype=response"),
        },
        F.when(F.col("_revisit"), http).otherwise(F.concat(http, F.col("_payload"))),
    )
    about = _record(
        {"WARC-Type": F.lit("metadata"), "WARC-Record-ID": of("metadata"), **common, "WARC-Concurrent-To": response, "Content-Type": F.lit("application/warc-fields")},
        F.coalesce(F.concat(F.lit("page-id: "), F.col("_page").cast("string"), F.lit("\r\n")), F.lit("")),
    )
    records = rows.select(F.explode(F.array(request, captured, about)).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _headers(data: bytes) -> dict[str, str]:
    out = {}
    for line in data.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _parsed(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple]:
    """Records from (file, what stands between two version lines), in order."""
    held, name = b"", None
    mark = f"{VERSION}\r\n".encode()
    for file, piece in pieces:
        if held and file == name:
            piece = held + mark + piece
        held, name = b"", file
        end = piece.find(b"\r\n\r\n")
        if end < 0:
            held = piece if piece.strip() else b""
            continue
        head = _headers(piece[:end])
        size = int(head.get("content-length", 0))
        if len(piece) - end - 4 < size:
            held = piece
            continue
        block, kind = piece[end + 4 : end + 4 + size], head.get("warc-type")
        http, payload, fields = None, None, {}
        if head.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http = top.decode("utf-8", "replace")
        elif head.get("content-type") == "application/warc-fields":
            fields = _headers(block)
        else:
            payload = block
        digest = head.get("warc-payload-digest", "").partition(":")[2] or None
        stored = kind == "response"
        yield (
            kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), digest, list(fields.items()), http,
            payload if stored else None, len(payload) if stored else None, hashlib.sha1(payload).hexdigest() if stored else None,
        )


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row per record. Without ``payloads`` only their sizes and digests leave the readers."""
    lines = spark.read.option("lineSep", f"{VERSION}\r\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((f, p) for b in batches for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        rows, size = [], 0
        for row in _parsed(pieces):
            rows.append(row if payloads else (*row[:9], None, *row[10:]))
            size += len(row[9] or b"") if payloads else 0
            if len(rows) >= 4096 or size > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return lines.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit, its request, and the fields of its metadata records.

    Records are brought together by the response's id, which the others name in WARC-Concurrent-To.
    """
    main = F.col("record_type").isin("response", "revisit")
    each = F.struct("record_type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "http_head", "payload", "payload_bytes", "payload_sha1")
    grouped = records.where(main | F.col("record_type").isin("request", "metadata")).withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")))
    request = F.struct("record_id", "http_head", "date")
    out = grouped.groupBy("capture_id").agg(
        F.max(F.when(main, each)).alias("response"),
        F.max(F.when(F.col("record_type") == "request", request)).alias("request"),
        F.flatten(F.collect_list(F.when(F.col("record_type") == "metadata", F.map_entries("fields")))).alias("metadata"),
    )
    return out.where(F.col("response").isNotNull())


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Page id, size and digest of the full payload, kind of record and the page referred to, per capture."""
    whole = assemble(read(spark, path, payloads=False))
    page = F.get(F.filter("metadata", lambda e: e["key"] == "page-id"), 0)["value"].cast("long")
    rows = whole.select(F.col("capture_id"), page.alias("page_id"), "response.record_type", "response.refers_to", F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_sha1").alias("own_sha1"))
    stored = rows.where(F.col("record_type") == "response").select(F.col("capture_id").alias("to_id"), F.col("page_id").alias("to_page"), F.col("own_bytes").alias("to_bytes"), F.col("own_sha1").alias("to_sha1"))
    asked = rows.where(F.col("refers_to").isNotNull()).select(F.col("refers_to").alias("to_id")).distinct()
    joined = rows.join(stored.join(asked, "to_id", "left_semi"), F.col("refers_to") == F.col("to_id"), "left")
    return joined.select("page_id", F.coalesce("own_bytes", "to_bytes").alias("payload_bytes"), F.coalesce("own_sha1", "to_sha1").alias("payload_digest"), "record_type", F.col("to_page").alias("refers_to"))


def oracle() -> str:
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
s AS (SELECT d, max(page_id) AS page FROM p WHERE n >= {LEAST} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id <> page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> page THEN page END AS refers_to
FROM p LEFT JOIN s ON p.d = s.d AND n >= {LEAST}"""
