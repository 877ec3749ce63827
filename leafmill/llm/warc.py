"""Web archives: records written as WARC/1.1 files, read back, and their captures in global order.

Writing: a record is one gzip member. Tasks gather members into segments of about SEGMENT bytes, and Spark's text
writer puts segments into files on whatever store the shared folder is on; its line separator is an
empty gzip member, so that a file is a plain sequence of members. Of equal payloads of LEAST bytes and more, the row with the largest
page_id is the response and the others are revisits that name it. Digests that occur once play no part in that; the
others are broadcast up to MOST_BROADCAST, beyond which rows and digests meet in a join whose hot digests Spark splits.

Reading: an archive is parsed member by member. Content-Length bounds a record, so payloads may hold anything. The
digest of a response is computed from what was read and must be the one that its header states. An archive's captures,
sorted by URL key and time, are a run.

Merging: all runs are cut into ranges by (URL key, time, place in the archive), so that a hot URL spreads over ranges. A task
gets its range's stretch of every run, each in order, and merges them by a loser tree: one comparison a level for
each capture. The ranges one after the other are all captures in global order.

Defined cases: a null html is an empty payload; a null page_id is smaller than any other, is written without a
number and read back as null; rows that share the largest page_id of equal payloads are all responses; a null url is written as
an empty one; control characters in a url are escaped; repeated rows are separate records; an empty table gives an empty
result; payloads of any length are one record; further columns play no part. The tables hold no time of capture: it
follows from page_id, seconds from the beginning of 2024 within one year.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import SHUFFLE_CLEANUP, deleted, dropped, session_conf, shared_folder, written
from .ngram_join import small_batches

LEAST = 1000
#: Bytes of a segment and segments of a file, about; a longer record is a segment of its own.
SEGMENT, SEGMENTS_A_FILE = 8 << 20, 4
#: Repeated digests that are broadcast at most.
MOST_BROADCAST = 100_000
#: Captures in a range of the merge, about.
RANGE_ROWS = 100_000
YEAR = 365 * 86_400
LEVELS = (6, 9, 1, 3, 0)


def member(data: bytes, level: int = LEVELS[0]) -> bytes:
    """One gzip member without name and time."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: What stands between members: an empty one.
BETWEEN = member(b"")
ARCHIVE_TEXT = {"lineSep": BETWEEN.decode("latin-1"), "encoding": "ISO-8859-1"}


def _escaped(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url)


def _record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{sha1}>"


def record(page_id: int | None, url: str | None, captured: str, sha1: str, payload: bytes, response: int | None) -> bytes:
    """A record: a revisit of the page ``response`` if that is given, else a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if response is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, sha1)}", f"WARC-Date: {captured}",
        f"WARC-Target-URI: {_escaped(url or '')}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", "Content-Type: application/http; msgtype=response",
    ]
    if response is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(response, sha1)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_responses(pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, captured, payload, sha1 and ``response``: the page that the row revisits, or null."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    second = F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(YEAR))
    captured = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + second), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    named = F.col("page_id").cast("long").alias("page_id")
    groups = pages.select(named, F.sha1(payload).alias("_sha1"), F.octet_length(payload).alias("_size")).where(F.col("_size") >= LEAST)
    groups = groups.groupBy("_sha1", "_size").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    groups = written(groups, "repeated-payloads")
    few = groups.limit(most_broadcast + 1).count() <= most_broadcast
    rows = pages.select(named, F.col("url").cast("string").alias("url"), captured.alias("captured"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    same = (F.col("sha1") == F.col("_sha1")) & (F.octet_length("payload") == F.col("_size"))
    rows = rows.join(F.broadcast(groups) if few else groups.hint("merge"), same, "left")
    again = F.col("page_id").isNull() | (F.col("page_id") < F.col("_last"))
    out = rows.select("page_id", "url", "captured", "payload", "sha1", F.when(again, F.col("_last")).alias("response"))
    out._reads = groups
    return out


def write_archives(pages: DataFrame, path: str, most_broadcast: int = MOST_BROADCAST) -> None:
    """Writes a record for every row (page_id, url, html) into archives in the folder ``path``."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([BETWEEN.join(held)], pa.binary())], ["segment"])
        for b in batches:
            for page_id, url, captured, payload, sha1, response in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = record(page_id, url, captured, sha1, payload, response)
                # Stored or compressed bytes that hold the separator by chance or intent are compressed otherwise.
                held.append(next(m for m in (member(data, level) for level in LEVELS) if BETWEEN not in m))
                size += len(held[-1])
                if size >= SEGMENT:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    spark = pages.sparkSession
    small_batches(pages)
    rows = with_responses(pages, most_broadcast)
    table = rows.mapInArrow(segments, "segment binary").select(F.col("segment").cast("string").alias("value"))
    with session_conf(spark, {SHUFFLE_CLEANUP: "true"}):
        table.write.options(**ARCHIVE_TEXT).option("maxRecordsPerFile", SEGMENTS_A_FILE).text(path)
    dropped(rows._reads)


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each gzip member that holds any data."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, to, parts, step = zlib.decompressobj(31), at, [], 4096
        while not z.eof:
            if to >= len(view):
                raise ValueError(f"the archive ends within the member at {at}")
            parts.append(z.decompress(view[to : to + step]))
            to, step = min(to + step, len(view)), min(2 * step, 1 << 20)
        end = to - len(z.unused_data)
        data = b"".join(parts)
        if data:
            yield at, end - at, data
        at = end


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}


def parsed(data: bytes) -> dict:
    """A record's page_id, url, captured, type, refers_to, digest and the size of the whole payload."""
    head, rest = data.split(b"\r\n\r\n", 1)
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    if len(block) != int(h["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {h['warc-record-id']} is cut short")
    http, payload = block.split(b"\r\n\r\n", 1)
    size, kind = int(_headers(http)["content-length"]), h["warc-type"]
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {h['warc-record-id']} does not hold the payload of its digest")
    number = lambda x: int(x) if (x := x.split(":")[2]) else None
    return {
        "page_id": number(h["warc-record-id"]), "url": h["warc-target-uri"], "captured": h["warc-date"], "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": number(h["warc-refers-to"]) if kind == "revisit" else None,
    }


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query, in lower case; a text that is no URL as it is."""
    try:
        parts = urlsplit(url.lower())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    place = ",".join(reversed(host.strip(".").split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


CAPTURE = "url_key string, captured string, archive string, at long, length long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
FIELDS = [c.split()[0] for c in CAPTURE.split(", ")]
KINDS = [pa.int64() if c.split()[1] == "long" else pa.string() for c in CAPTURE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], FIELDS)


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives in ``path``; those of one archive are in order of URL key and time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = []
                for at, length, data in members(content):
                    r = parsed(data) | {"archive": archive, "at": at, "length": length}
                    r["url_key"] = url_key(r["url"])
                    rows.append(tuple(r[f] for f in FIELDS))
                yield _batch(sorted(rows, key=lambda r: r[:4]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    small_batches(files)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").mapInArrow(read, CAPTURE)


def loser_tree(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """All items of sorted iterators in order. The inner nodes hold the losers of their matches, so the
    winner's successor plays once on each level on its way up."""
    k = len(runs)
    heads = [next(r, None) for r in runs]
    beats = lambda a, b: heads[b] is None or (heads[a] is not None and heads[a] <= heads[b])
    losers, winner = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while k and heads[top] is not None:
        yield heads[top]
        heads[top] = next(runs[top], None)
        node = (top + k) // 2
        while node:
            if not beats(top, losers[node]):
                top, losers[node] = losers[node], top
            node //= 2


def merged_captures(runs: DataFrame) -> DataFrame:
    """The captures of written ``runs`` in global order: the partitions one after the other, each in order."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches: dict[str, list[tuple]] = {}
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                stretches.setdefault(r[2], []).append(r)
        rows = []
        for r in loser_tree([map(lambda r: (r[:4], r), s) for s in stretches.values()]):
            rows.append(r[1])
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    ranges = runs.repartitionByRange(max(1, runs.count() // RANGE_ROWS), "url_key", "captured", "archive", "at")
    # Each run's stretch by itself, in the order that the run was written in.
    return ranges.sortWithinPartitions("archive", "url_key", "captured", "at").mapInArrow(merge, CAPTURE)


def archived_captures(pages: DataFrame) -> DataFrame:
    """The rows of ``pages`` written into archives, read back and merged: the columns of CAPTURE.

    The archives are deleted once their captures are written as runs."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/leafmill-archives-{uuid.uuid4().hex}"
    write_archives(pages, path)
    runs = written(capture_runs(spark, path), "capture-runs")
    deleted(spark, path)
    return merged_captures(runs)
