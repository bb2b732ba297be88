"""Web archives: records written in parallel, read back, and their index merged.

Each task writes its pages as records of one archive file, through Spark's own text writer with
the mark between records as line separator, so the files lie wherever Spark can write. Reading
them back gives a capture run per file, sorted by URL key and time. Runs are merged by ranges of
the key: within a range a loser tree takes the next capture from k runs at a time, and the ranges
in their order make up the global history.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.llm.common import ROOT, picked
from tabulary.session import scratch_path

END = "\r\n"
BETWEEN = END * 2
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
#: Bytes of payload wanted in a file, and never to be exceeded unless by a single record, as a
#: file is read as a whole.
FILE_BYTES, MOST_FILE_BYTES = 16 << 20, 512 << 20
#: Pages made into records at once.
ROWS = 256


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1, as archives state it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captured_at(page_id: int | None) -> str:
    """Pages have no time of their own; the id counts seconds from a fixed day."""
    try:
        moment = EPOCH + timedelta(seconds=page_id or 0)
    except OverflowError:
        moment = EPOCH
    return moment.strftime("%Y-%m-%dT%H:%M:%SZ")


def record_name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def one_line(url: str) -> str:
    """A URL as a header may hold it: line breaks and tabs as percent codes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id, url: str, payload: bytes, digest: str, response: bool, refers_to) -> bytes:
    """One WARC record without the mark that ends it.

    A revisit keeps the HTTP header, which states the length of the full payload, and leaves the
    payload to the response it refers to.
    """
    http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {len(payload)}{BETWEEN}".encode()
    block = http + payload if response else http
    head = [
        VERSION,
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        f"WARC-Date: {captured_at(page_id)}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if not response:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {record_name(refers_to)}"]
    return END.join(head).encode() + BETWEEN.encode() + block


def classified(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with their digest, the id of the response of their payload and their kind.

    The largest id of a digest is found on narrow rows and combined before the shuffle; whole
    payloads are joined by digest, where adaptive execution splits a hot one.
    """
    pages = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn(
        "digest", F.sha1("html")
    )
    kept = (
        pages.filter(F.octet_length("html") >= least_bytes)
        .groupBy(F.col("digest").alias("kept_digest"))
        .agg(F.max("page_id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
        # A payload that occurs once needs no partner.
        .filter("copies > 1")
        .drop("copies")
    )
    joined = pages.join(kept, pages["digest"] == kept["kept_digest"], "left")
    return joined.select(
        "page_id",
        "url",
        "html",
        "digest",
        "kept_id",
        (F.col("kept_id").isNull() | F.col("page_id").eqNullSafe(F.col("kept_id"))).alias("response"),
    )


def recorded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of classified pages, a few at a time, as each is held several times over."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            out = []
            for page_id, url, html, digest, kept_id, response in zip(
                *(column.to_pylist() for column in batch.slice(start, ROWS).columns), strict=True
            ):
                stated = base64.b32encode(bytes.fromhex(digest)).decode()
                out.append(record(page_id, url or "", html.encode(), stated, response, kept_id))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write(
    df: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
) -> None:
    """Writes a WARC record per row to compressed archive files below ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest id is
    the response and the others revisit it; rows that repeat that id are responses too, and so
    are all rows of a payload that has no id but null. A null payload is empty, a null URL an
    empty one. Extra columns are not looked at; an empty table gives archives without records.
    """
    chosen = picked(df, page_id=id_col, url=url_col, html=html_col)
    rows = classified(chosen, least_bytes)

    records = rows.mapInArrow(recorded, "value binary").select(F.col("value").cast("string").alias("value"))
    size = F.octet_length("html") + 1024
    mean, most = chosen.agg(F.avg(size), F.max(size)).first()
    per_file = max(1, int(min(FILE_BYTES // (mean or 1024), MOST_FILE_BYTES // (most or 1024))))
    writer = records.write.option("maxRecordsPerFile", per_file)
    writer.option("lineSep", BETWEEN).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """Host labels from the top level down, then path and query, in lower case."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    labels = [label for label in host.removeprefix("www.").split(".") if label]
    key = ",".join(reversed(labels)) + (f":{port}" if port else "")
    query = f"?{parts.query}" if parts.query else ""
    return f"{key}){parts.path or '/'}{query}".lower()


HEADER = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.MULTILINE)


def parsed(data: bytes) -> Iterator[dict]:
    """Captures of one archive, in the order of its records."""
    at = 0
    while (at := data.find(VERSION.encode(), at)) >= 0:
        head_end = data.index(BETWEEN.encode(), at)
        head = {k.lower(): v for k, v in HEADER.findall(data, at, head_end + 2)}
        start, size = head_end + 4, int(head[b"content-length"])
        block = data[start : start + size]
        http, _, payload = block.partition(BETWEEN.encode())
        stated = dict((k.lower(), v) for k, v in HEADER.findall(http))
        response = head[b"warc-type"] == b"response"
        digest = head[b"warc-payload-digest"].decode().removeprefix("sha1:")
        length = int(stated[b"content-length"])
        if response and (len(payload) != length or payload_digest(payload) != digest):
            raise ValueError(f"the payload of {head[b'warc-record-id']!r} is not what was written")
        number = re.compile(rb"<urn:x-page:(-?\d*)>")
        own = number.fullmatch(head[b"warc-record-id"])[1]
        refers = number.fullmatch(head.get(b"warc-refers-to", b"<urn:x-page:>"))[1]
        uri = head[b"warc-target-uri"].decode()
        yield {
            "page_id": int(own) if own else None,
            "url": uri,
            "url_key": url_key(uri),
            "captured_at": head[b"warc-date"].decode(),
            "payload_bytes": length,
            "payload_digest": digest,
            "record_type": "response" if response else "revisit",
            "refers_to": int(refers) if refers else None,
            "offset": at,
        }
        at = start + size


CAPTURE = (
    "page_id long, url string, url_key string, captured_at string, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long, offset long, archive string"
)
NAMES = [part.split()[0] for part in CAPTURE.split(", ")]


def read(spark: SparkSession, path: str) -> DataFrame:
    """A capture per record of the archives below ``path``, each file a run sorted by key and time.

    Payloads of responses are checked against length and digest.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = content if not content.startswith(b"\x1f\x8b") else gzip.decompress(content)
                captures = sorted(parsed(data), key=capture_order)
                columns = [[capture[c] for capture in captures] for c in NAMES[:-1]]
                columns.append([name.rpartition("/")[2]] * len(captures))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(columns, _kinds(), strict=True)], names=NAMES
                )

    return archives.select("path", "content").mapInArrow(run, CAPTURE)


def _kinds() -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return [kinds[part.split()[1]] for part in CAPTURE.split(", ")]


def capture_order(capture: dict) -> tuple:
    known = capture["page_id"] is not None
    return capture["url_key"], capture["captured_at"], known, capture["page_id"] or 0


class LoserTree:
    """The smallest of the heads of k sorted runs, found again with one comparison a level."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs = runs
        self.heads = [next(run, None) for run in runs]
        self.losers = [-1] * max(1, len(runs))
        for run in range(len(runs)):
            self._climb(run)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head comes before b's; an ended run comes last."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _climb(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node:
            loser = self.losers[node]
            if loser < 0:  # not met yet while the tree is built
                self.losers[node] = winner
                return
            if self._less(loser, winner):
                self.losers[node], winner = winner, loser
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._climb(winner)


def merged_index(captures: DataFrame) -> DataFrame:
    """Captures in global order of URL key, time and id.

    Captures are ranged by key, time and id, so even the history of one URL may span tasks.
    Within a range the run of each archive stays sorted and the loser tree merges the runs.
    """
    captures.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    order = ["url_key", "captured_at", "page_id"]
    ranged = captures.repartitionByRange(*order).sortWithinPartitions("archive", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [batch for batch in batches if batch.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables).combine_chunks()
        keys, times, ids, archives = (
            table.column(name).to_pylist() for name in (*order, "archive")
        )
        starts = [
            n for n in range(len(archives)) if n == 0 or archives[n] != archives[n - 1]
        ]
        ends = [*starts[1:], len(archives)]

        def heads(start: int, end: int) -> Iterator[tuple]:
            for n in range(start, end):
                yield keys[n], times[n], ids[n] is not None, ids[n] or 0, n

        tree = LoserTree([heads(s, e) for s, e in zip(starts, ends, strict=True)])
        placed = table.take(pa.array([head[-1] for head in tree], pa.int64()))
        yield from placed.to_batches(max_chunksize=10_000)

    return ranged.mapInArrow(run, CAPTURE)


def archive(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    path: str | None = None,
) -> DataFrame:
    """Writes the archives of ``df``, reads them back and returns the merged index.

    A row per capture, globally ordered by URL key, time and id: page_id, url, url_key,
    captured_at, payload_bytes, payload_digest, record_type, refers_to, offset, archive. ``offset``
    counts bytes of the unpacked archive, whose file is one gzip stream. Length and digest are those of the full payload also for a revisit. See :func:`write` for nulls,
    repeated rows and empty tables.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "archives")
    write(df, path, id_col, url_col, html_col, least_bytes)
    return merged_index(read(spark, path))


def histories(index: DataFrame) -> DataFrame:
    """First and last capture and number of distinct payloads of each URL key."""
    return index.groupBy("url_key").agg(
        F.min("captured_at").alias("first_at"),
        F.max("captured_at").alias("last_at"),
        F.count(F.lit(1)).alias("captures"),
        F.countDistinct("payload_digest").alias("payloads"),
    )
