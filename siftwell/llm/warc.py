"""Web archives: records written and read by Spark, capture indexes merged by a loser tree.

Every task writes one compressed archive of WARC 1.1 records; offsets count bytes of
its content. Reading an archive gives a run
of captures sorted by URL key and time; the runs are cut at common key ranges and
every range merges its part of all runs, so the whole is ordered from the first
range to the last and no task sees more than its range.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import unquote_plus, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import parts_for, written
from siftwell.session import shared_folder

ARCHIVE_BYTES = 16 << 20
#: Smaller payloads are always stored in full.
LEAST_REVISIT = 100
RUN_SCHEMA = (
    "urlkey string, timestamp string, page_id string, url string, record_type string, payload_bytes long,"
    " payload_digest string, refers_to string, file string, offset long, length long"
)


def first_copies(facts: DataFrame) -> DataFrame:
    """key -> refers_to for every record whose payload another, smaller id holds."""
    first = facts.filter(F.col("n_bytes") >= LEAST_REVISIT).groupBy("digest")
    first = first.agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = facts.filter(F.col("n_bytes") >= LEAST_REVISIT).join(first, "digest")
    return later.filter("refers_to IS NOT NULL AND NOT page_id <=> refers_to").select("key", "refers_to").distinct()


def record(body: Column, date: Column) -> Column:
    """Text of one record without the two empty lines that close it."""
    line = "\r\n"
    id_of = lambda c: F.coalesce(F.url_encode(F.col(c).cast("string")), F.lit(""))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit(line + line),
    )
    block = F.when(F.col("refers_to").isNull(), F.concat(http, body)).otherwise(http)
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    parts = [
        F.lit(f"WARC/1.1{line}WARC-Type: "),
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"),
        F.lit(f"{line}WARC-Record-ID: <urn:page:"),
        id_of("page_id"),
        F.lit(f">{line}WARC-Date: "),
        date,
        F.coalesce(F.concat(F.lit(f"{line}WARC-Target-URI: "), uri), F.lit("")),
        F.lit(f"{line}WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(F.col("refers_to").isNull(), F.lit("")).otherwise(
            F.concat(
                F.lit(f"{line}WARC-Refers-To: <urn:page:"),
                id_of("refers_to"),
                F.lit(f">{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            )
        ),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(line + line),
        block,
    ]
    return F.concat(*parts)


def write_archives(pages: DataFrame, captured: Column, path: str | None = None) -> str:
    """One record per row of page_id, url, html; returns the folder.

    Of records with equal payloads of at least 100 bytes those of the smallest
    page_id are responses and the others revisits of it. A null html is an empty
    payload, a null url leaves its header out, a null id never is the one referred
    to, and rows that repeat the smallest id are all responses. Copies are found
    on digests alone; payloads move once, spread evenly by row.
    """
    path = path or shared_folder(pages.sparkSession, "archives")
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    named = pages.select("page_id", "url", body.alias("html"), captured.alias("captured"))
    named = named.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn(
        "n_bytes", F.octet_length("html").cast("long")
    )
    named = named.withColumn("key", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "digest"))
    _, files = parts_for(pages, "html", ARCHIVE_BYTES)
    later = first_copies(named.select("page_id", "digest", "n_bytes", "key"))
    marked = named.repartition(files, "key").join(later.repartition(files, "key"), "key", "left")
    date = F.date_format(F.coalesce("captured", F.lit("1970-01-01").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = marked.select(record(F.col("html"), date).alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    return path


def url_key(url: str) -> str:
    """Host parts in reverse, then path and query, so that captures of one site stand together."""
    try:
        found = urlsplit(url)
        host = (found.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    rest = (found.path or "/") + (f"?{found.query}" if found.query else "")
    return f"{','.join(reversed(host.split('.')))}){rest}".lower() if host else url.lower()


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, offset and length of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield headers, data[start:stop], at, stop + 4 - at
        at = stop + 4


def bare_id(headers: dict[str, str], name: str) -> str | None:
    value = headers.get(name, "<urn:page:>")[len("<urn:page:") : -1]
    return unquote_plus(value) or None


def captures(file: str, data: bytes) -> list[dict]:
    """The archive's captures as a run sorted by URL key, time and id."""
    run = []
    for headers, block, offset, length in records(data):
        http, _, payload = block.partition(b"\r\n\r\n")
        if headers["WARC-Type"] == "response":
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if f"sha256:{digest}" != headers["WARC-Payload-Digest"]:
                raise ValueError(f"{file}: the payload at byte {offset} does not match its digest")
        else:
            size = int(http.rpartition(b"Content-Length: ")[2])
            digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        url = headers.get("WARC-Target-URI")
        run.append(
            {
                "urlkey": url_key(url or ""),
                "timestamp": headers["WARC-Date"],
                "page_id": bare_id(headers, "WARC-Record-ID"),
                "url": url,
                "record_type": headers["WARC-Type"],
                "payload_bytes": size,
                "payload_digest": digest,
                "refers_to": bare_id(headers, "WARC-Refers-To"),
                "file": file,
                "offset": offset,
                "length": length,
            }
        )
    run.sort(key=order)
    return run


def order(capture: dict) -> tuple:
    return capture["urlkey"], capture["timestamp"], capture["page_id"] or "", capture["file"], capture["offset"]


def read_runs(archives: DataFrame) -> DataFrame:
    """One sorted run of captures per archive file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = captures(file, gzip.decompress(data.as_py()))
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=RUN_ARROW)

    return archives.select("path", "content").mapInArrow(run, RUN_SCHEMA)


RUN_ARROW = pa.schema(
    [
        (name, pa.int64() if kind == "long" else pa.string())
        for name, kind in (x.split() for x in RUN_SCHEMA.split(","))
    ]
)


class LoserTree:
    """Merges sorted sequences; each inner node remembers the loser of its match.

    After a winner is taken only the matches on its own path are played again:
    one comparison per level.
    """

    def __init__(self, runs: Sequence[Iterator], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        left, right = self.heads[a], self.heads[b]
        return left is not None and (right is None or left[:2] < right[:2])

    def _play(self, i: int) -> None:
        """Run i against the losers above it; an empty place above waits for the other side."""
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and (best := self.heads[self.losers[0]]) is not None:
            yield best[2]
            i = self.losers[0]
            self.heads[i] = self._next(i)
            self._replay(i)

    def _replay(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner


def merged(runs: DataFrame) -> DataFrame:
    """All captures in one global order (partition after partition), with their place in the range."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            files = batch.column(batch.schema.get_field_index("file"))
            for file in files.unique().to_pylist():
                by_run.setdefault(file, []).append(batch.filter(pa.compute.equal(files, file)))
        tree = LoserTree([rows(x) for x in by_run.values()], order)
        held, place = [], 0
        for capture in tree:
            held.append(capture | {"place": place})
            place += 1
            if len(held) == 5000:
                yield pa.RecordBatch.from_pylist(held, schema=MERGED_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=MERGED_ARROW)

    ranged = runs.repartitionByRange("urlkey", "timestamp", F.coalesce("page_id", F.lit("")), "file", "offset")
    return ranged.mapInArrow(merge, f"{RUN_SCHEMA}, place long")


MERGED_ARROW = RUN_ARROW.append(pa.field("place", pa.int64()))


def rows(batches: list[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of one run; its pieces arrive as the run was written, in order."""
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            now = order(row)
            if last is not None and now < last:
                raise ValueError(f"the run of {row['file']} is not sorted")
            last = now
            yield row


def archive_and_index(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """Archives written, read back and indexed: one row per record in global capture order.

    ``pages`` holds page_id, url, html; other columns are ignored. ``captured``
    is the capture time, a timestamp (null: the epoch). page_id and refers_to
    come back in the type they had. An empty table gives no rows.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType
    folder = write_archives(pages, F.lit(None).cast("timestamp") if captured is None else captured)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    index = merged(written(read_runs(archives), "capture-runs"))
    return index.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
