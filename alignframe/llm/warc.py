"""WARC archives and their capture index.

Pages become gzip-member WARC records. Equal payloads are stored once: the record of the largest page id is the response, the
others are revisits that name it. Every task writes archive files together with a run of index lines that is sorted by
URL key, time and page. ``merge_index`` merges the runs externally: index lines are dealt by ranges of the
key, and each range merges its slices of all runs with a loser tree. The ranges in order are one global capture history,
in which every line has its number.

A null payload is an empty one. A null URL has the empty key and no target header. A record without a page id has no response
over one that has an id, and names nothing and is named by nothing. Rows that repeat id and payload are records of the
same kind each. An empty table makes no archive, no index line and no row.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignframe.llm.common import stored, tasks, write_file
from alignframe.session import fresh_path

FILE_BYTES = 32 << 20
# Packed bytes that the reader takes at a time.
PIECE_BYTES = 4 << 10
# Index lines that a range holds, about: some hundred megabytes of a worker.
RANGE_LINES = 1 << 18
# The WARC profile of a revisit with the same payload, and the end of headers and records.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL, _END = b"\r\n", b"\r\n\r\n"
_PRINTED = "".join(map(chr, range(33, 127)))

INDEX = "run string, place bigint, url_key string, captured bigint, page_id bigint, offset bigint, length bigint, record_type string"


def url_key(url: str | None) -> str:
    """Host parts in reverse, then path and query: captures of a site lie together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower()


def page_urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, captured: int, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP header and leaves the payload out."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Date: {datetime.fromtimestamp(captured, UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{digest_text(sha1)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"WARC-Record-ID: {page_urn(page_id)}")
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe=_PRINTED)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {page_urn(refers_to)}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + _END + block + _END) + packer.flush()


def records(blob: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``offset, headers, block`` of every record of an archive.

    A member is unpacked from pieces of ``PIECE_BYTES``: what follows it in its last piece is copied, not the rest of the archive.
    """
    at, whole = 0, memoryview(blob)
    while at < len(blob):
        unpacker, upto, parts = zlib.decompressobj(31), at, []
        while not unpacker.eof and upto < len(blob):
            parts.append(unpacker.decompress(whole[upto : upto + PIECE_BYTES]))
            upto = min(upto + PIECE_BYTES, len(blob))
        head, _, rest = b"".join(parts).partition(_END)
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield at, headers, rest[: int(headers["Content-Length"])]
        at = upto - len(unpacker.unused_data)


def first_responses(pages: DataFrame) -> DataFrame:
    """``page_id, sha1, refers_to`` of the pages that repeat another one's payload; ``pages``: ``page_id, sha1``."""
    largest = pages.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return pages.join(largest, "sha1").where("page_id <> refers_to").select("page_id", "sha1", "refers_to").distinct()


def write_archives(pages: DataFrame, captured: Column, folder: str, key: str = "page_id", url: str = "url",
                   html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages into ``folder``; return the sorted index runs as a stored table with the columns ``INDEX``."""
    rows = pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.unix_seconds(captured).alias("captured"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    ).withColumn("sha1", F.unhex(F.sha1("html")))
    # Ids and digests only: a payload that a third of all pages share is a hot key of narrow rows.
    revisits = stored(first_responses(stored(rows.select("page_id", "sha1"), "digests")), "revisits")
    joined = rows.join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "captured", "html", "sha1", "refers_to")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, files, held = TaskContext.get().partitionId(), 0, 0
        blobs: list[bytes] = []
        lines: list[tuple] = []

        def flush() -> pd.DataFrame:
            nonlocal files, held, blobs, lines
            name = f"pages-{part:06d}-{files:06d}.warc.gz"
            write_file(f"{folder}/{name}", b"".join(blobs))
            lines.sort()
            out = pd.DataFrame(
                [(name, i, k, t, None if p == _NO_ID else p, at, n, kind) for i, (k, t, p, at, n, kind) in enumerate(lines)],
                columns=["run", "place", "url_key", "captured", "page_id", "offset", "length", "record_type"],
            ).astype({"page_id": "Int64"})
            files, held, blobs, lines = files + 1, 0, [], []
            return out

        for batch in batches:
            ids = [None if pd.isna(p) else int(p) for p in batch["page_id"]]
            refers = [None if pd.isna(p) else int(p) for p in batch["refers_to"]]
            for page_id, url_, at, text, sha1, to in zip(
                ids, batch["url"], batch["captured"], batch["html"], batch["sha1"], refers, strict=True
            ):
                at = 0 if pd.isna(at) else int(at)
                blob = record(page_id, url_, at, text.encode(), bytes(sha1), to)
                kind = "response" if to is None else "revisit"
                lines.append((url_key(url_), at, _NO_ID if page_id is None else page_id, held, len(blob), kind))
                blobs.append(blob)
                held += len(blob)
                if held >= file_bytes:
                    yield flush()
        if blobs:
            yield flush()

    return stored(joined.mapInPandas(run, INDEX), "index-runs")


_NO_ID = -(1 << 63)


class LoserTree:
    """K-way merge: each inner node keeps the run that lost there, so the next smallest takes one comparison per level."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.width = 1
        while self.width < len(runs):
            self.width *= 2
        self.heads = [next(r, None) for r in runs] + [None] * (self.width - len(runs))
        self.losers = [0] * self.width
        self.best = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.width:
            return node - self.width
        a, b = self._play(2 * node), self._play(2 * node + 1)
        winner, self.losers[node] = (a, b) if self._wins(a, b) else (b, a)
        return winner

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.best]) is not None:
            yield head
            at = self.best
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.width) // 2
            while node:
                if self._wins(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.best = at


def merge_index(runs: DataFrame) -> DataFrame:
    """All index lines with ``history_position``: numbered from 0 by URL key, time and page (bytes, then numbers; null first).

    The ranges grow in number with the index. Lines equal in all three are numbered by archive and offset.
    """

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        # The slices of a range are its share of the index, without any page.
        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            for line in batch.itertuples(index=False):
                page = _NO_ID if pd.isna(line.page_id) else int(line.page_id)
                slices.setdefault(line.run, []).append(
                    (line.url_key, line.captured, page, line.run, line.offset, line.length, line.record_type)
                )
        out: list[tuple] = []
        tree = LoserTree([iter(slices[name]) for name in sorted(slices)]) if slices else ()
        for i, (k, t, page, name, at, n, kind) in enumerate(tree):
            out.append((part, i, k, t, None if page == _NO_ID else page, name, at, n, kind))
            if len(out) == 10_000:
                yield _lines(out)
                out = []
        yield _lines(out)

    # Captures of one URL may be a third of all: time and page cut it into ranges as well.
    ranges = max(tasks(runs.sparkSession), -(-runs.count() // RANGE_LINES))
    by_range = runs.repartitionByRange(ranges, "url_key", "captured", "page_id")
    merged = stored(by_range.sortWithinPartitions("run", "place").mapInPandas(
        merge,
        "range int, position bigint, url_key string, captured bigint, page_id bigint, run string, offset bigint, length bigint, record_type string",
    ), "history")
    # One row per range.
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in merged.groupBy("range").agg(F.count(F.lit(1))).collect()):
        offsets.append((part, before))
        before += n
    starts = F.broadcast(runs.sparkSession.createDataFrame(offsets, "range int, before bigint"))
    return merged.join(starts, "range").withColumn("history_position", F.col("before") + F.col("position")).drop("range", "position", "before")


def _lines(rows: list[tuple]) -> pd.DataFrame:
    columns = ["range", "position", "url_key", "captured", "page_id", "run", "offset", "length", "record_type"]
    return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64"})


def read_archives(spark, folder: str) -> DataFrame:
    """``run, offset, page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record in ``folder``.

    The digest of a response is computed from what is read and compared with its header.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        id_of = lambda urn: int(urn[len("<urn:page:") : -1]) if urn else None
        for batch in batches:
            for path, blob in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for at, headers, block in records(blob):
                    http, _, payload = block.partition(_END)
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = next(int(v) for h, _, v in (x.partition(b": ") for x in http.split(_EOL)) if h == b"Content-Length")
                    if kind == "response" and (size, digest) != (len(payload), digest_text(hashlib.sha1(payload).digest())):
                        raise ValueError(f"payload differs from its header: {path} at {at}")
                    rows.append((
                        path.rpartition("/")[2], at, id_of(headers.get("WARC-Record-ID")), size, digest, kind,
                        id_of(headers.get("WARC-Refers-To")),
                    ))
                columns = ["run", "offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    return files.mapInPandas(
        parse,
        "run string, offset bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    )


def archive(pages: DataFrame, captured: Column, folder: str | None = None) -> DataFrame:
    """Write, index and read back: the records, each with its place in the global capture history."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    runs = write_archives(pages, captured, folder)
    if runs.isEmpty():
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url_key string, captured bigint, history_position bigint")
    history = merge_index(runs).select("run", "offset", "url_key", "captured", "history_position")
    return read_archives(spark, folder).join(history, ["run", "offset"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "history_position"
    )
