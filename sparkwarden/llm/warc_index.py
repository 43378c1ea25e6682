r"""WARC archives of captures, and their index: sorted runs merged by a loser tree into one globally ordered history.

Captures are written as WARC records, several archives side by side, and read back from them. Every batch of an archive's
captures gives a run of index entries sorted by URL key and timestamp. Ranges of the key, cut at quantiles of a bounded
sample, are dealt to tasks; a task puts its part of every run, each sorted already, in a scratch file and merges them with
a k-way loser tree that holds a few entries of each, so the parts together are the whole index in order.

Of captures whose payloads are equal and of at least `REVISIT_BYTES`, the one with the largest id is stored as response,
the others as revisits that refer to it; smaller payloads are always stored.

Archives are written by Spark's text writer with the record end as line separator, so any file system that Spark knows
will do; each is a gzip file. URL key: host labels reversed, then path and query, in lower case.

Defined cases: a null payload is empty, a null URL is empty; an empty table gives no rows. Pages carry no capture time;
theirs is EPOCH and page_id seconds, taken modulo SPAN, in UTC whatever the session's time zone. Rows that share an id are captures of their own. A null id is written as an empty one and comes back as null;
among equal payloads it counts as smallest. Other columns do not take part.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import pickle
import tempfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import new_path, partitions, written

REVISIT_BYTES = 1000
EPOCH = 1_577_836_800  # 2020-01-01T00:00:00Z
#: Seconds, about 68 years, that capture times made of ids are spread over.
SPAN = 1 << 31
#: Copies of each repeated digest in its join, so that a payload that a third of all pages have is dealt to as many tasks.
SALTS = 32
#: Records of an archive, so that its file stays far below the 2 GB that one value of Spark can hold.
ARCHIVE = 20_000
#: Entries of a run that are in memory at a time.
CHUNK = 256
#: Keys in the sample that range borders are taken from.
SAMPLE = 20_000
END = "\r\n\r\n"
READ = 1 << 20

CAPTURE = "page_id long, url string, captured long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    rest = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#:]*)", 1), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Every capture with its payload's length and SHA-1, its record type and what it refers to."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    # Only digests of which there are several take part in the join.
    several = rows.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = salted.join(several, ["payload_digest", "salt"], "left").drop("salt")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("payload_bytes") >= REVISIT_BYTES)
    return rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def record(df: DataFrame) -> Column:
    """The text of a WARC record up to its end mark."""
    uuid = lambda c: F.regexp_replace(F.md5(F.concat(F.lit("page/"), F.coalesce(c.cast("string"), F.lit("")))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    seconds = F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SPAN))
    of_day = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")
    when = F.concat(day, F.lit("T"), two(of_day / 3600), F.lit(":"), two(F.pmod(of_day, F.lit(3600)) / 60), F.lit(":"), two(F.pmod(of_day, F.lit(60))), F.lit("Z"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END)
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    one_line = F.regexp_replace("url", r"[\r\n]", "")
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: "), uuid(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), one_line),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.concat(F.lit("X-Payload-Length: "), "payload_bytes"),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), uuid(F.col("refers_to")), F.lit("\r\nX-Refers-To-Page: "), F.col("refers_to").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    ]
    return F.concat(F.concat_ws("\r\n", *head), F.lit(END), body)


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    """Gzip archives of at most ARCHIVE records in folder path."""
    rows = decided(pages, **columns)
    rows.select(record(rows).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE).text(path)


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip archive that comes in pieces; one record is in memory at a time."""
    unzip, held = zlib.decompressobj(31), bytearray()
    pieces = iter(pieces)

    def fill(least: int) -> bool:
        nonlocal unzip
        while len(held) < least:
            if (piece := next(pieces, None)) is None:
                return False
            while piece:
                held.extend(unzip.decompress(piece))
                piece = unzip.unused_data
                if unzip.eof:
                    unzip = zlib.decompressobj(31)
        return True

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("an archive ends within a record")
                return
        lines = bytes(held[:at]).decode("utf-8", "replace").split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        if not lines[0].startswith("WARC/") or not fill(at + 4 + size):
            raise ValueError("not a whole WARC record")
        yield head, bytes(held[at + 4 : at + 4 + size])
        del held[: at + 4 + size]
        fill(4)
        del held[:4]


def _captures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CAPTURE. Length and digest of a response are taken from its payload; a revisit has those in its headers."""
    import calendar
    import time

    for batch in batches:
        for content in batch.column("content"):
            buffer = content.as_buffer()
            rows = []
            for head, block in records(buffer.slice(a, min(READ, buffer.size - a)).to_pybytes() for a in range(0, buffer.size, READ)):
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                kind = head["WARC-Type"]
                stored = kind == "response"
                when = calendar.timegm(time.strptime(head["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ"))
                rows.append((int(head["X-Page-ID"]) if head["X-Page-ID"] else None, head["WARC-Target-URI"], when, len(payload) if stored else int(head["X-Payload-Length"]), hashlib.sha1(payload).hexdigest() if stored else head["WARC-Payload-Digest"].removeprefix("sha1:"), kind, int(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None))
                if len(rows) == 4096:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "captured", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(spark, path: str) -> DataFrame:
    """Captures of all archives in a folder: page_id, url, captured (Unix seconds), payload_bytes, payload_digest, record_type, refers_to, archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_captures, CAPTURE)


class LoserTree:
    """Merges k sorted sequences: each inner node keeps the loser of its match, so the next item takes one path of matches."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        k = self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * k  # tree[0] is the winner
        for leaf in range(k):
            self._play(leaf, build=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, leaf: int, build: bool = False) -> None:
        node, own = (leaf + self.k) // 2, leaf
        while node > 0:
            if build and self.tree[node] < 0:
                self.tree[node] = own
                return
            if self._beats(self.tree[node], own):
                own, self.tree[node] = self.tree[node], own
            node //= 2
        self.tree[0] = own

    def __iter__(self) -> Iterator:
        while (head := self.heads[self.tree[0]]) is not None:
            yield head
            run = self.tree[0]
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


PART = "bucket int, run long, part array<struct<url_key: string, captured: long, page_id: long, seq: long>>"


def _cut(borders: list[str]):
    """Sorts the captures of a task into a run and cuts it at the borders."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = sorted((k, t, p is not None, p or 0, s) for k, t, p, s in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("url_key", "captured", "page_id", "seq")), strict=True))
            keys = [f"{e[0]} {e[1]:020d}" for e in entries]
            at = [0, *(bisect.bisect_left(keys, b) for b in borders), len(entries)]
            parts = [(i, [{"url_key": k, "captured": t, "page_id": p if known else None, "seq": s} for k, t, known, p, s in entries[a:b]]) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            if parts:
                kind = pa.list_(pa.struct([("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("seq", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x[0]["seq"] for _, x in parts], pa.int64()), pa.array([x for _, x in parts], kind)], ["bucket", "run", "part"])

    return run


class Runs:
    """Sorted runs in one scratch file of the task; each is read back a few entries at a time."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()
        self.chunks: list[list[tuple[int, int]]] = []

    def add(self, entries: list[tuple]) -> None:
        own = []
        for a in range(0, len(entries), CHUNK):
            at = self.file.seek(0, 2)
            own.append((at, self.file.write(pickle.dumps(entries[a : a + CHUNK], 5))))
        self.chunks.append(own)

    def read(self, run: int) -> Iterator[tuple]:
        for at, size in self.chunks[run]:
            self.file.seek(at)
            yield from pickle.loads(self.file.read(size))


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets: dict[int, Runs] = {}
    for batch in batches:
        for bucket, part in zip(batch.column(batch.schema.get_field_index("bucket")), batch.column(batch.schema.get_field_index("part")), strict=True):
            buckets.setdefault(bucket.as_py(), Runs()).add([(e["url_key"], e["captured"], e["page_id"] is not None, e["page_id"] or 0, e["seq"]) for e in part.as_py()])
    for bucket in sorted(buckets):
        runs = buckets.pop(bucket)
        tree = iter(LoserTree([runs.read(k) for k in range(len(runs.chunks))]))
        at = 0
        while own := list(itertools.islice(tree, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), bucket, np.int32)), pa.array(np.arange(at, at + len(own), dtype=np.int64)), pa.array([e[0] for e in own], pa.string()), pa.array([e[1] for e in own], pa.int64()), pa.array([e[4] for e in own], pa.int64())], ["bucket", "place", "url_key", "captured", "seq"])
            at += len(own)


def merged_index(captures: DataFrame) -> DataFrame:
    """captures with a unique number seq: rows (seq, url_key, captured, index_place), index_place: 0, 1, ... in global order."""
    n = partitions(captures.sparkSession)
    entries = captures.select(url_key(F.col("url")).alias("url_key"), "captured", "page_id", "seq")
    total = entries.count()
    border = F.concat_ws(" ", "url_key", F.lpad(F.col("captured").cast("string"), 20, "0"))
    sample = entries.filter(F.pmod(F.xxhash64("seq"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / max(1, total))))).select(border.alias("b"))
    keys = sorted(r["b"] for r in sample.collect())  # about SAMPLE keys at most
    borders = [keys[len(keys) * k // n] for k in range(1, n)] if len(keys) >= n else []
    parts = entries.mapInArrow(_cut(borders), PART)
    merged = written(parts.repartitionById(n, parts["bucket"]).mapInArrow(_merged, "bucket int, place long, url_key string, captured long, seq long"), "merged_index")
    counts = {r["bucket"]: r["n"] for r in merged.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each partition
    starts, at = [], 0
    for b in sorted(counts):
        starts.append((b, at))
        at += counts[b]
    starts = captures.sparkSession.createDataFrame(starts, "bucket int, start long")
    return merged.join(F.broadcast(starts), "bucket").select("seq", "url_key", "captured", (F.col("start") + F.col("place")).alias("index_place"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every page's record as read back from the archives, with its place in the merged index."""
    path = new_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    captures = written(read_archives(spark, path).withColumn("seq", F.monotonically_increasing_id()), "captures")
    return captures.join(merged_index(captures).drop("captured"), "seq").drop("seq", "url")


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d,
         regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://', '') AS rest
  FROM pages
), f AS (
  SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d
), k AS (
  SELECT page_id, n, d, regexp_replace(regexp_extract(rest, '^([^/?#:]*)', 1), '^www\.', '') AS host,
         regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '#.*$', '') AS path
  FROM p
), u AS (
  SELECT page_id, n, d, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS url_key FROM k
)
SELECT page_id, 1577836800 + (page_id % 2147483648 + 2147483648) % 2147483648 AS captured, n AS payload_bytes, u.d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to,
       url_key, row_number() OVER (ORDER BY url_key, (page_id % 2147483648 + 2147483648) % 2147483648, page_id) - 1 AS index_place
FROM u LEFT JOIN f ON u.d = f.d
"""
