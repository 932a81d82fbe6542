"""WARC archives of pages, and their capture index by external merge.

Pages are written as WARC records (a page whose payload an earlier page has is a revisit), the archives are read back, each gives a
locally sorted run of captures, and the runs are merged by URL key and time through a loser tree in each range of keys.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, new_path, stored

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Most records and, by the mean payload, about the most bytes of an archive; captures of a range that one task merges.
RECORDS, ARCHIVE_BYTES, RANGE_ROWS = 4096, 64 << 20, 200_000
EPOCH = "2024-01-01 00:00:00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SALTS = 16


def base32_sha1(value: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8 bytes: eight groups of 20 bits, four characters each."""
    out, digest = [], F.sha1(value.cast("binary"))
    for g in range(8):
        n = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes and payload_digest of every page."""
    read = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    return read.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def _revisits(meta: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, payload_digest, first_id) of the pages that revisit a response. Equal payloads: equal digest and length.

    The smallest page_id is found by partial minima before the shuffle; only groups of more than one page go back to their pages, each
    once for every salt, so a payload that very many pages share is spread over tasks."""
    group = ["payload_digest", "payload_bytes"]
    firsts = meta.filter(F.col("payload_bytes") >= min_bytes).groupBy(*group).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1 and first_id is not null").drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = meta.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALTS)))
    again = salted.join(firsts, [*group, "salt"]).filter("page_id is null or page_id <> first_id")
    return again.select("page_id", "payload_digest", "first_id").distinct()


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, records: int = RECORDS) -> None:
    """Write one WARC/1.1 record for each row as gzip-compressed archives under path: at most `records` records each, and payloads of
    ARCHIVE_BYTES at most (a longer one alone). For that, records are written by classes of payload size, each four times the last, with
    as many to an archive as the largest of the class allows.

    Null html is an empty payload; a null url has no target header; a null page_id an empty record name. Repeated rows give a record
    each. An empty table gives an archive without records; other columns are ignored. Spark's text writer puts the two line ends that
    close a record, so archives can go to any file system that Spark writes; an archive is one gzip stream. The table has no capture
    time: WARC-Date is a fixed day plus page_id seconds."""
    read = with_digests(pages)
    meta = stored(read.select("page_id", "payload_digest", "payload_bytes"), "digests")
    again = stored(_revisits(meta, min_bytes), "revisits")
    least = ARCHIVE_BYTES // records
    level = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(F.col("payload_bytes"), F.lit(1)) / F.lit(float(least))))).cast("int")
    levels = sorted(r["level"] for r in meta.select(level.alias("level")).distinct().collect()) or [0]  # a few numbers
    few = again.count() <= MAX_BROADCAST_ROWS
    same = read["page_id"].eqNullSafe(again["page_id"]) & (read["payload_digest"] == again["payload_digest"])
    marked = read.join(F.broadcast(again) if few else again, same, "left").select(read["*"], again["first_id"])
    crlf, name = F.lit("\r\n"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = F.col("first_id").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.coalesce(F.col("page_id").cast("long"), F.lit(0)) % 10**9), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        _header("WARC-Date", date),
        F.coalesce(_header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(_header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", size.cast("string")),
        crlf,
        block,
    )
    for k in levels:
        own = marked.filter(level == k).select(record.alias("value"))
        own.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // (least * 4**k))).text(path)


def url_key(url: str) -> str:
    """Host labels from the right, then path and query: com,example,www)/a?b"""
    _, found, rest = url.partition("://")
    if not found:
        return ""
    cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:].partition("#")[0].lower()


def parse(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the uncompressed archive, headers, block) of each record of a gzip-compressed archive, decompressed as it is read."""
    with io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw)), 1 << 20) as f:
        at = 0
        while version := f.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            head, size = {}, len(version)
            while line := f.readline():
                size += len(line)
                if line == b"\r\n":
                    break
                name, value = line.decode().rstrip("\r\n").split(": ", 1)
                head[name] = value
            n = int(head["Content-Length"])
            block = f.read(n)
            if f.read(4) != b"\r\n\r\n":
                raise ValueError(f"the record at byte {at} doesn't end where it says")
            yield at, head, block
            at += size + n + 4


def read_runs(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """Each archive's captures in order of URL key, time and page: run, url_key, captured, page_id, payload_bytes, payload_digest,
    record_type, refers_to, offset. The digest of every response is computed anew and held against its header."""
    named = kind == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for at, head, block in parse(batch.column(1)[k].as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(http.rsplit(b": ", 1)[1])
                    if head["WARC-Type"] == "response" and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != n):
                        raise ValueError("a payload doesn't match its digest")
                    refers = head.get("WARC-Refers-To", "<urn:page:>")[10:-1]
                    rows.append((url_key(head.get("WARC-Target-URI", "")), head["WARC-Date"], head["WARC-Record-ID"][10:-1] or None, n, digest, head["WARC-Type"], refers or None, at))
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] if r[2] is None or named else int(r[2])))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.string()] * 3, pa.int64(), *[pa.string()] * 3, pa.int64()], strict=True)] if rows else None
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(rows)), *cols], names=["run", "url_key", "captured", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    got = files.mapInArrow(run, "run string, url_key string, captured string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, offset long")
    return got.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


class LoserTree:
    """k sorted runs; the winner of every match goes up, the loser stays at its node, so the next least costs one path of matches."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.k, self.tree = k, [-1] * max(k, 1)
        for i in range(k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.at[a] < len(self.runs[a]), self.at[b] < len(self.runs[b])
        if not (x and y):
            return x
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node] = i
                return
            if self._less(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.at[w := self.tree[0]] < len(self.runs[w]):
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self._play(w)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures of all runs in one global order of (url_key, captured, page_id): range_no and place say where.

    runs: as read_runs gives them, kept in shared storage. Ranges of the full key, about `range_rows` captures each, are dealt to tasks, so
    memory stays bounded and a URL with very many captures is cut as well. Each task merges the pieces of runs in its range through a
    loser tree; ranges follow each other in order. Null page_ids come first among equals; repeated rows follow each other in order of
    their runs; no rows give none; a column named range_no or place would be replaced."""
    key = ["url_key", "captured", "page_id"]
    names = [c for c in runs.columns if c not in ("range_no", "place")]
    runs = runs.select(*names)
    least = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartitionByRange(max(least, -(-runs.count() // range_rows)), *key).sortWithinPartitions("run", *key)
    dealt = dealt.withColumn("range_no", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        got = pa.Table.from_batches(got)
        ids = [(x is not None, x) for x in got["page_id"].to_pylist()]
        pieces: dict[str, list[tuple]] = {}
        for name, *entry in zip(*(got[c].to_pylist() for c in ("run", "url_key", "captured")), ids, range(len(got)), strict=True):
            pieces.setdefault(name, []).append(tuple(entry))
        order = [e[3] for e in LoserTree(list(pieces.values()))]
        yield from got.take(pa.array(order)).append_column("place", pa.array(range(len(order)), pa.int64())).combine_chunks().to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema) + ", range_no int, place long"
    return dealt.mapInArrow(run, schema)


def archive(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write pages as WARC archives (under path, or a new folder of the shared one), read them back and return the merged capture
    index: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, run, offset, range_no, place.

    Null html is an empty payload; a null url has no target header and the key ''. Repeated rows give a record each; those of a
    page_id that is its payload's smallest are responses. A null page_id never is the smallest; if a payload has no other, its records
    are responses. An empty table gives no rows; other columns are ignored."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path, min_bytes)
    runs = stored(read_runs(spark, path, pages.schema["page_id"].dataType.simpleString()), "runs")
    return merge_runs(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "run", "offset", "range_no", "place")
