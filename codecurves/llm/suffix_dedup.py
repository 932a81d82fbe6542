"""Exact substring dedup: every byte goes that a 50-byte string covers which also starts in a document of a smaller id.

Documents are cut into shards by ranges of doc_id, of about equal bytes. Within a shard, a suffix array (Larsson-Sadakane) and its common prefixes (Kasai) put
equal strings side by side. Across shards, sorted runs of keys are merged by binary search to tell each shard which of its strings a
smaller shard has. Keys of all strings would be many times the text, so three merges follow each other. Anchors: 20-byte strings picked so
that equal 50-byte strings have an equal anchor; text whose anchors repeat nowhere is done with. Covers: all the bytes of a run of strings
with one anchor; where they are equal so are the strings. Strings themselves: only where an anchor has several covers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from . import common
from .common import joined, spans, utf8
from .suffixes import common_prefixes, suffix_array

LENGTH, ANCHOR = 50, 20
#: Bytes of text in a shard, and of keys in a bucket that one task merges: both bound a task's memory.
SHARD_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
BLOCK = 1 << 18
SALTS = 16
#: Most ranges of doc_id; what they begin with is all that the driver holds and sends out. Beyond MAX_RANGES * SHARD_BYTES of text, shards grow.
MAX_RANGES = 1 << 20
#: What the rows that reach a shard beside its documents are: exact copies; anchors that a smaller shard has, or only a larger one; covers
#: (runs of strings with one anchor) that a smaller shard has, or whose strings are asked for; strings that a smaller shard has.
COPY, ANCHOR_BEFORE, ANCHOR_AFTER, COVER_BEFORE, COVER_SPLIT, STRING_BEFORE = range(6)
SIDE = "shard long, kind int, bucket int, doc long, blob binary"


def string_keys(buf: np.ndarray, length: int) -> np.ndarray:
    """64-bit keys of the strings of `length` bytes at each place. Strings are short, so a polynomial modulo 2^64 will do (longer spans take
    common.span_hashes)."""
    if len(buf) < length:
        return np.zeros(0, np.uint64)
    total = common.polynomials(buf)
    return common.shifted(total[length:] - total[:-length], slice(0, len(buf) - length + 1))


def _slide(a: np.ndarray, width: int, least) -> np.ndarray:
    """Least (or greatest) of each `width` neighbours, by doubling."""
    size, out = 1, a
    while 2 * size <= width:
        out, size = least(out[:-size], out[size:]), 2 * size
    return least(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def anchor_runs(buf: np.ndarray, valid: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every valid string of `length` bytes has as its anchor the least key of the strings of `anchor` bytes in it, a property of its
    bytes alone. Returns runs (start, end, key) of places whose strings have the same anchor."""
    width, n, out = length - anchor + 1, len(buf), []
    for a in range(0, n, BLOCK):
        h = string_keys(buf[a : a + BLOCK + length - 1], anchor)
        if len(h) < width:
            continue
        least = _slide(h, width, np.minimum)
        fine = valid[a : a + len(least)]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (fine[1:] != fine[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(least))
        use = fine[start]
        out.append((start[use] + a, end[use] + a, least[start[use]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Shard:
    """One shard's documents, less exact copies of smaller documents; and what earlier merges told about its strings."""

    def __init__(self, table: pa.Table, side: pa.Table, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        kind = side["kind"].to_numpy()
        self.side = {k: side.filter(pa.array(kind == k)) for k in range(6)}
        void = table["doc"].is_null().to_numpy()
        ids = table["doc"].fill_null(0).to_numpy()
        order = np.lexsort((ids, void))
        ids, void = ids[order], void[order]
        self.table = table.take(pa.array(order))
        self.ids = self.table["doc"].to_pylist()
        #: Numbers of the shard's documents in order of doc_id, null last.
        self.doc = np.cumsum(np.concatenate([[False], (ids[1:] != ids[:-1]) | (void[1:] != void[:-1])])[: len(ids)])
        data, offs = utf8(self.table["text"])
        self.sizes = np.diff(offs)
        told = set(zip(self.side[COPY]["doc"].to_pylist(), self.side[COPY]["blob"].to_pylist(), strict=True))
        some = {d for d, _ in told}
        self.copy = np.array([d in some for d in self.ids], bool) & (self.sizes >= length)
        for r in np.flatnonzero(self.copy).tolist():  # rows of one id (or of none) may hold several texts
            self.copy[r] = (self.ids[r], hashlib.sha256(data[offs[r] : offs[r + 1]]).digest()) in told
        self.data, self.offs = data, offs
        keep = ~self.copy
        self.own = np.flatnonzero(keep)
        mask = np.repeat(keep, self.sizes)
        sizes = self.sizes[keep]
        self.buf, self.at = joined(data[mask], np.concatenate([[0], np.cumsum(sizes)]), gap=255)
        self.valid = np.ones(len(self.buf), bool)
        for a, n in zip(self.at.tolist(), sizes.tolist(), strict=True):
            self.valid[max(a, a + n - length + 1) : a + n + 1] = False

    def row(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, places, "right") - 1

    def sent(self, keys: np.ndarray, shard: int, narrow: bool, by: np.ndarray | None = None) -> pa.Table:
        """Distinct keys, sorted, cut into buckets by the lowest part of `by` (or of themselves). narrow: 32 bits are sent, enough to find
        candidates. With `by`, its 32 bits follow each bucket's keys."""
        group = keys if by is None else by
        bucket = (group % np.uint64(self.buckets)).astype(np.int64)
        rest = ((group // np.uint64(self.buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        rows = []
        for b in range(self.buckets):
            at = order[edge[b] : edge[b + 1]]
            if len(at):
                own, first = np.unique(rest[at] if narrow else keys[at], return_index=True)
                rows.append((b, own.tobytes() + (b"" if by is None else rest[at][first].tobytes())))
        n = len(rows)
        return pa.table({"shard": pa.array(np.full(n, shard, np.int64)), "kind": pa.array(np.zeros(n, np.int32)), "bucket": pa.array([r[0] for r in rows], pa.int32()), "doc": pa.array(np.zeros(n, np.int64)), "blob": pa.array([r[1] for r in rows], pa.binary())})

    def known(self, keys: np.ndarray, kind: int, narrow: bool) -> np.ndarray:
        """Whether a smaller shard has each key, as the merge of this kind answered."""
        out = np.zeros(len(keys), bool)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        rest = keys // np.uint64(self.buckets)
        rest = (rest & np.uint64(0xFFFFFFFF)).astype(np.uint32) if narrow else rest
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        side = self.side[kind]
        for b, blob in zip(side["bucket"].to_pylist(), side["blob"].to_pylist(), strict=True):
            at = order[edge[b] : edge[b + 1]]
            told = np.frombuffer(blob, np.uint32 if narrow else np.uint64)
            k = np.minimum(np.searchsorted(told, rest[at]), len(told) - 1)
            out[at] = told[k] == rest[at]
        return out

    def stretches(self, anchor: int) -> None:
        """Runs of strings with one anchor: where they start and end, the anchor's key, the document, the key of all the bytes they cover,
        and whether several documents of this shard have the anchor."""
        self.start, self.end, self.key = anchor_runs(self.buf, self.valid, self.length, anchor)
        self.who = self.doc[self.own[self.row(self.start)]] if len(self.start) else self.start
        order = np.lexsort((self.who, self.key))
        k, r = self.key[order], self.who[order]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        last = np.append(begin[1:], len(k)) - 1 if len(k) else begin
        self.near = np.zeros(len(k), bool)
        self.near[order] = np.repeat(r[begin] != r[last], last - begin + 1)

    def covers(self, use: np.ndarray) -> np.ndarray:
        """Keys of the bytes that these runs cover, from the first string's first to the last string's last."""
        out, start, stop = np.zeros(len(use), np.uint64), self.start[use], self.end[use] + self.length - 1
        for a in range(0, len(self.buf), BLOCK):
            lo, hi = np.searchsorted(start, [a, a + BLOCK])
            if hi > lo:
                out[lo:hi] = common.span_hashes(self.buf[a : int(stop[lo:hi].max())], start[lo:hi] - a, stop[lo:hi] - a)
        return out ^ (stop - start).astype(np.uint64)

    def places(self, use: np.ndarray) -> np.ndarray:
        """The places of all strings in these runs."""
        size = self.end[use] - self.start[use]
        return np.arange(int(size.sum())) + np.repeat(self.start[use] - (np.cumsum(size) - size), size)

    def string_keys(self, at: np.ndarray) -> np.ndarray:
        keys = np.zeros(len(at), np.uint64)
        for a in range(0, len(self.buf), BLOCK):
            lo, hi = np.searchsorted(at, [a, a + BLOCK])
            if hi > lo:
                keys[lo:hi] = string_keys(self.buf[a : a + BLOCK + self.length], self.length)[at[lo:hi] - a]
        return keys

    def shared(self) -> np.ndarray:
        """Runs whose anchor another shard has."""
        return np.flatnonzero(self.known(self.key, ANCHOR_BEFORE, True) | self.known(self.key, ANCHOR_AFTER, True))

    def told(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """Which of these keys the answers of a kind name, whatever their bucket."""
        blobs = self.side[kind]["blob"].to_pylist()
        return np.isin(keys, np.concatenate([np.frombuffer(b, np.uint64) for b in blobs])) if blobs else np.zeros(len(keys), bool)

    def classes(self, at: np.ndarray) -> np.ndarray:
        """A number for each of the strings at these places, equal for equal strings: suffix array of the text that the strings
        cover, classes cut where neighbours' common prefix is too short."""
        cover = np.cumsum(np.bincount(at, minlength=len(self.buf) + 1) - np.bincount(np.minimum(at + self.length, len(self.buf)), minlength=len(self.buf) + 1))[: len(self.buf)] > 0
        text = self.buf[cover]
        place = (np.cumsum(cover) - 1)[at]
        del cover
        wide = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
        packed = np.zeros(len(text), np.uint64)
        for i in range(7):  # nine bits a byte, so that the end of the text is less than any
            packed = (packed << np.uint64(9)) | wide[i : i + len(text)]
        sa, _ = suffix_array(packed, packed=7)  # to the full: Kasai needs the true order
        lcp = common_prefixes(np.concatenate([text.astype(np.int16), -1 - np.arange(self.length + 1, dtype=np.int16)]), sa, self.length)
        number = np.empty(len(sa), np.int64)
        number[sa] = np.cumsum(lcp < self.length)
        return number[place]

    def repeated_here(self) -> np.ndarray:
        """Places of strings that a document of this shard with a smaller id has."""
        at = self.places(np.flatnonzero(self.near))
        if not at.size:
            return at
        number, doc = self.classes(at), self.doc[self.own[self.row(at)]]
        order = np.lexsort((doc, number))
        new = np.concatenate([[True], np.diff(number[order]) != 0])
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        return at[order[doc[order] > doc[first]]]

    def repeated_before(self) -> np.ndarray:
        """Places of strings that a smaller shard has."""
        use = self.shared()
        keys = self.covers(use)
        whole, part = self.told(keys, COVER_BEFORE), self.told(keys, COVER_SPLIT)
        at = self.places(use[part & ~whole])
        return np.concatenate([self.places(use[whole]), at[self.told(self.string_keys(at), STRING_BEFORE)]])

    def removed(self, anchor: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(row of the table, starts, ends of the removed runs) of every document."""
        self.stretches(anchor)
        at = np.concatenate([self.repeated_here(), self.repeated_before()])
        change = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(change, at, 1)
        np.add.at(change, at + self.length, -1)
        a, b = spans(np.cumsum(change)[: len(self.buf)] > 0)
        row = self.row(a)
        edge = np.searchsorted(row, np.arange(len(self.own) + 1))
        out = []
        whole = np.zeros(1, np.int64)
        place = dict(zip(self.own.tolist(), range(len(self.own)), strict=True))
        for r in range(len(self.doc)):
            if self.copy[r]:
                out.append((r, whole, np.array([self.sizes[r]])))
            else:
                k = place[r]
                s = slice(edge[k], edge[k + 1])
                out.append((r, a[s] - self.at[k], b[s] - self.at[k]))
        return out

    def kept(self, r: int, starts: np.ndarray, ends: np.ndarray) -> bytes:
        raw = self.data[self.offs[r] : self.offs[r + 1]].tobytes()
        if not len(starts):
            return raw
        edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(raw)]
        return b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def merge_runs(runs: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted runs of distinct keys, in order of shard: every key once, the smallest shard that has it and the largest. Runs are merged
    two by two, each key of one put in its place among the other's by binary search."""
    level = [(keys, np.full(len(keys), shard, np.int32), np.full(len(keys), shard, np.int32)) for shard, keys in runs]
    while len(level) > 1:
        nxt = []
        for i in range(0, len(level) - 1, 2):
            (a, first, last), (b, first_b, last_b) = level[i], level[i + 1]
            k = np.searchsorted(a, b)
            new = np.ones(len(b), bool)
            if len(a):
                new = a[np.minimum(k, len(a) - 1)] != b
            last[k[~new]] = last_b[~new]
            at = k[new] + np.arange(int(new.sum()))
            old = np.ones(len(a) + len(at), bool)
            old[at] = False
            both = []
            for x, y in ((a, b), (first, first_b), (last, last_b)):
                z = np.empty(len(old), x.dtype)
                z[at], z[old] = y[new], x
                both.append(z)
            nxt.append(tuple(both))
        level = nxt + level[len(level) - len(level) % 2 :]
    return level[0]


def _answers(runs: DataFrame, cuts: "Cuts", kinds: tuple[int, ...], narrow: bool = False, grouped: bool = False) -> DataFrame:
    """What shards are told about the keys they sent. A smaller shard is one of a smaller range. First of kinds: those that a smaller shard has. Second: those that only a larger
    one has; or, if keys come grouped (covers by anchor), first holders of one of several covers of an anchor, whose strings must be
    compared one by one."""

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        shards, blobs = table["shard"].to_pylist(), table["blob"].to_pylist()
        if grouped:
            cut = [len(b) * 2 // 3 for b in blobs]
            keys = [np.frombuffer(b[:n], np.uint64) for b, n in zip(blobs, cut, strict=True)]
        else:
            keys = [np.frombuffer(b, np.uint32 if narrow else np.uint64) for b in blobs]
        ranges = cuts.range_of(np.array(shards)).tolist()
        every, first, last = merge_runs(list(zip(ranges, keys, strict=True)))
        if grouped:
            group = np.zeros(len(every), np.uint32)
            for b, n, k in zip(blobs, cut, keys, strict=True):
                group[np.searchsorted(every, k)] = np.frombuffer(b[n:], np.uint32)
            _, which, size = np.unique(group, return_inverse=True, return_counts=True)
            split = size[which] > 1
        rows = []
        for s, own, k, bucket in zip(shards, ranges, keys, table["bucket"].to_pylist(), strict=True):
            at = np.searchsorted(every, k)
            before = first[at] < own
            other = split[at] & ~before if grouped else (last[at] > own) & ~before
            for kind, told in zip(kinds, (k[before], k[other]), strict=False):
                if len(told):
                    rows.append((s, kind, bucket, 0, told.tobytes()))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        del every, first, last, keys, blobs
        common.release()
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("shard", "kind", "bucket", "doc", "blob"), types, strict=True))})

    return runs.groupBy("bucket").applyInArrow(answer, SIDE)


@dataclass(frozen=True)
class Cuts:
    """Ranges of doc_id in order: what each begins with, and the number of its first shard. A range is one shard, but the rows of one very
    large doc_id, and those without any (the last range), are dealt to several by their text: they remove nothing from each other."""

    begin: np.ndarray
    first: np.ndarray  # one more than ranges but the last: shards before each, then all of them

    def range_of(self, shard: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, shard, "right") - 1

    def shard_of(self, doc: pd.Series, text_hash: pd.Series) -> pd.Series:
        r = np.where(doc.isna(), len(self.begin), np.maximum(np.searchsorted(self.begin, doc.fillna(0).to_numpy(np.int64), "right") - 1, 0))
        return pd.Series(self.first[r] + text_hash.to_numpy(np.int64) % (self.first[r + 1] - self.first[r]))


def _cuts(docs: DataFrame, size: int) -> Cuts:
    """Sizes are summed by doc_id and run up in ranges of doc_id on executors; the driver gets one row for each range."""
    shard = max(SHARD_BYTES, -(-size // MAX_RANGES))
    sizes = docs.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"))
    ranged = common.stored(sizes.repartitionByRange("doc").withColumn("part", F.spark_partition_id()), "sizes")
    void = ranged.filter("doc is null").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()["b"]
    ranged = ranged.filter("doc is not null")
    parts = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("b")).collect())
    offset = docs.sparkSession.createDataFrame([(p, sum(b for q, b in parts if q < p)) for p, _ in parts], "part int, offset long")
    before = F.sum("b").over(Window.partitionBy("part").orderBy("doc")) - F.col("b") + F.col("offset")
    at = ranged.join(F.broadcast(offset), "part").select("doc", "b", F.floor(before / F.lit(shard)).alias("r"), (F.col("b") > 2 * shard).alias("alone"))
    rows = at.groupBy("r", "alone").agg(F.min("doc").alias("begin"), F.sum("b").alias("b")).orderBy("begin").collect()
    split = [-(-r["b"] // shard) if r["alone"] else 1 for r in rows] + [max(1, -(-int(void) // shard))]
    return Cuts(np.array([r["begin"] for r in rows], np.int64), np.concatenate([[0], np.cumsum(split)]).astype(np.int64))


def _sharded(docs: DataFrame, rest: list[str]) -> tuple[DataFrame, DataFrame, Cuts, int]:
    """(docs as doc, text, shard, and rest as a struct; the exact copies; ranges; bytes)."""
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"])
    cuts = _cuts(docs, size)

    @F.pandas_udf("long")
    def place(doc: pd.Series, text_hash: pd.Series) -> pd.Series:
        return cuts.shard_of(doc, text_hash)

    doc, text = F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text"), F.lit(""))
    shard = place(F.col("doc"), F.col("h")).alias("shard")
    more = [F.struct(*rest).alias("rest")] if rest else []
    base = docs.select(doc, text.alias("text"), F.abs(F.hash(text).cast("long")).alias("h"), *more).select("doc", "text", *(["rest"] if rest else []), shard)
    prints = docs.select(doc, F.sha2(text.cast("binary"), 256).alias("print"), F.abs(F.hash(text).cast("long")).alias("h"), F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt"))
    first = prints.groupBy("print").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").select("print", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = prints.join(first, ["print", "salt"]).filter("doc > first or (doc is null and first is not null)").select("doc", "print", shard)
    side = copies.select("shard", F.lit(COPY).alias("kind"), F.lit(0).alias("bucket"), "doc", F.unhex("print").alias("blob"))
    return base, side, cuts, size


def _empty(schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([], f.type) for f in schema}, schema=schema)


_SIDE = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("doc", pa.int64()), ("blob", pa.binary())])


def _find(docs: DataFrame, make, schema: str, length: int, anchor: int, rest: list[str]) -> DataFrame:
    """make: what to return for a shard. rest: columns of docs that it needs besides doc and text."""
    base, copies, cuts, size = _sharded(docs, rest)
    copies = common.stored(copies, "copies")
    buckets = max(1, -(-size // (4 * BUCKET_BYTES)))

    def sender(send):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _empty(_SIDE)
            s = Shard(left, right, length, buckets)
            s.stretches(anchor)
            out = send(s, left["shard"][0].as_py())
            del s
            common.release()
            return out

        return run

    def anchors_of(s: Shard, shard: int) -> pa.Table:
        return s.sent(s.key, shard, True)

    def covers_of(s: Shard, shard: int) -> pa.Table:
        use = s.shared()
        return s.sent(s.covers(use), shard, False, by=s.key[use])

    def strings_of(s: Shard, shard: int) -> pa.Table:
        use = s.shared()
        return s.sent(s.string_keys(s.places(use[s.told(s.covers(use), COVER_SPLIT)])), shard, False)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = make(Shard(left, right, length, buckets) if left.num_rows else None, anchor)
        common.release()
        return out

    def with_side(side: DataFrame, f, out: str) -> DataFrame:
        return base.groupBy("shard").cogroup(side.groupBy("shard")).applyInArrow(f, out)

    side = copies
    for send, kinds, how in ((anchors_of, (ANCHOR_BEFORE, ANCHOR_AFTER), {"narrow": True}), (covers_of, (COVER_BEFORE, COVER_SPLIT), {"grouped": True}), (strings_of, (STRING_BEFORE,), {})):
        side = side.unionByName(_answers(with_side(side, sender(send), SIDE), cuts, kinds, **how))
    return with_side(side, finish, schema)


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes), one row for each row of docs.

    A null text is empty. Rows with the same doc_id are one document's: they remove nothing from each other. Rows with a null doc_id come
    after all others and remove nothing from each other. An empty table gives no rows; other columns are ignored.

    Texts are shuffled once, by ranges of doc_id of about SHARD_BYTES each (a longer document is a shard of its own), and read four times;
    keys of anchors, covers and strings make small shuffles each way. A string that very many documents hold is one key a shard. Copies of a whole smaller document are told by their digest
    and skip the arrays: a smaller document holds all their strings."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def make(s: Shard | None, anchor: int) -> pa.Table:
        if s is None:
            return _empty(schema)
        rows = [(s.ids[r], int(s.sizes[r]), int((b - a).sum()), len(a), hashlib.sha256(s.kept(r, a, b)).hexdigest()) for r, a, b in s.removed(anchor)]
        return pa.table({f.name: pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)})

    out = _find(docs, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, anchor, [])
    return out if kind == "bigint" else out.withColumn("doc_id", F.col("doc_id").cast(kind))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """docs with all columns, repeated bytes cut out of text (n_chars, where it is a column, follows). No row goes. Bytes of a character
    that a cut parted are left out, so that text stays UTF-8; a null text stays null. Repeated rows, null doc_ids and empty tables as in
    `repeats`; columns of any name are kept."""
    rest = [c for c in docs.columns if c != "text"]
    as_null = "__text_is_null"
    wide = docs.withColumn(as_null, F.col("text").isNull())

    def make(s: Shard | None, anchor: int) -> pa.Table:
        if s is None:
            return pa.table({"rest": pa.array([], held), "new": pa.array([], pa.string())})
        texts: list = [None] * len(s.doc)
        for r, a, b in s.removed(anchor):
            texts[r] = s.kept(r, a, b).decode("utf-8", "ignore")
        return pa.table({"rest": s.table["rest"].cast(held), "new": pa.array(texts, pa.string())})

    inner = StructType([StructField(f.name, f.dataType, True) for f in wide.select(*rest, as_null).schema])
    held = to_arrow_type(inner)
    out = _find(wide, make, f"rest {inner.simpleString()}, new string", length, anchor, [*rest, as_null])
    text = F.when(F.col(f"rest.{as_null}"), F.lit(None)).otherwise(F.col("new")).alias("text")
    out = out.select(*(text if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out
