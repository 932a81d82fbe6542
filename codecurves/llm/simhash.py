"""SimHash near duplicates by deletion variants.

Fingerprints that differ in at most four of 64 bits are cut into three segments: one of them differs in at most one bit. So every
segment is indexed once for each of its bits with that bit wiped out, and two linked fingerprints meet under an equal key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, group_least, salt_of, salted, stored

#: Differing bits up to which fingerprints link, and words of a shingle.
BITS, SHINGLE = 4, 4
#: (shift, width) of the segments: one more than half of BITS, so that one differs by at most a bit.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
SEED = 42
#: Members of a key above which it is dealt anew by finer keys.
HOT = 20_000


def majority(h: np.ndarray) -> int:
    """The number whose bits are those that over half of these 64-bit hashes have."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65_536):
        ones += np.unpackbits(h[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text: words between ASCII white space, A-Z lower-cased, shingles counted as often as they occur."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long). Null text has no words: zero."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def variants(prints: DataFrame) -> DataFrame:
    """(key, fp): each segment with one of its bits wiped out, 64 keys a fingerprint."""
    shift = "CASE " + " ".join(f"WHEN v < {s + w} THEN {s}" for s, w in SEGMENTS) + " END"
    mask = "CASE " + " ".join(f"WHEN v < {s + w} THEN {(1 << w) - 1}L" for s, w in SEGMENTS) + " END"
    key = f"shiftleft(CAST(v AS BIGINT), 32) | (shiftrightunsigned(fp, {shift}) & {mask} & ~shiftleft(1L, v - {shift}))"
    return prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(F.expr(key).alias("key"), "fp")


def _forest(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that connect what links join among the fingerprints of one key: each reached member is compared with those not reached
    yet only, so a dense group costs little more than its size, and no group makes more edges than members."""
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= bits
            out += [(at, int(x)) for x in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return out


def _finer(hot: DataFrame) -> DataFrame:
    """(key, fp): members of a large key by fifths of their other bits. BITS differing bits leave one of BITS + 1 parts equal, so two
    linked members meet again."""
    shift = "CASE " + " ".join(f"WHEN v < {s + w} THEN {s}" for s, w in SEGMENTS) + " END"
    width = "CASE " + " ".join(f"WHEN v < {s + w} THEN {w}" for s, w in SEGMENTS) + " END"
    cut = hot.withColumn("v", F.expr("CAST(shiftrightunsigned(key, 32) AS INT)")).withColumn("shift", F.expr(shift)).withColumn("width", F.expr(width))
    low, high = "(fp & (shiftleft(1L, shift) - 1L))", "CASE WHEN shift + width >= 64 THEN 0L ELSE shiftrightunsigned(fp, shift + width) END"
    rest = cut.select("key", "fp", F.expr(f"shiftleft({high}, shift) | {low}").alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(BITS))).alias("p"))
    size = -(-(64 - min(w for _, w in SEGMENTS)) // (BITS + 1))
    part = F.expr(f"shiftrightunsigned(rest, {size} * p) & {(1 << size) - 1}L")
    return rest.select(F.xxhash64("key", "p", part).alias("key"), "fp")


def _blocks(hot: DataFrame, size: int) -> DataFrame:
    """(key, fp): members of a key that is large even so, in blocks of about `size`, every two blocks under a key of their own."""
    n = stored(hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias("blocks")), "large-keys")
    cut = hot.withColumn("salt", salt_of("fp")).join(salted(n), ["key", "salt"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("blocks = 1 or i <> j")
    return cut.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp")


def links(prints: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints that connect all that lie within `bits` of each other.

    Keys are dealt out by hash and read in order, in batches. Members of a key that has more than `hot` of them are passed on unread and
    meet again under finer keys; if one is as large even so, in pairs of blocks. So no task gathers more than two blocks of a key."""
    if bits > BITS:
        raise ValueError(f"segments are cut for {BITS} differing bits at most")

    def run(limit: int | None):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            old_k, old_f, passed = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
            for batch in _with_end(batches):
                if batch is None:
                    key, fp, done = old_k, old_f, len(old_k)
                else:
                    key = np.concatenate([old_k, batch.column(0).to_numpy()])
                    fp = np.concatenate([old_f, batch.column(1).to_numpy().view(np.uint64)])
                    done = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
                if limit and len(key):
                    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    size = np.diff(np.append(begin, len(key)))
                    large = np.repeat((size > limit) | (key[begin] == passed), size)
                    if large.any():
                        passed = key[-1] if large[-1] else passed
                        yield pa.RecordBatch.from_arrays([pa.array(key[large]), pa.array(fp[large].view(np.int64)), pa.array(np.ones(int(large.sum()), bool))], names=["a", "b", "hot"])
                        done -= int(large[:done].sum())
                        key, fp = key[~large], fp[~large]
                old_k, old_f = key[done:], fp[done:]
                key, fp = key[:done], fp[:done]
                if not done:
                    continue
                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                size = np.diff(np.append(begin, done))
                two = begin[size == 2]
                near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
                a, b = [fp[near]], [fp[near + 1]]
                for at, n in zip(begin[size > 2], size[size > 2], strict=True):
                    if found := _forest(own := fp[at : at + n], bits):
                        i = np.array(found)
                        a.append(own[i[:, 0]])
                        b.append(own[i[:, 1]])
                a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.zeros(len(a), bool))], names=["a", "b", "hot"])

        return read

    def found(level: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
        got = level.repartition("key").sortWithinPartitions("key").mapInArrow(run(limit), "a long, b long, hot boolean")
        got = stored(got, "links") if limit else got
        return got.filter("not hot").select("a", "b"), got.filter("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))

    out, left = found(variants(prints), hot)
    if not left.isEmpty():
        more, left = found(_finer(left), hot)
        out = out.unionByName(more)
        if not left.isEmpty():
            out = out.unionByName(found(_blocks(left, hot), None)[0])
    return out.distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links, itself included), one row per row
    of docs.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows and copies share a fingerprint and are one node
    of the graph. A null doc_id gets a component but never names one unless it has no other member (then component_id is null). An
    empty table gives no rows; other columns are ignored."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    label = components(links(prints.select("fp").distinct(), bits))
    least = group_least(prints, "fp", "doc_id", label).withColumnRenamed("node", "fp")
    found = prints.withColumn("salt", salt_of("doc_id")).join(least, ["fp", "salt"], "left")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("least", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all their columns, less those of a component whose smallest doc_id is another's. Rows with a null doc_id
    stay. Of repeated rows with one doc_id all stay or go together."""
    found = near_duplicates(docs, bits, shingle)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
