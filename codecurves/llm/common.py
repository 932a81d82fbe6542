"""Helpers that the training-data operators share: shared storage, UTF-8 views of Arrow columns, word cutting, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graphs import components, salt_of, salted  # noqa: F401
from ..functions.storage import discard, new_path, shared_dir, stored  # noqa: F401  (operators take them from here)

#: Largest number of rows that any operator turns into a broadcast table; every broadcast is checked against a bound.
MAX_BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after the other, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def pieces(batch: pa.RecordBatch, name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text column holds at most `limit` bytes (or one row), to bound memory. No row is left out."""
    _, offs = utf8(batch.column(name))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def release() -> None:
    """Give a Python worker's free memory back: workers are kept and used again by whatever runs next on the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, a-z and all of 0x80 and above.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def joined(data: np.ndarray, offs: np.ndarray, gap: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The rows with one byte `gap` after each, so that nothing crosses rows; and where each row starts."""
    n = len(offs) - 1
    out = np.full(len(data) + n, gap, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offs[1:] + np.arange(n)] = False
    out[keep] = data
    return out, offs[:-1] + np.arange(n)


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_BYTE = np.random.default_rng(20240607).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15
#: The prime 2^31 - 1, and the base of the polynomials modulo it.
PRIME, BASE = (1 << 31) - 1, 1_103_515_245
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int, modulus: int) -> np.ndarray:
    """base to the 0, 1, ... n - 1, modulo PRIME or 2^64."""
    key = base, modulus
    if len(_powers.get(key, ())) < n:
        out = np.ones(1, np.uint64)
        while len(out) < max(n, 1 << 16):
            step = out * np.uint64(pow(base, len(out), modulus))
            out = np.append(out, step % np.uint64(modulus) if modulus == PRIME else step)
        _powers[key] = out.astype(np.uint32) if modulus == PRIME else out
    return _powers[key][:n]


def polynomials(buf: np.ndarray) -> np.ndarray:
    """Sums of buf's bytes times powers, modulo 2^64: what stands before each place."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(_ODD, len(buf), 1 << 64), out=total[1:])
    return total


def shifted(h: np.ndarray, starts) -> np.ndarray:
    """Differences of polynomials, made to not depend on where the span begins, and mixed."""
    h = h * _power(pow(_ODD, -1, 1 << 64), (starts.stop if isinstance(starts, slice) else int(starts.max(initial=-1)) + 1), 1 << 64)[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand: a polynomial modulo 2^64 and one modulo the prime 2^31 - 1.

    The first takes typical spans for one another with a chance of 2^-64, but confuses structured ones of 1,024 bytes and more whatever
    its base (Thue-Morse words); the second has no such words: of degree d, it has d roots at most, so that two spans of n bytes meet
    with a chance of n / 2^31 at most over the choice of its base."""
    total, n = polynomials(buf), len(buf)
    h = shifted(total[ends] - total[starts], starts)
    terms = (buf.astype(np.uint64) + np.uint64(1)) * _power(BASE, n, PRIME)
    np.cumsum(terms if n < 1 << 22 else terms % np.uint64(PRIME), out=total[1:])
    low = (total[ends] - total[starts]) % np.uint64(PRIME) * _power(pow(BASE, -1, PRIME), n + 1, PRIME)[starts] % np.uint64(PRIME)
    return h ^ (low * np.uint64(0xC2B2AE3D27D4EB4F))


def group_least(rows: DataFrame, node: str, own: str, label: DataFrame) -> DataFrame:
    """(node, salt, least): the smallest `own` of all rows of a node's component, once for each salt, for nodes that several rows have or
    that are linked; all other rows are their own least. label: (node, label) of linked nodes.

    Minima are partial before each shuffle, and what goes back by node or label goes back once for each salt, so that a node or component
    with a third of all rows is several tasks' work."""
    nodes = stored(rows.groupBy(F.col(node).alias("node")).agg(F.min(own).alias("first"), F.count("*").alias("n")), "nodes")
    inside = nodes.join(label, "node")
    lowest = inside.groupBy("label").agg(F.min("first").alias("least"))
    linked = inside.select("node", "label", salt_of("node")).join(salted(lowest), ["label", "salt"]).select("node", "least")
    alone = nodes.filter("n > 1").join(label, "node", "left_anti").select("node", F.col("first").alias("least"))
    return salted(linked.unionByName(alone))
