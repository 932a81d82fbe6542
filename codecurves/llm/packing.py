"""Best-two-fit packing of tokenized documents into sequences of a fixed size.

Plan first, place later: a sequence is described by the lengths of its pieces, so the packing itself needs nothing but how many
pieces there are of each length (at most `size` numbers, whatever the corpus). The driver packs that histogram; every piece then
finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SIZE = 2048
END = 0
#: Entries of a worker's word cache; it is emptied when full. It holds results only and changes none.
CACHE = 400_000
#: Longest cut, in characters, that goes through the rank file.
SHORT = 1_000
SPECIAL = "<|endoftext|>"
_SPLIT = re.compile(r" (?=\S)")


class Encoder:
    """Token ids, as little-endian 32-bit bytes, of a `tokenizers` vocabulary file.

    The byte-pair vocabulary never joins characters across a space that is followed by a visible character, nor across its special
    token, so texts are cut there, and each distinct cut is encoded once and remembered. `tokenizers` encodes what is long; short cuts
    go through the rank file of the same vocabulary, which costs a fourth and can't be given what would overflow it."""

    def __init__(self, vocabulary: str, ranks_path: str | None, pattern: str):
        from tokenizers import Tokenizer

        self.raw = Tokenizer.from_file(vocabulary)
        self.special = self.raw.token_to_id(SPECIAL)
        self.known: dict[str, bytes] = {}
        self.short = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.short = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _bytes(self, cut: str) -> bytes:
        ids = self.short(cut) if self.short and len(cut) <= SHORT else self.raw.encode(cut, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _plain(self, text: str) -> bytes:
        head, *rest = _SPLIT.split(text)
        known, out = self.known, [self._bytes(head)] if head else []
        for word in rest:
            got = known.get(word)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = self._bytes(" " + word)
                if len(word) < 64:
                    known[word] = got
            out.append(got)
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        if self.special is None or SPECIAL not in text:
            return self._plain(text)
        return np.array([self.special], "<u4").tobytes().join(map(self._plain, text.split(SPECIAL)))


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str | None = None) -> Encoder:
    """A Python worker's encoder, kept for its next task. A vocabulary of the caller's own goes through `tokenizers` alone."""
    import public_tokenizers as P

    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary or P.path("byte_bpe_50k.json"), None if vocabulary else P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return _encoders[vocabulary]


def token_pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Cut every document (ids, then id 0) into pieces of at most `size` tokens; where it is longer, the first piece takes the
    remainder. Null text is empty: one piece that holds id 0. Columns: doc_id, piece, start, length, ids_crc32, part, rank
    (counted from 0 within part and length), and ids if asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(vocabulary), np.zeros(size + 1, np.int64), None
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            ids, out, blobs = batch.column(0), [], []
            part = batch.column(2)[0].as_py() if batch.num_rows and part is None else part
            rows = []
            for row, text in enumerate(batch.column(1)):
                blob = encode(text.as_py() or "") + end
                n = len(blob) // 4
                edges = [0, *range(n % size or min(n, size), n + 1, size)]
                for k in range(len(edges) - 1):
                    a, b = edges[k], edges[k + 1]
                    rank, seen[b - a] = int(seen[b - a]), seen[b - a] + 1
                    rows.append(row)
                    out.append((k, a, b - a, zlib.crc32(blob[4 * a : 4 * b]), part, rank))
                    if keep_ids:
                        blobs.append(np.frombuffer(blob[4 * a : 4 * b], "<u4").astype(np.int32))
            if out:
                cols = [pa.array(x) for x in zip(*out, strict=True)]
                cols[0] = cols[0].cast(pa.int32())
                made = [ids.take(pa.array(rows)), *(c if i == 0 else c.cast(pa.int64()) for i, c in enumerate(cols))]
                made += [pa.array(blobs, pa.list_(pa.int32()))] if keep_ids else []
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"][: len(made)]
                yield pa.RecordBatch.from_arrays(made, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("__part")).mapInArrow(cut, schema)


def plan_bins(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Best-two-fit over a histogram of lengths: (number of equal bins, lengths in a bin), every piece exactly once.

    A bin takes the longest piece left, then ever the longest that fits. If a gap stays, its smallest piece is traded for the two
    unpacked pieces that fill the widened gap the furthest, if they fill it further than it did. The same bin is repeated for as long as
    the counts last, so the number of steps depends on `size`, not on the number of pieces."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[int, list[int]]] = []
    while left.any():
        bin_, room, live = [], size, left.copy()
        while room and (fit := np.flatnonzero(live[: room + 1])).size:
            take = int(fit[-1])
            copies = int(min(live[take], room // take))
            bin_ += [take] * copies
            live[take] -= copies
            room -= take * copies
        if room and len(bin_) > 1:
            small, space = bin_[-1], room + bin_[-1]
            have = np.flatnonzero(live[: space + 1])
            if have.size:
                other = have[np.maximum(np.searchsorted(have, space - have, "right") - 1, 0)]
                other = np.where((other == have) & (live[have] < 2), have[np.maximum(np.searchsorted(have, have) - 1, 0)], other)
                ok = (have + other <= space) & ((other != have) | (live[have] > 1))
                total = np.where(ok, have + other, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    bin_[-1:] = sorted((int(have[best]), int(other[best])), reverse=True)
        lengths, uses = np.unique(bin_, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= times * uses
        plan.append((times, bin_))
    return plan


def _slots(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: ranks at which slots begin, first sequence of each slot, offset in the sequence."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, bin_ in plan:
        at = 0
        for length in bin_:
            rows.setdefault(length, []).append((used.get(length, 0), first, at))
            used[length] = used.get(length, 0) + times
            at += length
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in rows.items()}


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most `size` tokens.

    Nulls: a null text is empty; a null doc_id is kept as it is. Repeated rows are packed as often as they occur. An empty table
    gives no rows. Other columns of docs are ignored. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).
    The pieces are written to shared storage once (texts are read and encoded once); to the driver come at most `size` counts."""
    cut = stored(token_pieces(docs, size, vocabulary, keep_ids), "pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(_slots(plan_bins(total, size)))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            seq, off = np.zeros(len(got), np.int64), np.zeros(len(got), np.int64)
            lengths, ranks = got["length"].to_numpy(), (got["rank"] + got["before"]).to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                begin, first, offset = slots.value[int(length)]
                k = np.searchsorted(begin, ranks[at], "right") - 1
                seq[at], off[at] = first[k] + ranks[at] - begin[k], offset[k]
            yield got.drop(columns=["part", "rank", "before"]).assign(sequence_id=seq, offset=off)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name not in ("part", "rank")]
    return cut.join(before, ["part", "length"]).select(*cut.columns, "before").mapInPandas(place, ", ".join([*fields, "sequence_id long", "offset long"]))
