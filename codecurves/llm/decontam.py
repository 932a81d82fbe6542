"""Benchmark decontamination: an FM-index of words for each shard of the training texts, searched for every benchmark phrase.

A shard's words become symbols of the benchmark's own vocabulary; words outside it can be in no phrase and part the sequence, as do
texts. What is left of the shard is indexed (suffix array, wavelet matrix, sampled places), and all phrases are searched at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, joined, pieces, spans, stored, utf8
from .suffixes import FMIndex

WINDOW = 10
#: Bytes of text in a shard of an executor's memory, and of benchmark text in one broadcast. A larger benchmark is searched in
#: several passes over the documents, each with a part of it.
SHARD_BYTES, PART_BYTES = 3 << 20, 16 << 20

FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<first_word:long,end_word:long,start_byte:long,end_byte:long>>"


def _cut(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows: lower-case bytes, row, start and end byte in the row."""
    buf, at = joined(LOWER[data], offs)
    inside = ALNUM[buf]
    a, b = spans(inside)
    row = np.searchsorted(at, a, "right") - 1
    edge = np.append(0, np.cumsum(b - a))
    words = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(edge), pa.py_buffer(buf[inside])])
    return words, row, a - at[row], b - at[row]


class Phrases:
    """The distinct windows of a set of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        words, row, _, _ = _cut(*utf8(texts))
        each = words.dictionary_encode()
        self.vocabulary, symbol = each.dictionary, each.indices.to_numpy().astype(np.int64) + 2
        first = np.searchsorted(row, np.arange(len(items) + 1))
        seen: dict[tuple[int, ...], set[str]] = {}
        for k, (item, _) in enumerate(items):
            words = symbol[first[k] : first[k + 1]].tolist()
            for i in range(max(1, len(words) - window + 1) if words else 0):
                seen.setdefault(tuple(words[i : i + window]), set()).add(item)
        self.windows = np.zeros((len(seen), window), np.int64)
        self.lengths = np.array([len(w) for w in seen], np.int64)
        for k, w in enumerate(seen):
            self.windows[k, window - len(w) :] = w
        self.items = list(seen.values())
        self.least = int(self.lengths.min()) if seen else 0

    def find(self, words: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, word) of each occurrence in a shard's words."""
        none = np.zeros(0, np.int64)
        if not self.items or not len(words):
            return none, none
        k = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy().astype(np.int64)
        word = np.flatnonzero(k >= 0)
        if not word.size:
            return none, none
        new = np.concatenate([[True], (np.diff(word) > 1) | (np.diff(row[word]) > 0)])
        run = np.cumsum(new) - 1
        enough = np.bincount(run)[run] >= self.least
        word, new = word[enough], new[enough]
        if not word.size:
            return none, none
        run = np.cumsum(new) - 1
        place = np.arange(len(word)) + run
        s, back = np.ones(place[-1] + 2, np.int64), np.zeros(place[-1] + 2, np.int64)
        s[place], back[place] = k[word] + 2, word
        phrase, at = FMIndex(s, len(self.vocabulary) + 2).search(self.windows, self.lengths)
        return phrase, back[at]


def _leaks(phrases: Phrases, texts: pa.Array) -> list[tuple]:
    """(n_words, n_hit, items, merged spans) of each text."""
    word, row, a, b = _cut(*utf8(texts))
    phrase, at = phrases.find(word, row)
    end = at + phrases.lengths[phrase] if len(at) else at
    hit = np.cumsum(np.bincount(at, minlength=len(word) + 1) - np.bincount(end, minlength=len(word) + 1))[: len(word)] > 0
    edge = np.concatenate([[True], np.diff(row) > 0]) if len(word) else hit
    first = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
    last = np.flatnonzero(hit & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([hit[1:], [False]])))
    n = len(texts)
    words, begin = np.bincount(row, minlength=n), np.searchsorted(row, np.arange(n))
    own: list[list[dict]] = [[] for _ in range(n)]
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        r = int(row[i])
        own[r].append({"first_word": int(i - begin[r]), "end_word": int(j + 1 - begin[r]), "start_byte": int(a[i]), "end_byte": int(b[j])})
    items: list[set] = [set() for _ in range(n)]
    for pair in np.unique(row[at] * len(phrases.items) + phrase).tolist() if len(at) else []:
        items[pair // len(phrases.items)] |= phrases.items[pair % len(phrases.items)]
    return [(int(words[r]), sum(x["end_word"] - x["first_word"] for x in own[r]), sorted(items[r]), own[r]) for r in range(n)]


def merged(found: list[dict]) -> list[dict]:
    """Spans that overlap or touch become one."""
    out: list[dict] = []
    for x in sorted(found, key=lambda x: (x["first_word"], x["end_word"])):
        if out and x["first_word"] <= out[-1]["end_word"]:
            if x["end_word"] > out[-1]["end_word"]:
                out[-1] |= {k: x[k] for k in ("end_word", "end_byte")}
        else:
            out.append(dict(x))
    return out


class Part:
    """Benchmark items of one broadcast. What travels is their text; each Python worker makes the windows of it once."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.items, self.window, self.made = items, window, None

    def __getstate__(self):
        return self.items, self.window, None

    def __setstate__(self, state):
        self.items, self.window, self.made = state

    @property
    def phrases(self) -> Phrases:
        if self.made is None:
            self.made = Phrases(self.items, self.window)
        return self.made


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item, t, part): the items that have an id and a text, each once, and the number of parts of about PART_BYTES."""
    held = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("t")).filter("item is not null and t is not null").distinct()
    total = held.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-int(total) // PART_BYTES))
    return held.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(n))), n


def _part(items: DataFrame, k: int, window: int) -> Part:
    return Part([(r["item"], r["t"]) for r in items.filter(F.col("part") == k).collect()], window)


def _search(known, extra: int):
    """Rows of (text, then `extra` columns that are kept) to those columns and what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", SHARD_BYTES):
                cols = list(zip(*_leaks(known.value.phrases, b.column(0)), strict=True))
                made = [pa.array(c, t) for c, t in zip(cols, _types(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(1 + k) for k in range(extra)), *made], names=[*b.schema.names[1 : 1 + extra], "n_words", "n_hit", "items", "spans"])

    return run


def _in_parts(docs: DataFrame, items: DataFrame, parts: int, window: int, key: Column) -> DataFrame:
    """key, items and merged spans of the rows of docs in which a part of a large benchmark occurs. Parts come to the driver one after the
    other; what each finds is stored before its broadcast is dropped."""
    sc, found = docs.sparkSession.sparkContext, None
    keyed = docs.select("text", key.alias("key"))
    for k in range(parts):
        known = sc.broadcast(_part(items, k, window))
        got = keyed.mapInArrow(_search(known, 1), f"key long, {FOUND}").filter("n_hit > 0").select("key", "items", "spans").dropDuplicates(["key"])
        got = stored(got, "leaks")
        known.destroy()
        found = got if found is None else found.unionByName(got)
    every = found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(s) for s in batch.column(2).to_pylist()]
            hit = [sum(x["end_word"] - x["first_word"] for x in s) for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _types()[3]), pa.array(hit, pa.int64())], names=["key", "items", "spans", "n_hit"])

    return every.mapInArrow(merge, "key long, " + FOUND.split(", ", 2)[2] + ", n_hit long")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch, "text", SHARD_BYTES):
            _, row, _, _ = _cut(*utf8(b.column(0)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(np.bincount(row, minlength=b.num_rows).astype(np.int64))], names=["doc_id", "key", "n_words"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence of a window), items (ids with occurring windows, sorted as strings), spans
    (merged, in words and bytes), one row for each row of docs.

    A null text has no words. Items with a null id or text, or no word, have no windows. Repeated rows are searched each for
    themselves; an empty table gives no rows, an empty benchmark no hits; other columns are ignored. Documents aren't shuffled, unless
    the benchmark is larger than one broadcast may be: then each part has its pass, and a document's findings are merged by key. Words
    are compared by their bytes."""
    kind, sc = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext
    items, parts = _items(benchmark)
    if parts == 1:
        return docs.select("text", "doc_id").mapInArrow(_search(sc.broadcast(_part(items, 0, window)), 1), f"doc_id {kind}, {FOUND}")
    key = F.xxhash64("doc_id", "text")
    found = _in_parts(docs, items, parts, window, key)
    every = docs.select("text", "doc_id", key.alias("key")).mapInArrow(_count_words, f"doc_id {kind}, key long, n_words long").join(found, "key", "left")
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "spans": F.array().cast(FOUND.split("spans ")[1])}
    return every.select("doc_id", "n_words", *(F.coalesce(c, v).alias(c) for c, v in none.items()))


def _types() -> list[pa.DataType]:
    span = pa.struct([(k, pa.int64()) for k in ("first_word", "end_word", "start_byte", "end_byte")])
    return [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(span)]


def without(text: str, found: list[dict]) -> str:
    """The text less the bytes of the spans; what stood on either side is parted by one space."""
    raw, out, at = text.encode(), [], 0
    for x in found:
        out.append(raw[at : x["start_byte"]].rstrip(b" "))
        at = x["end_byte"]
    out.append(raw[at:].lstrip(b" ") if found else raw)
    return b" ".join(x for x in out if x).decode("utf-8", "ignore")


def _fresh(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with all columns, the merged spans cut out of text (n_chars, where it is a column, follows). No row goes.

    A null text stays null; a text that is all leak becomes empty. Repeated rows are cut alike; an empty table gives no rows, an empty
    benchmark changes none. Columns may have any name."""
    items, parts = _items(benchmark)
    if parts > 1:
        key, spans = _fresh("key", docs.columns), _fresh("spans", docs.columns)
        found = _in_parts(docs, items, parts, window, F.xxhash64("doc_id", "text")).select(F.col("key").alias(key), F.col("spans").alias(spans))
        joined_ = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(found, key, "left").select(*docs.columns, spans)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k, s = b.schema.get_field_index("text"), b.schema.get_field_index(spans)
                new = [without(t, x) if t and x else t for t, x in zip(b.column(k).to_pylist(), b.column(s).to_pylist(), strict=True)]
                yield b.set_column(k, b.schema.field(k), pa.array(new, b.schema.field(k).type)).remove_column(s)

        out = joined_.mapInArrow(cut, docs.schema)
    else:
        known = docs.sparkSession.sparkContext.broadcast(_part(items, 0, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in pieces(batch, "text", SHARD_BYTES):
                    k = b.schema.get_field_index("text")
                    found = _leaks(known.value.phrases, b.column(k))
                    new = [t if t is None or not s else without(t, s) for t, (_, _, _, s) in zip(b.column(k).to_pylist(), found, strict=True)]
                    yield b.set_column(k, b.schema.field(k), pa.array(new, b.schema.field(k).type))

        out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out
