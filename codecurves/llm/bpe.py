"""Byte-pair encoding by speculation, and decoding.

The longest vocabulary entry at each place proposes tokens. A proposal is what merging would give if each of its tokens is, and no merge
crosses a border between two of them; that is tested for all adjacent pairs at once. Only words that fail are merged exactly, many of
them at a time.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import pieces, utf8

#: Bytes of text and number of ids that a Python worker handles at a time; a longer row is handled alone.
SLICE_BYTES, SLICE_IDS = 2 << 20, 1 << 20
#: Entries of a worker's cache of encoded cuts; it is emptied when full. It holds results only and changes none.
CACHE = 600_000
#: Words of more bytes are merged without a proposal: they would keep all others waiting.
LONG = 256
#: Characters whose classes all versions of Unicode share; words with others are cut by the library whose ids are asked for.
SETTLED = "Ԁ"
_NEVER = np.int64(1) << 40

_B = np.arange(256)
_LETTER = np.isin(_B, [*range(65, 91), *range(97, 123)])
_VISIBLE = (_B > 32) & (_B < 127)
#: Bytes that begin a character which is surely no white space.
_SOLID = _VISIBLE | ((_B >= 0xC3) & ~np.isin(_B, [0xE1, 0xE2, 0xE3]))


class Table:
    """Whole numbers to whole numbers, looked up by arrays: open addressing, all keys of an array probed together; -1 for no entry."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]
            own = self.keys[at[left]] == keys[left]
            self.values[at[left[own]]] = values[left[own]]
            left = left[~own]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            own = found == keys[left]
            out[left[own]] = self.values[at[left[own]]]
            left = left[~own & (found != -1)]
        return out


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 signs for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file: its merges, a trie of its entries, and which proposals stand."""

    def __init__(self, path: str):
        import regex
        import tokenizers

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, letter = held["model"], byte_letters()
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or held["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        raw = lambda t: bytes(letter[c] for c in t)
        ids = {raw(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        n = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * n
        for t, i in [*ids.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes[i] = t
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.byte_ids = np.array(self.byte_id)
        split = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [(ids[raw(a)], ids[raw(b)], ids[raw(a + b)]) for a, b in split]
        a, b, c = (np.array(x, np.int64) for x in zip(*made, strict=True))
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        self.rank[c], self.left[c], self.right[c] = np.arange(len(c)), a, b
        if len(np.unique(c)) < len(c) or (np.arange(len(c)) <= np.maximum(self.rank[a], self.rank[b])).any():
            raise ValueError(f"{path}: an entry has two merges, or one comes before its parts")
        self.pair_rank, self.made = Table(a * n + b, np.arange(len(c))), c
        self.merges = {(x, y): (k, z) for k, (x, y, z) in enumerate(made)}
        self._trie(ids)
        # an entry is sound if merging its own bytes gives it: its halves are, and no earlier merge crosses between them
        sound = np.ones(n, bool)
        sound[c] = self.apart(a, b, np.arange(len(c)))
        for x, y, z in made:
            sound[z] &= sound[x] and sound[y]
        self.sound = sound
        self.cut_words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.cut_odd = tokenizers.Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.known: dict[bytes, bytes] = {}

    def _trie(self, ids: dict[bytes, int]) -> None:
        node, keys, accept = {b"": 0}, [], [-1]
        for token, i in ids.items():
            at = 0
            for k in range(1, len(token) + 1):
                head = token[:k]
                if head not in node:
                    node[head] = len(accept)
                    keys.append(at * 256 + token[k - 1])
                    accept.append(-1)
                at = node[head]
            accept[at] = i
        self.step, self.accept = Table(np.array(keys, np.int64), np.arange(1, len(accept))), np.array(accept)

    def apart(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of a and b together leaves the two as they are, for arrays of tokens. below: the rank of the merge
        that is to join them, where only earlier merges count.

        The merges that made both are undone, the latest first. What then touches the border may merge across it only later than the
        merge that took it away: of equal ranks the left one goes first."""
        fine, live, n = np.ones(len(a), bool), np.arange(len(a)), len(self.rank)
        x, y = a.copy(), b.copy()
        until = np.full(len(a), _NEVER) if below is None else below.astype(np.int64)  # merges of this rank or later don't count
        while len(live):
            r = self.pair_rank.get(x * n + y)
            bad = (r >= 0) & (r < until)
            fine[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            until = np.where(first, rx, ry + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return fine

    def propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of the longest entries at each place of the words data[start:end], in order; all words go on together."""
        word, token = [], []
        live, at = np.arange(len(start)), start.copy()
        begin, node, best = start.copy(), np.zeros(len(start), np.int64), np.full(len(start), -1)
        stop = end.copy()
        while len(live):
            more = np.flatnonzero(at < stop)
            to = np.full(len(live), -1)
            to[more] = self.step.get(node[more] * 256 + data[at[more]])
            on = to >= 0
            at += on
            node = np.where(on, to, 0)
            hit = on & (self.accept[node] >= 0)
            best[hit], begin[hit] = self.accept[node[hit]], at[hit]
            out = np.flatnonzero(~on)
            word.append(live[out])
            token.append(best[out])
            at[out] = begin[out]
            done = ~on & (at >= stop)
            if done.any():
                keep = ~done
                live, at, begin, node, best, stop = live[keep], at[keep], begin[keep], node[keep], best[keep], stop[keep]
        if not word:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, token = np.concatenate(word), np.concatenate(token)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the pair of least rank first, of equal ones the leftmost, in time n log n."""
        ids, merges, n = [self.byte_id[b] for b in word], self.merges, len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*merges[p], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heap = [(r, k, z, p) for r, z, k, p in heap]
        heapq.heapify(heap)
        while heap:
            _, k, z, (x, y) = heapq.heappop(heap)
            j = after[k]
            if ids[k] != x or j >= n or ids[j] != y:
                continue
            ids[k], ids[j], after[k] = z, -1, after[j]
            if after[k] < n:
                before[after[k]] = k
                if got := merges.get((z, ids[after[k]])):
                    heapq.heappush(heap, (got[0], k, got[1], (z, ids[after[k]])))
            if before[k] >= 0 and (got := merges.get((ids[before[k]], z))):
                heapq.heappush(heap, (got[0], before[k], got[1], (ids[before[k]], z)))
        return [i for i in ids if i >= 0]

    def merge_all(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) by exact merging of the words data[start:end]: in each round every word merges its pair of least rank, wherever
        it stands in it, from the left."""
        size, done = end - start, []
        word, token, n = np.repeat(np.arange(len(start)), size), self.byte_ids[data[_ranges(start, size)]], len(self.rank)
        while len(word):
            r = np.full(len(word), _NEVER)
            r[:-1] = self.pair_rank.get(token[:-1] * n + token[1:])
            r[:-1][(r[:-1] < 0) | (word[1:] != word[:-1])] = _NEVER
            r[-1] = _NEVER
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(r, first), np.diff(np.append(first, len(word))))
            over = least == _NEVER
            done.append((word[over], token[over]))
            hit = (r == least) & ~over
            run = np.flatnonzero(hit & ~np.append(False, hit[:-1]))  # of pairs that overlap every second one goes
            nth = np.arange(len(hit)) - run[np.maximum(np.searchsorted(run, np.arange(len(hit)), "right") - 1, 0)] if len(run) else np.zeros(len(hit), np.int64)
            hit &= nth % 2 == 0
            token[hit] = self.made[r[hit]]
            keep = ~over & ~np.append(False, hit[:-1])
            word, token = word[keep], token[keep]
        word, token = (np.concatenate(x) if done else np.zeros(0, np.int64) for x in (zip(*done, strict=True) if done else ([], [])))
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, as little-endian 32-bit bytes."""
        size = np.array([len(w) for w in words], np.int64)
        short = np.flatnonzero(size <= LONG)
        data = np.frombuffer(b"".join([words[k] for k in short.tolist()]), np.uint8).astype(np.int64)
        end = np.cumsum(size[short])
        start = end - size[short]
        word, token = self.propose(data, start, end)
        fails = np.zeros(len(short), bool)
        fails[word[~self.sound[token]]] = True
        inside = np.flatnonzero(word[1:] == word[:-1])
        pair, at = np.unique(token[inside] * len(self.rank) + token[inside + 1], return_inverse=True)
        fails[word[inside[~self.apart(pair // len(self.rank), pair % len(self.rank))[at]]]] = True
        again = np.flatnonzero(fails)
        redone, merged = self.merge_all(data, start[again], end[again])
        good = ~fails[word]
        word, token = np.append(word[good], again[redone]), np.append(token[good], merged)
        order = np.argsort(word, kind="stable")
        blob, edge = token[order].astype("<i4").tobytes(), 4 * np.searchsorted(word[order], np.arange(len(short) + 1))
        out: list[bytes] = [b""] * len(words)
        for k, lo, hi in zip(short.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            out[k] = blob[lo:hi]
        for k in np.flatnonzero(size > LONG).tolist():
            out[k] = np.array(self.merge(words[k]), "<i4").tobytes()
        return out

    def words(self, cut: bytes) -> list[bytes]:
        text = cut.decode()
        settled = text.isascii() or max(text) < SETTLED
        if settled and text[text[0] == " " :].isalpha():
            return [cut]
        if settled:
            return [w.encode() for w in self.cut_words(text)]
        return [text[a:b].encode() for _, (a, b) in self.cut_odd(text)]

    def encode_cuts(self, cuts: list[bytes]) -> list[bytes]:
        known = self.known
        new = [c for c in cuts if c not in known]
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = cuts
            each = list(map(self.words, new))
            every = list(dict.fromkeys(w for ws in each for w in ws))
            got = dict(zip(every, self.encode_words(every), strict=True))
            known.update((c, got[ws[0]] if len(ws) == 1 else b"".join(map(got.__getitem__, ws))) for c, ws in zip(new, each, strict=True))
        return [known[c] for c in cuts]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; null counts as empty."""
        segments, row, fixed = self._segments(texts)
        data, offs = utf8(segments)
        cut = cut_places(data, offs)
        ends = np.append(cut, len(data)).astype(np.int32)
        if len(cut):
            each = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            code = each.indices.to_numpy()
            edge, held = np.frombuffer(each.dictionary.buffers()[1], np.int32).tolist(), bytes(each.dictionary.buffers()[2])
            blobs = self.encode_cuts([held[a:b] for a, b in zip(edge, edge[1 : len(each.dictionary) + 1])])
        else:
            code, blobs = np.zeros(0, np.int64), []
        size = np.array([len(b) // 4 for b in blobs], np.int64)
        flat, start = np.frombuffer(b"".join(blobs), "<i4"), np.cumsum(size) - size
        ids = flat[_ranges(start[code], size[code])] if len(code) else flat
        per = np.diff(np.append(0, np.cumsum(size[code]))[np.searchsorted(cut, offs)])
        if fixed is not None:  # special tokens stand between their neighbours' ids
            place = np.cumsum(per)[fixed[0]]
            ids, per[fixed[0]] = np.insert(ids, place, fixed[1]), 1
        edge = np.append(0, np.cumsum(per))[np.searchsorted(row, np.arange(len(texts) + 1))]
        return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.astype(np.int32)))

    def _segments(self, texts: pa.Array):
        """The texts cut at special tokens: segments, the row of each, and (place, id) of those that are such a token (left empty)."""
        has = np.zeros(len(texts), bool)
        for s in self.special:
            has |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        if not has.any():
            return texts, np.arange(len(texts)), None
        import regex

        split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        out, row, place, ids = [], [], [], []
        for r, (text, cut) in enumerate(zip(texts.to_pylist(), has.tolist(), strict=True)):
            for k, part in enumerate(split(text) if cut else [text]):
                if k % 2:
                    place.append(len(out))
                    ids.append(self.special[part])
                out.append("" if k % 2 else part)
                row.append(r)
        return pa.array(out, pa.string()), np.array(row), (np.array(place), np.array(ids))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of id lists; null lists are empty, ids that the vocabulary lacks are passed over, broken UTF-8 becomes U+FFFD."""
        flat = pc.fill_null(ids.flatten(), -1).to_numpy().astype(np.int64)
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy().astype(np.int64)
        good = (flat >= 0) & (flat < len(self.lengths))
        safe = np.where(good, flat, 0)
        bytes_ = np.where(good, self.lengths[safe], 0)
        data = self.joined[_ranges(self.starts[safe], bytes_)]
        edge = np.append(0, np.cumsum(bytes_))[np.append(0, np.cumsum(size))]
        made = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(edge), pa.py_buffer(data)])
        try:
            return made.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in made.to_pylist()], pa.string())


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (size[0] of them), start[1], ..."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def cut_places(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Places where words surely begin: rows; a blank before a visible sign; what follows a letter and is none; a line end
    before a sign, and that sign. What lies between two places may still be several words."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        a, b = data[:-1], data[1:]
        inside = np.ones(len(a), bool)
        joint = offs[1:-1]
        inside[joint[(joint > 0) & (joint < len(data))] - 1] = False  # white space at a row's end is one word
        line = inside & (a == 10) & _VISIBLE[b]
        cut[: len(a)] |= (inside & (a == 32) & _SOLID[b]) | line
        cut[1 : len(data)] |= (_LETTER[a] & ~_LETTER[b] & (b < 128)) | line
    cut[offs[:-1]] = True
    return np.flatnonzero(cut[: len(data)])


_loaded: dict[str | None, Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    """A Python worker's vocabulary, kept for its next task."""
    if path not in _loaded:
        import public_tokenizers as P

        _loaded[path] = Vocabulary(path or P.path("byte_bpe_50k.json"))
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every text under the vocabulary file at `path`, as the tokenizers library gives them without special tokens
    of its own; a special token's name in a text is that token.

    A null or empty text has no ids; a null key is kept; repeated rows are encoded each for themselves; an empty table gives no rows; other
    columns are ignored, whatever their names. Nothing is shuffled. A long text is one row's work: time n log n, about 100 bytes of memory
    for each of its bytes."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for b in pieces(batch, "__text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([b.column(0), v.encode(b.column(1))], names=[key, "ids"])

    return docs.select(docs[key], docs[text].alias("__text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with the column `text`: what the lists in `ids` say, special tokens included.

    A null list gives an empty text; unknown and null ids say nothing; bytes that aren't UTF-8 become U+FFFD. All columns are kept; one
    that is already named like `text` is replaced."""
    from pyspark.sql.types import StringType, StructField, StructType

    held = tokens.drop(text)
    at, names = held.columns.index(ids), [*held.columns, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy()) if batch.num_rows else []
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE_IDS, "right")))
                b = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*b.columns, v.decode(b.column(at))], names=names)
                lo = hi

    return held.mapInArrow(run, StructType([*held.schema.fields, StructField(text, StringType())]))
