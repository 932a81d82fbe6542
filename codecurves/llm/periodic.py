"""Periodic runs of words, found on a grammar instead of the text.

Re-Pair replaces pairs of words that occur again and again by symbols, many pairs a round, until no pair is left twice. Every run crosses
the border between the two halves of some symbol, so the runs over each symbol's border are computed once, carried to all places that
the symbol derives, and what is part of a longer run of the same period is dropped there.

Re-Pair needs to see only words that can be in a run. A run of 24 words or more, at least three times its period long, consists of windows
of eight words that occur twice in their text; all other words part the sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import joined, pieces, spans, utf8

#: A run is at least this long, and at least so many times its period.
LEAST, TIMES = 24, 3
#: Words of the windows that must occur twice: runs hold LEAST - LEAST / TIMES of them or more. A power of two.
WINDOW = LEAST // TIMES
#: Bytes of text that a Python worker handles at a time (a longer text alone), and periods tried at a time.
SLICE_BYTES, SLICE_TRIES = 3 << 20, 1 << 21
#: Longest factor that gets a number of its own, as a power of two; longer ones are compared in steps of it.
TOP = 14

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

RUN = "struct<start:long,length:long,period:long>"


def repeated(ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words inside a window that occurs twice in its row. Windows are told by hashes, which can only keep more words."""
    keep = np.zeros(len(ids) + 1, np.int64)
    if len(ids) < WINDOW:
        return keep[:-1] > 0
    h, width = (ids.astype(np.uint64) + np.uint64(1)) * _MIX[0], 1
    while width < WINDOW:
        h = h[:-width] * _MIX[1] + (h[width:] ^ (h[width:] >> np.uint64(29))) * _MIX[2]
        width *= 2
    h ^= row[: len(h)].astype(np.uint64) * _MIX[3]
    at = np.flatnonzero(row[: len(h)] == row[WINDOW - 1 :])
    own = h[at]
    s = np.sort(own)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if len(twice):
        k = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
        hit = at[twice[k] == own]
        keep[hit] += 1
        keep -= np.bincount(hit + WINDOW, minlength=len(keep))
    return np.cumsum(keep)[:-1] > 0


class Grammar:
    """Rules of two symbols each, over words (symbols below `words`) in stretches: left, right, size (in words) and at (a place where
    the symbol occurs). rounds: ranges of rules, each made of earlier ones alone. roots: the symbol of each whole stretch."""

    def __init__(self, words: np.ndarray, stretch: np.ndarray):
        self.words = self.symbols = int(words.max()) + 1
        self.size, self.made, self.rounds = np.ones(self.words, np.int64), [], []
        s, at = words.astype(np.int64), np.arange(len(words))
        while len(s) > 1:
            key = np.where(stretch[at[1:]] == stretch[at[:-1]], s[:-1] * self.symbols + s[1:], -1)
            pair, k, n = np.unique(key, return_inverse=True, return_counts=True)
            n[pair < 0] = 0
            if n.max() < 2:
                break
            # the commonest pairs go first; among equally common ones, any order that is the same everywhere
            order = np.lexsort(((pair.astype(np.uint64) * _MIX[0]) >> np.uint64(16), n))
            place = np.empty(len(pair), np.int64)
            place[order] = np.arange(len(pair))
            place[n < 2] = -1
            p = place[k]
            new = np.append(True, key[1:] != key[:-1])
            begin = np.flatnonzero(new)
            even = (np.arange(len(key)) - begin[np.cumsum(new) - 1]) % 2 == 0
            left = ~new | (np.append(-2, p[:-1]) < p)
            right = np.append(~new[1:], False) | (np.append(p[1:], -2) < p)
            hit = np.flatnonzero((p >= 0) & even & left & right)
            used, first, which = np.unique(k[hit], return_index=True, return_inverse=True)
            s, at = self._replace(s, at, hit, which, pair[used] // self.symbols, pair[used] % self.symbols, at[hit[first]])
        while True:  # what is left of each stretch is halved and halved
            new = np.append(True, stretch[at[1:]] != stretch[at[:-1]])
            nth = np.arange(len(s)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            hit = np.flatnonzero((nth[:-1] % 2 == 0) & ~new[1:])
            if not len(hit):
                break
            s, at = self._replace(s, at, hit, np.arange(len(hit)), s[hit], s[hit + 1], at[hit])
        self.roots, self.places = s, at
        self.left, self.right, self.at = (np.concatenate(x) if self.made else np.zeros(0, np.int64) for x in (zip(*self.made, strict=True) if self.made else ([], [], [])))

    def _replace(self, s, at, hit, which, left, right, place):
        self.made.append((left, right, place))
        self.size = np.append(self.size, self.size[left] + self.size[right])
        self.rounds.append((self.symbols, self.symbols + len(left)))
        s = s.copy()
        s[hit] = self.symbols + which
        self.symbols += len(left)
        keep = np.ones(len(s), bool)
        keep[hit + 1] = False
        return s[keep], at[keep]


class Factors:
    """How far two places of a sequence agree, for arrays of places: equal factors of 1, 2, 4, ... words have equal numbers."""

    def __init__(self, words: np.ndarray, longest: int):
        self.levels = [words.astype(np.int32)]
        while len(self.levels) <= TOP and 2 ** len(self.levels) <= longest:
            half, last = 2 ** (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.unique(last[:-half].astype(np.int64) * (len(words) + 1) + last[half:], return_inverse=True)[1].astype(np.int32))

    def agree(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
        """Words that agree from i and j on (back: up to and with i and j), at most `limit`."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 2**k
            live = np.flatnonzero(out + step <= limit)
            while len(live):
                a, b = (i[live] - out[live] - step + 1, j[live] - out[live] - step + 1) if back else (i[live] + out[live], j[live] + out[live])
                live = live[level[a] == level[b]]
                out[live] += step
                live = live[out[live] + step <= limit[live]] if k == len(self.levels) - 1 else live[:0]
        return out


def border_runs(words: np.ndarray, g: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rule, start, end, period) of the runs over the border of each rule, inside what the rule derives; places are those of `at`.

    A run over a border reaches a period's length beyond it on one side at least. So comparing the border with the place one period
    before it, and one period behind it, finds all."""
    size = g.size[g.words :]
    rule = np.flatnonzero(size >= LEAST)
    tries = size[rule] // TIMES
    factors, found = None, []
    edges = np.append(0, np.cumsum(tries))
    lo = 0
    while lo < len(rule):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + SLICE_TRIES, "right")) - 1)
        x = np.repeat(rule[lo:hi], tries[lo:hi])
        q = np.arange(len(x)) - np.repeat(edges[lo:hi] - edges[lo], tries[lo:hi]) + 1
        lo = hi
        begin, end = g.at[x], g.at[x] + size[x]
        m = begin + g.size[g.left[x]]
        for ahead in (True, False):
            i = m if ahead else m - q  # the earlier of the two places compared
            ok = np.flatnonzero((m + q <= end) & (words[m - 1] == words[np.minimum(m - 1 + q, len(words) - 1)]) if ahead else (m - q >= begin) & (words[np.maximum(m - q, 0)] == words[np.minimum(m, len(words) - 1)]))
            if not len(ok):
                continue
            if factors is None:
                factors = Factors(words, int(size.max()))
            i, y, p = i[ok], x[ok], q[ok]
            a = i - factors.agree(i - 1, i + p - 1, i - begin[ok], back=True)
            b = i + p + factors.agree(i, i + p, end[ok] - i - p)
            long = b - a >= np.maximum(LEAST, TIMES * p)
            found.append((y[long], a[long], b[long], p[long]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    x, a, b, p = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((p, b, a, x))
    x, a, b, p = x[order], a[order], b[order], p[order]
    least = np.append(True, (x[1:] != x[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(x)]  # the smallest period of each
    return x[least], a[least], b[least], p[least]


def all_runs(words: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run of a sequence, by start and period. words: whole numbers from 0 on; runs stay inside stretches."""
    none = (np.zeros(0, np.int64),) * 3
    if len(words) < LEAST:
        return none
    g = Grammar(words, stretch)
    rule, start, end, period = border_runs(words, g)
    if not len(rule):
        return none
    n = len(g.left)
    first = np.searchsorted(rule, np.arange(n + 1))
    own = np.diff(first)
    has = np.append(np.zeros(g.words, bool), own > 0)
    for lo, hi in g.rounds:
        has[lo:hi] |= has[g.left[lo - g.words : hi - g.words]] | has[g.right[lo - g.words : hi - g.words]]
    at, symbol, made = g.places, g.roots, []
    while len(symbol):
        live = has[symbol]
        x, at = symbol[live] - g.words, at[live]
        some = own[x] > 0
        y, shift, n_own = x[some], at[some] - g.at[x[some]], own[x[some]]
        k = np.repeat(first[y] - (np.cumsum(n_own) - n_own), n_own) + np.arange(n_own.sum())
        shift = np.repeat(shift, n_own)
        made.append((start[k] + shift, end[k] + shift, period[k]))
        symbol = np.concatenate([g.left[x], g.right[x]])
        at = np.concatenate([at, at + g.size[g.left[x]]])
    a, b, p = (np.concatenate(c) for c in zip(*made, strict=True))
    order = np.lexsort((-b, a, p))
    a, b, p = a[order], b[order], p[order]
    far = np.maximum.accumulate(b + p * (len(words) + 1))  # the furthest end so far among those of a period
    whole = np.append(True, (p[1:] != p[:-1]) | (b[1:] + p[1:] * (len(words) + 1) > far[:-1]))
    a, b, p = a[whole], b[whole], p[whole]
    order = np.lexsort((p, b, a))
    a, b, p = a[order], b[order], p[order]
    least = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    a, b, p = a[least], b[least], p[least]
    order = np.lexsort((p, a))
    return a[order], b[order], p[order]


def find(texts: pa.Array) -> tuple[np.ndarray, list[list[dict]], pa.Array]:
    """Words, runs and collapsed text of each text."""
    buf, row_at = joined(*utf8(texts))
    begin, end = spans(~SPACE[buf])
    row = np.searchsorted(row_at, begin, "right") - 1
    n_words = np.bincount(row, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    size = end - begin
    each = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(np.ascontiguousarray(buf[~SPACE[buf]]))])
    ids = each.dictionary_encode().indices.to_numpy() if len(begin) else np.zeros(0, np.int32)
    kept = np.flatnonzero(repeated(ids, row))
    runs: list[list[dict]] = [[] for _ in range(len(texts))]
    drop = np.zeros(len(begin) + 1, np.int64)
    if len(kept):
        stretch = np.cumsum(np.append(True, (np.diff(kept) > 1) | (np.diff(row[kept]) > 0)))
        a, b, p = all_runs(np.unique(ids[kept], return_inverse=True)[1], stretch)
        for r, s, e, q in zip(row[kept[a]].tolist(), kept[a].tolist(), (b - a).tolist(), p.tolist(), strict=True):
            runs[r].append({"start": s - int(first[r]), "length": e, "period": q})
        drop += np.bincount(kept[a] + p, minlength=len(drop)) - np.bincount(kept[a] + b - a, minlength=len(drop))
    keep = np.flatnonzero(np.cumsum(drop)[:-1] == 0)
    return n_words, runs, _joined_words(buf, begin[keep], end[keep], row[keep], len(texts))


def _joined_words(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """The words of each row, parted by single blanks."""
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    stop = end + ~last  # the byte behind a word is white space
    buf = buf.copy()
    buf[end[~last]] = 32
    edge = np.bincount(begin, minlength=len(buf) + 1) - np.bincount(stop, minlength=len(buf) + 1)
    size = np.bincount(row, weights=stop - begin, minlength=n).astype(np.int64)
    data = buf[np.cumsum(edge)[:-1] > 0]
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(data)]).cast(pa.string())


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: its words are cut at ASCII white space; runs are (start, length, period) in words, in
    order of start and period, of all stretches that repeat a smallest period three times or more over 24 words or more and can't be
    longer; collapsed is the text less the words that any run contains after its first period, words parted by single blanks.

    A null or empty text has no words, no run and an empty collapsed text; a null key is kept; repeated rows are searched each for
    themselves; an empty table gives no rows; other columns are ignored, whatever their names. Nothing is shuffled, and no run crosses
    texts. A text is one row's work: memory grows with its words (about 100 bytes for each that lies in repeated windows), time by
    n log n."""
    kind = docs.schema[key].dataType.simpleString()
    run_type = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "__text", SLICE_BYTES):
                n, found, collapsed = find(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(found, run_type), collapsed], names=[key, "n_words", "runs", "collapsed"])

    return docs.select(docs[key], docs[text].alias("__text")).mapInArrow(search, f"`{key}` {kind}, n_words long, runs array<{RUN}>, collapsed string")
