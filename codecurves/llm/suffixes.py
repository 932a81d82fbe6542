"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, and a wavelet matrix for FM-indexes."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray, packed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of an integer sequence, and each suffix's group number (where its group begins in the order).

    Larsson and Sadakane: suffixes are sorted by their first symbols, then ever again only groups that still hold several are sorted
    by the group number of the suffix h symbols on, and h doubles.
    packed: how many symbols each entry of s stands for already (the entry and its successors packed into one number)."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sa = np.argsort(s, kind="stable")
    v = s[sa]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    live = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    h = packed
    while live.size:
        at = sa[live]
        group, nxt = rank[at], at + h
        key = group * (n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[live] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = np.maximum.accumulate(np.where(new, live, 0))
        live = live[~(new & np.concatenate([new[1:], [True]]))]
        h *= 2
    return sa, rank


def common_prefixes(s: np.ndarray, sa: np.ndarray, cap: int, lanes: int = 8192) -> np.ndarray:
    """Kasai: lcp[i] of the suffixes at sa[i-1] and sa[i], up to cap (lcp[0] = 0). s must end in `cap` symbols that match nothing.

    In text order a common prefix shrinks by at most one symbol from one position to the next. The text is cut into lanes that walk
    in step, so each step is one numpy operation over all lanes."""
    n = len(sa)
    plcp = np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    step = -(-n // lanes)
    base = np.arange(0, n, step)
    h = np.zeros(len(base), np.int64)
    for k in range(step):
        at = base + k
        on = np.flatnonzero(at < n)
        at, other = at[on], before[at[on]]
        h[on] = np.where(other >= 0, np.maximum(h[on] - 1, 0), 0)
        go = on[(other >= 0) & (h[on] < cap)]
        while go.size:
            i, j = base[go] + k + h[go], before[base[go] + k] + h[go]
            go = go[s[i] == s[j]]
            h[go] += 1
            go = go[h[go] < cap]
        plcp[at] = h[on]
    lcp = plcp[sa]
    if n:
        lcp[0] = 0
    return lcp


class Wavelet:
    """Wavelet matrix: symbol counts in a prefix, and symbols by place, in one step for each bit of the alphabet."""

    def __init__(self, s: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (s >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i."""
        lo = np.zeros_like(i)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            one, ones, zeros = ((c >> b) & 1).astype(bool), self.ones[level], self.zeros[level]
            lo, i = np.where(one, zeros + ones[lo], lo - ones[lo]), np.where(one, zeros + ones[i], i - ones[i])
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[i + 1] > ones[i]
            c = 2 * c + one
            i = np.where(one, zeros + ones[i], i - ones[i])
        return c


class FMIndex:
    """Backward search over a sequence of symbols 2..alphabet-1; 1 parts stretches that no phrase may cross; 0 is put at the end."""

    def __init__(self, s: np.ndarray, alphabet: int, sample: int = 8):
        s = np.concatenate([s, [0]]).astype(np.int64)
        self.n, self.sample = len(s), sample
        sa, _ = suffix_array(s)
        self.wavelet = Wavelet(s[sa - 1], alphabet)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=alphabet))])
        marked = sa % sample == 0
        self.marked, self.kept = np.concatenate([[0], np.cumsum(marked)]), sa[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: one row each, aligned to the right. Returns (phrase, place) of every occurrence."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(1, phrases.shape[1] + 1):
            go = live[lengths[live] >= k]
            c = phrases[go, -k]
            lo[go], hi[go] = self.below[c] + self.wavelet.rank(c, lo[go]), self.below[c] + self.wavelet.rank(c, hi[go])
            live = live[lo[live] < hi[live]]
        found = np.repeat(live, hi[live] - lo[live])
        first = np.cumsum(hi[live] - lo[live]) - (hi[live] - lo[live])
        rows = np.arange(len(found)) - np.repeat(first - lo[live], hi[live] - lo[live])
        return found, self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Walk back to the next sampled suffix; its place and the steps taken give the row's place."""
        out, steps, live = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while live.size:
            hit = self.marked[rows + 1] > self.marked[rows]
            out[live[hit]] = self.kept[self.marked[rows[hit]]] + steps
            live, rows = live[~hit], rows[~hit]
            c = self.wavelet.access(rows)
            rows = self.below[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out
