"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

A disguised word (leetspeak, letters set apart, letters repeated) is a lattice of the characters each sign may stand for; a character
model counted over the whole corpus picks the likeliest path through it. A word without such signs has one path only and stays as it
is. The score of the restored text rests on how much more often a word, or its beginning, stands in toxic texts than in others. A word
that only looks disguised (doubled letters are common) counts as written as well.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, joined, pieces, release, stored, utf8

#: Most labelled rows that the classifier is fitted on (those of the smallest hash), and the most features that it keeps.
MAX_LABELLED, MAX_FEATURES = 8_000, 50_000
#: Toxic texts that a feature must stand in, and how much likelier it must be there, before it counts; words of a worker's cache (emptied when full).
MIN_TEXTS, MIN_ODDS, CACHE = 3, 4.0, 100_000
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SWAP_COST, SYMBOLS = 1.0, 29

_RUN = re.compile(r"(.)\1*", re.S)
_WORD = re.compile(r"[^\W\d_]+")
_NOISY = re.compile(r"[0-9@$!|+(€]|([^\W\d_])\1|^\W*\w(?:[.\-_*~/,]\w){2,}\W*$")
_DOUBLE, _SLIM = re.compile(r"([^\W\d_])\1"), re.compile(r"(.)\1+", re.S)
#: Signs set apart: four or more, with up to three blanks or marks between any two, not part of longer words.
_APART = re.compile(r"(?<![^\W_])(?:(?:[^\W_]|[@$!|+(€])[\s.,/\-_*~]{1,3}){3,}(?:[^\W_]|[@$!|+(€])(?![^\W_])")
_SIGN = re.compile(r"[^\W_]|[@$!|+(€]")
_AROUND = ".,;:?\"'"
#: Slots after which the paths of a long lattice are cut back to where they part.
SETTLE = 2048


def core(token: str) -> str:
    """A token less the marks on either side of it."""
    i, j = 0, len(token)
    while i < j and not (token[i].isalnum() or token[i] in "_@$|(€"):
        i += 1
    if 0 < i < j and token[i - 1] == "!" and token[i].isalnum():
        i -= 1  # in front of a letter it may stand for one
    while j > i and not (token[j - 1].isalnum() or token[j - 1] in "_@$€"):
        j -= 1
    return token[i:j]


def slim(word: str) -> str:
    """A word with every run of a letter cut to one."""
    return _SLIM.sub(r"\1", word)


def symbol(c: str) -> int:
    """0: boundary, 1-26: a-z, 27: another letter, 28: digit."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 28 if c.isdigit() else 27 if c.isalpha() else 0


_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[48:58] = 28
_SYMBOL[0xC0:] = 27


def char_counts(docs: DataFrame) -> np.ndarray:
    """Character trigram counts over all texts; 29^3 numbers come to the driver, summed by Spark over every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for b in pieces(batch, "text", 4 << 20):
                buf, _ = joined(*utf8(b.column(0)))
                s = _SYMBOL[LOWER[buf[(buf < 0x80) | (buf >= 0xC0)]]]
                s = s[(s > 0) | np.concatenate([[True], s[:-1] > 0])]
                if len(s) > 2:
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    got = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3)
    out[got["gram"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Restorer:
    def __init__(self, counts: np.ndarray):
        one = (counts.sum((0, 1)) + 1) / (counts.sum() + SYMBOLS)
        two = (counts.sum(0) + 4 * one) / (counts.sum((0, 2))[:, None] + 4)
        three = (counts + 4 * two[None]) / (counts.sum(2)[:, :, None] + 4)
        self.logp = np.log(three).tolist()

    @staticmethod
    def lattice(word: str) -> Iterator[list[tuple[str, float]]]:
        """For each sign, or run of one sign, the strings it may stand for and their cost."""
        for m in _RUN.finditer(word):
            c, n = m[1], len(m[0])
            swaps = [(x, SWAP_COST) for x in LEET.get(c, "")]
            means = swaps + [(c, 0.0)] * c.isalnum()
            if not means:
                yield [("", 0.0)]
            elif n == 1:
                yield means
            elif c.isdigit():
                yield [(x * k, cost) for x, cost in swaps for k in (1, 2)] + [(c * n, 0.0)]
            else:
                yield [(x * k, cost) for x, cost in means for k in (1, 2)]

    def apart(self, signs: list[str]) -> str:
        """Signs set apart by blanks or marks: between any two, the word may go on or end."""

        def slots() -> Iterator[list[tuple[str, float]]]:
            for k, sign in enumerate(signs):
                if k:
                    yield [("", 0.0), (" ", 0.0)]
                yield from self.lattice(sign)

        return self.best(slots())

    def decode(self, word: str) -> str:
        return self.best(self.lattice(word))

    def best(self, slots: Iterable[list[tuple[str, float]]]) -> str:
        """The likeliest path (Viterbi over the last two characters). Paths are back pointers; what all of them share is settled as the
        lattice is read, so time and memory follow its length."""
        done: list[str] = []
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for k, slot in enumerate(chain(slots, [[(" ", 0.0)]])):
            if len(best) == len(slot) == 1:  # nothing to choose, and nothing before it is open
                ((x, y),), piece = best, slot[0][0]
                for c in piece:
                    x, y = y, symbol(c)
                done.append(piece)
                best = {(x, y): (0.0, None)}
                continue
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for piece, cost in slot:
                    x, y, s = a, b, score - cost
                    for c in piece:
                        z = symbol(c)
                        s += self.logp[x][y][z]
                        x, y = y, z
                    if (x, y) not in new or s > new[x, y][0]:
                        new[x, y] = (s, (path, piece))
            best = self._settled(new, done) if len(new) == 1 or k % SETTLE == SETTLE - 1 else new
        _, path = max(best.values(), key=lambda v: v[0])
        return ("".join(done) + "".join(_walk(path))).strip()

    @staticmethod
    def _settled(best: dict, done: list[str]) -> dict:
        """Move what all paths share to `done`, and cut them there."""
        chains = []
        for _, path in best.values():
            nodes = []
            while path is not None:
                nodes.append(path)
                path = path[0]
            chains.append(nodes[::-1])
        shared = 0
        while all(len(c) > shared and c[shared] is chains[0][shared] for c in chains):
            shared += 1
        done.extend(node[1] for node in chains[0][:shared])
        out = {}
        for (state, (score, _)), nodes in zip(best.items(), chains, strict=True):
            path = None
            for node in nodes[shared:]:
                path = (path, node[1])
            out[state] = (score, path)
        return out

    def restore(self, token: str) -> str:
        """A token between white space, lower case. Numbers stay numbers."""
        if not _NOISY.search(token):
            return token
        own = core(token)
        return self.decode(own) if any(c.isalpha() for c in own) else token

    def words(self, token: str) -> set[str]:
        """The words of a token, as restored and as written."""
        out = set(_WORD.findall(token))
        return out | set(_WORD.findall(self.restore(token))) if _NOISY.search(token) else out

    def joined(self, low: str) -> list[tuple[int, int, str]]:
        """(start, end, restored) of the stretches of a lower-case text whose signs are set apart."""
        return [(m.start(), m.end(), self.apart(_SIGN.findall(m[0]))) for m in _APART.finditer(low) if any(c.isalpha() for c in m[0])]

    def tokens(self, text: str) -> set[str]:
        low = text.lower()
        out = set(low.split())
        for _, _, word in self.joined(low):
            out.update(word.split())
        return out

    def text(self, text: str) -> str:
        """The whole text, lower case, with every disguised stretch and token in its restored form."""
        low, out, at = text.lower(), [], 0
        for start, end, word in self.joined(low):
            out += [low[at:start], word]
            at = end
        return re.sub(r"\S+", lambda m: self.restore(m[0]), "".join([*out, low[at:]]))


def _walk(path: tuple | None) -> list[str]:
    out = []
    while path is not None:
        path, piece = path
        out.append(piece)
    return out[::-1]


def features(word: str) -> list[str]:
    """The word, and its beginnings of three to six letters."""
    return ["=" + word, *("^" + word[:k] for k in range(3, min(6, len(word)) + 1))]


class Evidence:
    """The weight of each token of a text: that of the strongest feature of the words it holds, as written or as restored."""

    def __init__(self, restorer: Restorer, known: dict[str, tuple[int, int]], total: tuple[int, int]):
        self.restorer, self.known, self.total = restorer, known, total
        self.cache: dict[str, float] = {}
        self.heads = {f[1:4] for f in known}
        self.slim = {slim(f[1:])[:3] for f in known}

    def weight(self, p: int, n: int, own: int = -1) -> float:
        """own: the label of a text whose part in the counts is taken out."""
        pos, neg = self.total[0] - (own == 1), self.total[1] - (own == 0)
        return math.log((p - (own == 1) + 0.5) / (pos + 1)) - math.log((n - (own == 0) + 0.5) / (neg + 1))

    def token(self, raw: str, own: int = -1) -> float:
        found = [self.known[f] for w in self.restorer.words(raw) for f in features(w) if f in self.known]
        return max([0.0, *(self.weight(p, n, own) for p, n in found if p - (own == 1) > 0)])

    def text(self, text: str | None, own: int = -1) -> tuple[float, float]:
        """The two strongest tokens."""
        cache, heads, got = self.cache, self.heads, []
        for raw in self.restorer.tokens(text or ""):
            word = raw.strip(_AROUND).rstrip("!")
            if word.isalpha() and word[:3] not in heads and not (_DOUBLE.search(word) and slim(word)[:3] in self.slim):
                continue  # one word that begins like no feature, doubled letters or not
            if own >= 0:
                got.append(self.token(raw, own))
                continue
            x = cache.get(raw)
            if x is None:
                if len(cache) >= CACHE:
                    cache.clear()
                x = cache[raw] = self.token(raw)
            if x:
                got.append(x)
        got.sort(reverse=True)
        return (*got[:2], *[0.0] * (2 - len(got[:2])))


def _feature_counts(sample: DataFrame, restorer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        known: dict[str, list[str]] = {}

        def flush():
            p, n = ([v[i] for v in counts.values()] for i in (0, 1))
            out = pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(p, pa.int64()), pa.array(n, pa.int64())], names=["feature", "p", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = {""}
                for raw in restorer.value.tokens(text or ""):
                    if raw not in known:
                        if len(known) >= CACHE:
                            known.clear()
                        known[raw] = [f for w in restorer.value.words(raw) for f in features(w)]
                    held.update(known[raw])
                for f in held:
                    counts.setdefault(f, [0, 0])[0 if toxic else 1] += 1
                if len(counts) > 150_000:
                    yield flush()
        yield flush()
        release()

    return sample.select("text", "toxic").mapInArrow(run, "feature string, p long, n long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def fit(docs: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED):
    """labelled: doc_id, toxic (0 or 1). Returns the broadcast (restorer, known features, totals, coefficients) of a classifier."""
    sc = docs.sparkSession.sparkContext
    restorer = sc.broadcast(Restorer(char_counts(docs)))
    ids = labelled.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "labelled").repartition(24)
    counts = stored(_feature_counts(sample, restorer), "features")
    total = counts.filter("feature = ''").first()
    total = (total["p"], total["n"]) if total else (0, 0)
    odds = F.col("p") / F.lit(total[0] + 1) / ((F.col("n") + 0.5) / F.lit(total[1] + 1))
    kept = counts.filter(f"feature <> '' and p >= {MIN_TEXTS}").filter(odds > MIN_ODDS).orderBy(odds.desc(), "feature").limit(MAX_FEATURES).toArrow().to_pydict()
    known = {f: (p, n) for f, p, n in zip(kept["feature"], kept["p"], kept["n"], strict=True)}
    model = sc.broadcast((known, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see = Evidence(restorer.value, *model.value)
        for batch in batches:
            rows = [(*see.text(t, int(y > 0)), int(y > 0)) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(3)], names=["a", "b", "y"])

    seen = sample.mapInArrow(run, "a double, b double, y double").toArrow()  # max_labelled rows at most
    x = np.column_stack([seen["a"].to_numpy(), seen["b"].to_numpy(), np.ones(len(seen))])
    return restorer, model, _logistic(x, seen["y"].to_numpy())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps. The second token's weight is held back a hundred times harder than the first's: one strong word is enough. Rows are put in order first, so that the result doesn't hang on how Spark returned them."""
    w = np.array([0.0, 0.0, -8.0 if not y.any() else 0.0])
    if not y.any() or y.all():
        return w if not y.any() else np.array([0.0, 0.0, 8.0])
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    hold = np.diag([ridge, 100 * ridge, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _scorer(fitted):
    restorer, model, w = fitted

    def score(see: Evidence, text: str | None) -> float:
        a, b = see.text(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * w[0] + b * w[1] + w[2]))))

    return lambda: Evidence(restorer.value, *model.value), score


def score(docs: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5), one row for each row of docs.

    The character model counts every text; the classifier sees at most max_labelled labelled rows. Null and empty texts hold no words
    and score lowest. Without labelled rows, or toxic ones, every score is near zero. Repeated rows are scored each for themselves; an
    empty table gives no rows; other columns are ignored. Documents aren't shuffled."""
    make, rate = _scorer(fit(docs, labelled, max_labelled))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see = make()
        for batch in batches:
            s = np.array([rate(see, t.as_py()) for t in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])
        del see
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs, with all their columns, that score under 0.5.

    Null and empty texts hold no words and stay. Repeated rows stay or go each for themselves, and alike. Without labelled rows, or toxic
    ones, all rows stay. An empty table gives no rows; columns of any other name, labels' among them, are neither read nor changed."""
    make, rate = _scorer(fit(docs, labelled, max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see = make()
        for batch in batches:
            clean = [rate(see, t.as_py()) < 0.5 for t in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array(clean, pa.bool_()))
        del see
        release()

    return docs.mapInArrow(run, docs.schema)


def restored(docs: DataFrame) -> DataFrame:
    """doc_id, restored (the whole text, lower case, decoded under the corpus's character model), one row for each row of docs. A null
    text stays null; an empty table gives no rows."""
    restorer = docs.sparkSession.sparkContext.broadcast(Restorer(char_counts(docs)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if t is None else restorer.value.text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["doc_id", "restored"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, restored string")
