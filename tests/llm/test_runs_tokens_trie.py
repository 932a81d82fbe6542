"""Periodic runs, byte-pair tokens and the prefix trie against brute force, the tokenizers library and plain Python, and on odd tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import DATA, duck, rows

from codecurves.llm import bpe, periodic, queries, trie
from codecurves.llm.common import table

SMALL = f"{DATA}/sf0.001"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def odd(spark):
    """Nulls, empties, ties, repeated rows, a long text, and extra columns whose names operators use inside."""
    text = "a b c " * 20
    got = [(1, text), (2, text), (2, text), (3, None), (None, text), (None, None), (4, ""), (5, " \n\t "), (6, "x" * 70_000), (7, "y " * 30_000), (8, "É ü\x0b\x0c" * 30)]
    return spark.createDataFrame([(i, t, "k", [1], [1], "s", 1) for i, t in got], "doc_id long, text string, ids string, runs array<int>, decoded array<int>, __text string, n_words int")


# 11 periodic runs


def plain_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q):
                found.setdefault((s, i + q), q)
    runs = sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))
    drop = {k for s, n, q in runs for k in range(s + q, s + n)}
    return runs, " ".join(x for k, x in enumerate(w) if k not in drop)


def repetitive(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        kind = rng.random()
        if kind < 0.3:
            out += [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        elif kind < 0.7:
            period = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 14))]
            out += (period * 12)[: rng.randint(1, len(period) * 8)]
        elif kind < 0.8 and out:
            out += out[-rng.randint(1, len(out)) :] * rng.randint(1, 3)
        else:
            out += [str(rng.randint(0, 50)) for _ in range(rng.randint(0, 30))]
    return out[:1000]


@pytest.mark.parametrize("seed", range(60))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    docs = [repetitive(rng) for _ in range(rng.randint(1, 12))]
    docs += docs[: seed % 3]
    n, runs, collapsed = periodic.find(pa.array([rng.choice([" ", "\n", "\t  "]).join(d) for d in docs] + ["", None], pa.string()))
    for d, k, r, c in zip(docs, n, runs, collapsed.to_pylist()):
        assert k == len(d) and ([(x["start"], x["length"], x["period"]) for x in r], c) == plain_runs(d)
    assert collapsed.to_pylist()[-2:] == ["", ""] and runs[-2:] == [[], []]


def test_runs_of_highly_repetitive_texts():
    fib = ["a", "a b"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + " " + fib[-2])
    thue = " ".join("ab"[bin(k).count("1") % 2] for k in range(1500))
    for text in (fib[-1], thue, "a " * 2000, "a b " * 900 + "a", ("a " * 30 + "b ") * 40):
        _, runs, collapsed = periodic.find(pa.array([text]))
        assert ([(x["start"], x["length"], x["period"]) for x in runs[0]], collapsed[0].as_py()) == plain_runs(text.split())


def test_steps_beyond_the_longest_factor_and_few_tries(monkeypatch):
    monkeypatch.setattr(periodic, "TOP", 3)
    monkeypatch.setattr(periodic, "SLICE_TRIES", 50)
    test_runs_of_highly_repetitive_texts()
    test_runs_match_brute_force(3)


def test_grammar_leaves_no_pair_twice_and_derives_its_words():
    w = np.array([int(c) for c in "0123012301230123456456456" * 3])
    g = periodic.Grammar(w, np.ones(len(w), np.int64))

    def words(x):
        return [x] if x < g.words else words(g.left[x - g.words]) + words(g.right[x - g.words])

    assert words(g.roots[0]) == w.tolist() and len(g.roots) == 1
    for k in range(len(g.left)):
        assert w[g.at[k] : g.at[k] + g.size[g.words + k]].tolist() == words(g.words + k)


def test_runs_on_odd_tables(spark):
    d = odd(spark)
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.runs(d).collect())
    want = []
    for r in d.select("doc_id", "text").collect():
        w = re.findall("[^\x20\x09-\x0d]+", r["text"] or "")
        runs, text = ([(0, len(w), 1)], w[0]) if len(w) > 20_000 else plain_runs(w)
        want.append((str(r["doc_id"]), len(w), runs, text))
    assert got == sorted(want)
    assert periodic.runs(d.limit(0)).count() == 0


def test_runs_query_on_a_whole_table(spark):
    got = queries.op11_periodic_runs(spark, SMALL).toPandas().set_index("doc_id")
    docs = table(spark, SMALL, "documents").toPandas()
    assert len(got) == len(docs) and (got["n_runs"] > 0).sum() > 10
    for i, t in zip(docs["doc_id"], docs["text"]):
        w, h = re.findall("[^\x20\x09-\x0d]+", t or ""), zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 3000 and h % 10:
            continue  # the plain version takes quadratic time
        runs, collapsed = plain_runs(w)
        x = got.loc[i]
        assert x["n_runs"] == len(runs) and x["collapsed_sha256"] == sha(collapsed)
        assert x["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        if runs:
            s, n, q = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
            assert (x["start"], x["length"], x["period"], x["exponent_milli"]) == (s, n, q, 1000 * n // q)
        else:
            assert x[["start", "length", "period", "exponent_milli"]].isna().all()


# 12 byte-pair tokens


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def same_as_library(library, texts):
    v = bpe.vocabulary()
    ids = v.encode(pa.array(texts, pa.string()))
    for t, own in zip(texts, ids.to_pylist()):
        assert own == library.encode(t or "", add_special_tokens=False).ids
    assert v.decode(ids).to_pylist() == [library.decode(i, skip_special_tokens=False) for i in ids.to_pylist()]


def test_tokens_of_odd_texts(library):
    same_as_library(library, ["", None, "a  b", "  ", "x  ", "b", "don't we'LL 's  'tis", "a<|endoftext|>b  <|endoftext|>", "<|endoftext|>", " <|endoftext|> ", "a" * 800, "  \n\n x\n\t y", "É" * 400,
        "　 a  b  c", "👩‍👩‍👧 ok", "\x1c\x1d a\x85b", "a\n\n1", " " * 500, "\r\n \r\n", "x" * 256, "y" * 257, "<|endoftext|"])


@pytest.mark.parametrize("seed", range(12))
def test_tokens_of_random_texts(library, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "e", "t", "s", " ", "  ", "\n", "'", "'s", "'re", "é", "ß", "1", "23", ".", "!?", "\t", " ", "中", "ा", "̀", "<|endoftext|>", "the", " ing", "\r", "_", "Ω", " ", "\x00", "😀", "²"]
    any_sign = lambda: chr(rng.choice([rng.randint(1, 0x7FF), rng.randint(0x20, 0x3FFF), rng.randint(0xE000, 0x1FFFF)]))
    same_as_library(library, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)])
    same_as_library(library, ["".join(rng.choice("abcdehilnorst ") for _ in range(rng.randint(0, 80))) for _ in range(300)])
    same_as_library(library, ["".join(any_sign() for _ in range(rng.randint(0, 30))) for _ in range(150)])


def test_speculation_is_refused_where_merging_differs():
    v = bpe.vocabulary()
    rng = random.Random(7)
    words = list({"".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 12))).encode() for _ in range(3000)})
    exact = [np.array(v.merge(w), "<i4").tobytes() for w in words]
    data, end = np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum([len(w) for w in words])
    word, token = v.propose(data, end - np.array([len(w) for w in words]), end)
    greedy = [token[word == k].astype("<i4").tobytes() for k in range(len(words))]
    assert v.encode_words(words) == exact
    assert 0 < sum(g != e for g, e in zip(greedy, exact)) < len(words)  # both ways are taken
    merged = v.merge_all(data, end - np.array([len(w) for w in words]), end)
    assert [merged[1][merged[0] == k].astype("<i4").tobytes() for k in range(len(words))] == exact


def test_tokens_of_a_whole_table(spark, library):
    docs = table(spark, f"{DATA}/sf0.01", "documents")
    got = {r["doc_id"]: r for r in queries.op12_bpe(spark, f"{DATA}/sf0.01").collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        x = got[r["doc_id"]]
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_tokens_on_odd_tables(spark, library, monkeypatch):
    d = odd(spark)
    got = sorted((str(r["doc_id"]), r["ids"]) for r in bpe.encode(d).collect())
    assert got == sorted((str(r["doc_id"]), library.encode(r["text"] or "", add_special_tokens=False).ids) for r in d.select("doc_id", "text").collect())
    back = bpe.decode(bpe.encode(d))
    assert sorted(r["decoded"] for r in back.collect()) == sorted(r["text"] or "" for r in d.select("text").collect())
    assert bpe.encode(d.limit(0)).count() == 0
    lists = spark.createDataFrame([(1, [15496, None, 99_999, -4, 995], "old"), (2, None, None), (3, [], ""), (4, [138], "")], "k int, ids array<int>, decoded string")
    assert {r["k"]: r["decoded"] for r in bpe.decode(lists).collect()} == {1: "Hello world", 2: "", 3: "", 4: "�"}
    v = bpe.vocabulary()
    v.known.clear()
    monkeypatch.setattr(bpe, "CACHE", 3)
    same_as_library(library, ["one two three four five", "six one seven", "one"])


# 13 prefix trie


def plain_trie(rows_):
    by = {}
    for c, t, role, text in rows_:
        if c is not None:
            own = (role or "", text or "")
            by.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(own[0])}:{own[0]}{own[1]}".encode()).digest(), own))
    by = {c: [x[3] for x in sorted(own, key=lambda x: x[:3])] for c, own in by.items()}
    head = {c: zlib.crc32(str(c).encode()) % 6 for c in by}
    built = {c: tuple(by.get(c - c % 100, [])[: head[c]] + by[c][head[c] :]) for c in by}
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if built[c] == path)))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), sum(len(p) == len(path) + 1 for p in below), len(leaves), saved, sha(ends)))
    return sorted(map(repr, out))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, tmp_path, data):
    made = [(c, t, r, x, "k", 1, 2, "p") for c, t, r, x in data]
    d = spark.createDataFrame(made, "conv_id long, turn long, role string, text string, key string, depth int, n_convs int, parent string")
    d.write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted(repr(tuple(r[c] for c in COLUMNS)) for r in queries.op13_prefix_trie(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("chunk", [2, 4096])
def test_trie_matches_plain_python(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rng = random.Random(11)
    data = []
    for c in [*range(0, 60), *range(100, 130), 205, 317, 7001]:
        for t in range(rng.randint(1, 7)):
            data.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "É" * 5]) if c % 3 else f"{t}"))
    data += [(900, None, None, None), (900, 3, "user", None), (900, None, "user", "late"), (901, 1, None, "x"), (None, 1, "user", "nobody's"), (902, 1, "user", "same"), (902, 1, "user", "same"), (903, 2, "a", "tie"), (903, 2, "b", "tie")]
    rng.shuffle(data)
    assert trie_of(spark, tmp_path, data) == plain_trie(data)


def test_trie_of_nothing_and_of_turnless_conversations(spark, tmp_path):
    assert trie_of(spark, tmp_path / "a", []) == []
    data = [(c, 0, "user", "x") for c in (101, 102, 203, 305) if zlib.crc32(str(c).encode()) % 6 >= 1]  # no base: all turns go
    assert data and trie_of(spark, tmp_path / "b", data) == plain_trie(data)


def test_trie_matches_sql(spark):
    for sf in ("sf0.001", "sf0.01"):
        got, want = queries.op13_prefix_trie(spark, f"{DATA}/{sf}").toPandas(), duck(f"{DATA}/{sf}").sql(queries.SQL["op13_prefix_trie"]).df()
        whole = lambda d: d.astype({"parent_conv_id": "Int64"})
        assert sorted(got.columns) == sorted(want.columns) and rows(whole(got)) == rows(whole(want))


def test_ends_of_a_key_with_most_conversations_are_several_rows(spark):
    ends = spark.createDataFrame(pd.DataFrame({"conv": range(20_000)})).selectExpr("unhex('0a') AS key", "conv")
    lists = trie.end_lists(ends)
    assert lists.count() >= 5 and lists.agg({"n": "sum"}).first()[0] == 20_000
    assert trie.end_digests(lists).first()["ends_sha256"] == sha(",".join(map(str, range(20_000))))
