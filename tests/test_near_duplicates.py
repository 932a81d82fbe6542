"""Near copies against all pairs of files, and what large groups of them cost."""

import random
from collections import Counter

import pytest
from conftest import DATA, duck, rows
from pyspark.sql import functions as F

from codecurves.operators import corpus
from codecurves.plans.oracle import ORACLE
from codecurves.plans.queries import QUERIES, Inputs


def plain_shingles(text):
    w = (text or "").split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_pairs(texts):
    """{(a, b)} of all different texts with a Jaccard of 0.8 or more, by counting the shingles of every two texts that share one."""
    sets = {f: s for f, t in texts.items() if (s := plain_shingles(t))}
    held = {}
    for f in sorted(sets):
        for s in sets[f]:
            held.setdefault(s, []).append(f)
    both = Counter((a, b) for h in held.values() for i, a in enumerate(h) for b in h[i + 1 :])
    return {(a, b) for (a, b), n in both.items() if round(n / (len(sets[a]) + len(sets[b]) - n), 6) >= 0.8}


def plain_groups(nodes, pairs):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_and_groups_against_all_pairs(spark, sf):
    files = Inputs(spark, f"{DATA}/{sf}").files
    got = {(r["file_a"], r["file_b"]) for r in corpus.near_duplicate_pairs(files).collect()}
    groups = {r["file_id"]: r["group_id"] for r in corpus.near_duplicate_groups(files).collect()}
    first, copies, want = {}, [], set()
    by_language = {}
    for r in files.orderBy("file_id").collect():
        f = first.setdefault((r["language"], r["content"]), r["file_id"])
        copies.append((f, r["file_id"]))
        if f == r["file_id"]:
            by_language.setdefault(r["language"], {})[f] = r["content"]
    for texts in by_language.values():
        want |= plain_pairs(texts)
    assert got <= want and len(got) >= 0.99 * len(want) and want
    assert groups == plain_groups([f for _, f in copies], [*copies, *want])


def test_groups_match_sql_at_two_sizes(spark):
    small = f"{DATA}/sf0.01"
    assert rows(QUERIES["a4_near_duplicate_groups"](spark, small).toPandas()) == rows(duck(small).sql(ORACLE["a4_near_duplicate_groups"]).df())


def files_of(spark, texts):
    return spark.createDataFrame([("x", k, t) for k, t in enumerate(texts)], "language string, file_id long, content string")


def near_texts(n, edits, seed=4):
    """n texts of one stem of 120 words, each with `edits` words changed."""
    rng = random.Random(seed)
    stem = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    out = []
    for k in range(n):
        t = list(stem)
        for j in range(edits):
            t[rng.randint(0, 119)] = f"e{k}.{j}"
        out.append(" ".join(t))
    return out


def test_many_near_copies_make_few_comparisons(spark):
    n = 2000
    files = files_of(spark, near_texts(n, 1))
    _, s, keyed = corpus._banded(files, 5, 8)
    keys = keyed.select("language", F.xxhash64("band", "m").alias("key"), "file_id")
    links, second = corpus.near_duplicate_links(s, keys)
    n_links, n_second = links.count(), second.count()
    assert n_links <= 8 * n and n_second <= 8 * n  # all pairs: n^2 / 2 = 2,000,000
    assert {r["group_id"] for r in corpus.near_duplicate_groups(files).collect()} == {0}


def test_chains_copies_and_empty_texts(spark):
    rng = random.Random(6)
    words = [f"c{k}" for k in range(100)]
    chain = [" ".join(words)]
    for k in range(12):  # each a step of the last; the ends are far apart
        words[(k * 31) % 100] = f"d{k}"
        chain.append(" ".join(words))
    loose = near_texts(40, 4, seed=7)  # share keys with each other, mostly below the threshold
    texts = [*chain, *loose, None, "", "  ", None, chain[3], "a b", "a  b", "a b"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[k] for k in order]
    first = {}
    copies = [(first.setdefault(t, k), k) for k, t in enumerate(texts)]
    want = plain_groups(range(len(texts)), [*copies, *plain_pairs({k: t for t, k in first.items()})])
    files = files_of(spark, texts)
    assert {r["file_id"]: r["group_id"] for r in corpus.near_duplicate_groups(files).collect()} == want
    assert len(set(want.values())) > 10
    _, s, keyed = corpus._banded(files, 5, 8)
    keys = keyed.select("language", F.xxhash64("band", "m").alias("key"), "file_id")
    ends = []
    for block in (3, 2048):
        links, _ = corpus.near_duplicate_links(s, keys, block=block)
        ends.append(plain_groups(range(len(texts)), [*copies, *((r["hub"], r["file_id"]) for r in links.collect())]))
    assert ends == [want, want]
    assert corpus.near_duplicate_groups(files.limit(0)).count() == 0


def test_pairs_are_compared_by_sets_made_once(spark):
    draw = random.Random(8)
    text = [f"w{draw.randint(0, 5000)}" for _ in range(3000)]
    texts = [" ".join(text[:k] + ["x"] + text[k + 1 :]) for k in range(0, 1500, 100)] + [" ".join(text[:9]), "w1", ""]
    own = spark.createDataFrame([("c", "c", k, "", t) for k, t in enumerate(texts)], "language string, codebase string, file_id long, path string, content string")
    pairs = corpus.near_duplicate_pairs(own)
    assert "regexp_replace" not in pairs._jdf.queryExecution().optimizedPlan().toString()  # no text is cut for a pair
    sets = [{" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (t.split() for t in texts)]
    got = {(r["file_a"], r["file_b"]): r["jaccard"] for r in pairs.collect()}
    assert got == {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in range(15) for b in range(a + 1, 15)}


def test_hub_sets_go_out_once_for_so_many_pairs(spark):
    sets = spark.createDataFrame([(k, [*range(10), 100 + k]) for k in range(12)], "file_id long, s array<long>")
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 9)] + [(11, 10)], "file_id long, hub long")
    for hot in (3, 256):
        got = corpus._compared(pairs, sets, 0.5, hot).collect()
        assert sorted(map(tuple, got)) == sorted((*map(int, p), round(10 / 12, 6)) for p in pairs.collect())
