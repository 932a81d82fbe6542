"""Operators that are dealt out in parts: equal results whatever the parts, and no part with most of the rows."""

import random

import pytest
from pyspark.sql import functions as F
from test_known_answers import files

from codecurves.operators import corpus, predictors


def positions(spark, *texts):
    f = files(spark, *texts)
    return corpus.assign_positions(corpus.tokenize(f), f.select("codebase", "file_id", (F.col("file_id") + 1).alias("seq")))


def mixed(seed=1, n=400):
    rng = random.Random(seed)
    return [" ".join("the" if rng.random() < 0.4 else rng.choice("abcdefg") for _ in range(rng.randint(0, n // 4))) for _ in range(8)]


def bits(df):
    return sorted((r["codebase"], r["pos"], r["ctx"], r["ubits"]) for r in df.collect())


def plain(texts, lines=False):
    seq = [t for x in texts for t in (x.split("\n") if lines else x.split())]
    ctx = ["", *seq[:-1]]
    return [(seq[:i].count(seq[i]), ctx[:i].count(ctx[i]), list(zip(ctx[:i], seq[:i])).count((ctx[i], seq[i]))) for i in range(len(seq))]


def test_blocks_change_no_adaptive_loss(spark):
    t = positions(spark, *mixed())
    want = bits(predictors.score_adaptive(t))
    for block in (1, 7, 64):
        assert bits(predictors.score_adaptive(t, block=block)) == want
    cut = bits(predictors.score_adaptive(t, window=50, block=16))
    assert cut == bits(predictors.score_adaptive(t, window=50)) != want


def test_counts_are_those_of_plain_loops(spark):
    for texts, kind in ((mixed(3, 120), "word"), (["a\n\nb\n\n", "\n\na", ""], "line")):
        f = files(spark, *texts)
        t = corpus.assign_positions(corpus.tokenize(f, kind), f.select("codebase", "file_id", (F.col("file_id") + 1).alias("seq"))).withColumn("n_bytes", F.octet_length("token"))
        n = plain(texts, kind == "line")
        frame = spark.createDataFrame([(k + 1, *map(float, x)) for k, x in enumerate(n)], "pos long, cw double, cc double, ccw double").join(t, "pos")
        want = frame.select("pos", predictors.ubits(predictors.code_length((F.col("pos") - 1).cast("double"), F.col("cw"), F.col("cc"), F.col("ccw"), F.col("n_bytes"))).alias("ubits"))
        want = sorted(map(tuple, want.collect()))
        for block in (2, 5, 1000):
            assert sorted((r["pos"], r["ubits"]) for r in predictors.score_adaptive(t, block=block).collect()) == want


def test_blocks_change_no_limited_loss(spark):
    t = positions(spark, *mixed(2))
    got = lambda b: sorted((r["rung"], r["pos"], r["ubits"]) for r in predictors.score_limited_context(t, [4, 16], b).collect())
    assert got(16) == got(37) == got(1 << 16)


def test_a_word_that_is_most_of_a_codebase_is_no_single_task(spark):
    t = positions(spark, *mixed(5, 4000))
    n = t.count()
    dealt = t.select(F.floor((F.col("pos") - 1) / 64).alias("block")).groupBy("block").count()
    assert dealt.agg(F.max("count")).first()[0] <= 64 < 0.1 * n
    told = t.withColumn("block", F.floor((F.col("pos") - 1) / 64)).groupBy("token", "block").count().groupBy("token").count()
    assert told.agg(F.max("count")).first()[0] <= n / 64 + 1  # what is summed for the hot word: a row a block


def levels(spark, edges):
    e = spark.createDataFrame(edges, "src long, dst long")
    return {r["node"]: r["level"] for r in corpus.longest_paths(e).collect()}


def plain_levels(edges):
    """Longest paths by taking nodes away whose sources have all gone."""
    need, users, out = {}, {}, {}
    for a, b in set(edges):
        need[b] = need.get(b, 0) + 1
        users.setdefault(a, []).append(b)
    front = [a for a in users if a not in need]
    for a in front:
        out.setdefault(a, 0)
        for b in users.get(a, ()):
            out[b] = max(out.get(b, 0), out[a] + 1)
            need[b] -= 1
            if not need[b]:
                front.append(b)
    return {n: out[n] for n in front}


def test_levels_of_random_graphs(spark):
    for seed in range(2):
        rng = random.Random(seed)
        n = rng.randint(5, 60)
        edges = [tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(n, 3 * n))]
        if seed % 2:
            edges += [(b, a) for a, b in edges[:2]]  # cycles, and what hangs behind them
        assert levels(spark, edges) == plain_levels(edges)


def test_long_chains_take_few_rounds_and_a_plan_of_one_size(spark, monkeypatch):
    rounds = []
    jump = corpus._jumped
    monkeypatch.setattr(corpus, "_jumped", lambda p, n: rounds.append(n) or jump(p, n))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    sizes = []
    for n in (10, 5000):
        # a chain, a chain of diamonds behind it, and a tree on top
        edges = [(k, k + 1) for k in range(n)] + [x for k in range(5) for x in ((n + 3 * k, n + 3 * k + 1), (n + 3 * k, n + 3 * k + 2), (n + 3 * k + 1, n + 3 * k + 3), (n + 3 * k + 2, n + 3 * k + 3))] + [(7, -k) for k in range(1, 30)]
        rounds.clear()
        e = spark.createDataFrame(edges, "src long, dst long")
        got = corpus.longest_paths(e)
        assert {r["node"]: r["level"] for r in got.collect()} == plain_levels(edges)
        assert len(rounds) <= 10
        sizes.append(len(got._jdf.queryExecution().optimizedPlan().toString()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sizes[0] == sizes[1]


def test_replaced_tables_are_deleted(spark):
    import os

    from codecurves.functions.storage import shared_dir

    top = shared_dir(spark).removeprefix("file:").replace("///", "/").replace("//", "/")
    before = set(os.listdir(top))
    corpus.longest_paths(spark.createDataFrame([(k, k + 1) for k in range(20)], "src long, dst long")).count()
    assert len(set(os.listdir(top)) - before) <= 2  # what the result reads


def test_ranks_by_ranges_are_those_of_one_window(spark):
    from codecurves.functions.ranks import ranked

    rng = random.Random(8)
    rows_ = [("hot" if rng.random() < 0.7 else rng.choice("ab"), rng.choice([None, 1, 2, 3, 9]), k) for k in range(3000)]
    df = spark.createDataFrame(rows_, "g string, x int, k long")
    order = [F.col("x").desc(), F.col("k")]
    for by in (["g"], []):
        want = {}
        for g, x, k in sorted(rows_, key=lambda r: (-(r[1] if r[1] is not None else -1), r[2])):
            key = g if by else None
            want[k] = want.get(("n", key), 0) + 1
            want["n", key] = want[k]
        got = {r["k"]: r["rank"] for r in ranked(df, by, order).collect()}
        assert got == {k: v for k, v in want.items() if not isinstance(k, tuple)}
    assert ranked(df.limit(0), ["g"], order).count() == 0


def test_clearing_leaves_no_table(spark):
    import os

    from codecurves.functions.storage import clear, shared_dir, stored

    top = shared_dir(spark).removeprefix("file:").replace("///", "/").replace("//", "/")
    kept = stored(spark.range(5), "kept")
    assert kept.count() == 5 and any("codecurves-" in f for f in os.listdir(top))
    assert clear(spark) >= 1 and clear(spark) == 0
    assert not [f for f in os.listdir(top) if f.startswith("codecurves-kept")]


@pytest.mark.parametrize("kind", ["word", "char", "line"])
def test_files_dealt_whole_give_the_losses_of_tokens(spark, kind):
    """No token is a row before it is scored, whatever the blocks; a file may be longer than a block, begin or end with an empty line."""
    texts = [("A", 0, "a b a ü\n\nb a c\n"), ("A", 1, None), ("A", 2, "a"), ("A", 3, "\n\na b a b a b a b a ü a b\na"), ("B", 4, "a b"), ("C", 5, "  ")]
    f = spark.createDataFrame([("x", c, k, str(k), t) for c, k, t in texts], "language string, codebase string, file_id long, path string, content string")
    order = f.select("codebase", "file_id", (F.col("file_id") + 1).alias("seq"))
    want = sorted(map(tuple, predictors.score_adaptive(corpus.assign_positions(corpus.tokenize(f, kind), order)).collect()))
    packed = corpus.place_tokens(corpus.pack_tokens(f, kind), order)
    assert packed.count() < len(want)
    assert sorted(map(tuple, predictors.score_adaptive(packed, block=3).collect())) == want
    pairs = lambda t: sorted(map(tuple, predictors.train_ngram(t)[0].collect()))
    assert pairs(packed) == pairs(corpus.assign_positions(corpus.tokenize(f, kind), order))
    plan = predictors.train_ngram(packed)[1]._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # texts are cut once, for the pairs that are stored
