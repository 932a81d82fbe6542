"""What is told of tokens travels with their files: the same figures as by joins of tokens, and no token is dealt once it is scored."""

import random

from pyspark.sql import functions as F
from test_known_answers import files

from codecurves.operators import checks, corpus, predictors, semantics
from codecurves.sources import corpus_io

TEXTS = ["der Hund läuft. der Hund\nschläft nie", "a b a b\n\na b c", "", "ein Wort", "x\ty  z\nx y\n"]


def ordered(spark, *texts):
    f = files(spark, *texts)
    return f, corpus.order_shuffled(f)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_byte_positions_travel_with_files(spark):
    f, order = ordered(spark, *TEXTS)
    for tokenizer in ("word", "char"):
        placed = corpus.place_tokens(corpus.pack_tokens(f, tokenizer), order, bytes=True)
        for block in (3, 1 << 18):
            got = predictors.score_adaptive(placed, block=block, columns=["file_id", "i", "byte_pos"])
            want = predictors.byte_positions(predictors.score_adaptive(placed, block=block), order).select("file_id", "i", "byte_pos", "ubits")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    both = predictors.score_adaptive(placed, columns=["language", "byte_pos", "n_bytes"])
    assert exchanges(predictors.tokenizer_bias(both.withColumn("tokenizer", F.lit("char")))) == 2  # of blocks and of sums


def noisy_of(spark, *texts):
    f, order = ordered(spark, *texts)
    placed = corpus.place_tokens(corpus.pack_tokens(f), order)
    tokens = corpus.unpack_tokens(placed)
    return checks.noisy_texts(placed, percent=30, ahead=2), tokens, *checks.inject_noise(tokens, percent=30, ahead=2)


LONG = [" ".join(f"w{(k * j) % (7 + j)}" for k in range(5 + 9 * j)) for j in range(12)]


def test_noise_of_files_is_that_of_tokens(spark):
    marked, _, noisy, mutations = noisy_of(spark, *TEXTS, *LONG)
    new = corpus.unpack_tokens(marked).select("file_id", "i", "token", "n_bytes", "n_chars", "pos")
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, noisy.select(*new.columns).collect()))
    hits = marked.select("file_id", F.posexplode("marks").alias("i", "mark")).filter("mark % 2 = 1").select("file_id", "i")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, mutations.select("file_id", "i").collect())) and hits.count() > 20


def test_surprise_is_summed_where_tokens_are_scored(spark):
    marked, tokens, noisy, mutations = noisy_of(spark, *TEXTS, *LONG)
    want = checks.surprise_delta(predictors.score_adaptive(tokens), predictors.score_adaptive(noisy), mutations).collect()
    for block in (5, 1 << 18):
        sides = [predictors.score_adaptive(t, block=block, columns=["language", "pos", "mark"]) for t in (marked.withColumn("text", F.col("clean")), marked)]
        assert sorted(checks.surprise_sums(*sides).collect()) == sorted(want)


def test_quality_by_packed_ranges_is_that_of_all_pairs(spark):
    draw = random.Random(5)
    rows = [(2**draw.randint(0, 4), draw.choice([7, 131071, 131072, 10**6, 10**8, draw.randint(0, 10**7)]), draw.random() < 0.2) for _ in range(3000)]
    losses = spark.createDataFrame([(p, u, int(b)) for p, u, b in rows], "pos long, ubits long, mark int")
    want = {}
    for k in range(5):
        good, bad = ([u for p, u, b in rows if p == 2**k and b == w] for w in (False, True))
        want[k] = (len(bad), len(good), round(sum((g < b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad), 6))
    got = {r["bucket"]: (r["n_pos"], r["n_neg"], r["auc"]) for r in checks.anomaly_quality(losses).collect()}
    assert got == want


def test_most_surprising_tokens_are_dealt_by_file(spark):
    marked, _, noisy, mutations = noisy_of(spark, *TEXTS, *LONG)
    losses = predictors.score_adaptive(marked, block=16, columns=["language", "codebase", "file_id", "i", "mark"])
    got = checks.anomaly_top_k_of_files(losses, marked)
    assert got.collect() == checks.anomaly_top_k(predictors.score_adaptive(noisy), mutations).collect()
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_ablations_are_summed_where_tokens_are_scored(spark):
    f, order = ordered(spark, *TEXTS, "a, b. c\na, b. c\n\n  \n.\nx . y", *[t.replace("w3", "w3.\n") for t in LONG])
    want = semantics.ablation_effect(semantics.variant_losses(semantics.ablate(f), order)).collect()
    for block in (6, 1 << 18):
        got = semantics.ablation_sums(predictors.score_adaptive(semantics.ablated_texts(f, order), by=["variant"], block=block, columns=["codebase", "pos", "mark"]))
        assert sorted(got.collect(), key=str) == sorted(want, key=str)
    assert any(r["mean_bits"] for r in want)


def test_lines_are_summed_where_tokens_are_scored(spark):
    f, order = ordered(spark, *TEXTS, *[t.replace("w3 ", "w3\n\n") for t in LONG])
    want = semantics.line_losses(predictors.score_adaptive(corpus.place_tokens(corpus.pack_tokens(f), order)), f)
    placed = corpus.place_tokens(corpus.pack_tokens(f, lines=True), order)
    for block in (6, 1 << 18):
        got = semantics.line_losses(predictors.score_adaptive(placed, block=block, columns=["language", "codebase", "file_id", "n_bytes", "mark"]))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    again = predictors.score_adaptive(placed, columns=["language", "codebase", "file_id", "n_bytes", "mark"])
    assert exchanges(semantics.line_losses(again)) == 2  # of blocks and of sums


def test_windows_are_cut_out_of_files(spark):
    f, order = ordered(spark, *TEXTS, *LONG)
    for tokenizer in ("word", "char"):
        placed = corpus.place_tokens(corpus.pack_tokens(f, tokenizer), order)
        w = corpus.context_windows(corpus.unpack_tokens(placed), 16, 16).groupBy("language", "codebase", "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("tokens"))
        got = corpus.packed_windows(placed, 16)
        assert sorted(got.collect()) == sorted(w.collect()) and w.count() > 5
        assert "token#" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_frozen_losses_of_files_are_those_of_pairs(spark):
    both = [files(spark, *t, language=lang, codebase=c) for lang, c, t in (("x", "c", LONG[:7]), ("y", "d", [*LONG[5:], "", "einmal"]), ("z", "e", ["nie gelernt w1"]))]
    f = both[0].unionByName(both[1]).unionByName(both[2])
    placed = corpus.place_tokens(corpus.pack_tokens(f), corpus.order_shuffled(f))
    test, train = placed.filter("file_id % 3 = 0"), placed.filter("file_id % 3 > 0").withColumn("rung", F.explode(F.array(F.lit(1), F.lit(2)))).filter("rung = 2 or file_id % 2 = 0")
    for by, learnt in ((["language"], train.filter("rung = 2").drop("rung")), (["rung", "language"], train), (["rung", "train_lang"], train.withColumnRenamed("language", "train_lang"))):
        want = predictors.frozen_pairs(test, predictors.train_ngram(learnt, by), by, {"bucket": predictors.bucket(F.col("pos"))})
        cols = [*dict.fromkeys([*by, "language"]), "bucket", "n_bytes", "ubits"]
        sums = lambda d: sorted(map(tuple, d.groupBy(*cols).agg(F.sum("n")).collect()))
        for block in (20, 1 << 18):
            got = predictors.frozen_blocks(test, learnt, by, buckets=True, block=block)
            assert sums(got) == sums(want) and len(sums(want)) > 20
    assert "ctx" not in got._jdf.queryExecution().optimizedPlan().toString()  # no pair is dealt as a row


def test_ingested_sums_are_those_of_tokens(spark):
    f, order = ordered(spark, *TEXTS, *LONG[:4])
    f = f.withColumn("language", F.when(F.col("file_id") != 6, F.col("language")))
    placed = corpus.place_tokens(corpus.pack_tokens(f), order)
    rows = [("c", k, i, -1.5 * i) for k in range(9) for i in range(6)] + [("c", 1, 0, -9.0), ("c", 7, 1, None), ("d", 0, 0, -1.0), ("c", 99, 0, -1.0), ("c", 99, 0, -1.0), ("c", 6, 500, -2.0), (None, 0, 0, -1.0)]
    dump = spark.createDataFrame(rows, "codebase string, file_id long, i int, logprob double")
    losses, coverage = corpus_io.ingest_losses(corpus.unpack_tokens(placed), dump, "2")
    want = coverage.join(losses.groupBy("language").agg(F.sum("ubits").alias("ubits")), "language", "left").fillna(0, ["ubits"])
    got = corpus_io.ingest_sums(placed, dump, "2")
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
