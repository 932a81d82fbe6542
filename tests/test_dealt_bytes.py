"""What operators store and deal for each byte of text."""

import os
import random

from test_known_answers import files

from codecurves.functions import storage
from codecurves.operators import corpus, predictors, semantics
from codecurves.plans import queries
from codecurves.sources import corpus_io

SMALL = "/root/testdata/sf0.001"


def test_near_duplicates_store_no_shingles(spark):
    draw = random.Random(1)
    texts = [" ".join(f"{draw.getrandbits(40):x}" for _ in range(400)) for _ in range(60)]
    size = sum(map(len, texts))
    storage.clear(spark)
    assert corpus.near_duplicate_pairs(files(spark, *texts)).count() == 0
    held = sum(os.path.getsize(os.path.join(d, f)) for p in storage._held for d, _, names in os.walk(p.removeprefix("file:").replace("//", "/")) for f in names if f.endswith(".parquet"))
    storage.clear(spark)
    assert 0 < held < 2 * size


def test_predictable_runs_score_once(spark):
    losses = spark.createDataFrame([("x", 1, i, 2, b) for i, b in enumerate([1, 1, 1, 1, 9_000_000, 1, 1, 1, 1, 1])], "language string, file_id long, i int, n_bytes int, ubits long")
    got = semantics.predictable_runs(losses)
    assert [tuple(r)[:4] for r in got.collect()] == [("x", 2, 5, 18)]
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()  # reads what was stored, not the losses twice


def test_repeated_lines_go_without_a_shuffle(spark):
    after = queries._after(queries.Inputs(spark, SMALL))
    assert "Exchange" not in after._jdf.queryExecution().executedPlan().toString()


def test_adaptive_losses_give_no_more_than_asked(spark):
    x = queries.Inputs(spark, SMALL)
    every, some = (predictors.score_adaptive(x.packed(), columns=c) for c in (None, ["language", "pos"]))
    assert some.columns == ["language", "pos", "ubits"]
    at = lambda d: sorted(map(tuple, d.select("language", "pos", "ubits").collect()))
    assert at(some) == at(every)
    given = next(line for line in x.curve.inputFiles())  # a curve is stored, so that fits that read it twice score once
    assert "/codecurves-curve-" in given


def test_ingested_losses_read_the_dump_once(spark):
    dump = spark.createDataFrame([("c", 1, 0, -1.0), ("c", 1, 0, -2.0), ("c", 9, 0, -1.0)], "codebase string, file_id long, i int, logprob double")
    tokens = spark.createDataFrame([("x", "c", 1, 0, 1, 2, 2), ("x", "c", 1, 1, 2, 3, 3)], "language string, codebase string, file_id long, i int, pos long, n_bytes int, n_chars int")
    losses, coverage = corpus_io.ingest_losses(tokens, dump, "2")
    assert [(r["i"], r["ubits"]) for r in losses.collect()] == [(0, 2_000_000)]
    assert sorted(map(tuple, coverage.collect()), key=str) == sorted([("x", 2, 1, 1, 0, 1), (None, 0, 0, 0, 1, 0)], key=str)
    assert all("ExistingRDD" not in d._jdf.queryExecution().executedPlan().toString() for d in (losses, coverage))
