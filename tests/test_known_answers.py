"""Small inputs with answers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from codecurves.operators import checks, context, corpus, curves, fits, forecast, predictors, semantics
from codecurves.schema import FILES
from codecurves.sources import corpus_io


def files(spark, *texts, language="x", codebase="c"):
    return spark.createDataFrame([(language, codebase, i, f"{codebase}/{i}", t) for i, t in enumerate(texts)], FILES)


def tokens(spark, *texts):
    f = files(spark, *texts)
    return corpus.assign_positions(corpus.tokenize(f), f.select("codebase", "file_id", (F.col("file_id") + 1).alias("seq")))


def test_adaptive_bits_of_abab(spark):
    got = [r["ubits"] / 1e6 for r in predictors.score_adaptive(tokens(spark, "a b a b")).orderBy("pos").collect()]
    base = 2.0**-18  # one byte and the blank behind it, nine bits each
    p0 = lambda n, cw: (cw + base) / (n + 1)
    want = [p0(0, 0), (0 + p0(1, 0)) / (0 + 1), (0 + p0(2, 1)) / (0 + 1), (1 + p0(3, 1)) / (1 + 1)]
    assert got == pytest.approx([-math.log2(p) for p in want], abs=2e-6)


def test_limited_context_as_long_as_the_text_is_no_limit(spark):
    t = tokens(spark, "a b c a b", "c c a b a")
    full = {r["pos"]: r["ubits"] for r in predictors.score_adaptive(t).collect()}
    assert {r["pos"]: r["ubits"] for r in predictors.score_limited_context(t, [100]).collect()} == full


def test_window_of_memory_bounds_positions(spark):
    t = tokens(spark, "a a a a a a a a")
    got = [r["ubits"] for r in predictors.score_adaptive(t, window=4).orderBy("pos").collect()]
    assert got[:4] == got[4:]


def test_positions_and_offsets_are_contiguous(spark):
    t = tokens(spark, "a b", "", "c d e")
    assert sorted(r["pos"] for r in t.collect()) == [1, 2, 3, 4, 5]
    f = files(spark, "a b", "", "c")
    p = corpus.pack_corpus(f, f.select("codebase", "file_id", (F.col("file_id") + 1).alias("seq"))).orderBy("seq").collect()
    assert p[0]["byte_start"] == 0 and all(a["byte_end"] == b["byte_start"] for a, b in zip(p, p[1:]))


@pytest.mark.parametrize("edges,levels,cycle", [
    ([(0, 1), (1, 2)], {0: 0, 1: 1, 2: 2}, set()),
    ([(0, 1), (0, 2), (1, 3), (2, 3)], {0: 0, 1: 1, 2: 1, 3: 2}, set()),
])
def test_dependency_levels(spark, edges, levels, cycle):
    f = files(spark, *["t"] * (max(max(e) for e in edges) + 1))
    e = spark.createDataFrame([("c", a, b, "s") for a, b in edges], "codebase string, src long, dst long, symbol string")
    got = corpus.order_dependency(f, e).collect()
    assert {r["file_id"]: r["level"] for r in got} == levels and not any(r["in_cycle"] for r in got)
    seq = {r["file_id"]: r["seq"] for r in got}
    assert all(seq[a] < seq[b] for a, b in edges)


def ordered(spark, n, edges):
    e = spark.createDataFrame([("c", a, b, "s") for a, b in edges], "codebase string, src long, dst long, symbol string")
    return {r["file_id"]: (r["level"], r["in_cycle"]) for r in corpus.order_dependency(files(spark, *["t"] * n), e).collect()}


def test_cycles_are_told_from_what_hangs_on_them(spark):
    # 0 before a cycle 1-2-3, 4 and 5 behind it, 6 between it and the cycle 7-8, 9 alone
    got = ordered(spark, 10, [(0, 1), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (2, 6), (6, 7), (7, 8), (8, 7)])
    assert {k for k, v in got.items() if v[1]} == {1, 2, 3, 7, 8}
    assert got[0] == got[9] == (0, False) and got[1][0] == got[7][0] == 1 and got[4] == (2, False) and got[5] == (3, False) and got[6] == (2, False)


def test_long_chains_have_levels_to_the_end(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = ordered(spark, 61, [(k, k + 1) for k in range(60)])
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {k: (k, False) for k in range(61)}


def curve(spark, law):
    return spark.createDataFrame([("x", k, 1, float(law(2.0**k))) for k in range(5, 16)], "language string, bucket int, n long, bpb double")


def test_fit_returns_its_law(spark):
    r = fits.fit_power_law(curve(spark, lambda n: 7 * n**-0.2)).first()
    assert (r["a"], r["b"]) == pytest.approx((7, 0.2), abs=1e-5)
    w = fits.fit_power_law(curve(spark, lambda n: 7 * n**-0.2), weight="n").first()
    assert (w["a"], w["b"]) == pytest.approx((7, 0.2), abs=1e-5)


def test_offset_is_found_near_a_grid_point(spark):
    r = fits.fit_power_law_offset(curve(spark, lambda n: 2 + 70 * n**-0.5), grid=200).first()
    assert r["e"] == pytest.approx(2, abs=0.02) and not r["at_boundary"]


def test_crossovers(spark):
    f = spark.createDataFrame([("p", 10.0, 0.2), ("q", 5.0, 0.1), ("r", 20.0, 0.2)], "language string, a double, b double")
    got = {(r["lang_a"], r["lang_b"]): (r["log10_n_star"], r["verdict"]) for r in forecast.crossovers(f).collect()}
    assert got["p", "q"] == (pytest.approx(math.log10(1024), abs=1e-5), "in_range")
    assert got["p", "r"] == (None, "never")
    o = spark.createDataFrame([("p", 10.0, 0.2, 0.0), ("q", 5.0, 0.1, 0.0)], "language string, a double, b double, e double")
    assert forecast.crossovers_offset(o).first()["log10_n_star"] == pytest.approx(math.log10(1024), abs=0.06)


def test_noise_surprises_a_learnt_template(spark):
    text = " ".join(f"open file{i % 3} read close" for i in range(200))
    t = tokens(spark, text)
    noisy, m = checks.inject_noise(t, percent=5, ahead=2)
    q = checks.anomaly_quality(predictors.score_adaptive(noisy), m).filter("bucket >= 6").collect()
    assert q and all(r["auc"] > 0.75 for r in q)


def test_repeats_are_told_from_learning(spark):
    f = files(spark, "\n".join(["x y z w"] * 40))
    order = f.select("codebase", "file_id", F.lit(1).alias("seq"))
    t = corpus.assign_positions(corpus.tokenize(f), order)
    assert semantics.repeat_learning(predictors.score_adaptive(t), f, order).first()["mean_slope"] < 0


def test_domain_adjustment_turns_a_sign(spark):
    rows = [("p", "easy", 1.0)] * 9 + [("p", "hard", 5.0)] + [("q", "easy", 0.8)] + [("q", "hard", 4.8)] * 9
    got = {r["language"]: r for r in context.adjust_for_domain(spark.createDataFrame(rows, "language string, topic string, y double")).collect()}
    assert got["p"]["naive"] < 0 < got["p"]["adjusted"] and got["p"]["sign_changes"]


def test_code_rules(spark):
    f = spark.createDataFrame([("python", "c", 0, "a.py", "def used(x):\n    return x + 1"), ("python", "c", 1, "b.py", "from a import used\nprint(used(2))")], FILES)
    assert [(r["src"], r["dst"], r["symbol"]) for r in corpus.code_edges(f).collect()] == [(0, 1, "used")]
    assert [r["signature"] for r in checks.extract_signatures(f, checks.SIGNATURES).collect()] == ["def used(x):"]
    m = checks.mutate_code(f, rate=1.0).collect()
    assert [(r["rule"], r["mutated"]) for r in m] == [("sign flipped", "    return x - 1")]


def test_formats_round_trip(spark, tmp_path):
    (tmp_path / "src/one").mkdir(parents=True)
    (tmp_path / "src/one/a.py").write_text("x = 1\n")
    (tmp_path / "src/one/b.rs").write_text("fn main() {}\n")
    for fmt in ("text", "binary"):
        got = {(r["language"], r["codebase"], r["path"], r["content"]) for r in corpus_io.read_corpus(spark, str(tmp_path / "src"), fmt).collect()}
        assert got == {("python", "one", "one/a.py", "x = 1\n"), ("rust", "one", "one/b.rs", "fn main() {}\n")}
    f = files(spark, "a b", "c")
    f.write.json(str(tmp_path / "j"))
    assert sorted(corpus_io.read_corpus(spark, str(tmp_path / "j"), "json").collect()) == sorted(f.collect())
    packed = corpus.pack_corpus(f, f.select("codebase", "file_id", (F.col("file_id") + 1).alias("seq")))
    corpus_io.write_packed(packed, str(tmp_path / "p"))
    raw = "".join(p.read_text() for p in sorted((tmp_path / "p/language=x").glob("part*")))
    assert raw == "=== c/0 x 3\na b\n\n=== c/1 x 1\nc\n\n"


def test_shuffle_partitions_change_nothing(spark):
    t = tokens(spark, "a b a c", "b b a")
    old, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "8", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(tuple, curves.loss_by_position(predictors.score_adaptive(t)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1] == out[2]


def test_pass_at_k(spark):
    a = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, False)], "task_id long, attempt int, success boolean")
    got = {r["k"]: r["pass_at_k"] for r in forecast.best_of_k(a, [1, 2]).collect()}
    assert got == {1: 0.25, 2: 0.5}
