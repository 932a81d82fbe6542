"""Power laws: fits by language and codebase, an offset, intervals, holdouts and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parity import bucket, r6, total, u32
from ..functions.storage import stored
from .curves import by_codebase

LN2 = 0.6931471805599453


def _fit(points: DataFrame, by: list[str], y="ln_y") -> DataFrame:
    return points.groupBy(*by).agg(F.regr_intercept(y, "x").alias("c"), F.regr_slope(y, "x").alias("d"), F.regr_r2(y, "x").alias("r2"), F.count("*").cast("int").alias("n_points")).filter("n_points >= 2")


def points(curve: DataFrame, k_min: int) -> DataFrame:
    return curve.filter(F.col("bucket") >= k_min).withColumn("x", F.lit(LN2) * F.col("bucket")).withColumn("ln_y", F.ln("bpb"))


def fit_power_law(curve: DataFrame, k_min: int = 5, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """bpb = a n^-b by least squares of ln bpb on ln n; with a weight column, by weighted sums."""
    by = by or ["language"]
    p = points(curve, k_min)
    if weight:
        w = F.col(weight).cast("double")
        s = p.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("ln_y")).alias("wy"), F.sum(w * F.col("x") * F.col("x")).alias("wxx"), F.sum(w * F.col("x") * F.col("ln_y")).alias("wxy"), F.count("*").cast("int").alias("n_points")).filter("n_points >= 2")
        d = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / (F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"))
        return s.withColumn("d", d).select(*by, r6(F.exp((F.col("wy") - F.col("d") * F.col("wx")) / F.col("w"))).alias("a"), r6(-F.col("d")).alias("b"), "n_points")
    return _fit(p, by).select(*by, r6(F.exp("c")).alias("a"), r6(-F.col("d")).alias("b"), r6("r2").alias("r2"), "n_points")


def fit_power_law_offset(curve: DataFrame, grid: int = 20, k_min: int = 5) -> DataFrame:
    """bpb = E + a n^-b: for each E of a grid the fit is closed; the one of least squared error in bpb is kept. at_boundary: E is at an
    end of the grid, so it isn't identified."""
    p = points(curve, k_min)
    low = p.groupBy("language").agg(F.min("bpb").alias("low"))
    g = p.join(F.broadcast(low), "language").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))  # one row a language
    g = g.withColumn("e", F.lit(0.95) * F.col("low") * F.col("g") / F.lit(float(grid - 1))).withColumn("ln_y", F.ln(F.col("bpb") - F.col("e")))
    f = _fit(g, ["language", "g", "e"])
    err = g.join(f, ["language", "g", "e"]).withColumn("err", F.col("bpb") - F.col("e") - F.exp(F.col("c") + F.col("d") * F.col("x")))
    sse = err.groupBy("language", "g", "e", "c", "d", "n_points").agg(F.round(F.sum(F.col("err") * F.col("err")), 9).alias("sse"))
    best = sse.withColumn("k", F.row_number().over(Window.partitionBy("language").orderBy("sse", "g"))).filter("k = 1")
    return best.select("language", r6(F.exp("c")).alias("a"), r6(-F.col("d")).alias("b"), r6("e").alias("e"), "n_points", F.col("g").isin(0, grid - 1).alias("at_boundary"))


def codebase_exponents(losses: DataFrame, k_min: int = 5, least: int = 3) -> DataFrame:
    s = stored(by_codebase(losses), "sums").withColumn("bpb", F.col("ubits") / F.lit(1e6) / F.col("n_bytes"))  # read twice
    f = fit_power_law(s, k_min, ["language", "codebase"]).filter(F.col("n_points") >= least)
    return f.join(s.groupBy("codebase").agg(total("n").alias("n_tokens")), "codebase")


def fit_codebase_exponents(losses: DataFrame, k_min: int = 5) -> DataFrame:
    """One fit a codebase, then mean, spread and quartiles of the exponent by language."""
    q = lambda p: r6(F.percentile("b", F.lit(p)))
    return codebase_exponents(losses, k_min).groupBy("language").agg(F.count("*").alias("n_codebases"), r6(F.avg("b")).alias("mean_b"), r6(F.stddev_samp("b")).alias("sd_b"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"))


#: Cumulative Poisson(1), as thresholds of a 32-bit draw.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]


def bootstrap_exponents(losses: DataFrame, reps: int = 20, seed: str = "boot", k_min: int = 5) -> DataFrame:
    """Interval of the exponent: each codebase's bucket sums are drawn with a Poisson(1) weight from a hash of replicate and codebase."""
    s = by_codebase(losses).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    draw = u32(seed, F.concat_ws("/", F.col("rep").cast("string"), "codebase")).cast("double") / F.lit(4294967296.0)
    weight = sum((F.when(draw >= F.lit(t), 1).otherwise(0) for t in POISSON[1:]), F.when(draw >= F.lit(POISSON[0]), 1).otherwise(0))
    s = s.withColumn("w", weight).filter("w > 0").groupBy("rep", "language", "bucket").agg(total(F.col("ubits") * F.col("w")).alias("ubits"), total(F.col("n_bytes") * F.col("w")).alias("n_bytes"))
    f = fit_power_law(s.withColumn("bpb", F.col("ubits") / F.lit(1e6) / F.col("n_bytes")), k_min, ["rep", "language"])
    q = lambda p: r6(F.percentile("b", F.lit(p)))
    return f.groupBy("language").agg(F.count("*").alias("n_reps"), q(0.05).alias("lo"), q(0.5).alias("mid"), q(0.95).alias("hi"))


def forecast_holdout(curve: DataFrame, k_split: int, k_min: int = 5) -> DataFrame:
    """Fit on buckets up to k_split, predict those beyond: mean absolute error."""
    f = fit_power_law(curve.filter(F.col("bucket") <= k_split), k_min)
    late = curve.filter(F.col("bucket") > k_split).join(f, "language")
    guess = F.col("a") * F.pow(F.lit(2.0), -F.col("b") * F.col("bucket"))
    return late.groupBy("language").agg(F.count("*").alias("n_held_out"), r6(F.avg(F.abs(guess - F.col("bpb")))).alias("mean_abs_error"))


def compare_languages(fits: DataFrame, curve: DataFrame, traits: DataFrame) -> DataFrame:
    """Ranks by exponent, constant and loss at the largest bucket that all languages reach; mean exponent of each strength of typing."""
    common = curve.groupBy("language").agg(F.max("bucket").alias("m")).agg(F.min("m").alias("bucket"))
    at = curve.join(F.broadcast(common), "bucket").select("language", F.col("bpb").alias("common_bpb"))  # one row
    all_ = fits.join(at, "language").join(F.broadcast(traits), "language")  # one row a language
    rank = lambda c, down=False: F.dense_rank().over(Window.orderBy(F.col(c).desc() if down else F.col(c)))
    return all_.select("language", "strength", rank("b", True).alias("rank_b"), rank("a").alias("rank_a"), rank("common_bpb").alias("rank_bpb"), r6(F.avg("b").over(Window.partitionBy("strength"))).alias("strength_mean_b"))


def file_exponents(losses: DataFrame, k_min: int = 2, least: int = 3) -> DataFrame:
    """language, file_id, b, n_points: the exponent of each file, over positions in the file."""
    s = losses.withColumn("bucket", bucket(F.col("i") + 1)).groupBy("language", "file_id", "bucket").agg(total("ubits").alias("ubits"), total("n_bytes").alias("n_bytes"))
    s = s.withColumn("bpb", r6(F.col("ubits") / F.lit(1e6) / F.col("n_bytes")))
    return fit_power_law(s, k_min, ["language", "file_id"]).filter(F.col("n_points") >= least).select("language", "file_id", "b", "n_points")


def exponent_change(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Exponents of the same corpora before and after a change: by, b_before, b_after, change. before, after: curves with bucket and bpb."""
    f = lambda d, n: fit_power_law(d, by=by).select(*by, F.col("b").alias(n))
    return f(before, "b_before").join(f(after, "b_after"), by).withColumn("change", r6(F.col("b_after") - F.col("b_before")))
