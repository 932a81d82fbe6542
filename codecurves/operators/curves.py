"""Position averaging: loss by place in the context, balanced panels, factors, gains and prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parity import bucket, r6, total
from ..functions.storage import stored


def _sums() -> list:
    return [F.count("*").alias("n"), total("ubits").alias("ubits"), total("n_bytes").alias("n_bytes")]


def bpb():
    return r6(F.col("ubits") / F.lit(1e6) / F.col("n_bytes"))


def loss_by_position(losses: DataFrame, by: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Average by power-of-two position bucket (exact: by position): n, bits, bytes, bits per byte, standard error of bits per token."""
    at = F.col("pos") if exact else bucket(F.col("pos"))
    keyed = losses.withColumn("bucket", at)
    out = keyed.groupBy(*(by or ["language"]), "bucket").agg(*_sums(), F.stddev_samp(F.col("ubits") / F.lit(1e6)).alias("sd"))
    return out.select(*(by or ["language"]), "bucket", "n", "ubits", "n_bytes", bpb().alias("bpb"), r6(F.col("sd") / F.sqrt("n")).alias("stderr"))


def by_codebase(losses: DataFrame) -> DataFrame:
    return losses.withColumn("bucket", bucket(F.col("pos"))).groupBy("language", "codebase", "bucket").agg(*_sums())


def loss_by_position_balanced(losses: DataFrame, max_bucket: int) -> DataFrame:
    """Each codebase counts once, and only codebases that fill every bucket up to max_bucket, so that the curve's right end isn't made of
    other codebases than its left."""
    sums = stored(by_codebase(losses), "sums").filter(F.col("bucket") <= max_bucket)  # read twice
    full = sums.groupBy("codebase").agg(F.count("*").alias("k")).filter(F.col("k") == max_bucket + 1)
    panel = sums.join(full, "codebase", "left_semi")
    return panel.groupBy("language", "bucket").agg(F.count("*").alias("n_codebases"), r6(F.avg(F.col("ubits") / F.lit(1e6) / F.col("n_bytes"))).alias("bpb"))


def curve_by_factors(losses: DataFrame, factors: list[str]) -> DataFrame:
    """Curves by each factor alone and overall, in one pass."""
    keyed = losses.withColumn("bucket", bucket(F.col("pos")))
    sets = [[F.col(f), F.col("bucket")] for f in factors] + [[F.col("bucket")]]
    out = keyed.groupingSets(sets, *[F.col(f) for f in factors], F.col("bucket")).agg(F.grouping_id().cast("int").alias("level"), *_sums())
    return out.select(*factors, "bucket", "level", "n", "ubits", bpb().alias("bpb"))


def context_gain(curve: DataFrame, k_min: int = 5) -> DataFrame:
    """By language: how often and how far loss falls from bucket to bucket, and whether it keeps falling."""
    w = Window.partitionBy("language").orderBy("bucket")
    step = curve.filter(F.col("bucket") >= k_min).withColumn("gain", F.lag("bpb").over(w) - F.col("bpb")).filter("gain is not null")
    return step.groupBy("language").agg(F.count("*").alias("n_steps"), F.count_if(F.col("gain") > 0).alias("n_falling"), F.bool_and(F.col("gain") > 0).alias("always_falling"), r6(F.sum("gain")).alias("total_gain"))


def prefix_loss(losses: DataFrame) -> DataFrame:
    """Total loss and bits per byte of everything up to the end of each bucket."""
    s = losses.withColumn("bucket", bucket(F.col("pos"))).groupBy("language", "bucket").agg(*_sums())
    w = Window.partitionBy("language").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = s.select("language", "bucket", F.sum("ubits").over(w).cast("long").alias("ubits"), F.sum("n_bytes").over(w).cast("long").alias("n_bytes"))
    return run.withColumn("bpb", bpb())
