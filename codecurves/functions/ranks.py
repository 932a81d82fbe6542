"""Ranks over a whole table, or over groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row in its group, from 1 on. order must tell rows of a group apart, so that places are the same each time.

    Rows are dealt by ranges of (by, order) and keep the number of their range; a group's ranges follow each other, so a row's place is
    its place in its range and the size of the ranges before. What is summed in one task is one row a range."""
    cut = stored(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    size = cut.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    before = size.select(*by, "__range", (F.sum("__n").over(Window.partitionBy(*by).orderBy("__range")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    return cut.withColumn("__within", within).join(before, [*by, "__range"]).select(*df.columns, (F.col("__before") + F.col("__within")).cast("int").alias(name))
