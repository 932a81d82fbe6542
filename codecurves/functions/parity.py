"""Small expressions that every operator shares; each gives the same value in any engine that has md5 and log2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u32(seed: str, key: Column) -> Column:
    """A hash draw: the first eight hex digits of md5(seed:key) as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def bucket(pos: Column) -> Column:
    return F.floor(F.log2(pos.cast("double")) + F.lit(1e-9)).cast("int")


def ubits(bits: Column) -> Column:
    """Bits in millionths, whole: sums of them don't depend on order."""
    return F.round(bits * F.lit(1e6)).cast("long")


def r6(x: Column) -> Column:
    return F.round(x, 6)


def total(x) -> Column:
    return F.sum(x).cast("long")


def words(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\r\n]+", " "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def whole_mean(s: str, n: str) -> Column:
    """s / n of whole millionths, rounded half away from zero to a millionth without any division of doubles, then in ones."""
    return F.expr(f"CAST(sign({s}) * ((2 * abs({s}) + {n}) div (2 * {n})) AS DOUBLE) / 1e6D")


def whole_t(n: str, s: str, q: str) -> Column:
    """Student's t of n whole numbers with sum s and sum of squares q (a decimal), exact up to the last step; null without variance."""
    v = f"(CAST({n} AS DECIMAL(10,0)) * CAST({q} AS DECIMAL(27,0)) - CAST({s} AS DECIMAL(18,0)) * CAST({s} AS DECIMAL(18,0)))"
    return F.expr(f"CASE WHEN {v} > 0 THEN round(CAST({s} AS DOUBLE) * sqrt(CAST({n} - 1 AS DOUBLE)) / sqrt(CAST({v} AS DOUBLE)), 4) END")
