"""Quality rules by importance: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

DataFrame operations only: words, hashes, counts and sums all stay in the JVM.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that word 1-grams and 2-grams are hashed to. The two multinomials are this long, whatever the corpus.
BUCKETS = 16_384
#: Most trusted rows that the target multinomial is fitted on (those of the smallest hash); the raw multinomial takes all rows.
MAX_TRUSTED = 20_000
#: Added to every bucket's count.
SMOOTH = 1.0
#: A text is kept from this length-normalised ratio (nats per n-gram) upwards. Chosen on four folds of the labels; the fifth was held out.
THRESHOLD = -0.05
UNIT = 1e6


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ ; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of all 1-grams and 2-grams, from the words' hashes."""
    pairs = F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")), pairs)


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED, smooth: float = SMOOTH) -> list[int]:
    """log p(bucket | trusted) - log p(bucket | raw), in millionths. trusted: doc_ids. Two numbers a bucket come to the driver."""
    ids = trusted.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    hashed = docs.select("doc_id", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    marked = hashed.join(F.broadcast(ids.withColumn("is_trusted", F.lit(1))), "doc_id", "left")
    counts = marked.select("is_trusted", F.explode(ngram_buckets(F.col("h"), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("is_trusted").alias("target"))
    raw, target = np.full(buckets, smooth), np.full(buckets, smooth)
    for r in counts.collect():  # at most `buckets` rows
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return [int(x) for x in np.round(ratio * UNIT)]


def _n_repeat_words(h: Column, n: int) -> Column:
    """Words inside n-word windows that occur more than once in the text, the first included."""
    windows = F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))
    pairs = lambda w: F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    same = lambda s, i, k: F.coalesce(F.get(s, i + k)["x"] == F.get(s, i)["x"], F.lit(False))
    return windows, pairs, same


def base_columns(docs: DataFrame, window: int = 5) -> DataFrame:
    """doc_id, h (word hashes), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("t")).withColumn("w", words_of(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    read = read.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    windows, pairs, same = _n_repeat_words(F.col("h"), window)
    read = read.withColumn("g", windows)
    # A window's hash is looked for by sorting (n log n); texts without a repeated window are told by their distinct count alone.
    read = read.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), pairs(F.col("g"))).otherwise(F.expr("array()")))
    again = F.filter(F.transform("s", lambda x, i: F.when(same(F.col("s"), i, 1) | ((i > 0) & same(F.col("s"), F.greatest(i, F.lit(1)), -1)), x["i"])), lambda x: x.isNotNull())
    read = read.withColumn("p", F.array_sort(again))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(window), F.coalesce(F.get(F.col("p"), i + 1) - x, F.lit(window)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return read.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "h")


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Judge every document. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio (nats per n-gram,
    length-normalised; null without words), base_failed, kept.

    Null or empty texts have no words and fail the base rules. Repeated rows are judged each for themselves. Without trusted rows the
    target is uniform. Other columns are ignored; an empty table gives no rows. The ratios reach the executors as one array of `buckets`
    numbers, and every document's sum is a sum of whole numbers, so the verdict doesn't depend on order or partitions."""
    ratio = fit_ratio(docs, trusted, buckets, max_trusted)
    table = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<bigint>")
    read = base_columns(docs).withColumn("b", ngram_buckets(F.col("h"), buckets))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + F.get(table, x))
    read = read.withColumn("ratio", F.when(F.size("b") > 0, total / F.lit(UNIT) / F.size("b")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    read = read.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("ratio") >= F.lit(float(threshold)), F.lit(False)))
    return read.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "base_failed", kept.alias("kept"))


def reference_ratio(target: dict[int, int], raw: dict[int, int], buckets: int, smooth: float = SMOOTH) -> list[float]:
    """The same ratio for tests, from plain counts."""
    t, r = sum(target.values()) + smooth * buckets, sum(raw.values()) + smooth * buckets
    return [math.log((target.get(b, 0) + smooth) / t) - math.log((raw.get(b, 0) + smooth) / r) for b in range(buckets)]
