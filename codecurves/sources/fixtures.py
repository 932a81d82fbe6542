"""Adapters from the test tables to the library's tables. They are stand-ins: invented prose in the role of code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parity import u32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    codebase = F.concat_ws("/", "lang", "source")
    return d.select(F.col("lang").alias("language"), codebase.alias("codebase"), F.col("doc_id").alias("file_id"), F.concat_ws("/", codebase, F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task = document; passed = quality 1; context limit = power-of-two rung of its length; condition by hash draw."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rung = F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(1)).cast("double")) + F.lit(1e-9))).cast("int")
    condition = F.when(u32("c0", F.col("doc_id")) % 2 == 0, "full").otherwise("signature")
    return d.select(F.col("lang").alias("language"), F.concat_ws("/", "lang", "source").alias("codebase"), F.col("doc_id").alias("task_id"), F.lit(0).alias("sample"), condition.alias("condition"), rung.alias("context_limit"), (F.col("quality") == 1).alias("passed"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task = user, an attempt per event in order of time, success = a purchase."""
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("task_id"), n.alias("attempt"), (F.col("event_type") == "purchase").alias("success"))


def repairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(repair_id, file_id) from line items, and (file_id, module) from parts."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return items.select(F.col("l_orderkey").alias("repair_id"), F.col("l_partkey").alias("file_id")), parts.select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("module"))


#: What stands for a line of code: by language, a definition, a use and three statements. Fixed values, for tests only.
CODE = {
    "python": ("def {}(n):", "from lib import {}", "    y = {} + 1000", "    if n < {}:", "    except {}:"),
    "javascript": ("export function {}(n) {", "import { {} }", "    y = {} + 1000;", "    if (n < {})", "    let y = {};"),
    "coq": ("Lemma {} : t.", "apply {}.", "Definition n := {} + 1000.", "exact {}.", "Qed {}."),
}
ROLES = {"en": "python", "de": "javascript", "es": "coq", "fr": "python"}


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written out as code: each line that has a word of three letters or more becomes a definition, a use or a statement about
    that word, by hash draw, in the language that its own stands for."""
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    d = d.withColumn("w", F.lower(F.regexp_extract("line", "([A-Za-z]{3,})", 1))).filter("w <> ''")
    kind = u32("code", F.concat_ws(":", "doc_id", "i")) % 5
    as_code = F.coalesce(*[F.when((F.col("language") == k) & (kind == n), F.replace(F.lit(x), F.lit("{}"), F.col("w"))) for k, v in CODE.items() for n, x in enumerate(v)])
    role = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in ROLES.items()])
    d = d.withColumn("language", role).filter("language is not null").withColumn("line", as_code)
    g = d.groupBy("language", "source", F.col("doc_id").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))
    codebase = F.concat_ws("/", "language", "source")
    return g.select("language", codebase.alias("codebase"), "file_id", F.concat_ws("/", codebase, F.col("file_id").cast("string")).alias("path"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


#: Invented values, for tests only.
TRAITS = [("de", "static", "strong"), ("en", "dynamic", "weak"), ("es", "dynamic", "strong"), ("fr", "static", "weak")]
PRICES = [("de", 3.0), ("en", 1.0), ("es", 2.0), ("fr", 2.5)]


def traits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRAITS, "language string, typing string, strength string")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "language string, price double")
