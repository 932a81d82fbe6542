"""Sources and sinks: corpora in four formats, packed text, curves and loss dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parity import total
from ..functions.storage import stored
from ..schema import FILES

#: File extension to language, for corpora of plain files. A caller's map may replace it.
EXTENSIONS = {"py": "python", "js": "javascript", "hs": "haskell", "rs": "rust", "v": "coq", "c": "c"}


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet", ext_map: dict[str, str] | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """files(language, codebase, file_id, path, content). parquet and json hold those columns (or expressions for them in `columns`);
    text and binary are folders of files, whose language is their extension's and whose codebase is the first folder under path."""
    if fmt in ("parquet", "json"):
        read = spark.read.parquet(path) if fmt == "parquet" else spark.read.schema(FILES).json(path)
        return read.select(*[F.expr((columns or {}).get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in FILES])
    if fmt == "text":
        read = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("content"))
    elif fmt == "binary":
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("p"), F.decode("content", "utf-8").alias("content"))
    else:
        raise ValueError(f"no format {fmt}")
    kinds = ext_map or EXTENSIONS
    known = spark.createDataFrame(sorted(kinds.items()), "ext string, language string")
    root = path.removeprefix("file:").rstrip("/")
    rel = F.element_at(F.split("p", F.lit(root.lstrip("/") + "/"), 2), -1)
    read = read.withColumn("path", rel).withColumn("ext", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return read.join(F.broadcast(known), "ext").select("language", F.element_at(F.split("path", "/"), 1).alias("codebase"), F.xxhash64("path").alias("file_id"), "path", "content")


def write_packed(packed: DataFrame, path: str) -> None:
    """One text per language, parts in order: header and body of each file."""
    packed.repartitionByRange("language", "codebase", "seq").sortWithinPartitions("language", "codebase", "seq").select("language", F.concat("header", "body").alias("value")).write.partitionBy("language").option("lineSep", "\n").text(path)


def write_curves(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Losses and curves as Parquet by scorer and language; small tables as CSV."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scorer", "language").parquet(path)


def read_curves(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


#: What a log-probability is divided by to be bits, by the base of the logarithm.
PER_BIT = {"e": 0.6931471805599453, "2": 1.0, "10": 0.30102999566398120}


def ingest_sums(sizes: DataFrame, dump: DataFrame, log_base: str = "e") -> DataFrame:
    """The coverage that `ingest_losses` counts, with the bits of matched tokens, by language. sizes: language, codebase, file_id, n (tokens of each
    file). A dump's row is dealt once, by file, where equal rows meet and the file's size tells whether it has that token; no token is a row."""
    own = ["codebase", "file_id"]
    sizes = sizes.select("language", *own, "n")
    one = dump.select(*own, "i", "logprob").repartition(*own).groupBy(*own, "i").agg(F.min("logprob").alias("logprob"), (F.count("*") - 1).alias("extra"))
    d = one.join(sizes, own, "left").withColumn("held", F.coalesce((F.col("i") >= 0) & (F.col("i") < F.col("n")), F.lit(False)))
    matched = F.col("held") & F.col("language").isNotNull() & F.col("logprob").isNotNull()
    as_n = lambda c: total(F.when(c, 1).otherwise(0))
    bits = F.round(-F.col("logprob") / F.lit(PER_BIT[log_base]) * F.lit(1e6)).cast("long")
    zero = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    d = d.groupBy(F.when(F.col("held"), F.col("language")).alias("language")).agg(as_n(matched).alias("n_matched"), as_n(~F.col("held")).alias("n_orphan"), total("extra").alias("n_duplicate"), total(F.when(matched, bits).otherwise(0)).alias("ubits"))
    known = F.col("language").isNotNull()
    t = sizes.groupBy("language").agg(total("n").alias("n")).select("language", F.when(known, F.col("n")).otherwise(0).alias("n_tokens"), *zero("n_matched"), F.when(known, 0).otherwise(F.col("n")).alias("n_orphan"), *zero("n_duplicate", "ubits"))
    s = t.unionByName(d.select("language", *zero("n_tokens"), "n_matched", "n_orphan", "n_duplicate", "ubits")).groupBy("language").agg(*[total(c).alias(c) for c in ("n_tokens", "n_matched", "n_orphan", "n_duplicate", "ubits")])
    return s.select("language", "n_tokens", "n_matched", (F.col("n_tokens") - F.col("n_matched")).alias("n_missing"), "n_orphan", "n_duplicate", "ubits")


def ingest_losses(tokens: DataFrame, dump: DataFrame, log_base: str = "e") -> tuple[DataFrame, DataFrame]:
    """Attach an inference run's log-probabilities (dump: codebase, file_id, i, logprob) to tokens. Returns (losses, coverage): coverage
    counts tokens, matched, missing, orphans and surplus duplicates by language (orphans under null)."""
    key = ["codebase", "file_id", "i"]
    per_bit = PER_BIT[log_base]
    one = dump.groupBy(*key).agg(F.min("logprob").alias("logprob"), (F.count("*") - 1).alias("extra"))
    joined = tokens.join(one, key, "full_outer").select("language", *key, "pos", "n_bytes", "n_chars", "logprob", "extra")
    joined = stored(joined, "ingested")  # both results are made of it
    losses = joined.filter("language is not null and logprob is not null").withColumn("ubits", F.round(-F.col("logprob") / F.lit(per_bit) * F.lit(1e6)).cast("long"))
    seen, told = F.col("language").isNotNull(), F.col("logprob").isNotNull()
    as_n = lambda c: total(F.when(c, 1).otherwise(0))
    coverage = joined.groupBy("language").agg(as_n(seen).alias("n_tokens"), as_n(seen & told).alias("n_matched"), as_n(seen & ~told).alias("n_missing"), as_n(~seen).alias("n_orphan"), F.coalesce(total("extra"), F.lit(0).cast("long")).alias("n_duplicate"))
    return losses.drop("logprob", "extra"), coverage
