"""Tables in the folder that driver and executors share, to cut lineage in loops and between passes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, read from the session. Where it is unset, a local session gets a temporary folder (as in tests); on a cluster
    that is an error, since executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext.getCheckpointDir()):
        found = own.rsplit("/", 1)[0]
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths that this process has handed out and not deleted yet.
_held: set[str] = set()


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/codecurves-{tag}-{uuid.uuid4().hex}"
    _held.add(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back, so that lost executors cost no rerun of what made it. The
    table stays until `discard` or `clear`, since what is returned is read whenever its result is asked for."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` made, once nothing reads them any more (loops do so with those that a later round replaced)."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/codecurves-" in path:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _held.discard(path)


def clear(spark: SparkSession) -> int:
    """Delete all tables that this process has stored and not discarded, once the results that read them are written; returns how many."""
    paths = sorted(_held)
    for path in paths:
        _delete(spark, path)
    return len(paths)
