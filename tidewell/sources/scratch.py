"""Tables written to the folder that all executors share, to cut lineage in a way that outlives a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: The folder of this process below each shared one.
_runs: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidewell-"))
    return _own[0]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def run_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one, which goes when its JVM ends."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _runs:
        _runs[key] = f"{key[1]}/tidewell-{uuid.uuid4().hex}"
        fs, p = _path(spark, _runs[key])
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return _runs[key]


def release(spark: SparkSession) -> None:
    """Delete all that was settled so far; results that were not yet computed from it are lost."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key in _runs:
        fs, p = _path(spark, _runs.pop(key))
        fs.delete(p, True)


def settle(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, and read from there."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
