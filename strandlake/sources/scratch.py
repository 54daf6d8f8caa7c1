"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder that the SparkContext was given. Where neither is set: a local folder if driver and executors are one
    process (as in tests), else an error, as executors wouldn't see each other's files."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    given = sc._jsc.sc().getCheckpointDir()
    if not known and given.isDefined():
        known = given.get()
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below it that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
