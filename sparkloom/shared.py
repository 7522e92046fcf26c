"""The folder that all machines of the cluster share, and tables that are worked out once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, on one machine only (tests), a folder of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loom-')}")
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def own_folder(spark: SparkSession, owner: str) -> str:
    """A new folder below the shared one; it goes when the application ends."""
    sc = spark.sparkContext
    name = f"{shared_folder(spark)}/{owner}-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return name


def written(df: DataFrame, owner: str) -> DataFrame:
    """The same rows, worked out once and read from files: every use sees the same, whatever is lost."""
    path = f"{own_folder(df.sparkSession, owner)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
