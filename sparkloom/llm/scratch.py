"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, on one machine only (tests), a folder of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        named = f"file://{tempfile.mkdtemp(prefix='loom-')}"
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir() or named
    return named.rstrip("/")


class Scratch:
    """Tables that one operator writes to cut lineage; each is named once.

    A written table survives the loss of any executor, is read by column, and gives adaptive
    execution plain exchanges on both sides of a later join, which it can split when a key is hot.
    What an operator's result still reads goes when the application ends, the rest by ``drop``.
    """

    def __init__(self, spark: SparkSession, owner: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{owner}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        path, fs = self._path("")
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _path(self, name: str):
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(sc._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later query reads."""
        for name in names:
            path, fs = self._path(name)
            fs.delete(path, True)
            self.names.discard(name)

    def keep_only(self, *names: str) -> None:
        """Delete all tables but these."""
        self.drop(*(self.names - set(names)))
