"""File sources by name of their table function."""

from __future__ import annotations

import glob as _glob
import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=header, sep=sep, inferSchema=True)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or files that hold one array."""
    df = spark.read.json(path)
    return spark.read.json(path, multiLine=True) if df.columns == ["_corrupt_record"] else df


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """filename, content: one row per file."""
    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path AS filename", "value AS content")


def read_blob(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).selectExpr("path AS filename", "content", "length AS size")


def read_jdbc(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A table of another database; partition (column, lower, upper, parts) reads it in parallel.  The driver's jar is the caller's."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, low, high, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def glob(pattern: str) -> list[str]:
    return sorted(_glob.glob(pattern, recursive=True))


def file_exists(path: str) -> bool:
    return Path(path).exists()


def md5_file(path: str) -> str:
    return hashlib.md5(Path(path).read_bytes()).hexdigest()


READERS = {"read_parquet": read_parquet, "read_csv": read_csv, "read_csv_auto": read_csv, "read_json": read_json, "read_json_auto": read_json, "read_text": read_text, "read_blob": read_blob}
