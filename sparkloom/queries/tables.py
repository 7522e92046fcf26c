"""Tables of one data folder as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the folder's tables; only those that the text names are opened."""
    for name in TABLES:
        if name in text:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)
