"""Reading and writing canonical tables and files of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def append(rows: DataFrame, folder: str, name: str) -> None:
    rows.write.mode("append").parquet(f"{folder}/{name}")


def clear(spark: SparkSession, folder: str, name: str) -> None:
    """Leaves an empty table with the same columns."""
    schema = read_table(spark, folder, name).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder: file_id (a hash of what they hold), filename, content."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
