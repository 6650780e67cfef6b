"""Rows that are written once and read again: how rounds cut their lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset on one machine, as in tests, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='bomwright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _removed(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` from a table of their own in the shared folder, which is removed when the driver ends."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    atexit.register(_removed, spark, path)
    return spark.read.schema(rows.schema).parquet(path)


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that shuffles them: what Spark guesses of their size, from compressed files, before arrays are spread, may be a hundredth of it, and a broadcast has to fit the driver."""
    return rows.hint("merge")


#: So many rows are few.
FEW_ROWS = 10_000


def few_or_shuffled(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written, for a join that sends them to all tasks if they are few, whatever Spark guesses of them, so that wide rows on the other side stay where they are."""
    kept = written(rows, name)
    return F.broadcast(kept) if kept.limit(FEW_ROWS + 1).count() <= FEW_ROWS else shuffled(kept)


#: About how many rows of a large table one task is to sort or group.
ROWS_A_TASK = 250_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, about ``n``, dealt out by ``keys`` to more tasks the more there are, so that the memory of one does not grow with the table; what joins and groups by these keys stays there. Small tables are left as they are."""
    return rows.repartition(-(-n // ROWS_A_TASK), *keys) if n > 4 * ROWS_A_TASK else rows


#: How Parquet stores rows of long texts: it looks at the size of what it holds after each row and not only after a hundred.
LONG_ROWS = {"parquet.page.size.row.check.min": "1"}

#: Of a column of long texts it keeps no copies for a dictionary and for the least and greatest text, which would be worth nothing.
LONG_TEXTS = {"parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}


def storing_long_texts(spark: SparkSession, column: str) -> None:
    """Whoever stores texts in ``column`` as Parquet in this session does so in little more memory than they have; a session's own settings stay."""
    for key, value in (LONG_ROWS | {f"{k}#{column}": v for k, v in LONG_TEXTS.items()}).items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
