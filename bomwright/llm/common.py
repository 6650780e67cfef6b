"""What the training-data operators share: the word rule and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as in
    tests on one machine, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='bomwright-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove_later(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate rows when the driver ends."""

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  the session has already stopped; the folder is the cluster's to clean
            pass

    atexit.register(remove)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes rows once to the shared folder and reads them back: a cut of lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def named(name: str) -> Column:
    """A column by its whole name, which may hold dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(columns: list[str]) -> Column:
    """Columns of any names as one struct; its fields go by number, so they clash with nothing."""
    return F.struct(*(named(c).alias(f"c{k}") for k, c in enumerate(columns))) if columns else F.lit(None).cast("struct<nothing:int>")


def restored(columns: list[str], others: list[str], **changed: Column) -> list[Column]:
    """``columns``: those in ``changed`` as given there, ``others`` from the struct ``carried`` they were packed in, the rest as they are."""
    inside = {c: F.col(f"carried.c{k}") for k, c in enumerate(others)}
    return [(changed[c] if c in changed else inside[c] if c in inside else named(c)).alias(c) for c in columns]


#: A key of more rows than this is dealt to several tasks, and at most so many keys are.
HOT_ROWS = 2_000
HOT_KEYS = 20_000


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[tuple[str, str]], places: str, unit: Column) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, of which ``places`` tells how many rows have its key.

    ``keys``: a column of rows and one of groups; those of groups are dropped, and ``places`` too.
    A key of more than ``limit`` rows is dealt to several tasks: its group is repeated once for
    each, and a row goes to one by the hash ``unit``. Not more than ``HOT_KEYS`` keys can have
    more rows than the limit, so they are sent to all tasks. ``groups`` is read three times.
    """
    most, total = groups.agg(F.max(places), F.sum(places)).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    match = [F.col(a) == F.col(b) for a, b in keys]
    drop = [b for _, b in keys] + [places]
    if (most or 0) <= limit:
        return rows.join(groups, match).drop(*drop)
    hot = groups.where(F.col(places) > limit).groupBy(*(F.col(b).alias(f"hot_{k}") for k, (_, b) in enumerate(keys))).agg(F.ceil(F.max(places) / limit).alias("hot_salts"))
    dealt = rows.join(F.broadcast(hot), [F.col(a) == F.col(f"hot_{k}") for k, (a, _) in enumerate(keys)], "left")
    dealt = dealt.withColumn("salt", F.coalesce(F.pmod(unit, F.col("hot_salts")), F.lit(0).cast("bigint"))).drop(*(f"hot_{k}" for k in range(len(keys))), "hot_salts")
    last = F.when(F.col(places) > limit, F.ceil(F.col(places) / limit) - 1).otherwise(F.lit(0)).cast("bigint")
    repeated = groups.withColumn("group_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return dealt.join(repeated, [*match, F.col("salt") == F.col("group_salt")]).drop(*drop, "salt", "group_salt")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: tasks get Arrow batches of ``rows`` rows, unless the session asks for another number than Spark's 10,000."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has, without keeping an array of them after the count.

    A word starts wherever a non-space follows a space or the start.
    """
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")
