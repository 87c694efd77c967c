"""Order within keys of any size: written tables, dealt out by ranges, with what each range takes over from those before it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where a local session has none."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="reviewlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


_cleared: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A new folder within the application's own one in the shared folder, which goes when the application ends."""
    sc = spark.sparkContext
    folder = f"{shared_dir(spark).rstrip('/')}/settled-{sc.applicationId}"
    if folder not in _cleared:
        own = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = own.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(own)
        files.deleteOnExit(own)
        _cleared.add(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that lost executors cost no recomputation."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over tasks by a key, before work that is dear for each row: a file of a few row groups keeps only so many tasks busy, whatever its size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


#: Rows of one task where a key's rows meet and are sorted.
TASK_ROWS = 200_000


def parts(spark: SparkSession, rows: int) -> int:
    """Tasks for so many rows: as many as the session has, and more where a task would grow with the table."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def ranged(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """df written in ranges of keys and order, numbered in ``__part``. A key with many rows takes several ranges; rows that are equal in both stand in one."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()))


def carried(rows: DataFrame, keys: tuple[str, ...], each: Column, merged: Callable[[str], Column], name: str) -> DataFrame:
    """``rows`` of ranged() with what the earlier ranges of their key come to; null in a key's first range.

    Only the first key of a range can have begun before it, so there is at
    most one row a range to broadcast.
    """
    parts = rows.groupBy("__part", *keys).agg(each.alias("__each"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begun = parts.withColumn(name, merged("__each").over(before)).filter(F.col(name).isNotNull()).select("__part", *keys, name)
    return rows.join(F.broadcast(begun), ["__part", *keys], "left")


def numbered(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    """df with the place of each row within its key, from zero."""
    rows = carried(ranged(df, keys, order), keys, F.count("*"), F.sum, "__before")
    place = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order)).cast("long") - 1
    return rows.withColumn(name, place + F.coalesce("__before", F.lit(0))).drop("__part", "__before")


def with_previous(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], columns: dict[str, str]) -> DataFrame:
    """df with columns of the row before within its key: new names by column. ``order`` must tell rows of a key apart; the first row has nulls."""
    last = F.max(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in columns]))
    rows = carried(ranged(df, keys, order), keys, last, F.max, "__before")
    w = Window.partitionBy("__part", *keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    return rows.withColumns({new: F.when(first, F.col(f"__before.__{c}")).otherwise(F.lag(c).over(w)) for c, new in columns.items()}).drop("__part", "__before")
