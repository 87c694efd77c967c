"""What the training-data operators share: reading tables and cutting lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.operators.ranges import settled, shared_dir

__all__ = ["BLANKS", "checkpointed", "settled", "shared_dir", "table", "through_pandas"]

#: White space between words, as a Java regular expression.
BLANKS = r"[\x20\x09-\x0D]+"


def through_pandas(doc_id: str | Column) -> Column:
    """A long key as a string: beside a null, pandas would make it a double and change keys beyond 2 ** 53."""
    return (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("long").cast("string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """For the small frames of iterations: their files go when the frame is no longer used."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
