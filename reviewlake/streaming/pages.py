"""An extension of the batch operators: pages of reviews as a stream of files, each page taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_stream(spark: SparkSession, path: str, schema: str, watermark: str = "1 day") -> DataFrame:
    """Collected pages from a folder; replays of a page within the watermark are dropped."""
    pages = spark.readStream.schema(schema).json(path)
    return pages.withWatermark("observed_at", watermark).dropDuplicatesWithinWatermark(["run_id", "phase", "page_offset"])


def hourly_counts(pages: DataFrame) -> DataFrame:
    """Pages and reviews an hour for each property; late pages within the watermark are counted."""
    return pages.groupBy(F.window("observed_at", "1 hour"), "property_key").agg(F.count("*").alias("pages"), F.sum("n_reviews").alias("reviews"))
