"""One query's sections over one published generation, as lazy frames that share the classified facts."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import periods, scalars
from reviewlake.operators import feed, metrics, quality, rollup

RECENT = 4


@dataclass
class Sections:
    period: periods.Period
    overview: DataFrame
    trend: DataFrame
    histogram: DataFrame
    topics: DataFrame
    properties: DataFrame
    alerts: DataFrame
    recent: DataFrame
    feed: DataFrame
    total: int
    pages: int
    page: int
    options: DataFrame
    quality: DataFrame
    status: DataFrame


class ReviewEngine:
    """Answers queries on canonical reviews; facts are classified once for each generation and kept, spilling to disk, and so are the cells that all sums come from."""

    def __init__(self, properties: DataFrame, evidence: DataFrame) -> None:
        self.properties, self.evidence = properties, evidence
        self._generation, self._facts, self._cells, self._bounds = None, None, None, None

    def load(self, reviews: DataFrame, generation) -> DataFrame:
        """The classified facts; kept as long as the generation stays the same."""
        if self._facts is None or generation != self._generation:
            self.close()
            facts = rollup.classified(reviews).withColumn("public_id", scalars.public_id(F.col("property_key"), F.col("token")))
            self._facts, self._generation = facts.persist(StorageLevel.MEMORY_AND_DISK), generation
            self._cells = rollup.rollup(self._facts).persist(StorageLevel.MEMORY_AND_DISK)
            self._bounds = feed.date_bounds(self._facts).first()
        return self._facts

    def close(self) -> None:
        if self._facts is not None:
            self._facts.unpersist()
            self._cells.unpersist()
        self._facts = self._cells = None

    def sections(self, q: feed.FeedQuery, today: date) -> Sections:
        """All sections of a query.

        Overview, topics and alerts look at the period; trend, histogram and
        all mentions at every review in the chosen properties and dates;
        quality ignores the choice. The period's bounds come from all reviews.
        """
        if self._facts is None:
            raise RuntimeError("load a generation first")
        period = periods.custom_period(q.start, q.end, self._bounds["earliest"], self._bounds["latest"], today)
        chosen = rollup.Figures(feed.scoped(self._cells, replace(q, start=None, end=None)))
        scoped = rollup.Figures(feed.scoped(self._cells, q))
        everything = feed.scoped(self._facts, q)
        dims = self.properties.filter(F.col("property_key").isin(*q.properties)) if q.properties else self.properties
        rows, total, pages, page = feed.page(self._facts, q)
        checked = quality.quality_rows(self.evidence)
        per_property = chosen.properties(period, dims)
        per_topic = chosen.topics(period, self.properties)
        mentions = scoped.mentions.groupBy("topic").agg(F.sum("n").alias("n"))
        per_topic = per_topic.drop("all_mentions").join(F.broadcast(mentions), "topic", "left").withColumn("all_mentions", F.coalesce("n", F.lit(0))).drop("n")
        hidden = ("epoch", "has_negative_feedback", "token", "row_id")
        return Sections(
            period, chosen.overview(period), scoped.trend(today, q.start, q.end), scoped.histogram(), per_topic, per_property,
            metrics.alerts(per_property, per_topic, checked), everything.orderBy(*feed.order("newest")).limit(RECENT).drop(*hidden), rows.drop(*hidden), total, pages, page,
            feed.filter_options(self._facts), checked, quality.overall(checked),
        )
