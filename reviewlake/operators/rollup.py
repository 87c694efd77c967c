"""A rollup of the classified reviews, kept up to date by what each generation changes.

A cell counts the reviews of one property, date, score and sentiment; further
cells count their mentions by topic and polarity. All figures of the dashboard
but single reviews are sums over cells, so a new generation costs the
classification of the reviews that it changed and one aggregation of cells:
what it brings adds, what it takes away subtracts. The newest review of a cell
can't be subtracted; cells that lost it, and only those, look it up again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.periods import Period
from reviewlake.operators import metrics, topics
from reviewlake.operators.history import History
from reviewlake.operators.ranges import settled

#: What tells cells apart: those of reviews have no topic, those of mentions no score, sentiment or reply.
CELL = ("property_key", "local_date", "tenths", "sentiment", "has_negative_feedback", "responded", "topic", "polarity")
#: What a history must keep of a review for its cells.
CONTENT = ("row_id", "epoch", "local_date", "tenths", "positive_text", "negative_text", "partner_reply")

#: How many row numbers there are, and what stands for none: before every other, as nulls are.
_ROWS, _NO_ROW, _NO_EPOCH = Decimal(1 << 64), -(1 << 63), -5 * 10**18

Classify = Callable[[DataFrame], DataFrame]


def classified(reviews: DataFrame) -> DataFrame:
    return topics.classified_once(reviews, ("property_key", "token"))


def rollup(facts: DataFrame) -> DataFrame:
    """The cells of classified reviews: their number n, and of mentions the first by (epoch descending, row)."""
    none = F.lit(None)
    own = F.struct("tenths", "sentiment", F.coalesce(F.col("partner_reply") != "", F.lit(False)).alias("responded"), none.cast("string").alias("topic"), none.cast("string").alias("polarity"))
    # One number by (epoch descending, row): a least struct would make Spark sort all rows, a least number is kept in place.
    at = lambda c, least: F.coalesce(c.cast("decimal(19,0)"), F.lit(least).cast("decimal(19,0)"))
    place = at(-F.col("epoch"), _NO_EPOCH) * F.lit(_ROWS) + (at(F.col("row_id"), _NO_ROW) - F.lit(_NO_ROW))
    said = F.transform("topics", lambda t: F.struct(none.cast("int").alias("tenths"), none.cast("string").alias("sentiment"), none.cast("boolean").alias("responded"), t["topic"].alias("topic"), t["polarity"].alias("polarity")))
    rows = facts.select("property_key", "local_date", "has_negative_feedback", place.alias("place"), F.explode_outer(F.concat(F.array(own), F.coalesce(said, F.array()))).alias("x"))
    rows = rows.select("property_key", "local_date", "has_negative_feedback", "x.*", F.when(F.col("x.topic").isNotNull(), F.col("place")).alias("place"))
    found = rows.groupBy(*CELL).agg(F.count("*").alias("n"), F.min("place").alias("place"))
    rest = F.pmod("place", F.lit(_ROWS))
    e = F.nullif(F.call_function("div", F.col("place") - rest, F.lit(_ROWS)), F.lit(_NO_EPOCH))
    row = F.nullif((rest + F.lit(_NO_ROW)).cast("long"), F.lit(_NO_ROW))
    return found.select(*CELL, "n", F.when(F.col("place").isNotNull(), F.struct(e.alias("e"), row.alias("row_id"))).alias("first"))


def maintained(cells: DataFrame, removed: DataFrame, added: DataFrame, present: DataFrame, classify: Classify = classified) -> DataFrame:
    """The cells after one generation, from reviews that it removed and added, each at most once, and those that are present after it.

    Of ``present`` only the dates of cells that lost their newest review are
    read and classified.
    """
    def part(df: DataFrame, sign: int, name: str) -> DataFrame:
        kind = df.schema["first"].dataType
        return df.select(*CELL, (sign * F.col("n")).alias("n"), *[(F.col("first") if c == name else F.lit(None).cast(kind)).alias(c) for c in ("held", "brought", "taken")])

    moved = part(cells, 1, "held").unionByName(part(rollup(classify(added)), 1, "brought")).unionByName(part(rollup(classify(removed)), -1, "taken"))
    summed = moved.groupBy(*CELL).agg(F.sum("n").alias("n"), *[F.min(c).alias(c) for c in ("held", "brought", "taken")]).filter("n > 0")
    lost = F.coalesce((F.col("taken") == F.col("held")) & F.coalesce(F.col("brought") > F.col("taken"), F.lit(True)), F.lit(False))
    rows = settled(summed.select(*CELL, "n", F.least("held", "brought").alias("first"), lost.alias("lost")))
    short = rows.filter("lost").drop("first")
    near = present.join(short.select("property_key", "local_date").distinct(), ["property_key", "local_date"], "left_semi")
    found = rollup(classify(near)).filter("topic IS NOT NULL").select(*[F.col(c).alias(f"__{c}") for c in CELL], "first")
    alike = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in CELL]
    return rows.filter("NOT lost").select(*CELL, "n", "first").unionByName(short.join(found, alike, "left").select(*CELL, "n", "first"))


class Figures:
    """The dashboard's figures from cells, which stand for all reviews or for those that a filter by property and date leaves."""

    def __init__(self, cells: DataFrame) -> None:
        own = F.col("topic").isNull()
        self.reviews = cells.filter(own).withColumn("partner_reply", F.when(F.col("responded"), "replied").otherwise(""))
        self.mentions = cells.filter(~own)

    def overview(self, period: Period) -> DataFrame:
        return metrics.compared(self.reviews, period, weight="n")

    def trend(self, today: date, start: date | None = None, end: date | None = None) -> DataFrame:
        return metrics.weekly_trend(self.reviews, today, start, end, weight="n")

    def histogram(self) -> DataFrame:
        return metrics.score_histogram(self.reviews, weight="n")

    def topics(self, period: Period, properties: DataFrame) -> DataFrame:
        return metrics.topic_metrics(self.reviews, period, properties, "n", self.mentions)

    def properties(self, period: Period, properties: DataFrame) -> DataFrame:
        return metrics.property_metrics(self.reviews, period, properties, "n", self.mentions)


class Rollup:
    """The cells of a history's generations, kept up to date."""

    def __init__(self, history: History, classify: Classify = classified) -> None:
        self.history, self.classify = history, classify
        self.generation, self.cells = 0, None

    def advance(self, until: int | None = None) -> Rollup:
        """Takes in each generation after its own; the first one it meets is counted whole."""
        for c in self.history.commits(until):
            if c.generation <= self.generation:
                continue
            present = self.history.spark.read.parquet(c.state).filter("presence = 'present'")
            if self.cells is None:
                self.cells = settled(rollup(self.classify(present)))
            else:
                removed, added = self.history.delta(c.generation - 1, c.generation)
                self.cells = settled(maintained(self.cells, removed, added, present, self.classify))
            self.generation = c.generation
        return self

    def figures(self) -> Figures:
        return Figures(self.cells)
