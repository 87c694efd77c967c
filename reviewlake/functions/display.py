"""How figures are shown, and rankings that views derive from sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_text(score: Column, digits: int = 1) -> Column:
    return F.when(score.isNull(), "—").otherwise(F.format_number(score, digits))


def percent_text(share: Column, digits: int = 0) -> Column:
    return F.when(share.isNull(), "—").otherwise(F.concat(F.format_number(share, digits), F.lit("%")))


def count_text(n: Column) -> Column:
    return F.when(n.isNull(), "—").otherwise(F.format_number(n, 0))


def date_text(day: Column) -> Column:
    """A day such as 5 Jan 2024."""
    return F.when(day.isNull(), "—").otherwise(F.date_format(day, "d MMM yyyy"))


def delta_text(change: Column, digits: int = 1) -> Column:
    """Signed; changes below half the last digit's tenfold say that there is none."""
    small = F.abs(change) < 10.0 ** -(digits + 1)
    return F.when(change.isNull(), "—").when(small, "No change").otherwise(F.concat(F.when(change > 0, "+").otherwise(""), F.format_number(change, digits)))


def publication_label(status: Column) -> Column:
    return F.when(status == "verified", "Verified").when(status == "source-gap", "Disclosed gap").when(status == "collecting", "Collecting").otherwise("Needs attention")


def accepted(status: Column) -> Column:
    return status.isin("verified", "source-gap")


def is_neutral(value: Column) -> Column:
    """Whether a filter's value stands for no filter at all."""
    return value.isNull() | F.trim(value).isin("", "ALL", "all", "-1")


def ranked_topics(topics: DataFrame) -> DataFrame:
    """Topics by their negative share; those without one come last, ties in definition order."""
    return topics.orderBy(F.desc(F.coalesce("negative_share", F.lit(-1.0))), "topic_ordinal")


def notable_weeks(trend: DataFrame) -> DataFrame:
    """The strongest, weakest and busiest week of a trend; the earliest on ties. A trend has 53 rows at most."""
    rated = F.col("average").isNotNull()
    return trend.agg(
        F.min_by("week_start", F.when(rated, F.struct((-F.col("average")).alias("a"), "week_start"))).alias("strongest"),
        F.min_by("week_start", F.when(rated, F.struct("average", "week_start"))).alias("weakest"),
        F.min_by("week_start", F.struct((-F.col("reviews")).alias("n"), "week_start")).alias("busiest"),
    )
