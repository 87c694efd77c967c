"""Period metrics, trends, histograms, topic and property metrics, and alerts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.periods import Period, trend_weeks, week_start
from reviewlake.functions.scalars import delta, direction, share
from reviewlake.operators.ranges import carried, ranged
from reviewlake.operators.topics import topic_dimension, unpivoted

#: Buckets of the histogram and of the source, from the highest: (label, from, below) in tenths.
HISTOGRAM = (("9+", 90, 101), ("7-9", 70, 90), ("5-7", 50, 70), ("3-5", 30, 50), ("0-3", 0, 30))
SOURCE_BUCKETS = (("wonderful", 90, 101), ("good", 70, 90), ("okay", 50, 70), ("poor", 30, 50), ("very_poor", 10, 30))
#: Points of share from which a topic moves, and limits of the alerts.
TOPIC_MOVES, RATING_FALLS, RATING_FALLS_MUCH, TOPIC_RECURS, TOPIC_RECURS_MUCH, MOST_ALERTS = 2, -0.3, -1.0, 20, 40, 4


# Each metric takes reviews, a row each, or cells of a rollup, of which the column ``weight`` tells how many reviews they stand for.


def mean(tenths: Column, weight: str | None = None) -> Column:
    """Mean score from whole tenths, so that sums stay exact."""
    return (F.sum(tenths * F.col(weight)) / F.sum(F.when(tenths.isNotNull(), F.col(weight))) if weight else F.avg(tenths)) / 10


def counted(when: Column, weight: str | None = None) -> Column:
    """How many reviews there are of which a condition holds."""
    return F.coalesce(F.sum(F.when(when, F.col(weight))), F.lit(0)) if weight else F.count_if(when)


def period_metric(when: Column, prefix: str, weight: str | None = None) -> list[Column]:
    """The ten figures of a period as conditional aggregates, for one pass over all periods."""
    n = lambda c: counted(when & F.coalesce(c, F.lit(False)), weight)
    return [
        mean(F.when(when, F.col("tenths")), weight).alias(f"{prefix}_average"),
        counted(when, weight).alias(f"{prefix}_count"),
        *[n(F.col("sentiment") == s).alias(f"{prefix}_{s}") for s in ("positive", "mixed", "negative", "unclassified")],
        n(F.col("has_negative_feedback")).alias(f"{prefix}_negative_feedback"),
        n(F.col("partner_reply") != "").alias(f"{prefix}_responses"),
    ]


def compared(reviews: DataFrame, period: Period, keys: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Current against previous figures, per key or over all, in one aggregation."""
    both = reviews.filter(period.current() | period.previous())
    out = both.groupBy(*keys).agg(*period_metric(period.current(), "current", weight), *period_metric(period.previous(), "previous", weight))
    change = delta(F.col("current_average"), F.col("previous_average"))
    return out.withColumn("average_delta", change).withColumn("direction", direction(F.col("average_delta")))


def weekly_trend(reviews: DataFrame, today: date, start: date | None = None, end: date | None = None, weight: str | None = None) -> DataFrame:
    """A dense series of Monday weeks; the last is cut off at today; empty weeks have null means and shares."""
    first, last = trend_weeks(today, start, end)
    spark = reviews.sparkSession
    weeks = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval 7 days)")).alias("week_start"))
    weeks = weeks.withColumn("week_end", F.least(F.date_add("week_start", 6), F.lit(end or today))).withColumn("is_partial", F.col("week_end") < F.date_add("week_start", 6))
    seen = reviews.filter(F.col("local_date").between(F.lit(first), F.lit(end or today)))
    per = seen.groupBy(week_start(F.col("local_date")).alias("week_start")).agg(mean(F.col("tenths"), weight).alias("average"), counted(F.lit(True), weight).alias("n"), counted(F.col("sentiment") == "negative", weight).alias("negative"))
    out = weeks.join(F.broadcast(per), "week_start", "left").withColumn("reviews", F.coalesce("n", F.lit(0)))
    return out.select("week_start", "week_end", "is_partial", "average", "reviews", F.coalesce("negative", F.lit(0)).alias("negative"), share(F.col("negative"), F.col("n")).alias("negative_share"))


def _bucket(buckets) -> Column:
    out = F.lit(None).cast("string")
    for label, low, high in reversed(buckets):
        out = F.when((F.col("tenths") >= low) & (F.col("tenths") < high), label).otherwise(out)
    return out


def score_histogram(reviews: DataFrame, buckets=HISTOGRAM, weight: str | None = None) -> DataFrame:
    """All buckets with counts and shares; a share is zero where there are no reviews at all."""
    dim = reviews.sparkSession.createDataFrame([(i, b[0]) for i, b in enumerate(buckets)], "bucket_ordinal int, bucket string")
    counts = reviews.groupBy(_bucket(buckets).alias("bucket")).agg(counted(F.lit(True), weight).alias("n"))
    out = dim.join(F.broadcast(counts), "bucket", "left").select("bucket_ordinal", "bucket", F.coalesce("n", F.lit(0)).alias("reviews"))
    total = F.sum("reviews").over(Window.partitionBy())  # five rows
    return out.withColumn("share", F.coalesce(share(F.col("reviews"), total), F.lit(0.0)))


def source_buckets(reviews: DataFrame, keys: tuple[str, ...] = ("property_key",)) -> DataFrame:
    """Counts by source bucket; scores in no bucket have a null one, which is a violation."""
    return reviews.groupBy(*keys, _bucket(SOURCE_BUCKETS).alias("bucket")).agg(F.count("*").alias("reviews"))


def mentioned(reviews: DataFrame) -> DataFrame:
    """One row per review and topic, with the review's place among all: the newest first."""
    place = F.struct((-F.col("epoch")).alias("e"), "row_id").alias("first")
    return unpivoted(reviews.withColumn("first", place), ("first", "property_key", "local_date", "has_negative_feedback"))


def topic_metrics(reviews: DataFrame, period: Period, properties: DataFrame, weight: str | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """Eight rows: shares of negative mentions now and before, all mentions, and the leading property; topics are classified once.

    ``mentions`` gives the rows by topic of a rollup's cells.

    Ties for the lead go to the property seen first: the least position of a
    match by (epoch descending, row). The position is compared as a struct, so
    no global order is built.
    """
    spark = reviews.sparkSession
    seen = mentions if mentions is not None else mentioned(reviews)
    bad = F.col("has_negative_feedback") & F.col("polarity").isin("negative", "mixed")
    now = bad & period.current()
    per = seen.groupBy("topic", "property_key").agg(counted(now, weight).alias("now"), counted(bad & period.previous(), weight).alias("before"), counted(F.lit(True), weight).alias("all_mentions"), F.min(F.when(now, F.col("first"))).alias("first"))
    lead = F.min_by("property_key", F.when(F.col("now") > 0, F.struct((-F.col("now")).alias("n"), "first")))
    counts = per.groupBy("topic").agg(F.sum("now").alias("now"), F.sum("before").alias("before"), F.sum("all_mentions").alias("all_mentions"), F.count_if(F.col("now") > 0).alias("affected"), lead.alias("property_key"))
    whole = reviews.agg(counted(F.col("has_negative_feedback") & period.current(), weight).alias("now_all"), counted(F.col("has_negative_feedback") & period.previous(), weight).alias("before_all"))
    out = topic_dimension(spark).join(F.broadcast(counts), "topic", "left").join(properties.select("property_key", "property_name"), "property_key", "left").crossJoin(F.broadcast(whole))
    n = lambda c: F.coalesce(c, F.lit(0))
    out = out.withColumns({"negative_share": share(n("now"), F.col("now_all")), "previous_share": share(n("before"), F.col("before_all"))})
    change = F.col("negative_share") - F.col("previous_share")
    trend = F.when(change.isNull(), "unavailable").when(change > TOPIC_MOVES, "worsening").when(change < -TOPIC_MOVES, "improving").otherwise("stable")
    return out.select("topic_ordinal", "topic", "topic_label", n("now").alias("negative_mentions"), "negative_share", "previous_share", change.alias("share_delta"), n("all_mentions").alias("all_mentions"), n("affected").alias("affected_properties"), F.col("property_name").alias("leading_property"), trend.alias("trend"))


def top_negative_topic(reviews: DataFrame, period: Period, weight: str | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """The most frequent negative topic of each property in the period; ties go by topic name."""
    bad = period.current() & F.col("has_negative_feedback")
    seen = mentions.filter(bad) if mentions is not None else unpivoted(reviews.filter(bad), ("property_key",))
    counts = seen.filter(F.col("polarity").isin("negative", "mixed")).groupBy("property_key", "topic").agg(counted(F.lit(True), weight).alias("n"))
    return counts.groupBy("property_key").agg(F.min_by("topic", F.struct((-F.col("n")).alias("n"), "topic")).alias("top_topic"), F.max("n").alias("top_topic_mentions"))


def property_metrics(reviews: DataFrame, period: Period, properties: DataFrame, weight: str | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """A row for every property, with reviews or without. How to join is left to Spark: nothing bounds the number of properties."""
    per = reviews.groupBy("property_key").agg(
        counted(F.lit(True), weight).alias("n"), mean(F.col("tenths"), weight).alias("average"), F.max("local_date").alias("last_date"),
        *period_metric(period.current(), "current", weight), *period_metric(period.previous(), "previous", weight),
    )
    out = properties.join(per, "property_key", "left").join(top_negative_topic(reviews, period, weight, mentions), "property_key", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "ordinal", "property_key", "property_name", n("n").alias("reviews"), "average", "current_average", "previous_average",
        delta(F.col("current_average"), F.col("previous_average")).alias("week_delta"), n("current_count").alias("current_count"),
        share(F.col("current_negative"), F.col("current_count")).alias("negative_share"), share(F.col("current_responses"), F.col("current_count")).alias("response_rate"),
        "top_topic", "last_date",
    )


def alerts(property_rows: DataFrame, topic_rows: DataFrame, quality_rows: DataFrame) -> DataFrame:
    """At most four: the worst fall, the most frequent topic, source gaps, evidence errors."""
    fall = property_rows.filter("week_delta IS NOT NULL").orderBy("week_delta", "ordinal").limit(1).filter(F.col("week_delta") <= RATING_FALLS)
    fall = fall.select(F.lit(0).alias("priority"), "ordinal", F.concat(F.lit("rating:"), "property_key").alias("alert"), F.when(F.col("week_delta") <= RATING_FALLS_MUCH, "high").otherwise("medium").alias("severity"))
    topic = topic_rows.filter("negative_share IS NOT NULL").orderBy(F.desc("negative_share"), "topic_ordinal").limit(1).filter(F.col("negative_share") >= TOPIC_RECURS)
    topic = topic.select(F.lit(1).alias("priority"), F.col("topic_ordinal").alias("ordinal"), F.concat(F.lit("topic:"), "topic").alias("alert"), F.when(F.col("negative_share") >= TOPIC_RECURS_MUCH, "high").otherwise("medium").alias("severity"))
    gaps = quality_rows.filter("status = 'source-gap'").select(F.lit(2).alias("priority"), "ordinal", F.concat(F.lit("quality:"), "property_key").alias("alert"), F.lit("low").alias("severity"))
    errors = quality_rows.filter("status = 'evidence-error'").select(F.lit(3).alias("priority"), "ordinal", F.concat(F.lit("quality-error:"), "property_key").alias("alert"), F.lit("high").alias("severity"))
    return fall.unionByName(topic).unionByName(gaps).unionByName(errors).orderBy("priority", "ordinal").limit(MOST_ALERTS)


def nearest_rank(df: DataFrame, value: str, keys: tuple[str, ...], at=(0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles with minimum and maximum.

    Values are counted first, then ranked in ranges, so that no key's values
    gather in one task; nulls are left out.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    rows = carried(ranged(counted, keys, (value,)), keys, F.sum("__n"), F.sum, "__before")
    upto = F.sum("__n").over(Window.partitionBy("__part", *keys).orderBy(value)) + F.coalesce("__before", F.lit(0))
    rows = rows.withColumn("__upto", upto)
    whole = rows.groupBy(*keys).agg(F.max("__upto").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    at_least = [F.min(F.when(F.col("__upto") >= F.ceil(F.col("__total") * F.lit(str(p)).cast("decimal(9,6)")), F.col(value))).alias(f"p{round(p * 100)}") for p in at]
    found = rows.join(whole.select(*keys, F.col("n").alias("__total")), list(keys)).groupBy(*keys).agg(*at_least)
    return whole.join(found, list(keys))


def throughput(runs: DataFrame) -> DataFrame:
    """Pages and review occurrences a minute of runs, to two decimals; a run takes a millisecond at least."""
    minutes = lambda c: F.round(F.col(c) * 60_000 / F.greatest(F.lit(1), F.round("duration_ms")), 2)
    return runs.withColumns({"pages_per_minute": minutes("pages"), "reviews_per_minute": minutes("reviews")})


def publication_stats(versions: DataFrame) -> DataFrame:
    """Counts by presence and the mean over present reviews, per property."""
    present = F.col("presence") == "present"
    return versions.groupBy("property_key").agg(F.count_if(present).alias("present"), F.count_if(F.col("presence") == "suspect_missing").alias("suspect"), F.count_if(F.col("presence") == "tombstoned").alias("tombstoned"), mean(F.when(present, F.col("tenths"))).alias("average"))
