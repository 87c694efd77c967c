"""Queries over the driver's tables, by name, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import display, periods, scalars
from reviewlake.operators import export, feed, gaps, metrics, quality, sentiment, snapshots, topics
from reviewlake.operators import inventory as checks
from reviewlake.operators.ranges import parts, settled
from reviewlake.plans import oracles as sql
from reviewlake.plans.base import ORACLES, QUERIES, query, values
from reviewlake.sources import publications
from reviewlake.sources import reviews as src

TODAY = date.fromisoformat(src.AS_OF)
WEEK = periods.default_period(TODAY)
__all__ = ["ORACLES", "QUERIES"]

def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.with_sentiment(src.canonical(spark, sf_dir))


def with_topics(spark: SparkSession, sf_dir: str, evidence: bool = False) -> DataFrame:
    rows = src.canonical(spark, sf_dir)
    # A small table is one row group, which one task would read and classify alone; a large one has parts enough and isn't shuffled.
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    return topics.classified_once(rows, ("property_key", "token"), evidence)


COMPARED = ("current_average", "current_count", "current_positive", "current_mixed", "current_negative", "current_unclassified", "current_negative_feedback", "current_responses", "previous_average", "previous_count", "average_delta", "direction")


@query(sql.compared("2024-01-22", "2024-01-26", "2024-01-15", "2024-01-19", True))
def kpi_current_vs_previous(spark, sf_dir):
    return metrics.compared(classified(spark, sf_dir), WEEK, ("property_key",)).select("property_key", *COMPARED)


@query(sql.compared("2024-01-10", "2024-01-20", "2023-12-30", "2024-01-09", False))
def kpi_custom_range(spark, sf_dir):
    period = periods.custom_period(date(2024, 1, 10), date(2024, 1, 20), None, None, TODAY)
    return metrics.compared(classified(spark, sf_dir), period).select(*COMPARED)


@query(sql.compared("2024-01-20", "2024-01-26", "2024-01-13", "2024-01-19", False))
def kpi_one_sided(spark, sf_dir):
    bounds = feed.date_bounds(src.canonical(spark, sf_dir)).first()
    period = periods.custom_period(date(2024, 1, 20), None, bounds["earliest"], bounds["latest"], TODAY)
    return metrics.compared(classified(spark, sf_dir), period).select(*COMPARED)


@query(sql.WEEKLY_TREND)
def weekly_trend(spark, sf_dir):
    return metrics.weekly_trend(classified(spark, sf_dir), TODAY)


@query(sql.HISTOGRAM)
def score_histogram(spark, sf_dir):
    return metrics.score_histogram(src.canonical(spark, sf_dir))


@query(sql.SOURCE_BUCKETS)
def source_buckets(spark, sf_dir):
    return metrics.source_buckets(src.canonical(spark, sf_dir))


@query(sql.PROPERTY_METRICS)
def property_metrics(spark, sf_dir):
    return metrics.property_metrics(with_topics(spark, sf_dir), WEEK, src.properties(spark))


@query("SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return metrics.nearest_rank(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ("event_type",))


@query(f"{sql.REVIEWS} SELECT min(local_date) AS earliest, max(local_date) AS latest FROM rev")
def date_bounds(spark, sf_dir):
    return feed.date_bounds(src.canonical(spark, sf_dir))


@query(f"{sql.REVIEWS} SELECT positive_state, negative_state, band, sentiment, sentiment_rule, count(*) AS reviews FROM rev GROUP BY ALL")
def sentiment_rule_counts(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("positive_state", "negative_state", "band", "sentiment", "sentiment_rule").agg(F.count("*").alias("reviews"))


@query(f"{sql.REVIEWS} SELECT row_id, sentiment, has_negative_feedback FROM rev")
def sentiment_labels(spark, sf_dir):
    return classified(spark, sf_dir).select("row_id", "sentiment", "has_negative_feedback")


@query(sql.TOPIC_HITS)
def topic_hits(spark, sf_dir):
    text = F.concat_ws("\n", "positive_text", "negative_text")
    flags = [F.count_if(topics.mentions(t, text)).alias(t) for t, _ in topics.TOPICS]
    return src.canonical(spark, sf_dir).groupBy("property_key").agg(*flags)


@query(sql.REVIEW_TOPICS)
def review_topics(spark, sf_dir):
    return topics.unpivoted(with_topics(spark, sf_dir), ("row_id",))


@query(sql.TOPIC_EVIDENCE)
def topic_evidence(spark, sf_dir):
    said = with_topics(spark, sf_dir, evidence=True).select("row_id", F.explode_outer("topics").alias("t"))
    return said.select("row_id", "t.topic", F.explode_outer("t.evidence").alias("e")).filter("e IS NOT NULL").select("row_id", "topic", "e.*")


@query(sql.TOPIC_METRICS)
def topic_metrics(spark, sf_dir):
    return metrics.topic_metrics(with_topics(spark, sf_dir), WEEK, src.properties(spark))


@query(sql.TOP_TOPIC)
def topic_top_per_property(spark, sf_dir):
    return metrics.top_negative_topic(with_topics(spark, sf_dir), WEEK)


def _feed(spark, sf_dir, q: feed.FeedQuery, topical: bool = False) -> DataFrame:
    rows = (with_topics if topical else classified)(spark, sf_dir)
    rows = rows.withColumn("public_id", scalars.public_id(F.col("property_key"), F.col("token")))
    shown, total, pages, page = feed.page(rows, q)
    return shown.select("public_id", "row_id", "property_key", "local_date", "tenths", "sentiment", "helpful", F.lit(total).cast("long").alias("total"), F.lit(pages).cast("long").alias("pages"), F.lit(page).cast("long").alias("page"))


@query(sql.feed("epoch DESC, public_id", page=1))
def feed_newest(spark, sf_dir):
    return _feed(spark, sf_dir, feed.FeedQuery())


@query(sql.feed("epoch, public_id", page=3))
def feed_oldest(spark, sf_dir):
    return _feed(spark, sf_dir, feed.FeedQuery(sort="oldest", page=3))


@query(sql.feed("tenths DESC, epoch DESC, row_id", page=2))
def feed_highest(spark, sf_dir):
    return _feed(spark, sf_dir, feed.FeedQuery(sort="highest", page=2))


@query(sql.feed("tenths, epoch DESC, row_id", page=1, where="property_key IN ('view', 'click')"))
def feed_lowest(spark, sf_dir):
    return _feed(spark, sf_dir, feed.FeedQuery(sort="lowest", properties=("view", "click")))


@query(sql.feed("coalesce(helpful, 0) DESC, epoch DESC, row_id", page=1))
def feed_helpful(spark, sf_dir):
    return _feed(spark, sf_dir, feed.FeedQuery(sort="helpful"))


@query(sql.feed("epoch DESC, public_id", page=1, where="tenths BETWEEN 30 AND 90 AND sentiment IN ('mixed', 'negative') AND language = 'en' AND local_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"))
def feed_filters(spark, sf_dir):
    return _feed(spark, sf_dir, feed.FeedQuery(start=date(2024, 1, 5), end=date(2024, 1, 25), least_tenths=30, most_tenths=90, sentiments=("mixed", "negative"), language="en"))


@query(sql.feed("epoch DESC, public_id", page=1, where="contains(lower(concat_ws(chr(10), nullif(positive_text, ''), nullif(negative_text, ''), nullif(partner_reply, ''), nullif(language, ''), nullif(guest_type, ''), nullif(room, ''), nullif(property_key, ''))), 'street noise')"))
def feed_search(spark, sf_dir):
    return _feed(spark, sf_dir, feed.FeedQuery(search="Street Noise"))


@query(sql.feed("epoch DESC, public_id", page=1, where="row_id IN (SELECT row_id FROM top WHERE topic IN ('cleanliness', 'noise') GROUP BY 1 HAVING count(*) = 2)", topical=True))
def feed_topics(spark, sf_dir):
    return _feed(spark, sf_dir, feed.FeedQuery(topics=("cleanliness", "noise")), topical=True)


@query(f"{sql.REVIEWS} SELECT field, value FROM (SELECT DISTINCT 'language' AS field, language AS value FROM rev UNION SELECT DISTINCT 'guest_type', guest_type FROM rev UNION SELECT DISTINCT 'room', room FROM rev) WHERE trim(value) <> ''")
def filter_options(spark, sf_dir):
    return feed.filter_options(src.canonical(spark, sf_dir))


@query(sql.ALERTS)
def alerts(spark, sf_dir):
    # Written once: both metrics read the classified rows.
    rows = settled(with_topics(spark, sf_dir).select("row_id", "property_key", "epoch", "local_date", "tenths", "sentiment", "has_negative_feedback", "partner_reply", "topics"))
    dims = src.properties(spark)
    return metrics.alerts(metrics.property_metrics(rows, WEEK, dims), metrics.topic_metrics(rows, WEEK, dims), quality.quality_rows(values(spark, sf_dir, sql.EVIDENCE)))


@query(sql.QUALITY_ROWS)
def quality_rows(spark, sf_dir):
    return quality.quality_rows(values(spark, sf_dir, sql.MUCH_EVIDENCE))


@query(sql.OVERALL)
def overall_status(spark, sf_dir):
    return quality.overall(quality.quality_rows(values(spark, sf_dir, sql.MUCH_EVIDENCE)))


@query(sql.PUBLICATION_REASONS)
def publication_reasons(spark, sf_dir):
    rows = values(spark, sf_dir, sql.PUBLICATIONS)
    return rows.select("property_key", F.concat_ws(",", quality.publication_reasons()).alias("reasons"))


@query(f"SELECT n, CASE WHEN n >= 0 THEN least(5, CAST(floor(n * 0.01) AS INTEGER)) ELSE 0 END AS tolerated FROM {sql.COUNTS}")
def gap_tolerance(spark, sf_dir):
    return values(spark, sf_dir, sql.COUNTS).select("n", gaps.tolerance(F.col("n")).alias("tolerated"))


@query(sql.SHORTFALLS)
def bucket_shortfall(spark, sf_dir):
    return gaps.shortfalls(values(spark, sf_dir, sql.BUCKETS))


@query(sql.VISIBLE_GAP)
def visible_gap_eval(spark, sf_dir):
    return gaps.visible_gap(values(spark, sf_dir, sql.SHOWN), values(spark, sf_dir, sql.POLICY)).select("property_key", "gap", "verdict")


@query(sql.TOTALS_STATUS)
def totals_consistency(spark, sf_dir):
    rows = values(spark, sf_dir, sql.TOTALS)
    return rows.select("k", gaps.totals_status(F.col("unfiltered"), F.col("n"), F.array("a", "b", "c", "d")).alias("status"))


def inventory(spark: SparkSession, sf_dir: str, drop: int = 0, shift: int = 0, by: int = 0, more: tuple[str, ...] = ()) -> DataFrame:
    """A collected inventory: reviews but each ``drop``-th (none for 0); of each ``shift``-th the score is changed by ``by``; ``more`` names further columns."""
    r = src.canonical(spark, sf_dir)
    if drop:
        r = r.filter(F.col("row_id") % drop != 0)
    score = F.when(F.col("row_id") % shift == 0, F.col("tenths") + by).otherwise(F.col("tenths")) if shift else F.col("tenths")
    return r.select("property_key", "token", "row_id", "epoch", *more, score.cast("int").alias("tenths")).withColumn("record_hash", F.md5(F.concat_ws("|", "token", "tenths")))


@query(sql.INVENTORY_PARITY)
def inventory_parity(spark, sf_dir):
    newest = inventory(spark, sf_dir).filter((F.col("property_key") != "view") | (F.col("row_id") % 7 != 0))
    newest = newest.withColumn("record_hash", F.when((F.col("property_key") == "click") & (F.col("row_id") % 5 == 0), "changed").otherwise(F.col("record_hash")))
    return snapshots.inventory_parity(inventory(spark, sf_dir), newest)


@query("WITH f AS (SELECT event_id % 7 <> 0 AS l, event_id % 11 <> 0 AS r FROM events) SELECT count(*) FILTER (WHERE l AND r) AS shared, count(*) FILTER (WHERE l OR r) AS united, count(*) FILTER (WHERE l AND NOT r) AS left_only, count(*) FILTER (WHERE r AND NOT l) AS right_only, count(*) FILTER (WHERE l <> r) AS symmetric, count(*) FILTER (WHERE l <> r) = 0 AS parity FROM f")
def set_parity(spark, sf_dir):
    return snapshots.set_parity(inventory(spark, sf_dir, 7), inventory(spark, sf_dir, 11), ("property_key", "token"))


@query(sql.DIGESTS)
def inventory_digests(spark, sf_dir):
    return snapshots.inventory_digest(inventory(spark, sf_dir))


@query(sql.SNAPSHOT_DIFF)
def snapshot_diff(spark, sf_dir):
    changes = snapshots.compare(inventory(spark, sf_dir, 10), inventory(spark, sf_dir, 13, 17, 1))
    return changes.groupBy("property_key", "change").agg(F.count("*").alias("n"))


def _pages(spark, sf_dir) -> DataFrame:
    """Pages of ten reviews by row number; each 97th review comes on the next page too."""
    rows = inventory(spark, sf_dir).withColumn("page", F.floor(F.col("row_id") / 10))
    again = rows.filter(F.col("row_id") % 97 == 0).withColumn("page", F.col("page") + 1)
    return rows.unionByName(again)


@query(sql.RECONCILE)
def reconcile_run(spark, sf_dir):
    reported = inventory(spark, sf_dir).groupBy("property_key").agg((F.count("*") + (F.col("property_key") == "error").cast("int")).alias("reported"))
    return snapshots.reconcile(_pages(spark, sf_dir), reported)


@query(sql.MONOTONIC)
def page_monotonicity(spark, sf_dir):
    rows = inventory(spark, sf_dir)
    epoch = F.when(F.col("row_id") % 101 == 0, F.col("epoch") - 86400).otherwise(F.col("epoch"))
    pages = rows.select("property_key", F.lit("oldest").alias("phase"), F.floor(F.col("row_id") / 10).alias("page_offset"), (F.col("row_id") % 10).alias("card_index"), epoch.alias("epoch"), "row_id")
    return gaps.monotonic(pages, newest_first=False).select("property_key", "row_id")


@query(sql.DENSE_OFFSETS)
def dense_offsets(spark, sf_dir):
    pages = inventory(spark, sf_dir).select("property_key", F.lit("newest").alias("phase"), (F.floor(F.col("row_id") / 50) * 10).alias("page_offset")).distinct().filter("page_offset % 70 <> 60")
    return snapshots.dense_offsets(pages).select("property_key", "page_offset", F.col("expected_offset").cast("long").alias("expected_offset"))


@query(sql.REPEATED_PAGES)
def repeated_pages(spark, sf_dir):
    pages = inventory(spark, sf_dir).select("property_key", F.lit("newest").alias("phase"), (F.floor(F.col("row_id") / 50) * 10).alias("page_offset")).distinct().withColumn("page_hash", F.md5((F.col("page_offset") % 930).cast("string")))
    return snapshots.repeated_pages(pages).select("property_key", "page_offset", "first_offset")


def _tasks(spark, sf_dir) -> int:
    """Parts for four generations that meet in one task."""
    return parts(spark, 4 * spark.read.parquet(f"{sf_dir}/events.parquet").count())


def _generations(spark, sf_dir) -> DataFrame:
    tasks = _tasks(spark, sf_dir)
    one = snapshots.promote(None, inventory(spark, sf_dir, 10), 1, tasks=tasks)
    two = snapshots.promote(one, inventory(spark, sf_dir, 13, 17, 1), 2, tasks=tasks)
    return snapshots.promote(two, inventory(spark, sf_dir, 11, 19, 2), 3, tasks=tasks)


@query(sql.SCD2)
def scd2_promote(spark, sf_dir):
    return _generations(spark, sf_dir).groupBy("property_key", "version", "presence", "misses", "suspect_since", "tombstoned_at", "reactivations", "change").agg(F.count("*").alias("n"), F.sum("tenths").alias("tenths"))


@query(sql.TOMBSTONES)
def tombstone_lifecycle(spark, sf_dir):
    return metrics.publication_stats(snapshots.promote(_generations(spark, sf_dir), inventory(spark, sf_dir, 11), 4, tasks=_tasks(spark, sf_dir)))


@query(sql.BROKEN_STATES)
def generation_invariants(spark, sf_dir):
    """A generation of which some states were spoilt and some keys written twice."""
    g = _generations(spark, sf_dir)
    k = F.col("token").cast("long")
    g = g.withColumn("misses", F.when(k % 37 == 0, F.col("misses") + 5).otherwise(F.col("misses")))
    # Written: the union and both rules read it, and each would make the generations anew.
    g = settled(g.select(*snapshots.KEYS, "presence", "misses"))
    return snapshots.invariants(g.unionByName(g.filter((k % 41 == 0) & (k % 37 > 0))), _tasks(spark, sf_dir))


@query("SELECT event_id AS row_id, substr(sha256(event_type || ':' || CAST(event_id AS VARCHAR)), 1, 24) AS public_id FROM events")
def public_ids(spark, sf_dir):
    return src.canonical(spark, sf_dir).select("row_id", scalars.public_id(F.col("property_key"), F.col("token")).alias("public_id"))


@query(f"{sql.REVIEWS} SELECT property_key, count(*) AS contents, CAST(sum(n) AS BIGINT) AS reviews FROM (SELECT property_key, tenths, positive_text, negative_text, partner_reply, count(*) AS n FROM rev GROUP BY ALL HAVING count(*) > 1) GROUP BY 1")
def content_hash_dups(spark, sf_dir):
    hashed = snapshots.content_hash(F.col("tenths"), F.col("positive_text"), F.col("negative_text"), F.col("partner_reply"))
    per = src.canonical(spark, sf_dir).groupBy("property_key", hashed.alias("content_hash")).agg(F.count("*").alias("n")).filter("n > 1")
    return per.groupBy("property_key").agg(F.count("*").alias("contents"), F.sum("n").alias("reviews"))


@query(sql.CATEGORY_PIVOT)
def category_pivot(spark, sf_dir):
    out = export.category_pivot(values(spark, sf_dir, sql.CATEGORIES), ("staff", "comfort", "free_wifi"))
    return out.withColumn("other", F.to_json("other"))


@query(sql.CATEGORY_KEYS)
def category_keys(spark, sf_dir):
    return values(spark, sf_dir, sql.LABELS).select("k", "label", scalars.category_key(F.col("label"), {"free wifi": "free_wifi", "value for money": "value"}).alias("category"))


def _records(spark, sf_dir) -> DataFrame:
    return export.safe_records(src.canonical(spark, sf_dir), src.properties(spark))


@query(sql.EXPORT_SAMPLE)
def export_sample(spark, sf_dir):
    return export.sample(_records(spark, sf_dir), 5).select("property_key", "review_id", "local_date", "score")


@query(sql.CSV_LINES)
def export_csv_lines(spark, sf_dir):
    return export.csv_lines(_records(spark, sf_dir), ("property_key", "property_name", "hotel_id", "review_id", "local_date", "positive_text", "negative_text", "partner_reply", "helpful", "room"))


@query(sql.MANIFEST)
def export_manifest(spark, sf_dir):
    return export.manifest(_records(spark, sf_dir)).drop("average")


def _spoiled(spark, sf_dir) -> DataFrame:
    """Export records with known faults."""
    k = F.col("row_id")
    return _records(spark, sf_dir).withColumns({
        "hotel_id": F.when(k % 101 == 0, 0).otherwise(F.col("hotel_id")),
        "review_id": F.when(k % 103 == 0, "not-an-id").when(k % 107 == 0, "0" * 24).otherwise(F.col("review_id")),
        "score": F.when(k % 109 == 0, 10.5).otherwise(F.col("score")),
        "local_date": F.when(k % 113 == 0, F.date_add("local_date", 1)).otherwise(F.col("local_date")),
        "helpful": F.when(k % 127 == 0, -1).otherwise(F.col("helpful")),
    })


@query(sql.AUDIT_ISSUES)
def audit_issues(spark, sf_dir):
    return export.issue_counts(export.audited(_spoiled(spark, sf_dir), src.properties(spark), src.ZONE))


@query(sql.AUDIT_READINESS)
def audit_readiness(spark, sf_dir):
    return export.readiness(export.audited(_spoiled(spark, sf_dir), src.properties(spark), src.ZONE))


@query(sql.PHOTO_URLS)
def canonical_photo_urls(spark, sf_dir):
    return values(spark, sf_dir, sql.URLS).select("k", "url", scalars.canonical_photo(F.col("url")).alias("canonical"))


@query(sql.REDACTED)
def redact_urls(spark, sf_dir):
    return values(spark, sf_dir, sql.SECRET_TEXTS).select("k", scalars.redacted(F.col("t")).alias("shown"))


@query("SELECT 'detail.value:value' AS path, count(*) AS n FROM events WHERE event_id % 9 = 0 AND value <> -1 HAVING count(*) > 0")
def record_diff_paths(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    record = lambda score: F.to_json(F.struct("event_id", F.struct(score.alias("value"), "event_type").alias("detail"), F.array("user_id").alias("users")))
    pairs = e.select(record(F.col("value")).alias("before"), record(F.when(F.col("event_id") % 9 == 0, F.lit(-1.0)).otherwise(F.col("value"))).alias("after"))
    return export.diff_report(pairs)


@query(sql.WEEK_COLUMNS)
def local_weeks(spark, sf_dir):
    r = src.canonical(spark, sf_dir)
    return r.groupBy(periods.week_start(periods.local_date(F.col("epoch"), src.ZONE)).alias("week"), scalars.tone(F.col("tenths") / 10).alias("tone")).agg(F.count("*").alias("n"))


@query(sql.LEFT_JOINED)
def labelled_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"))


def _tables(spark, sf_dir) -> tuple[DataFrame, ...]:
    """Stored tables as the adapter's reviews would fill them: one property disabled, one unpublished, some reviews gone."""
    r = src.canonical(spark, sf_dir)
    props = src.properties(spark).withColumn("enabled", F.col("property_key") != "error")
    published = props.filter("property_key <> 'signup'").select("property_key", F.concat(F.lit("run-"), "property_key").alias("run_id"), F.lit(3).alias("generation"))
    held = r.select("row_id", "property_key", F.when(F.col("row_id") % 10 == 0, "suspect_missing").when(F.col("row_id") % 11 == 0, "tombstoned").otherwise("present").alias("presence"))
    versions = r.select("row_id", "property_key", "epoch", "tenths", F.lit(True).alias("is_current")).unionByName(r.filter("row_id % 5 = 0").select("row_id", "property_key", "epoch", (F.col("tenths") - 1).alias("tenths"), F.lit(False).alias("is_current")))
    return props, published, held, versions


@query(sql.ACCEPTED_REVIEWS)
def accepted_reviews(spark, sf_dir):
    props, published, held, versions = _tables(spark, sf_dir)
    return publications.fact_scan(props, published, held, versions).select("row_id", "property_key", "epoch", "tenths")


@query(sql.PUBLICATION_SCAN)
def publication_scan(spark, sf_dir):
    props, published, _, _ = _tables(spark, sf_dir)
    side = lambda name, where: published.filter(where).select("run_id", F.length("run_id").alias(name))
    out = publications.dimension_scan(props, published, side("parser", "true"), side("displayed", "true"), side("oldest", "property_key <> 'click'"), side("gap", "property_key = 'view'"), side("visible", "false"))
    return out.select("property_key", "hotel_id", "generation", "parser", "displayed", "oldest", "gap", "visible")


@query(sql.CURRENT_REVIEWS)
def current_reviews(spark, sf_dir):
    facts = publications.fact_scan(*_tables(spark, sf_dir))
    return publications.current_reviews(facts, "view").select("row_id", "epoch", "tenths")


def _phase_pages(spark, sf_dir) -> DataFrame:
    """Pages of a phase with faults: a gap after every seventh, moved counts, repeated hashes."""
    rows = inventory(spark, sf_dir).select("property_key", (F.floor(F.col("row_id") / 50) * 10).alias("page_offset")).groupBy("property_key", "page_offset").agg(F.count("*").alias("n_cards"))
    reported = F.when(F.col("page_offset") % 1930 == 1920, 101).otherwise(100)
    return rows.filter("page_offset % 170 <> 160").select("property_key", F.lit("newest").alias("phase"), "page_offset", F.lit(10).alias("page_limit"), "n_cards", reported.alias("reported"), F.md5((F.col("page_offset") % 1310).cast("string")).alias("page_hash"))


@query(sql.PAGE_VIOLATIONS)
def page_violations(spark, sf_dir):
    return checks.page_violations(_phase_pages(spark, sf_dir)).groupBy("property_key", "code").agg(F.count("*").alias("n"))


@query(sql.CARD_VIOLATIONS)
def card_violations(spark, sf_dir):
    rows = inventory(spark, sf_dir).select("property_key", F.lit("oldest").alias("phase"), F.floor(F.col("row_id") / 10).alias("page_offset"), (F.col("row_id") % 10).alias("card_index"), "token", "epoch", "tenths", "record_hash")
    again = rows.filter("token % 89 = 0").withColumns({"card_index": F.col("card_index") + 100, "record_hash": F.when(F.col("token") % 178 == 0, "changed").otherwise(F.col("record_hash"))})
    return checks.card_violations(rows.unionByName(again), newest_first=False).groupBy("property_key", "code").agg(F.count("*").alias("n"))


@query(sql.FINALIZED)
def finalize_runs(spark, sf_dir):
    return checks.finalized(values(spark, sf_dir, sql.PHASES), values(spark, sf_dir, sql.STAGED))


@query(sql.REGISTERED)
def register_properties(spark, sf_dir):
    return checks.register(values(spark, sf_dir, sql.EXISTING), values(spark, sf_dir, sql.INCOMING))


@query(sql.PHOTO_CHANGES)
def photo_changes(spark, sf_dir):
    return checks.photo_changes(values(spark, sf_dir, sql.PHOTO_PAIRS))


@query(sql.MANIFEST_PROBLEMS)
def manifest_problems(spark, sf_dir):
    declared = export.manifest(_records(spark, sf_dir)).select("property_key", (F.col("records") + (F.col("property_key") == "click").cast("int")).alias("records"), "earliest", F.when(F.col("property_key") == "view", F.date_add("latest", 1)).otherwise(F.col("latest")).alias("latest"))
    return checks.manifest_problems(declared.filter("property_key <> 'error'"), _records(spark, sf_dir))


@query(sql.NOTABLE_WEEKS)
def notable_weeks(spark, sf_dir):
    return display.notable_weeks(metrics.weekly_trend(classified(spark, sf_dir), TODAY))


@query(sql.RANKED_TOPICS)
def ranked_topics(spark, sf_dir):
    rows = display.ranked_topics(metrics.topic_metrics(with_topics(spark, sf_dir), WEEK, src.properties(spark)))
    return rows.select("topic", display.percent_text(F.col("negative_share"), 1).alias("share"), "trend")


@query(sql.INCREMENTAL_STOP)
def incremental_stop(spark, sf_dir):
    pages = inventory(spark, sf_dir).groupBy("property_key", F.floor(F.col("row_id") / 50).alias("page_offset")).agg(F.max("epoch").alias("newest_epoch"), (F.min("row_id") % 3 > 0).alias("all_known"))
    return snapshots.stop_incremental(pages, 1705300000)
