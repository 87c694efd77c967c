"""A whole query over three reviews, with the values worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import export, feed
from reviewlake.plans.dashboard import ReviewEngine

SCHEMA = "row_id long, property_key string, token string, epoch long, local_date date, tenths int, positive_text string, negative_text string, partner_reply string, language string, guest_type string, room string, helpful long"
ROWS = [
    (1, "p", "a", 1785200000, date(2026, 7, 28), 90, "Very clean", None, "Thanks", "en", "couple", None, 2),
    (2, "p", "b", 1785300000, date(2026, 7, 29), 60, None, "Dirty room", "", "en", None, "Studio", None),
    (3, "p", "c", 1784700000, date(2026, 7, 22), 80, "Great location", None, None, "de", "couple", None, 5),
]

#: Evidence of eight properties: one for each step of the ladder.
EVIDENCE = """(VALUES
    (0, 'ok', 'r1', 10, 10, 'a', 'a', 'x', 'x', 10, 10, 10, 10, false, false, false, false),
    (1, 'none', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, NULL, NULL, NULL, false, false, false, false),
    (2, 'ids', 'r1', 10, 10, 'a', 'b', 'x', 'x', 10, 10, 10, 10, false, false, false, false),
    (3, 'both', 'r1', 10, 10, 'a', 'a', 'x', 'x', 10, 12, 10, 10, true, true, true, true),
    (4, 'gap', 'r1', 500, 500, 'a', 'a', 'x', 'x', 500, 503, 500, 500, true, true, false, false),
    (5, 'gap_present', 'r1', 500, 500, 'a', 'a', 'x', 'x', 499, 503, 500, 500, true, true, false, false),
    (6, 'shown', 'r1', 500, 500, 'a', 'a', 'x', 'x', 500, 504, 500, 500, false, false, true, true),
    (7, 'also_ok', 'r2', 0, 0, 'e', 'e', 'e', 'e', 0, 0, 0, 0, false, false, false, false)
) AS t(ordinal, property_key, published_run, oldest_count, newest_count, oldest_ids, newest_ids, oldest_records, newest_records, present, displayed, structured, final_count, gap_attested, gap_valid, visible_attested, visible_valid)"""


@pytest.fixture(scope="module")
def engine(spark):
    properties = spark.createDataFrame([(0, "p", "Place", 1), (1, "q", "Quiet", 2)], "ordinal int, property_key string, property_name string, hotel_id int")
    e = ReviewEngine(properties, spark.sql(f"SELECT * FROM {EVIDENCE}"))
    facts = e.load(spark.createDataFrame(ROWS, SCHEMA), 1)
    assert e.load(None, 1) is facts
    yield e
    e.close()


def test_default_week(engine):
    s = engine.sections(feed.FeedQuery(), date(2026, 7, 31))
    o = s.overview.first()
    assert (o.current_count, o.current_average, o.previous_count, o.average_delta, o.direction) == (2, 7.5, 1, -0.5, "down")
    assert (o.current_negative, o.current_negative_feedback, o.current_responses) == (1, 1, 1)
    clean = s.topics.filter("topic = 'cleanliness'").first()
    assert (clean.negative_share, clean.all_mentions, clean.leading_property, clean.trend) == (100.0, 2, "Place", "unavailable")
    empty = s.properties.filter("property_key = 'q'").first()
    assert (empty.reviews, empty.current_count, empty.negative_share, empty.top_topic) == (0, 0, None, None)
    assert [r.alert for r in s.alerts.collect()][:2] == ["rating:p", "topic:cleanliness"] and s.trend.count() == 12
    assert {r.bucket: r.reviews for r in s.histogram.collect()} == {"9+": 1, "7-9": 1, "5-7": 1, "3-5": 0, "0-3": 0}
    assert "token" not in s.feed.columns and s.status.first().overall == "error"


def test_one_sided_and_combined(engine):
    s = engine.sections(feed.FeedQuery(start=date(2026, 7, 29)), date(2026, 7, 31))
    assert (s.period.current_start, s.period.current_end) == (date(2026, 7, 29), date(2026, 7, 29)) and s.total == 1
    s = engine.sections(feed.FeedQuery(topics=("cleanliness",), search="DIRTY", language="en"), date(2026, 7, 31))
    assert (s.total, [r.tenths for r in s.feed.collect()]) == (1, [60])
    assert engine.sections(feed.FeedQuery(topics=("cleanliness", "noise")), date(2026, 7, 31)).total == 0


def test_redacted_json(spark):
    rows = spark.createDataFrame([('{"a": {"Token": "x", "u": "https://h/?sid=1&session=2"}, "b": [1]}',), ("{",), (None,)], "t string")
    assert [r[0] for r in rows.select(export.redacted_json(F.col("t"))).collect()] == ['{"a":{"Token":"[REDACTED]","u":"https://h/?sid=[REDACTED]&session=[REDACTED]"},"b":[1]}', "[REDACTED]", None]
