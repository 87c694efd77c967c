"""What the third review found: work that was planned more than once, and a job that had become smaller."""

from pyspark.sql import functions as F

from reviewlake.operators import audit, export, feed, sentiment, topics
from reviewlake.plans import evidence, registry
from reviewlake.sources import contract
from reviewlake.sources import reviews as src

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Optimized Logical Plan ==")[1]


def test_bodies_are_read_once(spark):
    raw = spark.createDataFrame([('{"data":{"reviewListFrontend":{"reviewCard":[]}}}',)], "body string")
    for found in (contract.checked_metadata(raw), contract.checked_cards(raw)):
        optimized = plan(found).split("== Physical Plan ==")[0]
        assert 1 <= optimized.lower().count("parsejson") + optimized.lower().count("parse_json") <= 2
        # No leaf is checked in a lambda, which Spark interprets.
        assert "filled text" not in optimized


def test_photo_urls_end_as_in_expressions(spark):
    spec = contract.Array(contract.URL)
    urls = ["https://cf.photos.example.com/1.jpg", "https://CF.photos.example.com", "http://cf.photos.example.com/1", "https://a@cf.photos.example.com/", "https://photos.example.com.evil/1", "https://photos.example.com:8/?a b"]
    for url in urls:
        v = F.to_json(F.array(F.lit(url)))
        good = spark.range(1).select(contract.canonical_photo(F.lit(url)).isNotNull()).first()[0]
        assert (spark.range(1).select(contract.violations(F.parse_json(v), spec)).first()[0] == []) == good


def test_a_filter_on_topics_classifies_nothing_again(spark):
    rows = topics.with_topics_once(sentiment.with_sentiment(src.canonical(spark, SF)), ("property_key", "token"))
    assert "zip_with" not in plan(feed.filtered(rows, feed.FeedQuery(topics=("noise",))))


def test_records_do_not_meet_in_a_task_of_their_property(spark):
    for records in (export.full_records(evidence.cards(spark, SF), src.properties(spark)), export.safe_records(src.canonical(spark, SF), src.properties(spark))):
        assert "SortMergeJoin" not in plan(records)


def test_lines_are_audited_once(spark):
    lines = spark.createDataFrame([(1, "{}"), (2, "")], "line_no long, value string")
    found, counts = audit.audited_export(lines, spark.createDataFrame([("{}",)], "value string"), src.properties(spark), src.ZONE)
    assert "record.reviewedAtUtc" not in plan(found) and counts.first().jsonl_rows == 1


def test_sections_count_eight_cases_of_evidence(spark):
    found = {r.section: r.figure for r in registry.QUERIES["dashboard_sections"](spark, SF).collect()}
    assert found["quality"] == 8
