"""Responses, exports, their audit, and order within keys of any size."""

import json
import random

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import variants as V
from reviewlake.operators import audit, export, inventory, metrics, ranges
from reviewlake.sources import contract

ZONE = "Australia/Sydney"
PROPERTIES = "(VALUES ('a', 'A', 1), ('b', 'B', 2)) AS t(property_key, property_name, hotel_id)"


def record(**changes) -> dict:
    out = {
        "propertyKey": "a", "propertyName": "A", "bookingHotelId": 1, "reviewId": "0123456789abcdef01234567", "reviewedEpoch": 1704027600, "reviewedAtUtc": "2023-12-31T13:00:00.000Z", "reviewedLocalDate": "2024-01-01", "score": 8.5, "title": None, "positiveText": "x",
        "negativeText": None, "sourceLanguage": "en", "partnerReply": None, "helpfulVotesCount": None, "bookingDetails": None, "guestDetails": {"username": "u"}, "photos": [{"id": 1, "urls": [{"size": "s", "url": "https://photo-cdn.invalid/x?k=1"}]}],
        "highlights": {"positive": [], "negative": []}, "textTrivialFlag": 0, "isApproved": True, "isTranslatable": None,
    }
    return out | changes


def audited(spark, texts):
    lines = spark.createDataFrame(list(enumerate(texts)), "line_no long, value string")
    rows = audit.audited_records(lines, spark.sql(f"SELECT * FROM {PROPERTIES}"), ZONE).orderBy("line_no").collect()
    return [(sorted({(i.code, i.field.removeprefix("record").lstrip(".")) for i in r.issues if not i.code.startswith("ANALYTICS")}), r.weekly_ready, r.property_ready, r.feed_ready) for r in rows]


CASES = [
    (record(), [], True, True, True),
    (record(extra=1), [("RECORD_SCHEMA_MISMATCH", "")], False, False, False),
    ({k: v for k, v in record().items() if k != "title"}, [("RECORD_SCHEMA_MISMATCH", "")], False, False, False),
    (record(guestDetails={"Session-ID": 1}), [("PRIVACY_FIELD_PRESENT", "")], False, False, False),
    (record(title='say "token": "x"'), [], True, True, True),
    (record(guestDetails={"pageUrl": ["https://x.example/?SID=1"]}), [("SESSION_DATA_PRESENT", "")], False, False, False),
    (record(guestDetails={"link": "https://u:p@x.example/"}), [("SESSION_DATA_PRESENT", "")], False, False, False),
    (record(positiveText="https://x.example/?sid=1"), [], True, True, True),
    (record(propertyKey="b"), [("PROPERTY_IDENTITY_MISMATCH", "property")], False, False, False),
    (record(propertyKey=None), [("PROPERTY_IDENTITY_MISMATCH", "property")], False, False, False),
    (record(reviewId="0123456789ABCDEF01234567"), [("PUBLIC_REVIEW_ID_INVALID", "reviewId")], False, True, False),
    (record(score="8"), [("SCORE_INVALID", "score")], False, False, False),
    (record(score=8.25), [("SCORE_INVALID", "score")], False, False, False),
    (record(score=8), [], True, True, True),
    (record(reviewedLocalDate="2023-12-31"), [("SYDNEY_LOCAL_DATE_INVALID", "reviewedLocalDate")], False, True, False),
    (record(reviewedEpoch=None), [("SYDNEY_LOCAL_DATE_INVALID", "reviewedLocalDate"), ("UTC_TIMESTAMP_INVALID", "reviewedAtUtc")], False, True, False),
    (record(reviewedAtUtc="2023-12-31T13:00:00Z"), [("UTC_TIMESTAMP_INVALID", "reviewedAtUtc")], True, True, False),
    (record(title=5, isApproved="yes", helpfulVotesCount=-1, textTrivialFlag=0.5, bookingDetails=[], highlights=None), [("FEED_FIELD_INVALID", f) for f in ("bookingDetails", "helpfulVotesCount", "highlights", "isApproved", "textTrivialFlag", "title")], True, True, False),
    (record(photos=None), [("PHOTO_URL_NOT_CANONICAL", "photos")], True, True, False),
    (record(photos=[{"urls": [{"url": "https://photo-cdn.invalid.example/x"}, {"url": 5}]}, {"urls": None}]), [("PHOTO_URL_NOT_CANONICAL", "photos"), ("PHOTO_URL_NOT_CANONICAL", "photos[].urls[].url")], True, True, False),
    ([1], [("RECORD_SCHEMA_MISMATCH", "")], False, False, False),
]


def test_each_fault_of_a_record_is_found(spark):
    texts = []
    for n, (r, *_) in enumerate(CASES):
        if isinstance(r, dict) and r.get("reviewId", "").islower():
            r = r | {"reviewId": f"{n:024x}"}
        texts.append(json.dumps(r))
    assert audited(spark, texts) == [(issues, *ready) for _, issues, *ready in CASES]


def test_the_first_of_repeated_ids_is_valid(spark):
    got = audited(spark, [json.dumps(record())] * 3)
    assert got[0] == ([], True, True, True) and got[1:] == [([("PUBLIC_REVIEW_ID_DUPLICATE", "reviewId")], False, True, False)] * 2


def manifest(**changes) -> dict:
    p = {"propertyKey": "a", "bookingHotelId": 1, "publishedRunId": "r", "publicationGeneration": 1, "parserVersion": audit.PARSER, "totalPublishedReviews": 1, "exportedReviews": 1, "currentAverageScore": 8.5, "authoritativeFullPublication": True, "advertisedReviews": 1, "retrievableReviews": 1, "sourceReviewGap": 0, "sourceDiscrepancyKind": None, "sourceDiscrepancyScoreBucket": None, "advertisedBucketReviews": None, "retrievableBucketReviews": None}
    b = p | {"propertyKey": "b", "bookingHotelId": 2, "totalPublishedReviews": 0, "exportedReviews": 0, "currentAverageScore": None, "advertisedReviews": 0, "retrievableReviews": 0}
    of_a = {k[2:]: v for k, v in changes.items() if k.startswith("a_")}
    whole = {"generatedAt": "2024-01-01T00:00:00.000Z", "mode": "all_current_reviews", "samplePerProperty": None, "strictAll": True, "requestedPropertyCount": 2, "omittedPropertyKeys": [], "properties": [p | of_a, b], "totalRecords": 1}
    return whole | {k: v for k, v in changes.items() if not k.startswith("a_")}


GAP = {"a_totalPublishedReviews": 500, "a_exportedReviews": 500, "a_retrievableReviews": 500, "a_advertisedReviews": 503, "a_sourceReviewGap": 3}
MANIFESTS = [
    ({}, set()),
    ({"mode": "sample"}, {"MANIFEST_NOT_PRODUCTION"}),
    ({"generatedAt": "today"}, {"MANIFEST_FIELD_INVALID"}),
    ({"totalRecords": 2}, {"MANIFEST_TOTAL_MISMATCH"}),
    ({"properties": []}, {"MANIFEST_PROPERTY_COVERAGE_MISMATCH", "MANIFEST_PROPERTY_COUNT_MISMATCH", "MANIFEST_TOTAL_MISMATCH", "MANIFEST_PROPERTY_AVERAGE_MISMATCH"}),
    ({"other": 1}, {"MANIFEST_SCHEMA_MISMATCH"}),
    ({"a_bookingHotelId": 9}, {"MANIFEST_PROPERTY_COVERAGE_MISMATCH"}),
    ({"a_parserVersion": "1"}, {"MANIFEST_PROPERTY_INVALID"}),
    ({"a_currentAverageScore": 8.4}, {"MANIFEST_PROPERTY_AVERAGE_MISMATCH"}),
    ({"a_advertisedReviews": 2}, {"MANIFEST_SOURCE_COUNT_MISMATCH"}),
    (GAP | {"a_sourceDiscrepancyKind": audit.SOURCE_GAP, "a_sourceDiscrepancyScoreBucket": "REVIEW_ADJ_GOOD", "a_advertisedBucketReviews": 10, "a_retrievableBucketReviews": 8}, {"MANIFEST_PROPERTY_COUNT_MISMATCH", "MANIFEST_TOTAL_MISMATCH"}),
    (GAP | {"a_sourceDiscrepancyKind": audit.SOURCE_GAP, "a_sourceDiscrepancyScoreBucket": "REVIEW_ADJ_GOOD", "a_advertisedBucketReviews": 10, "a_retrievableBucketReviews": 6}, {"MANIFEST_PROPERTY_COUNT_MISMATCH", "MANIFEST_TOTAL_MISMATCH", "MANIFEST_SOURCE_COUNT_MISMATCH"}),
    (GAP | {"a_sourceDiscrepancyKind": audit.VISIBLE_GAP}, {"MANIFEST_PROPERTY_COUNT_MISMATCH", "MANIFEST_TOTAL_MISMATCH"}),
]


def test_each_fault_of_a_manifest_is_found(spark):
    lines = spark.createDataFrame([(0, json.dumps(record()))], "line_no long, value string")
    policy = spark.createDataFrame([("a", 1, 5)], "property_key string, hotel_id int, most_gap int")
    for changes, codes in MANIFESTS:
        text = spark.createDataFrame([(json.dumps(manifest(**changes)),)], "value string")
        errors, counts = audit.audited_export(lines, text, spark.sql(f"SELECT * FROM {PROPERTIES}"), ZONE, policy)
        assert {r.code for r in errors.collect()} == codes, changes
    assert tuple(counts.first()) == (1, 1, 1, 1, 1, 1)


@pytest.mark.parametrize("text,kind,count", [("1", "NUMBER", True), ("1.0", "NUMBER", True), ("1.5", "NUMBER", False), ("-1", "NUMBER", False), ("1e30", "NUMBER", False), ('"1"', "STRING", False), ("null", "VOID", False), ("true", "BOOLEAN", False), ("[]", "ARRAY", False), ("{}", "OBJECT", False)])
def test_kinds(spark, text, kind, count):
    assert tuple(spark.range(1).select(F.try_parse_json(F.lit(text)).alias("v")).select(V.kind(F.col("v")), V.is_count(F.col("v"))).first()) == (kind, count)


def test_spec_of_nested_values(spark):
    spec = contract.Object("T", ("__typename", "a"), {"a": contract.Array(contract.COUNT, unique=None), "b": contract.TEXT_}, nullable=False)
    texts = {'{"__typename":"T","a":[1,2],"b":null}': [], '{"__typename":"T"}': ["missing a"], '{"__typename":"U","a":[1,"x",-1]}': ["a[]:count", "type name"], "5": ["object"], "null": ["object"], '{"__typename":"T","a":{},"b":7}': ["a:array", "b:text"]}
    for text, expected in texts.items():
        assert spark.range(1).select(contract.violations(F.parse_json(F.lit(text)), spec)).first()[0] == expected


@pytest.mark.parametrize("parts", ["1", "3", "16"])
def test_order_within_keys_of_any_size(spark, parts):
    """One key has most rows, others few; nulls are a key, too."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        r = random.Random(4)
        rows = [("hot", n, r.choice([None, n])) for n in range(300)] + [(k, n, n) for k in "abc" for n in range(2)]
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "k string, n long, v long")
        assert {(x.k, x.n): x.place for x in ranges.numbered(df, ("k",), ("n",), "place").collect()} == {(k, n): n for k, n, _ in rows}
        value = {(k, n): v for k, n, v in rows}
        got = ranges.with_previous(df, ("k",), ("n",), {"n": "m", "v": "w"}).collect()
        assert all((x.m, x.w) == ((x.n - 1, value[x.k, x.n - 1]) if x.n else (None, None)) for x in got) and len(got) == len(rows)
        figures = metrics.nearest_rank(df, "n", ("k",)).filter("k = 'hot'").first()
        assert (figures.n, figures.p50, figures.p95, figures.p99, figures.least, figures.most) == (300, 149, 284, 296, 0, 299)
        assert ranges.numbered(df.limit(0), ("k",), ("n",), "place").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sinks(spark, tmp_path):
    reviews = spark.createDataFrame([("a", "t1", 1704027600, 85, "yes", None, "en", None, 2, 1, json.dumps({"guestDetails": None, "bookingDetails": {"numNights": 2.5, "roomType": {"id": 1, "name": 'R "x"'}}, "photos": []}))], "property_key string, token string, epoch long, tenths int, positive_text string, negative_text string, language string, partner_reply string, helpful long, row_id long, card_json string").withColumn("local_date", F.to_date(F.lit("2024-01-01")))
    records = export.full_records(reviews, spark.sql(f"SELECT * FROM {PROPERTIES}"))
    assert tuple(records.columns[:21]) == audit.RECORD_KEYS
    export.write_json_lines(records, str(tmp_path / "x"))
    (text,) = [r.value for r in spark.read.text(str(tmp_path / "x")).collect()]
    got = json.loads(text)
    assert set(got) == set(audit.RECORD_KEYS) and got["guestDetails"] is None and got["bookingDetails"]["numNights"] is None
    line = export.flat_lines(records).first()[0]
    assert line == f'"a","A","1","{got["reviewId"]}","2024-01-01","8.5",,"yes",,"en",,"2","R ""x""",,,,'
    assert audited(spark, [text])[0] == ([], True, True, True)


def test_replays_and_failures(spark):
    held = spark.sql("SELECT * FROM (VALUES ('r', 0, 'h', 2)) AS t(run_id, page_offset, page_hash, n_cards)")
    assert [x.outcome for x in inventory.staged(held, held).collect()] == ["REPLAYED"]
    assert [x.outcome for x in inventory.staged(held, held.withColumn("n_cards", F.lit(3))).collect()] == ["CONFLICT"]


def test_escaped_keys_and_urls_are_seen(spark):
    rows = spark.createDataFrame([(r'{"token":"x"}',), (r'{"photoUrl":"https:\/\/a.b\/?sid=1"}',), ('{"name":"token"}',), ("{",)], "t string")
    assert [tuple(r) for r in rows.select(audit.forbidden_keys(F.col("t")), audit.session_urls(F.col("t"))).collect()][:3] == [(True, False), (False, True), (False, False)]


def test_secrets_words_urls_and_headers_are_masked(spark):
    text = '{"secret":"v","accessToken":"t","myPassword":"p","sid":"z","u":"https://a.b/?sid=1&aid=2&label=x&page=3","reviewUrl":"r","title":"t","log":"Cookie = a=b","n":1,"positiveText":"words"}'
    rows = spark.createDataFrame([(text,), ('{"a":' * 21 + "1" + "}" * 21,)], "t string")
    shown, deep = (r[0] for r in rows.select(export.redacted_json(F.col("t"))).collect())
    m = "[REDACTED]"
    assert json.loads(shown) == {"secret": m, "accessToken": m, "myPassword": m, "sid": m, "u": f"https://a.b/?sid={m}&aid={m}&label={m}&page=3", "reviewUrl": m, "title": m, "log": f"Cookie: {m}", "n": 1, "positiveText": m}
    assert "[MaxDepth]" in deep
    assert rows.limit(1).select(export.sensitive_paths(F.col("t"))).first()[0] == ["accessToken", "myPassword", "reviewUrl", "secret", "sid", "u:url"]
