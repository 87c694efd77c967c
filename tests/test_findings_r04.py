"""What the fourth review found too slow for large tables: kinds of values worked out over and over for each line of an export."""

import json
import random

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from reviewlake.operators import audit, export
from reviewlake.plans import evidence
from reviewlake.sources import reviews as src

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_not_typed_value_by_value(spark, monkeypatch):
    monkeypatch.setattr(audit, "settled", lambda df: df)
    assert "schemaOfVariant" not in plan(audit.audited_lines(spark.createDataFrame([(1, "{}")], "line_no long, value string"), src.properties(spark), src.ZONE))


def test_cards_are_not_typed_value_by_value(spark):
    # The nights of a booking, which alone need the kind of a value.
    assert plan(export.full_records(evidence.cards(spark, SF), src.properties(spark))).count("schemaOfVariant") == 1
    # Lines without a fault pass no pattern, the others only their own.
    made = plan(evidence.export_lines(spark, SF))
    assert made.count("regexp_replace(") == 1 and " OR " in made.split("regexp_replace(")[0]


def test_the_walk_finds_what_the_expressions_find(spark):
    r = random.Random(5)
    keys = ["token", "Set-Cookie", "a", "photoUrl", "page_URI", "Link", "x", "tokens", 'say "token"', "sesſion"]
    texts = ["https://u:p@x.example/", "https://x.example/?a=1&SID=2", "https://x.example/?sidx=1", "HTTPS://x.example/?a&token#b", "/?sid=1", "https://x.example/#?sid=1", "token", "https://x.example/@", 'a\\"b', "é\n"]

    def value(depth: int):
        kind = r.random()
        if depth and kind < 0.3:
            return {k: value(depth - 1) for k in r.sample(keys, r.randrange(4))}
        return [r.choice(texts) for _ in range(r.randrange(3))] if kind < 0.4 else r.choice([*texts, None, True, 1.5])

    whole = [{k: value(3) for k in r.sample(keys, 3)} for _ in range(400)]
    rows = spark.createDataFrame([(json.dumps(x),) for x in whole], "t string")
    found = [tuple(x) for x in rows.select(audit.forbidden_keys(F.col("t")), audit.session_urls(F.col("t"))).collect()]
    assert found == [audit._sensitive(x) for x in whole] and len(set(found)) == 4


def test_odd_lines(spark):
    good = {
        "propertyKey": "view", "propertyName": "Harbour View Suites", "bookingHotelId": 101, "reviewId": "0123456789abcdef01234567", "reviewedEpoch": 1704027600, "reviewedAtUtc": "2023-12-31T13:00:00.000Z", "reviewedLocalDate": "2024-01-01", "score": 8.5,
        **dict.fromkeys(("title", "positiveText", "negativeText", "sourceLanguage", "partnerReply", "helpfulVotesCount", "bookingDetails", "guestDetails", "textTrivialFlag", "isApproved", "isTranslatable")), "photos": [], "highlights": {"positive": [], "negative": []},
    }
    text = lambda **changes: json.dumps(good | {"reviewId": f"{len(lines):024x}"} | changes)
    lines, expected = [], []
    for made, codes in (
        (lambda: " " + text(), set()),
        (lambda: text(bookingHotelId=101.0, reviewedEpoch=1704027600.0), set()),
        # Infinite in a double, yet a number.
        (lambda: text(title=0).replace('"title": 0', '"title": 1e400'), {"FEED_FIELD_INVALID"}),
        (lambda: text(score=0).replace('"score": 0', '"score": ' + "1" * 400), {"SCORE_INVALID"}),
        (lambda: text(propertyKey="\ud800"), {"PROPERTY_IDENTITY_MISMATCH"}),
        (lambda: text(guestDetails={"pageUrl": [["https://x.example/?sid=1"]]}), {"SESSION_DATA_PRESENT"}),
        (lambda: text(guestDetails={"pageUrl": ["https://x.example/?a=[1]&sid=1"]}), {"SESSION_DATA_PRESENT"}),
        (lambda: text(highlights={"positive": []}), {"FEED_FIELD_INVALID"}),
        (lambda: text(photos=[5, {"urls": [None]}]), {"PHOTO_URL_NOT_CANONICAL"}),
        (lambda: '{"a":' * 900 + "1" + "}" * 900, None),
        (lambda: "[]", {"RECORD_SCHEMA_MISMATCH"}),
    ):
        lines.append(made())
        expected.append(codes)
    rows = audit.audited_records(spark.createDataFrame([*enumerate(lines), (90, ""), (91, '{"a":1,"a":2}'), (92, None)], "line_no long, value string"), src.properties(spark), src.ZONE).orderBy("line_no").collect()
    found = [{i.code for i in x.issues if not i.code.startswith("ANALYTICS")} for x in rows]
    assert len(found) == len(lines) and [f for f, e in zip(found, expected) if e is not None] == [e for e in expected if e is not None]


def test_the_recheck_writes_the_lines_once(spark, monkeypatch):
    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *more: written.append(path) or write(self, path, *more))
    found = evidence.export_average_recheck(spark, SF)
    assert len(written) == 1 and "__first" not in plan(found)
