"""Queries on responses, exports, evidence and derivations, each beside its oracle."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions import display, scalars
from reviewlake.operators import audit, export, feed, gaps, inventory, metrics, quality, snapshots
from reviewlake.operators.ranges import spread
from reviewlake.plans import oracles as sql
from reviewlake.plans import registry
from reviewlake.plans.base import query, values
from reviewlake.plans.dashboard import ReviewEngine
from reviewlake.sources import contract, publications
from reviewlake.sources import reviews as src

R = sql.REVIEWS


def _null_if(bad: Column, x: Column) -> Column:
    return F.when(~bad, x)


def cards(spark, sf_dir: str, faulty: bool = False) -> DataFrame:
    """Canonical reviews with the card that they might have come from; faulty: every so many break the contract in one way."""
    r, k = spread(src.canonical(spark, sf_dir), "row_id"), F.col("row_id")
    bad = lambda n: (k % n == 0) & F.lit(faulty)
    lit, none = F.lit, F.lit(None).cast("string")
    typed = lambda of, /, **fields: F.struct(lit(of).alias("__typename"), *[v.alias(f) for f, v in fields.items()])
    guest = typed("GuestDetails", username=F.concat(lit("guest "), k.cast("string")), avatarUrl=lit("https://a.example/x?sid=1"), countryCode=lit("au"), countryName=lit("Australia"), avatarColor=none, showCountryFlag=lit(True), anonymous=k % 2 == 0, guestTypeTranslation=F.col("guest_type"), userReviewCount=(k % 9).cast("long"))
    booking = F.struct(F.when(bad(53), "X").otherwise("BookingDetails").alias("__typename"), lit("COUPLE").alias("customerType"), k.alias("roomId"), F.when(F.col("room").isNotNull(), typed("RoomTranslation", id=k.cast("string"), name=F.col("room"))).alias("roomType"), none.alias("checkoutDate"), none.alias("checkinDate"), (k % 7).alias("numNights"), none.alias("stayStatus"))
    url = F.concat(F.when(bad(43), "http").otherwise("https"), lit("://cf.photos.example.com/"), k.cast("string"), lit(".jpg?k=1"))
    photo = typed("ReviewPhoto", id=k.cast("string"), urls=F.array(typed("ReviewPhotoUrl", size=lit("max"), url=url)), kind=none)
    card = typed(
        "ReviewCard", reviewUrl=F.col("token"), guestDetails=_null_if(k % 4 == 0, guest), bookingDetails=booking, reviewedDate=F.col("epoch"), isTranslatable=lit(True), helpfulVotesCount=F.when(bad(41), -1).otherwise(F.col("helpful")),
        reviewScore=F.when(bad(37), 10.5).otherwise(F.col("tenths") / 10), textDetails=typed("TextDetails", title=F.concat(lit("Title "), (k % 5).cast("string")), positiveText=F.col("positive_text"), negativeText=F.col("negative_text"), textTrivialFlag=(k % 3).cast("int"), lang=F.col("language")),
        isApproved=k % 5 > 0, partnerReply=typed("PropertyReplyData", reply=F.col("partner_reply")), positiveHighlights=F.array(F.struct(F.when(bad(47), 9).otherwise(0).alias("start"), lit(4).alias("end"))), negativeHighlights=F.array().cast("array<struct<start: int, end: int>>"), editUrl=none, photos=F.array(photo),
    )
    text = F.to_json(card, {"ignoreNullFields": "false"})
    text = F.when(bad(31), F.replace(text, lit(',"editUrl":null'), lit(""))).otherwise(text)
    text = F.when(bad(59), F.regexp_replace(text, r'"numNights":(\d+)', '"numNights":"$1"')).otherwise(text)
    return r.withColumn("card_json", text)


_FAULTS = {"missing editUrl": 31, "reviewScore:score": 37, "helpfulVotesCount:count": 41, "photos[].urls[].url:photo url": 43, "positiveHighlights[]:end before start": 47, "bookingDetails:type name": 53, "bookingDetails.numNights:count": 59}


def bodies(cards_: DataFrame, size: int = 10) -> DataFrame:
    """Responses of ten cards each; every eleventh cannot be read, every thirteenth has no list."""
    number = F.floor(F.col("row_id") / size)
    pages = cards_.groupBy(number.alias("page")).agg(F.array_sort(F.collect_list(F.struct("row_id", "card_json"))).alias("c"))
    body = F.concat(F.lit('{"data":{"reviewListFrontend":{"reviewsCount":10,"reviewCard":['), F.array_join("c.card_json", ","), F.lit("]}}}"))
    return pages.select("page", F.when(F.col("page") % 11 == 0, F.substring(body, 1, 40)).when(F.col("page") % 13 == 0, '{"data":{}}').otherwise(body).alias("body"))


@query(
    "WITH e AS (SELECT event_id AS k, event_id // 10 AS page FROM events), ok AS (SELECT * FROM e WHERE page % 11 <> 0 AND page % 13 <> 0), found AS ("
    + " UNION ALL ".join(f"SELECT '{v}' AS violation FROM ok WHERE k % {n} = 0" for v, n in _FAULTS.items())
    + " UNION ALL SELECT DISTINCT ON (page) CASE WHEN page % 11 = 0 THEN 'body:not json' ELSE 'body:no review list' END FROM e WHERE page % 11 = 0 OR page % 13 = 0) SELECT violation, count(*) AS n FROM found GROUP BY 1"
)
def card_contract(spark, sf_dir):
    """What is wrong with the cards of collected pages; pages without cards are rows, too."""
    found = contract.checked_cards(bodies(cards(spark, sf_dir, faulty=True)))
    return found.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


@query(f"{R} SELECT token AS review_url, epoch, tenths, CASE WHEN row_id % 4 > 0 THEN 'guest ' || row_id END AS guest, row_id % 7 AS nights, 'https://photo-cdn.invalid/' || row_id || '.jpg?k=1' AS photo FROM rev WHERE row_id // 10 % 11 <> 0 AND row_id // 10 % 13 <> 0")
def normalised_cards(spark, sf_dir):
    """Reviews from the cards of collected pages: a null guest stays null, photo hosts are canonical."""
    found = contract.checked_cards(bodies(cards(spark, sf_dir))).filter("size(violations) = 0")
    card = F.from_json("card_json", src.CARD)
    rows = found.withColumn("c", card).withColumn("v", F.parse_json("card_json"))
    return rows.select(F.col("c.reviewUrl").alias("review_url"), F.col("c.reviewedDate").alias("epoch"), scalars.tenths(F.col("c.reviewScore")).alias("tenths"), F.col("c.guestDetails.username").alias("guest"), contract.nights(F.try_variant_get("v", "$.bookingDetails.numNights", "variant")).alias("nights"), scalars.canonical_photo(F.col("c.photos")[0]["urls"][0]["url"]).alias("photo"))


#: What is wrong with the lists beside some events' cards.
_META_FAULTS = {"ratingScores[].translation:filled text": "k % 5 = 0", "ratingScores[].value:score": "k % 12 = 11", "ratingScores:duplicate": "k % 7 = 0", "topicFilters[].isSelected:flag": "k % 11 = 0", "reviewScoreFilter[].count:count": "k % 13 = 0", "roomTypeFilter:duplicate": "k % 17 = 0", "sorters[]:type name": "k % 19 = 0"}
_META = """(SELECT event_id AS k, '{"data":{"reviewListFrontend":{"ratingScores":[{"__typename":"RatingScore","name":"' || event_type || '","translation":"' || CASE WHEN event_id % 5 = 0 THEN '' ELSE 'T' END || '","value":' || (event_id % 12) || '},{"__typename":"RatingScore","name":"' || CASE WHEN event_id % 7 = 0 THEN event_type ELSE 'other' END || '","translation":"O","value":1}],'
    || '"topicFilters":[{"__typename":"TopicFilter","id":1,"name":"t","isSelected":' || CASE WHEN event_id % 11 = 0 THEN '"no"' ELSE 'true' END || '}],"reviewScoreFilter":[{"__typename":"ReviewScoreFilter","name":"x","value":"' || user_id || '","count":' || (event_id % 13 - 1) || '}],"languageFilter":[],"timeOfYearFilter":[],"customerTypeFilter":[],'
    || '"roomTypeFilter":' || CASE WHEN event_id % 17 = 0 THEN '[{"__typename":"RoomTypeFilter","name":"r","roomTypeId":"7","count":1,"roomIds":[1]},{"__typename":"RoomTypeFilter","name":"s","roomTypeId":"7","count":1,"roomIds":[]}]' ELSE 'null' END || ',"sorters":[' || CASE WHEN event_id % 19 = 0 THEN '{"name":"n","value":"v"}' ELSE '' END || ']}}}' AS body FROM events)"""


@query("WITH e AS (SELECT event_id AS k FROM events) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{v}' AS violation, count(*) AS n FROM e WHERE {c}" for v, c in _META_FAULTS.items()) + ") WHERE n > 0")
def metadata_contract(spark, sf_dir):
    """What is wrong with the metadata beside the cards."""
    found = contract.checked_metadata(spread(values(spark, sf_dir, _META), "k"))
    return found.select(F.explode("metadata_violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


_SCORED = """(SELECT event_id AS k, CASE event_id % 8 WHEN 0 THEN '{"score":' || s || ',"title":"x"}' WHEN 1 THEN '{"reviewScore":' || s || ',"title":null}' WHEN 2 THEN '{"score":' || s || ',"reviewScore":' || s || '}' WHEN 3 THEN '{"score":' || s || ',"reviewScore":8.25}'
    WHEN 4 THEN '{"title":' || user_id || '}' WHEN 5 THEN '{"score":"' || s || '"}' ELSE '{"score":' || s || ',"title":"t"}' END AS v FROM (SELECT event_id, user_id, (event_id % 12) || '.5' AS s FROM events) AS e)"""
_BAD = "coalesce(json_type(v, '$.{0}') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') OR CAST(v->'$.{0}' AS DOUBLE) NOT BETWEEN 0 AND 10, false)"


@query(f"""SELECT k, CASE WHEN json_type(v, '$.score') IS NULL AND json_type(v, '$.reviewScore') IS NULL THEN 'score:missing' WHEN {_BAD.format('score')} OR {_BAD.format('reviewScore')} THEN 'score:range'
    WHEN CAST(v->'$.score' AS DOUBLE) <> CAST(v->'$.reviewScore' AS DOUBLE) THEN 'score:aliases differ' END AS score, CASE WHEN json_type(v, '$.title') NOT IN ('VARCHAR', 'NULL') THEN 'title:text' END AS title FROM (SELECT k, CAST(v AS JSON) AS v FROM {_SCORED})""")
def insight_input(spark, sf_dir):
    """What is wrong with the score and the title that the classifier is given."""
    v = F.parse_json("v")
    return values(spark, sf_dir, _SCORED).select("k", contract.score_violation(v).alias("score"), contract.title_violation(v).alias("title"))


@query(f"""{R} SELECT property_key AS "propertyKey", property_name AS "propertyName", hotel_id AS "bookingHotelId", public_id AS "reviewId", epoch AS "reviewedEpoch", strftime(make_timestamp(epoch * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS "reviewedAtUtc", local_date AS "reviewedLocalDate",
    tenths / 10.0::DOUBLE AS score, 'Title ' || (row_id % 5) AS title, positive_text AS "positiveText", negative_text AS "negativeText", language AS "sourceLanguage", partner_reply AS "partnerReply", helpful AS "helpfulVotesCount", row_id % 7 AS nights, room,
    CASE WHEN row_id % 4 > 0 THEN 'guest ' || row_id END AS username, CASE WHEN row_id % 4 > 0 THEN row_id % 9 END AS written, 'https://photo-cdn.invalid/' || row_id || '.jpg?k=1' AS photo, 4::BIGINT AS marked, row_id % 3 AS "textTrivialFlag", row_id % 5 > 0 AS "isApproved", true AS "isTranslatable"
    FROM rev JOIN props USING (property_key)""")
def full_records(spark, sf_dir):
    """The 21 fields of a record, with a look into those that are nested."""
    r = export.full_records(cards(spark, sf_dir), src.properties(spark))
    nested = {"nights": "bookingDetails.numNights", "room": "bookingDetails.roomType.name", "username": "guestDetails.username", "written": "guestDetails.userReviewCount"}
    return r.select(*[c for c in r.columns if c not in ("epoch", "row_id", "bookingDetails", "guestDetails", "photos", "highlights")], *[F.col(p).alias(k) for k, p in nested.items()], F.col("photos")[0]["urls"][0]["url"].alias("photo"), F.col("highlights.positive")[0]["end"].alias("marked"))


def _cells(*columns: str) -> str:
    return " || ',' || ".join(f"coalesce('\"' || replace(CAST({c} AS VARCHAR), '\"', '\"\"') || '\"', '')" for c in columns)


@query(f"{R} SELECT {_cells('property_key', 'property_name', 'hotel_id', 'public_id', 'local_date', 'tenths / 10.0::DOUBLE', repr('Title ') + ' || (row_id % 5)', 'positive_text', 'negative_text', 'language', 'partner_reply', 'helpful', 'room', repr('COUPLE'), 'row_id % 7', 'CASE WHEN row_id % 4 > 0 THEN ' + repr('Australia') + ' END', 'CASE WHEN row_id % 4 > 0 THEN guest_type END')} AS line FROM rev JOIN props USING (property_key)")
def export_flat_lines(spark, sf_dir):
    """The 17 columns of the flat export."""
    return export.flat_lines(export.full_records(cards(spark, sf_dir), src.properties(spark)))


def export_lines(spark, sf_dir: str) -> DataFrame:
    """(line_no, value): an export's JSON lines, of which every so many are at fault."""
    r = export.full_records(cards(spark, sf_dir), src.properties(spark))
    rows = r.select(F.col("row_id").alias("line_no"), F.to_json(F.struct(*audit.RECORD_KEYS), {"ignoreNullFields": "false"}).alias("value"))
    k = F.col("line_no")
    edits = (
        (101, r'"bookingHotelId":\d+', '"bookingHotelId":0'), (103, '"reviewId":"[0-9a-f]{24}"', '"reviewId":"not-an-id"'), (107, '"reviewId":"[0-9a-f]{24}"', f'"reviewId":"{"0" * 24}"'), (109, r'"score":[0-9.]+', '"score":10.5'),
        (113, r'"reviewedLocalDate":"[0-9-]+"', '"reviewedLocalDate":"2000-01-01"'), (127, r'"reviewedAtUtc":"[^"]+"', '"reviewedAtUtc":"yesterday"'), (131, r'"title":"[^"]*"', '"title":5'), (137, r'"isApproved":(?:true|false)', '"isApproved":"yes"'),
        (139, r"^\{", '{"sessionId":"x",'), (149, r"https://photo-cdn\.invalid", "https://other.example"), (163, r"\?k=1", "?k=1&sid=2"), (151, "(?s)^.*$", ""), (157, "(?s)^.+$", "{"),
    )
    # Most lines have no edit, the others one or two, in order: only these pass over the text.
    due = F.array_compact(F.array(*[F.when(k % n == 0, F.struct(F.lit(pattern).alias("pattern"), F.lit(new).alias("new"))) for n, pattern, new in edits]))
    value = F.aggregate(due, F.col("value"), lambda text, e: F.regexp_replace(text, e["pattern"], e["new"]))
    edited = functools.reduce(Column.__or__, [k % n == 0 for n, _, _ in edits])
    return rows.withColumn("value", F.when(edited, value).otherwise(F.col("value")))


def export_manifest_text(spark, sf_dir: str) -> DataFrame:
    """One row, value: a manifest that fits export_lines() but for the mode, a count, a total, a gap and the means."""
    k = F.col("row_id")
    per = src.canonical(spark, sf_dir).filter((k % 151 != 0) & (k % 157 != 0) & (k % 101 != 0)).groupBy("property_key").agg(F.count("*").alias("n"))
    rows = src.properties(spark).join(per, "property_key").withColumn("n", F.col("n") + (F.col("property_key") == "click").cast("int"))
    none = F.lit(None).cast("string")
    one = F.struct(
        F.col("property_key").alias("propertyKey"), F.col("hotel_id").alias("bookingHotelId"), F.lit("r1").alias("publishedRunId"), F.lit(2).alias("publicationGeneration"), F.lit(audit.PARSER).alias("parserVersion"), F.col("n").alias("totalPublishedReviews"), F.col("n").alias("exportedReviews"),
        F.lit(1.0).alias("currentAverageScore"), F.lit(True).alias("authoritativeFullPublication"), (F.col("n") + (F.col("property_key") == "view").cast("int")).alias("advertisedReviews"), F.col("n").alias("retrievableReviews"), F.lit(0).alias("sourceReviewGap"), none.alias("sourceDiscrepancyKind"), none.alias("sourceDiscrepancyScoreBucket"), none.alias("advertisedBucketReviews"), none.alias("retrievableBucketReviews"),
    )
    whole = rows.agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.to_json(one, {"ignoreNullFields": "false"}))).alias("p"))  # five rows
    return whole.select(F.concat(F.lit('{"generatedAt":"2024-01-26T00:00:00.000Z","mode":"sample","samplePerProperty":null,"strictAll":true,"requestedPropertyCount":5,"omittedPropertyKeys":[],"totalRecords":'), F.col("total").cast("string"), F.lit(',"properties":['), F.array_join("p", ","), F.lit("]}")).alias("value"))


_LINES = f"""{R}, l AS (SELECT property_key, row_id AS k, tenths, row_id % 101 = 0 AS identity_, row_id % 103 = 0 AS id_, row_id % 107 = 0 AND row_id % 103 <> 0 AS zero_, row_id % 109 = 0 AS score_, row_id % 113 = 0 AS date_, row_id % 127 = 0 AS utc_, row_id % 131 = 0 AS title_,
    row_id % 137 = 0 AS approved_, row_id % 139 = 0 AS key_, row_id % 149 = 0 AS photo_, row_id % 163 = 0 AS sid_ FROM rev WHERE row_id % 151 <> 0 AND row_id % 157 <> 0),
z AS (SELECT *, zero_ AND row_number() OVER (PARTITION BY zero_ ORDER BY k) > 1 AS twice_ FROM l),
d AS (SELECT *, NOT (key_ OR sid_ OR identity_ OR id_ OR twice_ OR score_ OR date_) AS weekly, NOT (key_ OR sid_ OR identity_ OR score_) AS prop FROM z),
per AS (SELECT property_key, count(*) AS n, count(*) FILTER (WHERE NOT score_) AS scored, avg(tenths) FILTER (WHERE NOT score_) / 10 AS mean FROM d WHERE NOT identity_ GROUP BY 1)"""
_CODES = {
    ("RECORD_SCHEMA_MISMATCH", "record"): "key_", ("PRIVACY_FIELD_PRESENT", "record"): "key_", ("SESSION_DATA_PRESENT", "record"): "sid_", ("PROPERTY_IDENTITY_MISMATCH", "record.property"): "identity_", ("PUBLIC_REVIEW_ID_INVALID", "record.reviewId"): "id_", ("PUBLIC_REVIEW_ID_DUPLICATE", "record.reviewId"): "twice_",
    ("SCORE_INVALID", "record.score"): "score_", ("SYDNEY_LOCAL_DATE_INVALID", "record.reviewedLocalDate"): "date_", ("UTC_TIMESTAMP_INVALID", "record.reviewedAtUtc"): "utc_", ("FEED_FIELD_INVALID", "record.title"): "title_", ("FEED_FIELD_INVALID", "record.isApproved"): "approved_", ("PHOTO_URL_NOT_CANONICAL", "record.photos[].urls[].url"): "photo_",
    ("ANALYTICS_WEEKLY_NOT_READY", "record"): "NOT weekly", ("ANALYTICS_PROPERTY_NOT_READY", "record"): "NOT prop", ("ANALYTICS_FEED_NOT_READY", "record"): "NOT weekly OR utc_ OR title_ OR approved_ OR photo_",
}


@query(
    _LINES + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS code, '{f}' AS field, count(*) AS n FROM d WHERE {w}" for (c, f), w in _CODES.items())
    + """ UNION ALL SELECT 'JSONL_BLANK_LINE', 'jsonl', count(*) FROM rev WHERE row_id % 151 = 0 UNION ALL SELECT 'JSONL_INVALID_JSON', 'jsonl', count(*) FROM rev WHERE row_id % 157 = 0 AND row_id % 151 <> 0
    UNION ALL SELECT 'MANIFEST_NOT_PRODUCTION', 'manifest.mode', 1 UNION ALL SELECT 'MANIFEST_SOURCE_COUNT_MISMATCH', 'manifest.properties[].sourceReviewGap', 1 UNION ALL SELECT 'MANIFEST_PROPERTY_COUNT_MISMATCH', 'manifest.properties[].exportedReviews', 1
    UNION ALL SELECT 'MANIFEST_TOTAL_MISMATCH', 'manifest.totalRecords', count(*) FROM (SELECT 1 WHERE (SELECT sum(n) + 1 FROM per) <> (SELECT count(*) FROM rev WHERE row_id % 151 <> 0))
    UNION ALL SELECT 'MANIFEST_PROPERTY_AVERAGE_MISMATCH', 'manifest.properties[].currentAverageScore', count(*) FROM per WHERE n = scored AND abs(mean - 1) > 1e-9) WHERE n > 0"""
)
def export_audit(spark, sf_dir):
    """All issues of an export and its manifest, by code and field."""
    return audit.audited_export(export_lines(spark, sf_dir), export_manifest_text(spark, sf_dir), src.properties(spark), src.ZONE)[0]


@query(_LINES + """ SELECT (SELECT count(*) FROM rev WHERE row_id % 151 <> 0) AS jsonl_rows, count(*) AS parsed_records, count(*) FILTER (WHERE NOT id_ AND NOT twice_) AS unique_id_rows, count(*) FILTER (WHERE weekly) AS weekly_ready_rows,
    count(*) FILTER (WHERE prop) AS property_ready_rows, count(*) FILTER (WHERE weekly AND NOT (utc_ OR title_ OR approved_ OR photo_)) AS feed_ready_rows FROM d""")
def export_audit_counts(spark, sf_dir):
    return audit.audited_export(export_lines(spark, sf_dir), export_manifest_text(spark, sf_dir), src.properties(spark), src.ZONE)[1]


@query(_LINES + " SELECT property_key, n AS records, mean FROM per WHERE abs(mean - 5) > 1e-9")
def export_average_recheck(spark, sf_dir):
    """Properties whose declared mean (5 for all) is not that of their sound records."""
    # The means and the counts read the audited lines, which are written already.
    rows = audit.audited_records(export_lines(spark, sf_dir), src.properties(spark), src.ZONE).filter("property_key IS NOT NULL").select("property_key", "score")
    found = export.averages_recheck(rows, src.properties(spark).select("property_key", F.lit(5.0).alias("declared")))
    return rows.groupBy("property_key").agg(F.count("*").alias("records")).join(found.select("property_key", F.col("average").alias("mean")), "property_key")


@query("""WITH l AS (SELECT event_id AS k, CASE WHEN event_id % 7 = 0 THEN 'blank' WHEN event_id % 11 = 0 THEN 'bad_json' END AS flag, user_id FROM events)
SELECT coalesce(flag, 'read') AS flag, count(*) AS n, CAST(sum(CASE WHEN flag IS NULL THEN user_id END) AS BIGINT) AS total FROM l GROUP BY 1""")
def json_line_flags(spark, sf_dir):
    """A JSONL source with blank and broken lines."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_id") % 7 == 0, "  ").when(F.col("event_id") % 11 == 0, '{"user_id": 1').otherwise(F.to_json(F.struct("event_id", "user_id")))
    rows = src.parsed_lines(e.select(text.alias("value")), "event_id long, user_id long")
    return rows.groupBy(F.coalesce("flag", F.lit("read")).alias("flag")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("flag").isNull(), F.col("record.user_id"))).alias("total"))


_RATINGS = """(SELECT event_id AS k, CASE event_id % 5 WHEN 0 THEN '[{"name":"hotel_' || event_type || '","translation":"T' || user_id || '","value":' || (event_id % 11) || '.5},{"name":"free_' || event_type || '","translation":" ","value":7},{"name":null,"value":6},{"name":"x","value":"9"},{"name":"y"},5]'
    WHEN 1 THEN '{"a":' || event_id || '}' WHEN 2 THEN NULL ELSE '[{"name":"' || event_type || '_clean","value":' || (event_id % 10) || '}]' END AS v FROM events)"""


@query(f"""WITH r AS (SELECT k, unnest(from_json(CASE WHEN json_type(v) = 'ARRAY' THEN v END, '["JSON"]')) AS x FROM (SELECT k, CAST(v AS JSON) AS v FROM {_RATINGS})),
s AS (SELECT k, CAST(x->'$.value' AS DOUBLE) AS score, nullif(trim(x->>'$.translation'), '') AS t, replace(x->>'$.name', '_', ' ') AS n FROM r WHERE json_type(x, '$.value') IN ('DOUBLE', 'UBIGINT', 'BIGINT'))
SELECT k, coalesce(t, list_aggregate(list_transform(string_split(n, ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' '), 'Category') AS name, score FROM s""")
def category_score_rows(spark, sf_dir):
    """Category scores that are numbers, under their shown names."""
    return values(spark, sf_dir, _RATINGS).select("k", F.explode(export.category_scores(F.col("v"))).alias("c")).select("k", "c.name", "c.score")


_FAILED = """(SELECT event_id AS k, CASE event_id % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network_error' WHEN 2 THEN 'temporary_server_error' WHEN 3 THEN 'rate_limited' WHEN 4 THEN 'challenge' END AS kind, CAST(1 + event_id % 4 AS INT) AS attempt,
    CASE WHEN event_id % 6 = 3 THEN CASE user_id % 3 WHEN 0 THEN CAST(user_id % 300 AS STRING) WHEN 1 THEN 'Fri, 26 Jan 2024 00:00:' || (10 + event_id % 50) || ' GMT' ELSE 'soon' END END AS retry_after, CAST(event_id % 5 AS DOUBLE) / 4 AS sample FROM events)"""


@query(f"""SELECT k, CASE WHEN kind = 'rate_limited' THEN 'rate_limited' WHEN kind IN ('timeout', 'network_error', 'temporary_server_error') THEN CASE WHEN attempt >= 3 THEN 'attempt_budget_exhausted' ELSE 'temporary_failure' END ELSE 'not_retryable' END AS reason,
    CASE WHEN kind IN ('timeout', 'network_error', 'temporary_server_error') AND attempt < 3 THEN CAST(floor(least(30000, 500 * 2 ** (attempt - 1)) * (0.8 + 0.4 * sample) + 0.5) AS BIGINT) END AS delay_ms,
    CASE WHEN kind = 'rate_limited' THEN coalesce(try_cast(retry_after AS BIGINT) * 1000, epoch_ms(try_strptime(retry_after, '%a, %d %b %Y %H:%M:%S GMT')) - epoch_ms(TIMESTAMP '2024-01-26 00:00:00')) END AS reschedule_ms FROM {_FAILED}""")
def retry_decisions(spark, sf_dir):
    rows = values(spark, sf_dir, _FAILED).withColumns({"now": F.lit("2024-01-26 00:00:00").cast("timestamp"), "sample": F.col("sample").cast("double")})
    return export.retry_decisions(rows).select("k", "reason", "delay_ms", "reschedule_ms")


_CODE = "CASE event_id % 7 WHEN 0 THEN 'CHALLENGE' WHEN 3 THEN 'OTHER' ELSE 'REVIEW_CAPTURE_TIMEOUT' END"


@query(f"""WITH e AS (SELECT user_id AS run_id, event_id AS place, {_CODE} AS code FROM events), g AS (SELECT *, sum(CASE WHEN code <> 'REVIEW_CAPTURE_TIMEOUT' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY place) AS part FROM e),
c AS (SELECT *, sum(CASE WHEN code = 'REVIEW_CAPTURE_TIMEOUT' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, part ORDER BY place) AS timeouts FROM g)
SELECT code, code = 'CHALLENGE' OR code = 'REVIEW_CAPTURE_TIMEOUT' AND timeouts >= 2 AS open, count(*) AS n FROM c GROUP BY 1, 2""")
def circuit_decisions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("place"), F.expr(_CODE).alias("code"))
    return export.circuit(e).groupBy("code", "open").agg(F.count("*").alias("n"))


#: Lines of the jobs' logs: six kinds that tell something, and noise.
_LOG = """(SELECT 'j' || user_id AS job, event_id AS line_no, CASE WHEN event_id % 17 = 0 THEN 'noise: ' || event_type WHEN event_id % 6 = 0 THEN '[10:00] full: ' || event_type WHEN event_id % 6 = 1 THEN '[10:01] progress: ' || event_type || ' oldest-first ' || (event_id % 40) || '/40'
    WHEN event_id % 6 = 2 THEN '  [10:03] progress: ' || event_type || ' newest-first ' || (event_id % 40) || '/' || (user_id + 40) || ' verified ' WHEN event_id % 6 = 3 THEN '[10:04] progress: ' || event_type || ' final head verified (10 cards)'
    WHEN event_id % 6 = 4 THEN '[10:05] failed: ' || event_type || ': ' || CASE WHEN event_id % 5 = 0 THEN 'CHALLENGE' ELSE 'RATE_LIMITED slow down' END ELSE '[10:06] passed: ' || event_type || ' (' || (event_id % 40) || ' reviews)' END AS line FROM events)"""


@query("""WITH l AS (SELECT 'j' || user_id AS job, event_type AS property_key, event_id AS k, event_id % 6 AS kind, event_id % 40 AS n, user_id + 40 AS whole FROM events WHERE event_id % 17 > 0),
said AS (SELECT *, CASE kind WHEN 0 THEN 'collecting' WHEN 1 THEN 'collecting' WHEN 2 THEN 'collecting' WHEN 4 THEN 'failed' WHEN 5 THEN 'published' END AS state, CASE kind WHEN 1 THEN 'oldest-first' WHEN 2 THEN 'newest-first' WHEN 3 THEN 'verifying' WHEN 4 THEN '' WHEN 5 THEN '' END AS pass,
    CASE WHEN kind IN (1, 2, 5) THEN n END AS processed, CASE kind WHEN 1 THEN 40 WHEN 2 THEN whole END AS expected, CASE kind WHEN 5 THEN n END AS reviews, CASE WHEN kind = 4 THEN CASE WHEN k % 5 = 0 THEN 'CHALLENGE' ELSE 'RATE_LIMITED' END END AS error_code, CASE WHEN kind = 4 THEN CASE WHEN k % 5 = 0 THEN 'CHALLENGE' ELSE 'slow down' END END AS error FROM l)
SELECT job, property_key, nullif(arg_max(pass, k) FILTER (WHERE pass IS NOT NULL), '') AS pass, """ + ", ".join(f"arg_max({c}, k) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("state", "processed", "expected", "reviews", "error_code", "error")) + " FROM said GROUP BY 1, 2")
def job_progress(spark, sf_dir):
    return export.progress(values(spark, sf_dir, _LOG))


@query("""SELECT event_id AS k, 'Room ' || upper(event_type[1]) || event_type[2:] || '-' || (user_id % 3) || ' O''Neil' AS humanized, concat_ws(chr(10), CASE WHEN event_id % 2 = 0 THEN event_type END, CASE WHEN event_id % 3 = 0 THEN 'text' END) AS combined,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 101 AS INTEGER) END AS tenths, 'the-' || event_type || '-' || (event_id % 5) AS slug, 'https://www.example.com/hotel/au/the-' || event_type || '_' || (event_id % 5) || '.en-gb.html' AS page,
    greatest(event_id % 3000, 12) AS visible, event_id % 2 = 0 AS shows, '{"a":[1,2],"b":' || (event_id % 3) || '}' AS canonical,
    CASE WHEN event_id % 6 = 0 THEN 'rate_limited' WHEN event_id % 6 = 1 THEN 'challenge' WHEN event_id % 6 = 2 THEN 'server_error' WHEN event_id % 6 = 3 THEN 'not_json' WHEN event_id % 6 = 4 THEN 'empty' ELSE 'json' END AS kind FROM events""")
def scalar_derivations(spark, sf_dir):
    """Derivations of single values: labels, texts, scores, addresses, page figures, canonical JSON and kinds of answers."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, text = F.col("event_id"), lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    n = lambda m: (k % m).cast("string")
    page = text("https://www.example.com/hotel/au/the-", F.col("event_type"), "_", n(5), ".en-gb.html")
    grouped = F.when(k % 3000 >= 1000, F.regexp_replace((k % 3000).cast("string"), r"(\d)(\d{3})$", "$1,$2")).otherwise((k % 3000).cast("string"))
    status = F.when(k % 6 == 0, 429).when(k % 6 == 2, 503).otherwise(200)
    body = F.when(k % 6 == 1, "<p>CAPTCHA</p>").when(k % 6 == 3, "<html>").when(k % 6 == 4, " ").otherwise('{"a": 1}')
    return e.select(
        k.alias("k"), scalars.humanized(text(" ROOM_", F.col("event_type"), "-", (F.col("user_id") % 3).cast("string"), "_o'neil ")).alias("humanized"), scalars.combined_text(F.when(k % 2 == 0, F.col("event_type")).otherwise(""), F.when(k % 3 == 0, "text")).alias("combined"),
        scalars.tenths(F.when(k % 4 == 0, k % 101 + F.lit(20)).otherwise(k % 101 / 10)).alias("tenths"), scalars.property_slug(page).alias("slug"), scalars.canonical_page(text(page, "?sid=", n(7), "#x")).alias("page"),
        scalars.visible_count(text("12 reviews and ", grouped, " Reviews, 5 rooms")).alias("visible"), scalars.shows_score(text("Scored ", F.when(k % 2 == 0, "8.4").otherwise("18.4"), " of 10"), F.lit(84)).alias("shows"),
        scalars.canonical_json(text('{"b": ', n(3), ', "a": [1.0, 2]}')).alias("canonical"), scalars.response_kind(status, body).alias("kind"),
    )


@query("""SELECT event_id AS k, CASE WHEN event_id % 9 = 0 THEN '—' ELSE printf('%.1f', value) END AS score, CASE WHEN event_id % 9 = 0 THEN '—' WHEN abs(value - 50) < 0.01 THEN 'No change' WHEN value > 50 THEN '+' || printf('%.1f', value - 50) ELSE printf('%.1f', value - 50) END AS delta,
    CASE event_id % 4 WHEN 0 THEN 'Verified' WHEN 1 THEN 'Disclosed gap' WHEN 2 THEN 'Collecting' ELSE 'Needs attention' END AS label, event_id % 4 < 2 AS accepted, event_id % 3 < 2 AS neutral, CASE WHEN event_id >= 1000 THEN format('{:,}', event_id) ELSE CAST(event_id AS VARCHAR) END AS counted, strftime(ts, '%-d %b %Y') AS day FROM events WHERE value < 1000""")
def display_values(spark, sf_dir):
    """How figures, counts, days and labels are shown."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value < 1000")
    k = F.col("event_id")
    figure = F.when(k % 9 != 0, F.col("value"))
    status = F.when(k % 4 == 0, "verified").when(k % 4 == 1, "source-gap").when(k % 4 == 2, "collecting").otherwise("evidence-error")
    return e.select(k.alias("k"), display.score_text(figure).alias("score"), display.delta_text(figure - 50).alias("delta"), display.publication_label(status).alias("label"), display.accepted(status).alias("accepted"), display.is_neutral(F.when(k % 3 == 0, " ALL ").when(k % 3 == 2, "suite")).alias("neutral"), display.count_text(k).alias("counted"), display.date_text(F.to_date("ts")).alias("day"))


@query(f"{R} SELECT row_id, epoch FROM rev WHERE property_key = 'view' AND tenths = 50")
def lookup_rows(spark, sf_dir):
    """Rows by key; the conditions reach the scan."""
    return publications.lookup(src.canonical(spark, sf_dir), property_key="view", tenths=50).select("row_id", "epoch")


@query("SELECT 'r' || (event_id % 3) AS run_id, event_id // 3 * 10 AS page_offset, row_number() OVER (ORDER BY event_id // 3 * 10) AS place FROM events WHERE event_id % 3 = 1")
def page_evidence_rows(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("run_id"), F.lit("newest").alias("phase"), (F.floor(F.col("event_id") / 3) * 10).alias("page_offset"))
    from reviewlake.operators.ranges import numbered

    return numbered(publications.page_evidence(pages, "r1"), ("phase",), ("page_offset",), "place").select("run_id", "page_offset", (F.col("place") + 1).alias("place"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left_anti")


_GAPPED = """(SELECT k, advertised, advertised - k % 6 + CASE WHEN k % 7 = 0 THEN 6 ELSE 0 END AS retrievable, advertised - CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS total, CASE WHEN k % 11 = 0 THEN 'NONE' ELSE 'ALL' END AS named, each_bucket - CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS each_bucket
    FROM (SELECT event_id AS k, CASE WHEN event_id % 31 = 0 THEN -1 ELSE event_id % 200 * 5 END AS advertised, event_id % 200 AS each_bucket FROM events) AS e)"""


@query(f"""SELECT k, verdict, CASE WHEN verdict = 'OK' THEN advertised - retrievable END AS gap FROM (SELECT *, CASE WHEN advertised < 0 OR retrievable < 0 THEN 'INVALID_COUNT' WHEN advertised = retrievable THEN 'NONE' WHEN retrievable > advertised OR advertised - retrievable > least(5, floor(advertised * 0.01)) THEN 'GAP_COUNT_MISMATCH'
    WHEN named <> 'ALL' OR total <> advertised THEN 'TRUSTED_TOTALS_MISMATCH' WHEN 5 * each_bucket <> advertised THEN 'ADVERTISED_BUCKET_SUM_MISMATCH' ELSE 'OK' END AS verdict FROM {_GAPPED})""")
def source_gap_evidence(spark, sf_dir):
    rows = values(spark, sf_dir, _GAPPED)
    totals = F.array(*[F.struct(F.when((F.col("named") == "ALL") | F.lit(i > 0), t).otherwise("other").alias("source"), F.col("total").alias("n")) for i, t in enumerate(gaps.TOTALS)])
    buckets = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col("each_bucket").alias("advertised")) for b in gaps.BUCKETS])
    return gaps.source_gap(rows.withColumns({"totals": totals, "buckets": buckets})).select("k", "verdict", F.col("evidence.gap").alias("gap"))


_DISCLOSED = f"""WITH s AS ({sql.SHORTFALLS}), a AS (SELECT s.*, CAST(substr(s.property_key, 2) AS BIGINT) AS q, h.advertised AS headline_advertised FROM s JOIN {sql.BUCKETS} AS h ON h.property_key = s.property_key AND h.bucket = s.headline_bucket),
v AS (SELECT * REPLACE (CASE WHEN q % 19 = 7 THEN 'none' || q ELSE property_key END AS property_key, CASE WHEN q % 11 = 4 THEN 'INVALID_ATTESTATION' WHEN q % 7 = 3 THEN 'CONTRACT_KIND_MISMATCH' WHEN q % 19 = 7 THEN 'BUCKETS_MISSING' WHEN verdict <> 'OK' THEN 'BUCKETS_INVALID'
    WHEN q % 13 = 5 THEN 'COUNT_MISMATCH' WHEN q % 17 = 6 THEN 'HEADLINE_MISMATCH' ELSE 'OK' END AS verdict) FROM a)
SELECT property_key, verdict, """ + ", ".join(f"CASE WHEN verdict = 'OK' THEN {c} END AS {c}" for c in ("advertised", "retrievable", "headline_bucket", "headline_advertised")) + " FROM v"


@query(_DISCLOSED)
def gap_disclosures(spark, sf_dir):
    """Attestations of the gaps that the buckets show, some of them wrong, recomputed from their buckets before they are shown."""
    buckets = values(spark, sf_dir, sql.BUCKETS)
    head = buckets.select("property_key", F.col("bucket").alias("headline_bucket"), F.col("advertised").alias("headline_advertised"), F.col("retrievable").alias("headline_retrievable"))
    q = F.substring_index("property_key", "p", -1).cast("long")
    one = lambda m, r: (q % m == r).cast("int")
    attested = gaps.shortfalls(buckets).join(head, ["property_key", "headline_bucket"]).select(
        F.when(q % 19 == 7, F.concat(F.lit("none"), q.cast("string"))).otherwise(F.col("property_key")).alias("property_key"), F.when(q % 7 == 3, "other").otherwise(gaps.GAP_KIND).alias("kind"), (1 + one(11, 4)).alias("version"), (F.col("advertised") + one(13, 5)).alias("advertised"), "retrievable", "gap",
        "headline_bucket", (F.col("headline_gap") + one(17, 6)).alias("headline_gap"), "headline_advertised", "headline_retrievable",
    )
    return gaps.disclosures(attested, buckets).select("property_key", "verdict", "advertised", "retrievable", "headline_bucket", "headline_advertised")


@query("""WITH t AS (SELECT user_id AS property_key, count(*) AS n, min(event_id % 2) AS low, max(event_id % 2) AS high FROM events GROUP BY 1) SELECT property_key, n = 4 AS complete, false AS named, low = high AS equal, high AS total FROM t""")
def trusted_totals(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("property_key"), F.lit("reviewScoreFilter.ALL").alias("source"), (F.col("event_id") % 2).alias("n"))
    return gaps.trusted_totals(rows)


@query("SELECT user_id % 50 AS property_key, sha256('[' || string_agg(format('{{\"name\":\"{}\",\"translation\":null,\"value\":{}}}', event_type, event_id), ',' ORDER BY event_type, event_id) || ']') AS digest FROM events WHERE event_id < 500 GROUP BY 1")
def category_digests(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id < 500").select((F.col("user_id") % 50).alias("property_key"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("translation"), F.col("event_id").alias("value"))
    return gaps.category_digest(rows)


_SNAPSHOTS = "(SELECT event_id AS k, CASE WHEN event_id % 11 > 0 THEN event_id % 100 + event_id % 8 - 1 END AS displayed, event_id % 100 AS structured, event_id % 3 = 0 AS gap_attested, event_id % 5 < 2 AS visible_attested FROM events)"


@query(f"SELECT k, CASE WHEN displayed IS NULL THEN 'unavailable' WHEN displayed = structured THEN 'exact' WHEN displayed > structured AND gap_attested THEN 'structured_gap' WHEN displayed - structured BETWEEN 1 AND 5 AND visible_attested THEN 'visible_gap' ELSE 'broken' END AS invariant FROM {_SNAPSHOTS}")
def snapshot_invariants(spark, sf_dir):
    return values(spark, sf_dir, _SNAPSHOTS).select("k", quality.snapshot_invariant().alias("invariant"))


@query("SELECT user_id AS run_id, count(DISTINCT event_type) = 1 AS one_hash, count(*) AS pages, CAST(2 * (ceil(max(event_id % 40) / 10.0) + 1) + 1 AS BIGINT) AS expected_pages, count(*) = 2 * (ceil(max(event_id % 40) / 10.0) + 1) + 1 AS complete FROM events GROUP BY 1")
def count_attestations(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 40).alias("total"), F.col("event_type").alias("evidence_hash"))
    return quality.count_attestation(pages)


@query(f"""{R}, o AS (SELECT property_key, token, epoch, row_number() OVER (PARTITION BY property_key ORDER BY epoch, row_id) AS i FROM rev QUALIFY i <= 10),
newest AS (SELECT property_key, token, epoch, row_number() OVER (PARTITION BY property_key ORDER BY epoch DESC, row_id) AS i FROM rev WHERE property_key NOT IN ('view', 'error') QUALIFY i <= 10),
n AS (SELECT property_key, token, epoch, CASE WHEN property_key = 'purchase' AND i <= 2 THEN 3 - i ELSE i END AS i FROM newest UNION ALL SELECT property_key, token, 0, i FROM o WHERE property_key = 'view'),
steps AS (SELECT property_key, lag(epoch) OVER (PARTITION BY property_key ORDER BY i) < epoch AS wrong FROM n),
one AS (SELECT property_key, list(token ORDER BY i) AS ids, any_value((SELECT bool_or(coalesce(wrong, false)) FROM steps s WHERE s.property_key = n.property_key)) AS wrong FROM n GROUP BY 1),
two AS (SELECT property_key, list(token ORDER BY i) AS ids FROM o GROUP BY 1)
SELECT two.property_key, CASE WHEN one.ids IS NULL THEN 'MISSING_PAGE' WHEN wrong THEN 'NON_MONOTONIC_PAGINATION' WHEN one.ids = two.ids THEN 'SORTER_NOT_APPLIED' WHEN two.property_key = 'click' THEN 'MOVING_REVIEW_COUNT' ELSE 'OK' END AS verdict FROM two LEFT JOIN one USING (property_key)""")
def canary_verdicts(spark, sf_dir):
    """First pages of either order from the reviews themselves: for one property the same cards twice, for one two cards changed over, for one another count, for one no newest page."""
    rows = registry.inventory(spark, sf_dir).select("property_key", "token", "row_id", "epoch")

    def first(order) -> DataFrame:
        return rows.withColumn("card_index", F.row_number().over(Window.partitionBy("property_key").orderBy(order, "row_id"))).filter("card_index <= 10")

    oldest = first(F.asc("epoch")).withColumn("reported", F.lit(20))
    twice = oldest.filter("property_key = 'view'").withColumn("epoch", F.lit(0).cast("long"))
    newest = first(F.desc("epoch")).filter("property_key NOT IN ('view', 'error')").withColumn("reported", F.when(F.col("property_key") == "click", 21).otherwise(20))
    newest = newest.withColumn("card_index", F.when((F.col("property_key") == "purchase") & (F.col("card_index") <= 2), 3 - F.col("card_index")).otherwise(F.col("card_index")))
    return inventory.canary(oldest, newest.unionByName(twice))


_HEADS = "(SELECT 'u' || user_id AS property_key, md5(CAST(min(event_id) + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS STRING)) AS page_hash FROM events GROUP BY user_id)"
_NEWEST = """(SELECT 'u' || user_id AS property_key, 0 AS page_offset, md5(CAST(min(event_id) AS STRING)) AS page_hash FROM events WHERE user_id % 8 > 0 GROUP BY user_id
    UNION ALL SELECT 'u' || user_id, 10, md5(CAST(max(event_id) AS STRING)) FROM events GROUP BY user_id)"""


@query("SELECT DISTINCT 'u' || user_id AS property_key, user_id % 3 > 0 AND user_id % 8 > 0 AS unchanged FROM events")
def head_checks(spark, sf_dir):
    """Whether each user's first page was the same at the end; for some it was never seen."""
    return inventory.head_unchanged(values(spark, sf_dir, _HEADS), values(spark, sf_dir, _NEWEST))


@query("SELECT event_id AS row_id, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'tenths' END, CASE WHEN event_id % 7 = 0 THEN 'language' END) AS mismatched FROM events")
def card_attribution(spark, sf_dir):
    """Normalised columns that differ from the retained card: some were changed after."""
    r = src.canonical(spark, sf_dir).select("row_id", "tenths", F.coalesce("language", F.lit("xx")).alias("language"), F.lit(None).cast("string").alias("joined"))
    r = r.withColumn("card_json", F.to_json(F.struct("tenths", "language")))
    r = r.withColumns({"tenths": F.when(F.col("row_id") % 5 == 0, F.col("tenths") + 1).otherwise(F.col("tenths")), "language": F.when(F.col("row_id") % 7 == 0, "zz").otherwise(F.col("language"))})
    return inventory.attribution(r, {"tenths": "$.tenths", "language": "$.language", "joined": "$.joined"}, ("joined",)).select("row_id", F.array_join("mismatched", ",").alias("mismatched"))


@query("SELECT event_id AS k, event_id % 5 = 0 OR event_id % 7 = 0 AS changed FROM events")
def record_hashes(spark, sf_dir):
    """Whole-card digests: the key order and the photo host do not count, every value does."""
    c = cards(spark, sf_dir).select("row_id", "card_json")
    k = F.col("row_id")
    other = F.regexp_replace("card_json", "cf.photos.example.com", "q-xx.photos.example.com")
    other = F.regexp_replace(other, r'^\{"__typename":"ReviewCard",(.*)\}$', '{$1,"__typename":"ReviewCard"}')
    other = F.when(k % 5 == 0, F.regexp_replace(other, '"title":"[^"]*"', '"title":"changed"')).when(k % 7 == 0, F.regexp_replace(other, r"\.jpg\?k=1", ".jpg?k=2")).otherwise(other)
    return c.select(k.alias("k"), (contract.record_hash(F.col("card_json")) != contract.record_hash(other)).alias("changed"))


_RUNS = "(SELECT 'r' || event_id AS run_id, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'succeeded' ELSE 'failed' END AS status, CASE WHEN event_id % 3 = 2 THEN 'OLD' || user_id END AS error_code FROM events WHERE event_id % 7 > 0)"
_FAILS = "(SELECT 'r' || event_id AS run_id, upper(event_type) AS code FROM events WHERE event_id % 4 = 0)"


@query(f"SELECT coalesce(r.run_id, f.run_id) AS run_id, CASE WHEN f.run_id IS NULL OR r.status = 'succeeded' THEN r.status WHEN r.run_id IS NOT NULL THEN 'failed' END AS status, CASE WHEN r.status = 'succeeded' OR f.run_id IS NULL THEN r.error_code WHEN r.run_id IS NOT NULL THEN f.code END AS error_code, CASE WHEN r.run_id IS NULL THEN 'RUN_NOT_FOUND' WHEN r.status = 'succeeded' AND f.run_id IS NOT NULL THEN 'RUN_ALREADY_PUBLISHED' END AS conflict FROM {_RUNS} AS r FULL JOIN {_FAILS} AS f ON r.run_id = f.run_id")
def failed_runs(spark, sf_dir):
    """Runs after some were failed; one that is published can't be."""
    return inventory.fail_runs(values(spark, sf_dir, _RUNS), values(spark, sf_dir, _FAILS))


@query(f"{R} SELECT property_key, count(*) FILTER (WHERE row_id % 10 <> 0) AS n, CASE WHEN property_key = 'view' THEN 'COUNT_MOVED' WHEN property_key = 'click' THEN 'RECORDS_MOVED' ELSE 'OK' END AS verdict FROM rev GROUP BY 1")
def promotion_rechecks(spark, sf_dir):
    """Evidence rebuilt before promotion, against what was attested: for one property a row has gone since, for one a record has changed."""
    staged = registry.inventory(spark, sf_dir, 10)
    attested = snapshots.inventory_digest(staged.withColumn("record_hash", F.when((F.col("property_key") == "click") & (F.col("row_id") % 9 == 0), "x").otherwise(F.col("record_hash"))))
    attested = attested.withColumn("n", F.col("n") + (F.col("property_key") == "view").cast("int"))
    return inventory.rechecked(attested, staged).select("property_key", "n", "verdict")


_STAGE = "(SELECT 'r' || (event_id % 10) AS run_id, event_id * 10 AS page_offset, md5(event_type || user_id) AS page_hash, event_id % 11 AS n_cards FROM events WHERE event_id % 13 > 0)"
_AGAIN = "(SELECT 'r' || (event_id % 10) AS run_id, event_id * 10 AS page_offset, md5(CASE WHEN event_id % 7 = 0 THEN 'other' ELSE event_type || user_id END) AS page_hash, event_id % 11 + CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS n_cards FROM events WHERE event_id % 3 > 0)"


@query("SELECT 'r' || (event_id % 10) AS run_id, event_id * 10 AS page_offset, CASE WHEN event_id % 13 = 0 THEN 'STAGED' WHEN event_id % 7 = 0 OR event_id % 17 = 0 THEN 'CONFLICT' ELSE 'REPLAYED' END AS outcome FROM events WHERE event_id % 3 > 0")
def staged_pages(spark, sf_dir):
    """Pages that come to a run: a replay changes nothing, another content at the same place fails the run."""
    return inventory.staged(values(spark, sf_dir, _STAGE), values(spark, sf_dir, _AGAIN)).select("run_id", "page_offset", "outcome")


_CONFIG = """(SELECT event_id AS ordinal, CASE WHEN event_id % 97 = 0 THEN '' ELSE 'p' || event_id END AS property_key, CASE WHEN event_id % 89 = 0 THEN -1 - event_id WHEN event_id % 83 = 1 THEN event_id - 1 ELSE event_id END AS hotel_id,
    CASE WHEN event_id % 79 = 0 THEN '/x' WHEN event_id % 73 = 0 THEN 'y' || event_id ELSE '/' || event_type || event_id END AS path FROM events)"""


@query(f"SELECT field, value, n FROM (SELECT 'hotel_id' AS field, CAST(hotel_id AS VARCHAR) AS value, count(*) AS n FROM {_CONFIG} GROUP BY 2 UNION ALL SELECT 'path', path, count(*) FROM {_CONFIG} GROUP BY 2 UNION ALL SELECT 'property_key', property_key, count(*) FROM {_CONFIG} GROUP BY 2) WHERE n > 1 UNION ALL SELECT 'invalid', property_key, 1 FROM {_CONFIG} WHERE property_key = '' OR hotel_id <= 0 OR path NOT LIKE '/%' UNION ALL SELECT 'unknown', 'zz', 1")
def config_checks(spark, sf_dir):
    """Repeated, invalid and unknown keys of a configuration."""
    return src.config_problems(values(spark, sf_dir, _CONFIG), ("p1", "zz"))


@query("SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN 'guest.avatarUrl,guest.session_ID' WHEN event_id % 3 = 1 THEN 'links[]:url' ELSE '' END AS paths, CASE WHEN event_id % 3 = 0 THEN '{\"guest\":{\"session_ID\":\"[REDACTED]\",\"avatarUrl\":\"[REDACTED]\"}}' WHEN event_id % 3 = 1 THEN '{\"links\":[\"https://x.example/?token=[REDACTED]&b=1\"]}' ELSE '{\"n\":1}' END AS masked FROM events")
def sensitive_keys(spark, sf_dir):
    """Keys and URLs that must not leave, at any depth, and the records with their values masked."""
    k = F.col("event_id")
    text = F.when(k % 3 == 0, '{"guest":{"session_ID":"s","avatarUrl":"u"}}').when(k % 3 == 1, '{"links":["https://x.example/?token=abc&b=1"]}').otherwise('{"n":1}')
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(k.alias("k"), text.alias("t"))
    return rows.select("k", F.array_join(export.sensitive_paths("t"), ",").alias("paths"), export.redacted_json("t").alias("masked"))


@query("SELECT user_id % 10 AS k, CAST(count(*) AS BIGINT) AS pages, round(count(*) * 60000 / greatest(1, round(sum(value))), 2) AS pages_per_minute, round(CAST(sum(event_id % 11) AS DOUBLE) * 60000 / greatest(1, round(sum(value))), 2) AS reviews_per_minute FROM events GROUP BY 1")
def run_throughput(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy((F.col("user_id") % 10).alias("k")).agg(F.count("*").alias("pages"), F.sum(F.col("event_id") % 11).alias("reviews"), F.sum("value").alias("duration_ms"))
    return metrics.throughput(runs).select("k", "pages", "pages_per_minute", "reviews_per_minute")


def _engine(spark, sf_dir):
    engine = ReviewEngine(src.properties(spark), values(spark, sf_dir, sql.EIGHT_EVIDENCE))
    engine.load(src.canonical(spark, sf_dir), 1)
    return engine


@query(f"{R} SELECT public_id, property_key, local_date, tenths, sentiment FROM rev WHERE local_date >= DATE '2024-01-10' ORDER BY epoch DESC, public_id LIMIT 4")
def dashboard_recent(spark, sf_dir):
    """The recent reviews among an engine's sections."""
    from datetime import date

    return _engine(spark, sf_dir).sections(feed.FeedQuery(start=date(2024, 1, 10)), registry.TODAY).recent.select("public_id", "property_key", "local_date", "tenths", "sentiment")


@query(f"{R}, s AS (SELECT * FROM rev WHERE property_key IN ('view', 'click')), c AS (SELECT avg(tenths) FILTER (WHERE {sql.NOW}) / 10 AS now_, avg(tenths) FILTER (WHERE {sql.BEFORE}) / 10 AS before_ FROM s) SELECT 'average' AS section, now_ AS figure FROM c UNION ALL SELECT 'delta', now_ - before_ FROM c UNION ALL SELECT 'feed', count(*) FROM s UNION ALL SELECT 'weeks', 12 UNION ALL SELECT 'quality', 8 UNION ALL SELECT 'properties', 2")
def dashboard_sections(spark, sf_dir):
    """Figures out of all sections of one query, from facts that are classified once."""
    s = _engine(spark, sf_dir).sections(feed.FeedQuery(properties=("view", "click")), registry.TODAY)
    n = lambda df, name: df.agg(F.count("*").cast("double").alias("figure")).select(F.lit(name).alias("section"), "figure")
    out = s.overview.select(F.explode(F.array(F.struct(F.lit("average").alias("section"), F.col("current_average").alias("figure")), F.struct(F.lit("delta").alias("section"), F.col("average_delta").alias("figure")))).alias("x")).select("x.*")
    for part in (spark.range(1).select(F.lit("feed").alias("section"), F.lit(float(s.total)).alias("figure")), n(s.trend, "weeks"), n(s.quality, "quality"), n(s.properties, "properties")):
        out = out.unionByName(part)
    return out
