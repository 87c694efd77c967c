"""DuckDB SQL that computes what the registered queries do, over the same tables."""

from __future__ import annotations

from reviewlake.sources.reviews import AS_OF, NEGATIVE_TEXTS, POSITIVE_TEXTS, PROPERTIES


def _text(t) -> str:
    return "NULL" if t is None else "'" + str(t).replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _text(x) for x in r) + ")" for r in rows)


def _state(c: str, fillers: tuple[str, ...]) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN 'empty' WHEN {c} IN ({', '.join(map(_text, fillers))}) THEN 'placeholder' ELSE 'substantive' END"


#: The adapter, and the sentiment of each review.
REVIEWS = f"""WITH pos(i, t) AS (VALUES {_values(enumerate(POSITIVE_TEXTS))}), neg(i, t) AS (VALUES {_values(enumerate(NEGATIVE_TEXTS))}),
props(ordinal, property_key, property_name, hotel_id) AS (VALUES {_values((i, *p) for i, p in enumerate(PROPERTIES))}),
raw AS (SELECT e.event_id AS row_id, e.event_type AS property_key, CAST(e.event_id AS VARCHAR) AS token, CAST(floor(epoch(e.ts)) AS BIGINT) AS epoch,
    CAST(e.ts + INTERVAL 11 HOUR AS DATE) AS local_date, CAST(CAST(floor(e.value * 100) AS BIGINT) % 101 AS INTEGER) AS tenths,
    pos.t AS positive_text, neg.t AS negative_text, CASE e.user_id % 3 WHEN 0 THEN 'Thank you' WHEN 1 THEN '' END AS partner_reply,
    CASE e.user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END AS language,
    CASE e.user_id % 3 WHEN 0 THEN 'couple' WHEN 1 THEN 'solo_traveller' ELSE 'family with_children' END AS guest_type,
    CASE e.user_id % 5 WHEN 0 THEN 'Studio' WHEN 1 THEN 'Queen Room' WHEN 3 THEN 'Family Suite' END AS room,
    CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS helpful
    FROM events e LEFT JOIN pos ON pos.i = e.event_id % {len(POSITIVE_TEXTS)} LEFT JOIN neg ON neg.i = e.event_id % {len(NEGATIVE_TEXTS)}),
stated AS (SELECT *, {_state('positive_text', ('n/a',))} AS positive_state, {_state('negative_text', ('nothing',))} AS negative_state,
    CASE WHEN tenths >= 80 THEN 'positive' WHEN tenths < 70 THEN 'negative' ELSE 'mixed' END AS band FROM raw),
ruled AS (SELECT *, 'sentiment.' || CASE WHEN positive_state = 'substantive' AND negative_state = 'substantive' THEN 'both_text_channels'
    WHEN positive_state = 'substantive' THEN CASE WHEN band = 'negative' THEN 'positive_text_low_score' ELSE 'positive_text' END
    WHEN negative_state = 'substantive' THEN CASE WHEN band = 'positive' THEN 'negative_text_high_score' ELSE 'negative_text' END
    ELSE 'score_only_' || band END AS sentiment_rule FROM stated),
labelled AS (SELECT *, CASE WHEN sentiment_rule IN ('sentiment.both_text_channels', 'sentiment.positive_text_low_score', 'sentiment.negative_text_high_score') THEN 'mixed'
    WHEN sentiment_rule = 'sentiment.positive_text' THEN 'positive' WHEN sentiment_rule = 'sentiment.negative_text' THEN 'negative' ELSE band END AS sentiment FROM ruled),
rev AS (SELECT *, sentiment = 'negative' OR negative_state = 'substantive' AS has_negative_feedback,
    substr(sha256(property_key || ':' || token), 1, 24) AS public_id FROM labelled)"""

#: Fixed values, stated here again: the topics with their labels.
TOPICS = (
    ("cleanliness", "Cleanliness"), ("check_in", "Check-in experience"), ("staff_reception", "Staff or receptionist behaviour"), ("noise", "Noise"),
    ("facilities", "Facilities"), ("location", "Location"), ("room_condition", "Room condition"), ("value_for_money", "Value for money"),
)
#: Topics of the adapter's texts as a reader labels them: (channel, text, topic, polarity).
LABELLED = (
    ("p", 1, "cleanliness", "positive"), ("p", 1, "staff_reception", "positive"), ("p", 2, "location", "positive"), ("p", 3, "noise", "positive"), ("p", 3, "value_for_money", "positive"),
    ("p", 5, "cleanliness", "negative"), ("p", 5, "check_in", "positive"), ("p", 6, "facilities", "positive"),
    ("n", 2, "cleanliness", "negative"), ("n", 2, "noise", "negative"), ("n", 2, "room_condition", "negative"), ("n", 3, "value_for_money", "negative"), ("n", 3, "check_in", "negative"), ("n", 3, "noise", "positive"), ("n", 4, "facilities", "negative"),
)
TOPICAL = f"""{REVIEWS}, said(channel, i, topic, polarity) AS (VALUES {_values(LABELLED)}),
dim(topic_ordinal, topic, topic_label) AS (VALUES {_values((i, *t) for i, t in enumerate(TOPICS))}),
every AS (SELECT r.row_id, s.topic, s.polarity FROM rev r JOIN said s ON s.channel = 'p' AND s.i = r.row_id % {len(POSITIVE_TEXTS)}
    UNION ALL SELECT r.row_id, s.topic, s.polarity FROM rev r JOIN said s ON s.channel = 'n' AND s.i = r.row_id % {len(NEGATIVE_TEXTS)}),
top AS (SELECT row_id, topic, CASE WHEN count(DISTINCT polarity) > 1 THEN 'mixed' ELSE min(polarity) END AS polarity FROM every GROUP BY 1, 2)"""

#: Evidence in the adapter's texts as a reader marks it: (channel, text, topic, rule, matched words, polarity, negated); places are found by search.
MARKED = (
    ("p", 1, "cleanliness", "positive_condition", "spotless", "positive", 0), ("p", 1, "staff_reception", "positive_behaviour", "staff were friendly", "positive", 0),
    ("p", 2, "location", "positive_access", "Great location", "positive", 0), ("p", 2, "location", "positive_access", "close to", "positive", 0),
    ("p", 3, "noise", "positive_condition", "Quiet", "positive", 0), ("p", 3, "value_for_money", "positive_value", "good value", "positive", 0),
    ("p", 5, "cleanliness", "positive_condition", "clean", "negative", 1), ("p", 5, "check_in", "positive_experience", "easy check-in", "positive", 0),
    ("p", 6, "facilities", "positive_quality", "Fast wifi", "positive", 0), ("p", 6, "facilities", "positive_quality", "hot water", "positive", 0),
    ("n", 2, "room_condition", "source_anchor", "bathroom", "negative", 0), ("n", 2, "cleanliness", "negative_condition", "dirty", "negative", 0), ("n", 2, "noise", "negative_condition", "street noise", "negative", 0), ("n", 2, "noise", "negative_condition", "loud", "negative", 0),
    ("n", 3, "value_for_money", "negative_value", "Expensive", "negative", 0), ("n", 3, "check_in", "negative_experience", "slow check-in", "negative", 0), ("n", 3, "noise", "negative_condition", "noisy", "positive", 1),
    ("n", 4, "facilities", "missing", "No lift", "negative", 0),
)
TOPIC_EVIDENCE = f"""{REVIEWS}, marked(channel, i, topic, rule, words, polarity, negated) AS (VALUES {_values(MARKED)})
SELECT r.row_id, m.topic, m.topic || '.' || m.rule AS rule, CASE m.channel WHEN 'p' THEN 'positive_text' ELSE 'negative_text' END AS field, CAST(strpos(CASE m.channel WHEN 'p' THEN r.positive_text ELSE r.negative_text END, m.words) - 1 AS INTEGER) AS "start",
    CAST(strpos(CASE m.channel WHEN 'p' THEN r.positive_text ELSE r.negative_text END, m.words) - 1 + length(m.words) AS INTEGER) AS "end", m.words AS text, m.polarity, m.negated = 1 AS negated
FROM rev r JOIN marked m ON m.channel = 'p' AND m.i = r.row_id % {len(POSITIVE_TEXTS)} OR m.channel = 'n' AND m.i = r.row_id % {len(NEGATIVE_TEXTS)}"""
REVIEW_TOPICS = f"{TOPICAL} SELECT row_id, topic, polarity FROM top"
NOW, BEFORE = "local_date BETWEEN DATE '2024-01-22' AND DATE '2024-01-26'", "local_date BETWEEN DATE '2024-01-15' AND DATE '2024-01-19'"


def compared(start: str, end: str, before_start: str, before_end: str, keyed: bool) -> str:
    now, before = f"local_date BETWEEN DATE '{start}' AND DATE '{end}'", f"local_date BETWEEN DATE '{before_start}' AND DATE '{before_end}'"
    n = lambda c: f"count(*) FILTER (WHERE ({now}) AND {c})"
    key, group = ("property_key, ", " GROUP BY property_key") if keyed else ("", "")
    return f"""{REVIEWS}, per AS (SELECT {key}avg(tenths) FILTER (WHERE {now}) / 10 AS current_average, count(*) FILTER (WHERE {now}) AS current_count,
    {n("sentiment = 'positive'")} AS current_positive, {n("sentiment = 'mixed'")} AS current_mixed, {n("sentiment = 'negative'")} AS current_negative, {n("sentiment = 'unclassified'")} AS current_unclassified,
    {n("has_negative_feedback")} AS current_negative_feedback, {n("partner_reply <> ''")} AS current_responses,
    avg(tenths) FILTER (WHERE {before}) / 10 AS previous_average, count(*) FILTER (WHERE {before}) AS previous_count FROM rev WHERE ({now}) OR ({before}){group})
SELECT *, current_average - previous_average AS average_delta, CASE WHEN current_average - previous_average IS NULL THEN 'unavailable'
    WHEN abs(current_average - previous_average) < 0.0001 THEN 'flat' WHEN current_average > previous_average THEN 'up' ELSE 'down' END AS direction FROM per"""


WEEKLY_TREND = f"""{REVIEWS}, weeks AS (SELECT CAST(w AS DATE) AS week_start FROM generate_series(DATE '2023-11-06', DATE '2024-01-22', INTERVAL 7 DAY) AS g(w)),
bounded AS (SELECT week_start, least(week_start + 6, DATE '{AS_OF}') AS week_end FROM weeks)
SELECT b.week_start, b.week_end, b.week_end < b.week_start + 6 AS is_partial, avg(r.tenths) / 10 AS average, count(r.row_id) AS reviews,
    count(*) FILTER (WHERE r.sentiment = 'negative') AS negative, count(*) FILTER (WHERE r.sentiment = 'negative') / nullif(CAST(count(r.row_id) AS DOUBLE), 0) * 100 AS negative_share
FROM bounded b LEFT JOIN rev r ON r.local_date BETWEEN b.week_start AND b.week_end GROUP BY 1, 2"""

HISTOGRAM = f"""{REVIEWS}, b(bucket_ordinal, bucket, low, high) AS (VALUES (0, '9+', 90, 101), (1, '7-9', 70, 90), (2, '5-7', 50, 70), (3, '3-5', 30, 50), (4, '0-3', 0, 30))
SELECT bucket_ordinal, bucket, count(row_id) AS reviews, CAST(count(row_id) AS DOUBLE) / (SELECT count(*) FROM rev) * 100 AS share FROM b LEFT JOIN rev ON tenths >= low AND tenths < high GROUP BY 1, 2"""

SOURCE_BUCKETS = f"{REVIEWS} SELECT property_key, CASE WHEN tenths >= 90 THEN 'wonderful' WHEN tenths >= 70 THEN 'good' WHEN tenths >= 50 THEN 'okay' WHEN tenths >= 30 THEN 'poor' WHEN tenths >= 10 THEN 'very_poor' END AS bucket, count(*) AS reviews FROM rev GROUP BY 1, 2"

_COUNTED = f"""{TOPICAL}, neg_now AS (SELECT r.property_key, t.topic, r.epoch, r.row_id, {NOW} AS is_now, {BEFORE} AS is_before FROM top t JOIN rev r USING (row_id) WHERE r.has_negative_feedback AND t.polarity IN ('negative', 'mixed')),
per_property AS (SELECT property_key, topic, count(*) AS n, min((-epoch, row_id)) AS first_seen FROM neg_now WHERE is_now GROUP BY 1, 2),
led AS (SELECT topic, property_key, count(*) OVER (PARTITION BY topic) AS affected, row_number() OVER (PARTITION BY topic ORDER BY n DESC, first_seen) AS k FROM per_property),
top_topic AS (SELECT property_key, topic AS top_topic, n AS top_topic_mentions, row_number() OVER (PARTITION BY property_key ORDER BY n DESC, topic) AS k FROM per_property),
whole AS (SELECT count(*) FILTER (WHERE {NOW}) AS now_all, count(*) FILTER (WHERE {BEFORE}) AS before_all FROM rev WHERE has_negative_feedback),
tm AS (SELECT d.topic_ordinal, d.topic, d.topic_label, (SELECT count(*) FROM neg_now n WHERE n.topic = d.topic AND is_now) AS negative_mentions,
    (SELECT count(*) FROM neg_now n WHERE n.topic = d.topic AND is_now) / nullif(CAST(now_all AS DOUBLE), 0) * 100 AS negative_share,
    (SELECT count(*) FROM neg_now n WHERE n.topic = d.topic AND is_before) / nullif(CAST(before_all AS DOUBLE), 0) * 100 AS previous_share,
    (SELECT count(*) FROM top t WHERE t.topic = d.topic) AS all_mentions, coalesce(l.affected, 0) AS affected_properties, p.property_name AS leading_property
    FROM dim d CROSS JOIN whole LEFT JOIN led l ON l.topic = d.topic AND l.k = 1 LEFT JOIN props p ON p.property_key = l.property_key),
pm AS (SELECT p.ordinal, p.property_key, p.property_name, count(r.row_id) AS reviews, avg(r.tenths) / 10 AS average, avg(r.tenths) FILTER (WHERE {NOW}) / 10 AS current_average,
    avg(r.tenths) FILTER (WHERE {BEFORE}) / 10 AS previous_average, avg(r.tenths) FILTER (WHERE {NOW}) / 10 - avg(r.tenths) FILTER (WHERE {BEFORE}) / 10 AS week_delta,
    count(*) FILTER (WHERE {NOW}) AS current_count, count(*) FILTER (WHERE {NOW} AND sentiment = 'negative') / nullif(CAST(count(*) FILTER (WHERE {NOW}) AS DOUBLE), 0) * 100 AS negative_share,
    count(*) FILTER (WHERE {NOW} AND partner_reply <> '') / nullif(CAST(count(*) FILTER (WHERE {NOW}) AS DOUBLE), 0) * 100 AS response_rate, any_value(t.top_topic) AS top_topic, max(r.local_date) AS last_date
    FROM props p LEFT JOIN rev r USING (property_key) LEFT JOIN top_topic t ON t.property_key = p.property_key AND t.k = 1 GROUP BY 1, 2, 3)"""
TOPIC_METRICS = f"""{_COUNTED} SELECT *, negative_share - previous_share AS share_delta, CASE WHEN negative_share - previous_share IS NULL THEN 'unavailable' WHEN negative_share - previous_share > 2 THEN 'worsening'
    WHEN negative_share - previous_share < -2 THEN 'improving' ELSE 'stable' END AS trend FROM tm"""
TOP_TOPIC = f"{_COUNTED} SELECT property_key, top_topic, top_topic_mentions FROM top_topic WHERE k = 1"
PROPERTY_METRICS = f"{_COUNTED} SELECT * FROM pm"

TOPIC_HITS = f"{TOPICAL} SELECT r.property_key, " + ", ".join(f"count(*) FILTER (WHERE t.topic = '{t}') AS {t}" for t, _ in TOPICS) + " FROM rev r LEFT JOIN top t USING (row_id) GROUP BY 1"


def feed(order: str, page: int, where: str = "true", size: int = 20, topical: bool = False) -> str:
    return f"""{TOPICAL if topical else REVIEWS}, hit AS (SELECT *, count(*) OVER () AS total FROM rev WHERE {where})
SELECT public_id, row_id, property_key, local_date, tenths, sentiment, helpful, total, CAST(ceil(total / {size}.0) AS BIGINT) AS pages,
    CAST(least({page}, greatest(1, ceil(total / {size}.0))) AS BIGINT) AS page
FROM hit QUALIFY row_number() OVER (ORDER BY {order}) BETWEEN (least({page}, greatest(1, ceil(total / {size}.0))) - 1) * {size} + 1 AND least({page}, greatest(1, ceil(total / {size}.0))) * {size}"""



def _evidence(place: str, key: str) -> str:
    """Evidence of publications, one for each group of events: two inventories that agree or don't, counts that were shown, and attested gaps."""
    return f"""(SELECT u AS ordinal, property_key, CASE WHEN u % 9 <> 4 THEN 'r1' END AS published_run, n AS oldest_count, n AS newest_count, ids AS oldest_ids, CASE WHEN u % 11 = 2 THEN fewer ELSE ids END AS newest_ids,
    records AS oldest_records, records + CASE WHEN u % 21 = 5 THEN 1 ELSE 0 END AS newest_records, n - CASE WHEN u % 23 = 9 THEN 1 ELSE 0 END AS present,
    n + CASE WHEN u % 7 = 3 THEN 3 WHEN u % 6 = 1 THEN 2 WHEN u % 19 = 8 THEN 1 ELSE 0 END AS displayed, n AS structured, n AS final_count,
    u % 7 = 3 OR u % 12 = 7 AS gap_attested, u % 7 = 3 AND u % 5 <> 1 AS gap_valid, u % 6 = 1 AS visible_attested, u % 6 = 1 AND u % 5 > 0 AS visible_valid
    FROM (SELECT {place} AS u, {key} AS property_key, count(*) AS n, sum(event_id) AS ids, sum(CASE WHEN event_id % 5 > 0 THEN event_id + 1 ELSE 0 END) AS fewer, sum(event_id * user_id) AS records FROM events GROUP BY 1, 2) AS g)"""


#: Evidence of the five properties, and of as many as there are users.
EVIDENCE = _evidence("CASE " + " ".join(f"WHEN event_type = '{k}' THEN {i}" for i, (k, *_) in enumerate(PROPERTIES)) + " END", "event_type")
MUCH_EVIDENCE = _evidence("user_id", "'u' || user_id")
#: Evidence of eight cases: every step of the status ladder is among them.
EIGHT_EVIDENCE = _evidence("event_id % 8", "'p' || (event_id % 8)")
_STATUS = """CASE WHEN published_run IS NULL THEN 'collecting' WHEN (oldest_count, oldest_ids, oldest_records) IS DISTINCT FROM (newest_count, newest_ids, newest_records) OR gap_attested AND visible_attested THEN 'evidence-error'
    WHEN present <> structured OR final_count <> structured THEN 'evidence-error' WHEN gap_attested THEN CASE WHEN gap_valid THEN 'source-gap' ELSE 'evidence-error' END
    WHEN displayed = structured THEN 'verified' WHEN visible_attested AND visible_valid THEN 'source-gap' ELSE 'evidence-error' END"""
QUALITY_ROWS = f"""WITH t AS (SELECT *, {_STATUS} AS status, CASE WHEN published_run IS NOT NULL THEN displayed - present ELSE 0 END AS source_gap FROM {MUCH_EVIDENCE})
SELECT ordinal, property_key, status, CASE WHEN published_run IS NOT NULL THEN present END AS retrievable, CASE WHEN published_run IS NOT NULL THEN displayed END AS advertised, source_gap,
    CASE status WHEN 'verified' THEN 'Counts, identities and records agree.' WHEN 'source-gap' THEN source_gap || ' advertised but not returned; the evidence for it holds.' WHEN 'collecting' THEN 'No accepted full publication yet.' ELSE 'The stored evidence does not agree.' END AS note FROM t"""
OVERALL = f"""WITH t AS (SELECT {_STATUS} AS status FROM {MUCH_EVIDENCE}) SELECT CASE WHEN bool_or(status = 'evidence-error') THEN 'error' WHEN bool_or(status = 'collecting') THEN 'collecting' WHEN bool_or(status = 'source-gap') THEN 'attention' ELSE 'verified' END AS overall,
    count(*) FILTER (WHERE status IN ('verified', 'source-gap')) AS accepted, count(*) FILTER (WHERE status NOT IN ('verified', 'source-gap')) AS pending FROM t"""
ALERTS = f"""{_COUNTED}, fall AS (SELECT 0 AS priority, ordinal, 'rating:' || property_key AS alert, CASE WHEN week_delta <= -1 THEN 'high' ELSE 'medium' END AS severity, week_delta FROM pm WHERE week_delta IS NOT NULL ORDER BY week_delta, ordinal LIMIT 1),
often AS (SELECT 1 AS priority, topic_ordinal AS ordinal, 'topic:' || topic AS alert, CASE WHEN negative_share >= 40 THEN 'high' ELSE 'medium' END AS severity, negative_share FROM tm WHERE negative_share IS NOT NULL ORDER BY negative_share DESC, topic_ordinal LIMIT 1),
stated_quality AS (SELECT ordinal, property_key, {_STATUS} AS status FROM {EVIDENCE})
SELECT * FROM (SELECT priority, ordinal, alert, severity FROM fall WHERE week_delta <= -0.3 UNION ALL SELECT priority, ordinal, alert, severity FROM often WHERE negative_share >= 20
    UNION ALL SELECT 2, ordinal, 'quality:' || property_key, 'low' FROM stated_quality WHERE status = 'source-gap'
    UNION ALL SELECT 3, ordinal, 'quality-error:' || property_key, 'high' FROM stated_quality WHERE status = 'evidence-error') ORDER BY priority, ordinal LIMIT 4"""

#: Publications, one for each event, with faults of every kind, alone and together.
PUBLICATIONS = """(SELECT 'e' || k AS property_key, run AS published_run, CASE WHEN k % 41 = 0 THEN 'r0' ELSE run END AS last_full_run, CASE WHEN k % 43 = 0 THEN NULL WHEN k % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS run_status,
    CASE WHEN k % 11 = 0 THEN 'v0' ELSE 'v1' END AS run_parser, 'v1' AS expected_parser, k % 13 > 0 AS complete_inventory, CASE WHEN k % 17 = 0 THEN 'other' ELSE 'e' || k END AS run_property, CASE WHEN k % 53 = 0 THEN n + 1 ELSE n END AS present, n AS final_count,
    n AS oldest_count, CASE WHEN k % 61 = 0 THEN n + 1 ELSE n END AS newest_count, 'a' || n AS oldest_ids, CASE WHEN k % 67 = 0 THEN 'b' ELSE 'a' || n END AS newest_ids, 'x' || user_id AS oldest_records, CASE WHEN k % 71 = 0 THEN 'y' ELSE 'x' || user_id END AS newest_records,
    CASE WHEN k % 47 = 0 THEN NULL WHEN k % 59 = 0 THEN n - 1 ELSE n END AS structured, n + k % 4 AS displayed, k % 3 = 0 AS gap_attested, k % 3 = 0 AND k % 19 > 0 AS gap_valid, k % 5 = 0 AS visible_attested, k % 5 = 0 AND k % 23 > 0 AS visible_valid,
    CASE WHEN k % 29 = 0 THEN n + 7 ELSE n + k % 4 END AS gap_advertised, n AS gap_retrievable
    FROM (SELECT event_id AS k, user_id, event_id % 600 AS n, CASE WHEN event_id % 37 > 0 THEN 'r' || user_id END AS run FROM events) AS e)"""
_COUNTED_ONCE = "coalesce(structured = final_count AND structured = present, false)"
PUBLICATION_REASONS = f"""SELECT property_key, CASE WHEN published_run IS NULL THEN 'publication_missing' ELSE concat_ws(',',
    CASE WHEN run_status IS NULL THEN 'latest_run_missing' END, CASE WHEN run_status <> 'succeeded' THEN 'latest_run_not_succeeded' END, CASE WHEN run_parser IS DISTINCT FROM expected_parser THEN 'latest_run_parser_version_mismatch' END,
    CASE WHEN NOT coalesce(complete_inventory, false) THEN 'latest_run_not_complete_inventory' END, CASE WHEN run_property IS DISTINCT FROM property_key THEN 'latest_run_property_mismatch' END, CASE WHEN present IS DISTINCT FROM final_count THEN 'published_count_mismatch' END,
    CASE WHEN last_full_run IS DISTINCT FROM published_run THEN 'latest_run_is_not_latest_full_run' END, CASE WHEN (oldest_count, oldest_ids, oldest_records) IS DISTINCT FROM (newest_count, newest_ids, newest_records) THEN 'full_inventory_attestation_invalid' END,
    CASE WHEN gap_attested AND NOT gap_valid THEN 'source_discrepancy_attestation_invalid' END,
    CASE WHEN structured IS NULL THEN 'property_snapshot_missing' WHEN NOT {_COUNTED_ONCE} THEN 'property_snapshot_count_mismatch' END,
    CASE WHEN {_COUNTED_ONCE} AND gap_attested AND visible_attested THEN 'conflicting_count_discrepancy_attestations' END,
    CASE WHEN {_COUNTED_ONCE} AND gap_attested AND gap_valid AND (displayed, structured) IS DISTINCT FROM (gap_advertised, gap_retrievable) THEN 'source_discrepancy_snapshot_mismatch' END,
    CASE WHEN {_COUNTED_ONCE} AND NOT gap_attested AND displayed IS DISTINCT FROM structured AND NOT visible_valid THEN 'visible_count_discrepancy_invalid' END,
    CASE WHEN {_COUNTED_ONCE} AND NOT gap_attested AND displayed = structured AND visible_attested THEN 'unexpected_visible_count_discrepancy' END) END AS reasons FROM {PUBLICATIONS}"""

COUNTS = "(SELECT event_id * 37 % 1500 - 10 AS n FROM events)"
#: Five events are the five score buckets of a property; some are missing, some fall short, some have more than they say.
BUCKETS = """(SELECT 'p' || q AS property_key, CASE b WHEN 0 THEN 'REVIEW_ADJ_SUPERB' WHEN 1 THEN 'REVIEW_ADJ_GOOD' WHEN 2 THEN 'REVIEW_ADJ_AVERAGE_PASSABLE' WHEN 3 THEN 'REVIEW_ADJ_POOR' ELSE 'REVIEW_ADJ_VERY_POOR' END AS bucket, advertised,
    advertised - CASE WHEN q % 6 = b THEN 2 ELSE 0 END - CASE WHEN q % 4 = b THEN 1 ELSE 0 END + CASE WHEN q % 29 = b THEN 3 ELSE 0 END - CASE WHEN q % 31 = 7 THEN 4 ELSE 0 END AS retrievable
    FROM (SELECT CAST((event_id - event_id % 5) / 5 AS BIGINT) AS q, event_id % 5 AS b, 60 + event_id % 97 AS advertised FROM events WHERE event_id % 61 > 0) AS e)"""
SHORTFALLS = f"""WITH b AS (SELECT *, advertised - retrievable AS short, list_position(['REVIEW_ADJ_SUPERB', 'REVIEW_ADJ_GOOD', 'REVIEW_ADJ_AVERAGE_PASSABLE', 'REVIEW_ADJ_POOR', 'REVIEW_ADJ_VERY_POOR'], bucket) AS place FROM {BUCKETS}),
p AS (SELECT property_key, CAST(sum(advertised) AS BIGINT) AS advertised, CAST(sum(retrievable) AS BIGINT) AS retrievable, CAST(sum(short) AS BIGINT) AS gap, min(short) AS low, count(*) AS n FROM b GROUP BY 1),
h AS (SELECT property_key, bucket AS headline_bucket, short AS headline_gap FROM b QUALIFY row_number() OVER (PARTITION BY property_key ORDER BY short DESC, place) = 1)
SELECT property_key, advertised, retrievable, gap, least(5, CAST(floor(advertised * 0.01) AS INTEGER)) AS tolerated, headline_bucket, headline_gap,
    CASE WHEN n <> 5 THEN 'BUCKET_SET_MISMATCH' WHEN low < 0 THEN 'BUCKET_SURPLUS' WHEN gap <= 0 THEN 'NO_GAP' WHEN gap > least(5, floor(advertised * 0.01)) THEN 'GAP_TOO_LARGE' ELSE 'OK' END AS verdict FROM p JOIN h USING (property_key)"""
SHOWN = "(SELECT 'e' || event_id AS property_key, event_id AS hotel_id, 100 + event_id % 9 AS visible, 100 + event_id % 4 AS structured FROM events)"
POLICY = "(SELECT 'e' || event_id AS property_key, CASE WHEN event_id % 7 = 0 THEN -1 ELSE event_id END AS hotel_id, 5 AS most_gap FROM events WHERE event_id % 3 > 0)"
VISIBLE_GAP = f"SELECT t.property_key, visible - structured AS gap, CASE WHEN visible = structured THEN 'none' WHEN p.most_gap IS NULL THEN 'no_policy' WHEN t.hotel_id <> p.hotel_id THEN 'identity' WHEN visible - structured BETWEEN 1 AND p.most_gap THEN 'accepted' ELSE 'out_of_range' END AS verdict FROM {SHOWN} AS t LEFT JOIN {POLICY} AS p ON p.property_key = t.property_key"
TOTALS = """(SELECT k, k % 7 > 0 AS unfiltered, n, CASE WHEN k % 11 > 0 AND k % 3 > 0 THEN n END AS a, CASE WHEN k % 11 > 0 THEN n + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END END AS b, CASE WHEN k % 11 > 0 AND k % 4 > 0 THEN n END AS c,
    CASE WHEN k % 11 > 0 AND k % 13 > 0 THEN n END AS d FROM (SELECT event_id AS k, event_id % 100 AS n FROM events) AS e)"""
TOTALS_STATUS = f"SELECT k, CASE WHEN NOT unfiltered THEN 'not_evaluated_filtered' WHEN coalesce(a, b, c, d) IS NULL THEN 'unavailable' WHEN coalesce(a, n) = n AND coalesce(b, n) = n AND coalesce(c, n) = n AND coalesce(d, n) = n THEN 'consistent' ELSE 'inconsistent' END AS status FROM {TOTALS}"

INVENTORY_PARITY = f"""{REVIEWS}, f AS (SELECT property_key, NOT (property_key = 'view' AND row_id % 7 = 0) AS kept, property_key = 'click' AND row_id % 5 = 0 AS changed FROM rev)
SELECT property_key, count(*) AS oldest_count, count(*) FILTER (WHERE kept) AS newest_count, count(*) FILTER (WHERE NOT kept) AS identity_mismatches, count(*) FILTER (WHERE kept AND changed) AS record_mismatches,
    CASE WHEN count(*) FILTER (WHERE NOT kept) > 0 THEN 'IDENTITY_MISMATCH' WHEN count(*) FILTER (WHERE changed) > 0 THEN 'RECORD_MISMATCH' ELSE 'OK' END AS verdict FROM f GROUP BY 1"""
_NUMBER = lambda x: f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"
DIGESTS = f"""{REVIEWS}, h AS (SELECT property_key, {_NUMBER("token")} AS i, {_NUMBER("token || '|' || md5(token || '|' || tenths)")} AS r FROM rev),
s AS (SELECT property_key, i % 256 AS shard, count(*) AS n, bit_xor(i) AS ix, sum(CAST(i AS HUGEINT)) AS isum, bit_xor(r) AS rx, sum(CAST(r AS HUGEINT)) AS rsum FROM h GROUP BY 1, 2)
SELECT property_key, CAST(sum(n) AS BIGINT) AS n, sha256('[' || string_agg('{{"shard":' || shard || ',"n":' || n || ',"ix":' || ix || ',"isum":' || isum || '}}', ',' ORDER BY shard) || ']') AS ids_digest,
    sha256('[' || string_agg('{{"shard":' || shard || ',"n":' || n || ',"rx":' || rx || ',"rsum":' || rsum || '}}', ',' ORDER BY shard) || ']') AS records_digest FROM s GROUP BY 1"""
SNAPSHOT_DIFF = f"""{REVIEWS} SELECT property_key, CASE WHEN row_id % 10 = 0 THEN 'inserted' WHEN row_id % 13 = 0 THEN 'missing' WHEN row_id % 17 = 0 THEN 'updated' ELSE 'unchanged' END AS change, count(*) AS n
FROM rev WHERE row_id % 10 <> 0 OR row_id % 13 <> 0 GROUP BY 1, 2"""
RECONCILE = f"""{REVIEWS} SELECT property_key, count(*) + CASE WHEN property_key = 'error' THEN 1 ELSE 0 END AS reported, count(*) AS unique_reviews, count(*) FILTER (WHERE row_id % 97 = 0) AS repeats,
    CASE WHEN property_key = 'error' THEN 'COUNT_MISMATCH' ELSE 'OK' END AS verdict FROM rev GROUP BY 1"""
MONOTONIC = f"""{REVIEWS}, p AS (SELECT property_key, row_id, CASE WHEN row_id % 101 = 0 THEN epoch - 86400 ELSE epoch END AS e FROM rev),
o AS (SELECT *, lag(e) OVER (PARTITION BY property_key ORDER BY row_id) AS before FROM p) SELECT property_key, row_id FROM o WHERE e < before"""
_OFFSETS = f"{REVIEWS}, pages AS (SELECT DISTINCT property_key, CAST(floor(row_id / 50) * 10 AS BIGINT) AS page_offset FROM rev)"
DENSE_OFFSETS = f"{_OFFSETS}, o AS (SELECT *, (row_number() OVER (PARTITION BY property_key ORDER BY page_offset) - 1) * 10 AS expected_offset FROM pages WHERE page_offset % 70 <> 60) SELECT property_key, page_offset, expected_offset FROM o WHERE page_offset <> expected_offset"
REPEATED_PAGES = f"{_OFFSETS}, o AS (SELECT *, min(page_offset) OVER (PARTITION BY property_key, page_offset % 930) AS first_offset FROM pages) SELECT property_key, page_offset, first_offset FROM o WHERE page_offset > first_offset"

#: Three complete runs in closed form: who is seen (s1 to s3) and with which score.
_RUNS = f"""{REVIEWS}, runs AS (SELECT property_key, row_id, row_id % 10 <> 0 AS s1, row_id % 13 <> 0 AS s2, row_id % 11 <> 0 AS s3, tenths AS t1, tenths + CASE WHEN row_id % 17 = 0 THEN 1 ELSE 0 END AS t2, tenths + CASE WHEN row_id % 19 = 0 THEN 2 ELSE 0 END AS t3 FROM rev),
known AS (SELECT *, CASE WHEN s2 THEN t2 ELSE t1 END AS after2, CASE WHEN s3 THEN t3 WHEN s2 THEN t2 ELSE t1 END AS after3 FROM runs WHERE s1 OR s2 OR s3),
done AS (SELECT property_key, after3 AS tenths,
    1 + CASE WHEN s1 AND s2 AND t1 <> t2 THEN 1 ELSE 0 END + CASE WHEN (s1 OR s2) AND s3 AND t3 <> after2 THEN 1 ELSE 0 END AS version,
    CASE WHEN s3 THEN 'present' WHEN s2 THEN 'suspect_missing' ELSE 'tombstoned' END AS presence, CASE WHEN s3 THEN 0 WHEN s2 THEN 1 ELSE 2 END AS misses,
    CASE WHEN s3 THEN NULL WHEN s2 THEN 3 ELSE 2 END AS suspect_since, CASE WHEN NOT s3 AND NOT s2 THEN 3 END AS tombstoned_at,
    CASE WHEN s1 AND NOT s2 AND s3 THEN 1 ELSE 0 END AS reactivations,
    CASE WHEN s3 AND NOT (s1 OR s2) THEN 'inserted' WHEN s3 AND NOT s2 THEN CASE WHEN t3 <> after2 THEN 'reactivated_updated' ELSE 'reactivated' END WHEN s3 AND t3 <> after2 THEN 'updated' WHEN s3 THEN 'unchanged' WHEN s2 THEN 'suspect_missing' ELSE 'tombstoned' END AS change,
    row_id FROM known)"""
SCD2 = f"{_RUNS} SELECT property_key, version, presence, misses, suspect_since, tombstoned_at, reactivations, change, count(*) AS n, CAST(sum(tenths) AS BIGINT) AS tenths FROM done GROUP BY ALL"
BROKEN_STATES = f"""{_RUNS} SELECT property_key, CAST(row_id AS VARCHAR) AS token, 'STATE_MISSES' AS violation FROM done WHERE row_id % 37 = 0 AND presence <> 'tombstoned'
    UNION ALL SELECT property_key, CAST(row_id AS VARCHAR), 'TWO_CURRENT' FROM done WHERE row_id % 41 = 0 AND row_id % 37 > 0"""
TOMBSTONES = f"""{_RUNS}, four AS (SELECT property_key, r.row_id % 11 <> 0 AS s4, CASE WHEN r.row_id % 11 <> 0 THEN 'present' ELSE 'tombstoned' END AS presence, x.tenths FROM done r JOIN rev x USING (property_key, row_id))
SELECT property_key, count(*) FILTER (WHERE presence = 'present') AS present, count(*) FILTER (WHERE presence = 'suspect_missing') AS suspect, count(*) FILTER (WHERE presence = 'tombstoned') AS tombstoned, avg(tenths) FILTER (WHERE presence = 'present') / 10 AS average FROM four GROUP BY 1"""

CATEGORIES = """(SELECT 'u' || user_id AS property_key, CASE event_type WHEN 'view' THEN 'staff' WHEN 'click' THEN 'comfort' WHEN 'purchase' THEN 'free_wifi' WHEN 'signup' THEN 'pool' ELSE 'bar' END AS category,
    CAST(event_id % 101 AS DOUBLE) / 10 AS score, event_id AS place FROM events)"""
CATEGORY_PIVOT = f"""WITH c AS (SELECT property_key, category, arg_max(score, place) AS score FROM {CATEGORIES} GROUP BY 1, 2)
SELECT property_key, max(score) FILTER (WHERE category = 'staff') AS staff, max(score) FILTER (WHERE category = 'comfort') AS comfort, max(score) FILTER (WHERE category = 'free_wifi') AS free_wifi,
    '{{' || coalesce(string_agg('"' || category || '":' || score, ',' ORDER BY category) FILTER (WHERE category NOT IN ('staff', 'comfort', 'free_wifi')), '') || '}}' AS other FROM c GROUP BY 1"""
LABELS = """(SELECT event_id AS k, event_type, user_id, CASE event_id % 4 WHEN 0 THEN '  Free   WiFi ' WHEN 1 THEN upper(event_type) || ' for money' WHEN 2 THEN event_type || ' & Drink-' || user_id ELSE 'Value for money!' END AS label FROM events)"""
CATEGORY_KEYS = f"SELECT k, label, CASE k % 4 WHEN 0 THEN 'free_wifi' WHEN 1 THEN 'source:' || event_type || ' for money' WHEN 2 THEN 'source:' || event_type || ' and drink ' || user_id ELSE 'value' END AS category FROM {LABELS}"
EXPORT_SAMPLE = f"{REVIEWS} SELECT property_key, public_id AS review_id, local_date, tenths / 10.0::DOUBLE AS score FROM rev QUALIFY row_number() OVER (PARTITION BY property_key ORDER BY epoch DESC, row_id) <= 5"
_CELL = lambda c: f"coalesce('\"' || replace(CAST({c} AS VARCHAR), '\"', '\"\"') || '\"', '')"
CSV_LINES = f"{REVIEWS} SELECT " + " || ',' || ".join(_CELL(c) for c in ("property_key", "property_name", "hotel_id", "public_id", "local_date", "positive_text", "negative_text", "partner_reply", "helpful", "room")) + " AS line FROM rev JOIN props USING (property_key)"
MANIFEST = f"{REVIEWS} SELECT property_key, property_name, hotel_id, count(*) AS records, min(local_date) AS earliest, max(local_date) AS latest FROM rev JOIN props USING (property_key) GROUP BY 1, 2, 3"
_AUDITED = f"""{REVIEWS}, a AS (SELECT property_key, row_id, row_id % 101 = 0 AS identity_, row_id % 103 = 0 AS id_, row_id % 109 = 0 AS score_, row_id % 113 = 0 AS date_, row_id % 127 = 0 AS votes_,
    CASE WHEN row_id % 103 = 0 THEN 'not-an-id' WHEN row_id % 107 = 0 THEN '000000000000000000000000' ELSE public_id END AS rid FROM rev),
d AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY row_id) > 1 AS twice_ FROM a)"""
AUDIT_ISSUES = _AUDITED + " SELECT code, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{code}' AS code FROM d WHERE {c}" for code, c in (("PROPERTY_IDENTITY_MISMATCH", "identity_"), ("REVIEW_ID_INVALID", "id_"), ("REVIEW_ID_DUPLICATE", "twice_"), ("SCORE_INVALID", "score_"), ("LOCAL_DATE_MISMATCH", "date_"), ("VOTES_INVALID", "votes_"))) + ") GROUP BY 1"
AUDIT_READINESS = f"""{_AUDITED} SELECT property_key, count(*) AS records, count(*) FILTER (WHERE NOT (identity_ OR id_ OR twice_ OR score_ OR date_)) AS weekly_ready, count(*) FILTER (WHERE NOT (identity_ OR score_)) AS property_ready,
    count(*) FILTER (WHERE NOT (identity_ OR id_ OR twice_ OR score_ OR date_ OR votes_)) AS feed_ready FROM d GROUP BY 1"""
URLS = """(SELECT event_id AS k, user_id, CASE event_id % 7 WHEN 0 THEN 'https://cf.photos.example.com/x/' || event_id || '.jpg?k=' || user_id WHEN 1 THEN 'https://PHOTOS.example.com:443/' || event_id WHEN 2 THEN 'http://cf.photos.example.com/' || event_id
    WHEN 3 THEN 'https://u:p@cf.photos.example.com/' || event_id WHEN 4 THEN 'https://photos.example.com.evil.net/' || event_id WHEN 5 THEN 'https://q.photos.example.com/a ' || event_id END AS url FROM events)"""
PHOTO_URLS = f"SELECT k, url, CASE k % 7 WHEN 0 THEN 'https://photo-cdn.invalid/x/' || k || '.jpg?k=' || user_id WHEN 1 THEN 'https://photo-cdn.invalid:443/' || k END AS canonical FROM {URLS}"
SECRET_TEXTS = """(SELECT event_id AS k, user_id, event_type, CASE event_id % 4 WHEN 0 THEN 'GET https://x.example/a?sid=' || event_id || '&page=' || user_id WHEN 1 THEN 'Authorization: Bearer ' || event_id WHEN 2 THEN event_type ELSE 'https://x.example/?q=' || event_id || '&TOKEN=' || user_id || '#f' END AS t FROM events)"""
REDACTED = f"SELECT k, CASE k % 4 WHEN 0 THEN 'GET https://x.example/a?sid=[REDACTED]&page=' || user_id WHEN 1 THEN 'Authorization: [REDACTED]' WHEN 2 THEN event_type ELSE 'https://x.example/?q=' || k || '&TOKEN=[REDACTED]#f' END AS shown FROM {SECRET_TEXTS}"
WEEK_COLUMNS = f"{REVIEWS} SELECT CAST(date_trunc('week', local_date) AS DATE) AS week, CASE WHEN tenths >= 80 THEN 'excellent' WHEN tenths >= 70 THEN 'good' WHEN tenths >= 50 THEN 'mixed' ELSE 'poor' END AS tone, count(*) AS n FROM rev GROUP BY 1, 2"
LEFT_JOINED = "SELECT source, count(*) AS documents, count(quality) AS labelled, count(*) FILTER (WHERE quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"

_LIVE = "property_key IN ('view', 'click', 'purchase') AND row_id % 10 <> 0 AND row_id % 11 <> 0"
ACCEPTED_REVIEWS = f"{REVIEWS} SELECT row_id, property_key, epoch, tenths FROM rev WHERE {_LIVE}"
CURRENT_REVIEWS = f"{REVIEWS} SELECT row_id, epoch, tenths FROM rev WHERE {_LIVE} AND property_key = 'view'"
PUBLICATION_SCAN = "SELECT * FROM (VALUES ('view', 101, 3, 8, 8, 8, 8, NULL), ('click', 102, 3, 9, 9, NULL, NULL, NULL), ('purchase', 103, 3, 12, 12, 12, NULL, NULL), ('signup', 104, NULL, NULL, NULL, NULL, NULL, NULL)) AS t(property_key, hotel_id, generation, parser, displayed, oldest, gap, visible)"
PAGE_VIOLATIONS = f"""{REVIEWS}, p AS (SELECT property_key, CAST(floor(row_id / 50) * 10 AS BIGINT) AS page_offset, count(*) AS n_cards FROM rev GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN page_offset % 1930 = 1920 THEN 101 ELSE 100 END AS reported FROM p WHERE page_offset % 170 <> 160),
w AS (SELECT *, coalesce(lag(page_offset + 10) OVER o, 0) AS expected, first_value(reported) OVER o AS first_reported, page_offset = max(page_offset) OVER (PARTITION BY property_key) AS is_last,
    min(page_offset) OVER (PARTITION BY property_key, page_offset % 1310) AS first_offset FROM q WINDOW o AS (PARTITION BY property_key ORDER BY page_offset))
SELECT property_key, code, count(*) AS n FROM (SELECT property_key, unnest(list_filter([CASE WHEN n_cards > 10 THEN 'TOO_MANY_CARDS' END, CASE WHEN page_offset <> expected THEN 'OFFSET_GAP' END, CASE WHEN n_cards < 10 AND NOT is_last THEN 'PREMATURE_SHORT_PAGE' END,
    CASE WHEN n_cards >= 10 AND is_last THEN 'TERMINAL_PAGE_MISSING' END, CASE WHEN reported <> first_reported THEN 'COUNT_MOVED' END, CASE WHEN page_offset > first_offset THEN 'REPEATED_PAGE' END], lambda x: x IS NOT NULL)) AS code FROM w) GROUP BY 1, 2"""
CARD_VIOLATIONS = f"""{REVIEWS}, c AS (SELECT property_key, row_id // 10 AS page_offset, row_id % 10 AS card_index, row_id, epoch, tenths, 0 AS copy FROM rev UNION ALL SELECT property_key, row_id // 10, row_id % 10 + 100, row_id, epoch, tenths, 1 FROM rev WHERE row_id % 89 = 0),
w AS (SELECT *, lag(epoch) OVER (PARTITION BY property_key ORDER BY page_offset, card_index) AS before FROM c)
SELECT property_key, code, count(*) AS n FROM (SELECT property_key, 'DATE_ORDER' AS code FROM w WHERE epoch < before UNION ALL SELECT property_key, 'DUPLICATE_IN_PAGE' FROM w WHERE copy = 1
    UNION ALL SELECT property_key, 'RECORD_CHANGED' FROM w WHERE copy = 1 AND row_id % 178 = 0 UNION ALL SELECT property_key, 'NO_SCORE_BUCKET' FROM w WHERE tenths NOT BETWEEN 10 AND 100) GROUP BY 1, 2"""
#: Two phases of each user's run, and what it staged: some lack a phase, have bad pages, another count, or staged too little.
PHASES = """(SELECT 'u' || user_id AS property_key, 'oldest' AS phase, count(*) AS reported, CASE WHEN user_id % 11 = 3 THEN 'PAGE_SHAPE' ELSE 'OK' END AS verdict FROM events GROUP BY user_id
    UNION ALL SELECT 'u' || user_id, 'newest', count(*) + CASE WHEN user_id % 7 = 2 THEN 1 ELSE 0 END, 'OK' FROM events WHERE user_id % 5 > 0 GROUP BY user_id)"""
STAGED = "(SELECT 'u' || user_id AS property_key, CAST(event_id AS STRING) AS token FROM events WHERE user_id % 13 <> 4 OR event_id % 2 = 0)"
FINALIZED = """WITH g AS (SELECT user_id AS u, count(*) AS n, user_id % 7 = 2 AND user_id % 5 > 0 AS moved, count(*) FILTER (WHERE user_id % 13 <> 4 OR event_id % 2 = 0) AS staged FROM events GROUP BY 1), f AS (SELECT *, n + CASE WHEN moved THEN 1 ELSE 0 END AS final_count FROM g)
SELECT 'u' || u AS property_key, final_count, staged, CASE WHEN u % 5 = 0 THEN 'PHASE_MISSING' WHEN u % 11 = 3 THEN 'PHASE_INVALID' WHEN moved THEN 'COUNTS_DIFFER' WHEN staged <> final_count THEN 'STAGED_COUNT_MISMATCH' ELSE 'OK' END AS verdict FROM f"""
EXISTING = "(SELECT 'p' || event_id AS property_key, event_id AS hotel_id, event_type AS property_name FROM events WHERE event_id % 3 > 0)"
INCOMING = "(SELECT 'p' || event_id AS property_key, event_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS hotel_id, CASE WHEN event_id % 5 = 0 THEN 'new ' || event_type ELSE event_type END AS property_name FROM events WHERE event_id % 4 > 0)"
REGISTERED = """WITH e AS (SELECT event_id AS k, event_type AS name, event_id % 3 > 0 AS held, event_id % 4 > 0 AS comes, event_id % 7 = 0 AS other, event_id % 5 = 0 AS renamed, (event_id + 1) % 3 > 0 AND event_id + 1 IN (SELECT event_id FROM events) AS taken FROM events)
SELECT 'p' || k AS property_key, CASE WHEN other AND NOT held THEN k + 1 ELSE k END AS hotel_id, CASE WHEN comes AND renamed THEN 'new ' || name ELSE name END AS property_name, CASE WHEN NOT comes THEN 'kept' WHEN NOT held THEN 'added' WHEN renamed THEN 'renamed' ELSE 'unchanged' END AS change,
    CASE WHEN comes AND other THEN CASE WHEN held THEN 'HOTEL_ID_CHANGED' WHEN taken THEN 'HOTEL_ID_TAKEN' END END AS conflict FROM e WHERE held OR comes"""
PHOTO_PAIRS = """(SELECT 'https://a.x/p?k=' || event_id || '&l=2#f' AS before, CASE WHEN event_id % 17 > 0 THEN CASE WHEN event_id % 19 = 0 THEN 'http' ELSE 'https' END || '://' || CASE WHEN event_id % 3 = 0 THEN 'b.x' ELSE 'a.x' END || CASE WHEN event_id % 5 = 0 THEN '/q' ELSE '/p' END
    || CASE WHEN event_id % 7 = 0 THEN '?k=x&l=2' WHEN event_id % 11 = 0 THEN '?l=2&k=' || event_id WHEN event_id % 23 = 0 THEN '?m=' || event_id ELSE '?k=' || event_id || '&l=2' END || CASE WHEN event_id % 13 = 0 THEN '#z' ELSE '#f' END END AS after FROM events)"""
PHOTO_CHANGES = "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in {
    "parseable": "true", "protocol": "k % 19 = 0", "host": "k % 3 = 0", "path": "k % 5 = 0", "query": "k % 7 = 0 OR k % 11 = 0 OR k % 23 = 0", "fragment": "k % 13 = 0", "query_keys": "k % 23 = 0 AND k % 7 > 0 AND k % 11 > 0", "query_values": "k % 7 = 0", "same_without_query": "k % 19 > 0 AND k % 3 > 0 AND k % 5 > 0",
}.items()) + ", (SELECT count(*) FROM events WHERE event_id % 17 = 0) AS unparsable FROM (SELECT event_id AS k FROM events WHERE event_id % 17 > 0)"
MANIFEST_PROBLEMS = f"{REVIEWS} SELECT property_key, CASE WHEN property_key = 'error' THEN NULL ELSE count(*) + CASE WHEN property_key = 'click' THEN 1 ELSE 0 END END AS records, count(*) AS found, CASE property_key WHEN 'error' THEN 'PROPERTY_NOT_DECLARED' WHEN 'click' THEN 'COUNT_MISMATCH' WHEN 'view' THEN 'DATE_BOUNDS' ELSE 'OK' END AS verdict FROM rev GROUP BY 1"
NOTABLE_WEEKS = f"{WEEKLY_TREND.replace('SELECT b.week_start', ', trend AS (SELECT b.week_start', 1)}) SELECT (SELECT week_start FROM trend WHERE average IS NOT NULL ORDER BY average DESC, week_start LIMIT 1) AS strongest, (SELECT week_start FROM trend WHERE average IS NOT NULL ORDER BY average, week_start LIMIT 1) AS weakest, (SELECT week_start FROM trend ORDER BY reviews DESC, week_start LIMIT 1) AS busiest"
RANKED_TOPICS = f"WITH ranked AS ({TOPIC_METRICS}) SELECT topic, CASE WHEN negative_share IS NULL THEN '—' ELSE printf('%.1f%%', negative_share) END AS share, trend FROM ranked"
INCREMENTAL_STOP = f"""{REVIEWS}, p AS (SELECT property_key, row_id // 50 AS page_offset, max(epoch) < 1705300000 AND min(row_id) % 3 > 0 AS calm FROM rev GROUP BY 1, 2),
w AS (SELECT *, calm AND coalesce(lag(calm) OVER (PARTITION BY property_key ORDER BY page_offset), false) AS stop FROM p) SELECT property_key, min(page_offset) AS stop_offset FROM w WHERE stop GROUP BY 1"""
