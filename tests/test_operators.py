import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import periods, scalars
from reviewlake.operators import export, feed, gaps, quality, snapshots
from reviewlake.sources import reviews as src


def test_periods():
    p = periods.default_period(date(2026, 7, 31))
    assert (p.current_start, p.current_end, p.previous_start, p.previous_end) == (date(2026, 7, 27), date(2026, 7, 31), date(2026, 7, 20), date(2026, 7, 24))
    assert periods.monday(date(2026, 8, 2)) == date(2026, 7, 27)
    p = periods.custom_period(None, date(2024, 1, 5), date(2024, 1, 1), date(2024, 1, 30), date(2024, 1, 26))
    assert (p.current_start, p.previous_start, p.previous_end) == (date(2024, 1, 1), date(2023, 12, 27), date(2023, 12, 31))
    p = periods.custom_period(date(2024, 2, 5), None, date(2024, 1, 1), date(2024, 1, 30), date(2024, 1, 26))
    assert p.current_start == p.current_end == date(2024, 2, 5)
    with pytest.raises(ValueError):
        periods.custom_period(date(2024, 2, 5), date(2024, 2, 1), None, None, date(2024, 2, 1))
    assert periods.trend_weeks(date(2024, 1, 26)) == (date(2023, 11, 6), date(2024, 1, 22))


def test_local_date_follows_daylight_saving(spark):
    rows = spark.createDataFrame([(1704027600,), (1720533600,)], "e long").select(periods.local_date(F.col("e"), "Australia/Sydney")).collect()
    assert [r[0] for r in rows] == [date(2024, 1, 1), date(2024, 7, 10)]


def test_feed_query_checks():
    for bad in ({"sort": "best"}, {"sentiments": ("glad",)}, {"start": date(2024, 2, 1), "end": date(2024, 1, 1)}, {"properties": ("x",), "known_properties": ("y",)}):
        with pytest.raises(feed.InvalidQuery):
            feed.FeedQuery(**bad)
    q = feed.FeedQuery(page=0, size=1000, search="  a  ", least_tenths=-5, most_tenths=400)
    assert (q.page, q.size, q.search, q.least_tenths, q.most_tenths) == (1, 100, "a", 0, 100)
    assert feed.FeedQuery(page="7").page == 1


def test_feed_page_is_clamped(spark):
    rows = spark.createDataFrame([(i, i, f"p{i:02}", 50) for i in range(12)], "row_id int, epoch long, public_id string, tenths int")
    shown, total, pages, page = feed.page(rows, feed.FeedQuery(page=9, size=5))
    assert (total, pages, page, [r.row_id for r in shown.collect()]) == (12, 3, 3, [1, 0])
    shown, total, pages, page = feed.page(rows.limit(0), feed.FeedQuery())
    assert (total, pages, page, shown.count()) == (0, 0, 1, 0)


def staged(spark, *rows):
    return spark.createDataFrame([("p", t, h, 80) for t, h in rows], "property_key string, token string, record_hash string, tenths int")


def state(df):
    return {r.token: (r.presence, r.version, r.misses, r.suspect_since, r.tombstoned_at, r.reactivations, r.change) for r in df.collect()}


def test_version_history(spark):
    g = snapshots.promote(None, staged(spark, ("a", "1"), ("b", "1")), 1)
    assert state(g)["a"] == ("present", 1, 0, None, None, 0, "inserted")
    g = snapshots.promote(g, staged(spark, ("a", "2")), 2)
    assert state(g) == {"a": ("present", 2, 0, None, None, 0, "updated"), "b": ("suspect_missing", 1, 1, 2, None, 0, "suspect_missing")}
    partial = snapshots.promote(g, staged(spark, ("c", "1")), 3, complete=False)
    assert state(partial)["b"][:3] == ("suspect_missing", 1, 1) and state(partial)["a"][0] == "present"
    g = snapshots.promote(g, staged(spark, ("a", "2")), 3)
    assert state(g)["b"] == ("tombstoned", 1, 2, 2, 3, 0, "tombstoned")
    again = snapshots.promote(g, staged(spark, ("a", "2")), 4)
    assert state(again)["b"] == ("tombstoned", 1, 3, 2, 3, 0, "kept")
    g = snapshots.promote(again, staged(spark, ("a", "2"), ("b", "9")), 5)
    assert state(g)["b"] == ("present", 2, 0, None, None, 1, "reactivated_updated")
    assert snapshots.invariants(g).count() == 0


def test_generations_are_published_whole(spark, tmp_path):
    root = str(tmp_path / "history")
    one = snapshots.promote(None, staged(spark, ("a", "1")), 1)
    snapshots.publish(one, root, 1)
    snapshots.publish(snapshots.promote(snapshots.published(spark, root), staged(spark, ("a", "2"), ("b", "1")), 2), root, 2)
    assert {r.token: r.version for r in snapshots.published(spark, root).collect()} == {"a": 2, "b": 1}


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 20, 21])
def test_reconcile_sizes(spark, n):
    pages = spark.createDataFrame([("p", i // 10, str(i), "h") for i in range(n)], "property_key string, page int, token string, record_hash string")
    reported = spark.createDataFrame([("p", n)], "property_key string, reported long")
    assert snapshots.reconcile(pages, reported).first().verdict == "OK"


def test_reconcile_faults(spark):
    schema = "property_key string, page int, token string, record_hash string"
    pages = spark.createDataFrame([("twice", 0, "a", "h"), ("twice", 0, "a", "h"), ("moved", 0, "a", "h"), ("moved", 1, "a", "i"), ("again", 0, "a", "h"), ("again", 1, "a", "h")], schema)
    reported = spark.createDataFrame([("twice", 1), ("moved", 1), ("again", 1), ("none", 1)], "property_key string, reported long")
    got = {r.property_key: (r.verdict, r.repeats) for r in snapshots.reconcile(pages, reported).collect()}
    assert got == {"twice": ("DUPLICATE_IN_PAGE", 1), "moved": ("RECORD_CHANGED", 1), "again": ("OK", 1), "none": ("COUNT_MISMATCH", 0)}


def test_digests_ignore_order_and_see_changes(spark):
    rows = spark.range(1000).select(F.lit("p").alias("property_key"), F.col("id").cast("string").alias("token"), F.md5(F.col("id").cast("string")).alias("record_hash"))
    same, other = rows.orderBy(F.desc("record_hash")).repartition(7), rows.withColumn("record_hash", F.when(F.col("token") == "5", "x").otherwise(F.col("record_hash")))
    a, b, c = (snapshots.inventory_digest(x).first() for x in (rows, same, other))
    assert a == b and a.ids_digest == c.ids_digest and a.records_digest != c.records_digest


def test_export_gate(spark):
    ok = "('p', 'r', 'r', 'succeeded', 'v', 'v', true, 'p', 1, 1, 1, 1, 'a', 'a', 'x', 'x', 1, 1, false, false, false, false, 1, 1)"
    names = "t(property_key, published_run, last_full_run, run_status, run_parser, expected_parser, complete_inventory, run_property, present, final_count, oldest_count, newest_count, oldest_ids, newest_ids, oldest_records, newest_records, structured, displayed, gap_attested, gap_valid, visible_attested, visible_valid, gap_advertised, gap_retrievable)"
    quality.require_authoritative(spark.sql(f"SELECT * FROM (VALUES {ok}) AS {names}"))
    with pytest.raises(quality.NotAuthoritative, match="published_count_mismatch"):
        quality.require_authoritative(spark.sql(f"SELECT * FROM (VALUES {ok.replace('1, 1, 1, 1', '2, 1, 1, 1', 1)}) AS {names}"))


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([('say "hi"', None, 3, "")], "a string, b string, c int, d string")
    assert export.csv_lines(rows, ("a", "b", "c", "d")).first()[0] == '"say ""hi""",,"3",""'
    export.write_csv(rows, str(tmp_path / "x"), ("a", "b"))
    assert spark.read.text(str(tmp_path / "x" / "header")).first()[0] == "a,b"


def test_json_walks(spark):
    pairs = spark.createDataFrame([('{"a": 1, "b": [1, 2], "c": {"d": null}}', '{"a": 2, "b": [1], "c": {"d": "x"}, "e": 1}'), ("{", "{}")], "x string, y string")
    got = [r[0] for r in pairs.select(export.changed_paths("x", "y")).collect()]
    assert got == [["a:value", "b:length", "c.d:kind", "e:added"], None]
    rows = spark.createDataFrame([('{"a": {"User-Name": 1}, "u": "https://x.example/?sid=1&session=2"}',), ('{"ok": [1]}',)], "t string")
    assert [r[0] for r in rows.select(export.sensitive_paths("t")).collect()] == [["a.User-Name", "u:url"], []]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(scalars.humanized(F.lit("  solo_traveller's trip-plan "))) == "Solo Traveller'S Trip-Plan"
    assert get(scalars.humanized(F.lit("  "))) is None
    assert [get(scalars.tenths(F.lit(x))) for x in (8.5, 10.0, 8.55, 11.0)] == [85, 100, None, None]
    assert get(scalars.visible_count(F.lit("Based on 1,234 reviews and 12 reviews"))) == 1234
    assert get(scalars.shows_score(F.lit("Scored 8.7 by guests"), F.lit(87))) and not get(scalars.shows_score(F.lit("Scored 18.75"), F.lit(87)))
    assert get(scalars.canonical_json(F.lit('{"b": 1.0, "a": [2, {"d": 1, "c": 2}]}'))) == '{"a":[2,{"c":2,"d":1}],"b":1}'
    assert get(scalars.canonical_page(F.lit("https://x.example/a/b.html?q=1#f"))) == "https://x.example/a/b.html"
    assert get(scalars.canonical_page(F.lit("https://u:p@x.example/a"))) is None
    assert get(scalars.direction(F.lit(None).cast("double"))) == "unavailable" and get(scalars.direction(F.lit(0.00001))) == "flat"
    assert [get(scalars.response_kind(F.lit(s), F.lit(b))) for s, b in ((200, "{}"), (200, "<html>"), (429, ""), (403, ""), (503, ""), (200, "captcha"))] == ["json", "not_json", "rate_limited", "challenge", "server_error", "challenge"]
    assert export.backoff_ms(0) == 500 and export.backoff_ms(10) == 30_000


CARD = '{"reviewUrl": "u%d", "reviewedDate": 1700000000, "reviewScore": %s, "textDetails": null, "bookingDetails": null, "guestDetails": null, "partnerReply": null, "photos": null, "positiveHighlights": null, "negativeHighlights": null, "helpfulVotesCount": 0, "isApproved": true, "isTranslatable": false, "editUrl": null}'


def test_page_contract(spark):
    body = '{"data": {"reviewListFrontend": {"reviewsCount": 3, "reviewCard": [%s, %s, {"reviewUrl": "", "reviewScore": 8}]}}}' % (CARD % (1, "8.5"), CARD % (2, "8.55"))
    rows = src.review_pages(spark.createDataFrame([(body,), ("no json",)], "body string")).orderBy(F.asc_nulls_last("card_index")).collect()
    assert rows.pop().violations == ["no_cards"]
    assert [r.violations for r in rows[:2]] == [[], ["score_precision"]]
    assert {"missing:reviewedDate", "identity", "epoch"} <= set(rows[2].violations) and rows[0].card.bookingDetails is None


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    rows = src.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    assert sorted(str(r.flag) for r in rows) == ["None", "None", "bad_json", "blank"]


def test_config_problems(spark):
    rows = spark.createDataFrame([("a", 1, "/x"), ("b", 1, "/y")], "property_key string, hotel_id int, path string")
    assert [tuple(r) for r in src.config_problems(rows).collect()] == [("hotel_id", "1", 2)]


def test_incremental_stop_and_attestation(spark):
    pages = spark.createDataFrame([("p", 0, True, 50), ("p", 10, False, 5), ("p", 20, True, 5), ("p", 30, True, 4), ("p", 40, True, 3)], "property_key string, page_offset int, all_known boolean, newest_epoch long")
    assert snapshots.stop_incremental(pages, 10).first().stop_offset == 30
    runs = spark.createDataFrame([("r", 12, "h")] * 7 + [("s", 12, "h"), ("s", 12, "i")], "run_id string, total int, evidence_hash string")
    got = {r.run_id: (r.one_hash, r.complete) for r in quality.count_attestation(runs).collect()}
    assert got == {"r": (True, True), "s": (False, False)}


def test_trusted_totals(spark):
    rows = spark.createDataFrame([("p", s, 5) for s in gaps.TOTALS] + [("q", s, 5) for s in gaps.TOTALS[:3]], "property_key string, source string, n int")
    got = {r.property_key: (r.complete, r.named, r.equal) for r in gaps.trusted_totals(rows).collect()}
    assert got == {"p": (True, True, True), "q": (False, False, True)}


def test_progress_log(spark):
    rows = spark.createDataFrame([("j", 1, "[t] full: a"), ("j", 2, "[t] progress: a oldest-first 3/30"), ("j", 3, "[t] passed: a (30 reviews)")], "job string, line_no int, line string")
    assert tuple(export.progress(rows).first()) == ("j", "a", "published", None, 30, 30, 30, None, None)


def test_page_stream(spark, tmp_path):
    from reviewlake.streaming import pages

    folder = tmp_path / "in"
    folder.mkdir()
    line = '{"run_id": "r", "phase": "oldest", "page_offset": %d, "property_key": "p", "n_reviews": 10, "observed_at": "2024-01-01T00:0%d:00Z"}'
    (folder / "a.json").write_text("\n".join(line % x for x in ((0, 1), (10, 2), (0, 3))))
    stream = pages.page_stream(spark, str(folder), "run_id string, phase string, page_offset int, property_key string, n_reviews int, observed_at timestamp")
    q = pages.hourly_counts(stream).writeStream.outputMode("append").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    (folder / "b.json").write_text(line.replace("2024-01-01", "2024-01-05") % (20, 1))
    q.processAllAvailable()
    q.stop()
    assert [(r.pages, r.reviews) for r in spark.table("hourly").collect()] == [(2, 20)]


def test_display(spark):
    from reviewlake.functions import display

    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    null = F.lit(None).cast("double")
    assert [get(display.delta_text(F.lit(x))) for x in (0.26, -1.0, 0.001)] == ["+0.3", "-1.0", "No change"] and get(display.delta_text(null)) == "—"
    assert get(display.score_text(F.lit(8.456))) == "8.5" and get(display.percent_text(F.lit(12.6))) == "13%" and get(display.percent_text(null)) == "—"
    assert [get(display.is_neutral(F.lit(x))) for x in ("ALL", " ", "en")] == [True, True, False]
    assert get(display.publication_label(F.lit("collecting"))) == "Collecting" and get(display.accepted(F.lit("source-gap")))


def test_inventory_checks(spark):
    from reviewlake.operators import inventory

    pages = spark.createDataFrame([("p", "oldest", 0, 10, 10, 15, "a"), ("p", "oldest", 10, 10, 5, 15, "b"), ("q", "oldest", 0, 10, 0, 4, "a"), ("r", "newest", 0, 11, 3, 3, "a")], "property_key string, phase string, page_offset int, page_limit int, n_cards int, reported int, page_hash string")
    assert sorted((r.property_key, r.code) for r in inventory.page_violations(pages).collect()) == [("q", "EMPTY_FIRST_PAGE"), ("r", "LIMIT_RANGE")]
    cards = spark.createDataFrame([("p", "oldest", i // 10 * 10, i % 10, str(i), i, 50, "h") for i in range(15)], "property_key string, phase string, page_offset int, card_index int, token string, epoch long, tenths int, record_hash string")
    got = {r.property_key: (r.verdict, r.unique_reviews) for r in inventory.phase_verdicts(pages, cards).collect()}
    assert got == {"p": ("OK", 15), "q": ("PAGE_SHAPE", 0), "r": ("PAGE_SHAPE", 0)}
    assert inventory.card_violations(cards, newest_first=False).count() == 0 and inventory.card_violations(cards, newest_first=True).count() == 14
    kinds = "property_key string, card_index int, token string, epoch long, reported int, sorters array<string>, evidence string"
    both = ["NEWEST_FIRST", "OLDEST_FIRST"]
    first = lambda *rows: spark.createDataFrame([(p, i, t, e, n, s, d) for p, ids, es, n, s, d in rows for i, (t, e) in enumerate(zip(ids, es))], kinds)
    oldest = first(("ok", "ab", (1, 2), 9, both, "x"), ("same", "ab", (5, 5), 2, None, None), ("one", "a", (5,), 1, None, None), ("count", "ab", (1, 2), 9, None, None), ("sort", "ab", (1, 2), 9, both[:1], None), ("move", "ab", (2, 1), 9, None, None), ("sums", "ab", (1, 2), 9, None, "x"), ("lost", "ab", (1, 2), 9, None, None))
    newest = first(("ok", "cb", (3, 2), 9, both, "x"), ("same", "ab", (5, 5), 2, None, None), ("one", "a", (5,), 1, None, None), ("count", "cb", (3, 2), 8, None, None), ("sort", "cb", (3, 2), 9, both, None), ("move", "cb", (3, 2), 9, None, None), ("sums", "cb", (3, 2), 9, None, "y"))
    verdicts = {r.property_key: r.verdict for r in inventory.canary(oldest, newest).collect()}
    assert verdicts == {"ok": "OK", "same": "SORTER_NOT_APPLIED", "one": "OK", "count": "MOVING_REVIEW_COUNT", "sort": "UNSUPPORTED_SORTER", "move": "NON_MONOTONIC_PAGINATION", "sums": "MOVING_AGGREGATE_COUNTS", "lost": "MISSING_PAGE"}
    head = inventory.head_unchanged(pages.filter("page_offset = 0 AND property_key <> 'q'"), pages.withColumn("page_hash", F.lit("a")))
    assert all(r.unchanged for r in head.collect())


def test_attribution(spark):
    from reviewlake.operators import inventory

    rows = spark.createDataFrame([(85, None, '{"score": 85, "votes": null}'), (85, 2, '{"score": 80, "votes": 2}'), (85, None, '{"score": 85}')], "score int, votes int, card_json string")
    got = [r.mismatched for r in inventory.attribution(rows, {"score": "$.score", "votes": "$.votes"}, ("votes",)).collect()]
    assert got == [[], ["score"], []]
    filters = spark.createDataFrame([("p", "language", "en", 3), ("p", "language", "en", 4), ("p", "score", "ALL", -1)], "property_key string, kind string, value string, count int")
    assert sorted((r.kind, r.code) for r in inventory.metadata_problems(filters).collect()) == [("language", "DUPLICATE_VALUE"), ("score", "NEGATIVE_COUNT")]


@pytest.mark.parametrize("sort", feed.ORDERS)
def test_deep_pages_and_seeks(spark, monkeypatch, sort):
    """Pages out of ranges, and pages after the last row shown, are those of the whole order."""
    r = random.Random(2)
    rows = spark.createDataFrame([(i, f"{r.randrange(40):03d}-{i}", "p", r.randrange(30), r.randrange(101), r.choice([None, 1, 2]), None) for i in range(200)], "row_id long, public_id string, property_key string, epoch long, tenths int, helpful long, local_date date")
    whole = [x.row_id for x in rows.orderBy(*feed.order(sort)).collect()]
    monkeypatch.setattr(feed, "SHALLOW", -1)
    last = None
    for page in (1, 2, 4, 9):
        shown, total, pages, at = feed.page(rows, feed.FeedQuery(sort=sort, page=page, size=30))
        assert [x.row_id for x in shown.collect()] == whole[(at - 1) * 30 : at * 30] and (total, pages, at) == (200, 7, min(page, 7))
    for k in range(3):
        got = feed.after(rows, feed.FeedQuery(sort=sort, size=30), last).collect()
        assert [x.row_id for x in got] == whole[k * 30 : k * 30 + 30]
        last = got[-1].asDict()


def test_keys_held_twice_are_told(spark):
    rows = lambda *x: spark.createDataFrame(x, "property_key string, token string, record_hash string")
    got = snapshots.compare(rows(("p", "a", "1"), ("p", "a", "2"), ("p", "b", None), ("p", "c", "1")), rows(("p", "a", "1"), ("p", "b", None), ("p", "d", "1")))
    assert sorted((r.token, r.change) for r in got.collect()) == [("a", "duplicate"), ("b", "unchanged"), ("c", "missing"), ("d", "inserted")]
