"""Queries on published generations: five runs cut from the events, their versions, states and commits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import periods
from reviewlake.operators import merkle, rollup
from reviewlake.operators.history import History
from reviewlake.operators.ranges import scratch
from reviewlake.plans import oracles as sql
from reviewlake.plans.base import query
from reviewlake.plans.registry import COMPARED, inventory
from reviewlake.sources import reviews as src

#: The runs: each ``drop``-th review is not seen (0: all are); of each ``shift``-th the score is ``by`` higher; whether the run is complete.
RUNS = ((10, 0, 0, True), (13, 17, 1, True), (11, 19, 2, True), (4, 23, 3, False), (11, 17, 1, True))

_kept: dict[tuple, History] = {}
_rolled: dict[tuple, rollup.Rollup] = {}


def staged(spark: SparkSession, sf_dir: str, k: int, more: tuple[str, ...] = ()) -> DataFrame:
    """What run k (from 1) collected; an incremental one has only a fourth of the reviews, those that a complete one may leave out."""
    drop, shift, by, complete = RUNS[k - 1]
    rows = inventory(spark, sf_dir, drop if complete else 0, shift, by, more).withColumn("tenths", F.least("tenths", F.lit(100)))
    # As bytes: half of what its hex digits take in every state, segment and shuffle.
    rows = rows.withColumn("record_hash", F.unhex(F.md5(F.concat_ws("|", "token", "tenths"))))
    return rows if complete else rows.filter(F.col("row_id") % drop == 0)


def history(spark: SparkSession, sf_dir: str, content: tuple[str, ...] = ("tenths",)) -> History:
    """The five runs published one after the other, once for an application and its tables."""
    key = (spark.sparkContext.applicationId, sf_dir, content)
    if key not in _kept:
        made, base, present = History(spark, scratch(spark), content), None, None
        more = tuple(c for c in content if c not in ("tenths", "row_id", "epoch"))
        for k, (*_, complete) in enumerate(RUNS, 1):
            rows = staged(spark, sf_dir, k, more)
            # The source's final count: what a complete run saw; an incremental one adds what was not present.
            if complete:
                final = rows.count()
            else:
                final = present + rows.join(made.current().filter("presence = 'present'"), ["property_key", "token"], "left_anti").count()
            made.publish(rows, k, base, final, complete)
            base, present = k, final
        _kept[key] = made
    return _kept[key]


#: Per review and run: whether it was seen, and its score then.
_SEEN = f"""{sql.REVIEWS}, runs(k, complete) AS (VALUES {', '.join(f"({k}, {str(c).lower()})" for k, (*_, c) in enumerate(RUNS, 1))}),
seen AS (SELECT r.property_key, r.token, r.row_id, k, complete, CASE k {' '.join(f"WHEN {k} THEN {f'row_id % {drop} <> 0' if complete else f'row_id % {drop} = 0'}" for k, (drop, _, _, complete) in enumerate(RUNS, 1))} END AS seen,
    least(100, tenths + CASE k {' '.join(f"WHEN {k} THEN {f'CASE WHEN row_id % {shift} = 0 THEN {by} ELSE 0 END' if shift else '0'}" for k, (_, shift, by, _) in enumerate(RUNS, 1))} END) AS tenths FROM rev r, runs),
observed AS (SELECT *, lag(tenths) OVER w AS before FROM seen WHERE seen WINDOW w AS (PARTITION BY property_key, token ORDER BY k)),
opened AS (SELECT *, row_number() OVER w AS version, lead(k) OVER w AS closed FROM observed WHERE before IS NULL OR before <> tenths WINDOW w AS (PARTITION BY property_key, token ORDER BY k)),
missed AS (SELECT *, max(CASE WHEN seen THEN k END) OVER (PARTITION BY property_key, token ORDER BY k) AS last_seen, count(*) FILTER (WHERE complete) OVER (PARTITION BY property_key, token ORDER BY k) AS full_runs FROM seen),
counted AS (SELECT *, full_runs - max(CASE WHEN seen THEN full_runs END) OVER (PARTITION BY property_key, token ORDER BY k) AS misses FROM missed),
states AS (SELECT *, CASE WHEN misses = 0 THEN 'present' WHEN misses = 1 THEN 'suspect_missing' ELSE 'tombstoned' END AS presence FROM counted WHERE last_seen IS NOT NULL),
moves AS (SELECT s.*, lag(presence) OVER (PARTITION BY property_key, token ORDER BY k) AS was, o.version FROM states s LEFT JOIN opened o USING (property_key, token, k))"""
_AS_OF = "SELECT s.property_key, s.token, s.presence, o.tenths, CAST(o.version AS INTEGER) AS version FROM states s JOIN opened o ON s.property_key = o.property_key AND s.token = o.token AND o.k <= {k} AND coalesce(o.closed > {k}, true) WHERE s.k = {k}"


@query(f"{_SEEN} SELECT property_key, token, CAST(version AS INTEGER) AS version, tenths, k AS valid_from, closed AS valid_to, closed IS NULL AS is_current FROM opened")
def version_history(spark, sf_dir):
    return history(spark, sf_dir).versions().drop("record_hash")


@query(f"{_SEEN} {_AS_OF.format(k=3)}")
def history_as_of(spark, sf_dir):
    return history(spark, sf_dir).as_of(3).drop("record_hash")


@query(f"{_SEEN} {_AS_OF.format(k=5)}")
def history_current(spark, sf_dir):
    return history(spark, sf_dir).current().select("property_key", "token", "presence", "tenths", "version")


@query(f"""{_SEEN} SELECT k AS generation, k AS run_id, CASE WHEN k > 1 THEN k - 1 END AS base_run, complete, count(*) FILTER (WHERE was IS NULL) AS inserted, count(*) FILTER (WHERE version > 1) AS updated,
    count(*) FILTER (WHERE seen AND was IS NOT NULL AND version IS NULL) AS unchanged, count(*) FILTER (WHERE seen AND was <> 'present') AS reactivated,
    count(*) FILTER (WHERE presence = 'suspect_missing' AND was = 'present') AS suspect_missing, count(*) FILTER (WHERE presence = 'tombstoned' AND was <> 'tombstoned') AS tombstoned,
    count(*) FILTER (WHERE presence = 'present') AS present FROM moves GROUP BY k, complete""")
def history_commits(spark, sf_dir):
    return history(spark, sf_dir).table()


def cells(spark: SparkSession, sf_dir: str) -> rollup.Rollup:
    """The rollup of the five runs, counted at the first and maintained through the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _rolled:
        _rolled[key] = rollup.Rollup(history(spark, sf_dir, rollup.CONTENT)).advance()
    return _rolled[key]


WEEK = periods.default_period(date.fromisoformat(src.AS_OF))


def _after(text: str) -> str:
    """SQL over the reviews as the fifth run leaves them: those that it saw, with its scores."""
    score, known = "CAST(CAST(floor(e.value * 100) AS BIGINT) % 101 AS INTEGER)", "FROM labelled)"
    assert text.count(score) == 1 == text.count(known)
    drop, shift, by, _ = RUNS[-1]
    return text.replace(score, f"least(100, {score} + CASE WHEN e.event_id % {shift} = 0 THEN {by} ELSE 0 END)").replace(known, f"FROM labelled WHERE row_id % {drop} <> 0)")


_CELLS = """SELECT property_key, local_date, tenths, sentiment, has_negative_feedback, coalesce(partner_reply <> '', false) AS responded, CAST(NULL AS VARCHAR) AS topic, CAST(NULL AS VARCHAR) AS polarity, count(*) AS n, CAST(NULL AS BIGINT) AS newest_epoch, CAST(NULL AS BIGINT) AS newest_row FROM rev GROUP BY ALL
UNION ALL SELECT property_key, local_date, NULL, NULL, has_negative_feedback, NULL, topic, polarity, count(*), max(epoch), first(row_id ORDER BY epoch DESC, row_id) FROM rev JOIN top USING (row_id) GROUP BY property_key, local_date, has_negative_feedback, topic, polarity"""


@query(_after(f"{sql.TOPICAL} {_CELLS}"))
def rollup_cells(spark, sf_dir):
    """Every cell after five generations, from the first one's and four differences."""
    found = cells(spark, sf_dir).cells
    return found.select(*rollup.CELL, "n", (-F.col("first.e")).alias("newest_epoch"), F.col("first.row_id").alias("newest_row"))


@query(_after(sql.compared("2024-01-22", "2024-01-26", "2024-01-15", "2024-01-19", False)))
def rollup_overview(spark, sf_dir):
    return cells(spark, sf_dir).figures().overview(WEEK).select(*COMPARED)


@query(_after(sql.WEEKLY_TREND))
def rollup_trend(spark, sf_dir):
    return cells(spark, sf_dir).figures().trend(date.fromisoformat(src.AS_OF))


@query(_after(sql.HISTOGRAM))
def rollup_histogram(spark, sf_dir):
    return cells(spark, sf_dir).figures().histogram()


@query(_after(sql.TOPIC_METRICS))
def rollup_topics(spark, sf_dir):
    return cells(spark, sf_dir).figures().topics(WEEK, src.properties(spark))


@query(_after(sql.PROPERTY_METRICS))
def rollup_properties(spark, sf_dir):
    return cells(spark, sf_dir).figures().properties(WEEK, src.properties(spark))


@query(f"""{sql.REVIEWS}, x AS (SELECT property_key, token, row_id % 499 <> 0 AS a, row_id % 501 <> 0 AS b, row_id % 503 = 0 AS changed FROM rev)
SELECT property_key, token, CASE WHEN NOT a THEN 'inserted' WHEN NOT b THEN 'missing' ELSE 'updated' END AS change FROM x WHERE (a OR b) AND NOT (a AND b AND NOT changed)""")
def merkle_differences(spark, sf_dir):
    """Where two inventories part, from their trees of hashes."""
    left, right = (merkle.written(rows, scratch(spark), bits=8, page_rows=50) for rows in (inventory(spark, sf_dir, 499), inventory(spark, sf_dir, 501, 503, 1)))
    return merkle.differences(left, right).select("property_key", "token", "change")
