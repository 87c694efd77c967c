"""The rollup after each generation is the one that counting everything anew would give."""

from datetime import date

import pytest

from reviewlake.functions import periods
from reviewlake.operators import metrics, rollup
from reviewlake.operators.history import History

SCHEMA = "property_key string, token string, record_hash string, row_id long, epoch long, local_date date, tenths int, positive_text string, negative_text string, partner_reply string"
TEXTS = (None, "The room was spotless and the staff were friendly", "dirty bathroom, loud street noise", "nothing", "Not clean at all but easy check-in")


def review(i, score, text, day=1, reply=None):
    return ("pq"[i % 2], f"t{i}", f"{score}|{text}|{day}|{reply}", i, 1_700_000_000 + 86_400 * day + i % 3, date(2023, 11, 14 + day), score, TEXTS[text % 5], TEXTS[(text + 2) % 5], reply)


RUNS = [
    [review(i, 10 * (i % 11), i, i % 5, "Thanks" if i % 3 else "") for i in range(40)],
    [review(i, 10 * (i % 11) + (i % 7 == 0), i + (i % 4 == 0), i % 5, "Thanks") for i in range(3, 40)],  # three vanish, the newest of some cells among them
    [review(i, 50, 2, 2) for i in range(20)],  # many move into a few cells, others vanish
    [],
    [review(i, 10 * (i % 11), i, i % 5) for i in range(45)],  # all come back
]


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    h, base = History(spark, str(tmp_path_factory.mktemp("history")), rollup.CONTENT), None
    for k, rows in enumerate(RUNS, 1):
        h.publish(spark.createDataFrame(rows, SCHEMA), k, base, len(rows))
        base = k
    return h


def rows(df, columns=None):
    return sorted((str(tuple(r[c] for c in columns or df.columns)) for r in df.collect()))


def test_each_generation_equals_a_recount(spark, published):
    kept, period = rollup.Rollup(published), periods.custom_period(date(2023, 11, 15), date(2023, 11, 17), None, None, date(2023, 11, 20))
    dims = spark.createDataFrame([(0, "p", "P", 1), (1, "q", "Q", 2), (2, "r", "R", 3)], "ordinal int, property_key string, property_name string, hotel_id int")
    for c in published.commits():
        kept.advance(c.generation)
        facts = rollup.classified(spark.read.parquet(c.state).filter("presence = 'present'"))
        assert kept.generation == c.generation and rows(kept.cells) == rows(rollup.rollup(facts), kept.cells.columns)
        f = kept.figures()
        assert rows(f.overview(period)) == rows(metrics.compared(facts, period))
        assert rows(f.histogram()) == rows(metrics.score_histogram(facts))
        assert rows(f.trend(date(2023, 11, 20))) == rows(metrics.weekly_trend(facts, date(2023, 11, 20)))
        assert rows(f.topics(period, dims)) == rows(metrics.topic_metrics(facts, period, dims))
        assert rows(f.properties(period, dims)) == rows(metrics.property_metrics(facts, period, dims))
    assert kept.advance().generation == 5


def test_only_changed_reviews_are_classified(spark, published):
    seen = []

    def watched(df):
        seen.append(df.count())
        return rollup.classified(df)

    small = History(spark, published.root, rollup.CONTENT)
    kept = rollup.Rollup(small, watched).advance(1)
    kept.advance(2)
    added, removed, near = seen[1:]
    assert seen[0] == 40 and removed <= 40 and added < 40 and near <= 37
    updated = small.commits()[1]
    assert added == updated.updated + updated.inserted and removed == updated.updated + updated.suspect_missing
