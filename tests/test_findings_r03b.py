"""What the third review projected for larger tables: work for each row that belongs to each text, sorts of all rows, tasks that grow."""

import datetime

from pyspark.sql import functions as F

from reviewlake.operators import ranges, rollup, sentiment, snapshots, topics
from reviewlake.sources import reviews as src

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Optimized Logical Plan ==")[1]


def test_text_states_are_worked_out_for_texts(spark):
    rows = src.canonical(spark, SF)
    once = rollup.classified(rows)
    assert "lower(" not in plan(once) and "lower(" in plan(sentiment.with_sentiment(rows))
    texts = [("The room was spotless", None), (None, None), ("", "nothing"), ("  ", "Slow wifi"), ("N/A!", "No lift. Staff were not friendly")]
    said = spark.createDataFrame([(i, i % 3, *texts[i % 5], 10 * (i % 11)) for i in range(110)] * 2, "token int, property_key int, positive_text string, negative_text string, tenths int")
    whole = topics.with_topics(sentiment.with_sentiment(said))
    for few in (topics.FEW, 0):
        topics.FEW, before = few, topics.FEW
        try:
            found = topics.classified_once(said, ("property_key", "token"))
        finally:
            topics.FEW = before
        assert found.columns == whole.columns and sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))


def test_cells_are_counted_without_sorting_the_reviews(spark):
    most = 2**63
    places = [(253402300799, 5), (253402300799, -3), (0, most - 1), (-5, 1 - most), (1_700_000_000, 0), (1_700_000_000, -1), (None, 7), (10**12, None), (None, None)]
    row = lambda key, e, r: (key, datetime.date(2024, 1, 1), 50, "negative", True, "", e, r, [("noise", "negative")])
    schema = "property_key string, local_date date, tenths int, sentiment string, has_negative_feedback boolean, partner_reply string, epoch long, row_id long, topics array<struct<topic: string, polarity: string>>"
    cells = rollup.rollup(spark.createDataFrame([row(str(i), *p) for i, p in enumerate(places)] + [row("all", *p) for p in places[:6]], schema))
    assert "SortAggregate" not in plan(cells)
    expected = {str(i): (None if e is None else -e, r) for i, (e, r) in enumerate(places)} | {"all": (-253402300799, -3)}
    assert {r.property_key: tuple(r.first) for r in cells.filter("topic IS NOT NULL").collect()} == expected
    assert cells.filter(F.col("topic").isNull() & F.col("first").isNotNull()).count() == 0


def test_generations_meet_once_in_parts_that_grow_with_the_table(spark):
    assert ranges.parts(spark, 10) == 4 and ranges.parts(spark, 50 * ranges.TASK_ROWS + 1) == 51
    rows = lambda *names: spark.createDataFrame([("p", t, b"h", 1) for t in names], "property_key string, token string, record_hash binary, tenths int")
    one = ranges.settled(snapshots.promote(None, rows("a", "b"), 1, tasks=7))
    two = snapshots.promote(one, rows("b", "b", "c"), 2, tasks=7)
    physical = plan(two).split("== Physical Plan ==")[1]
    assert physical.count("Exchange ") == 2 == physical.count("hashpartitioning(property_key") and physical.count(", 7)") == 2
    assert sorted((r.token, r.staged, r.change) for r in two.select("token", F.coalesce("staged", F.lit(0)).alias("staged"), "change").collect()) == [("a", 0, "suspect_missing"), ("b", 1, "unchanged"), ("b", 2, "unchanged"), ("c", 1, "inserted")]
    bad = snapshots.invariants(two, 7)
    assert [tuple(r) for r in bad.collect()] == [("p", "b", "TWO_CURRENT")] and ", 7)" in plan(bad)


def test_texts_are_shuffled_once_for_both_joins(spark):
    from reviewlake.llm import repeats

    text = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = [(1, text), (2, "x" + text), (2, text + "y"), (None, text), (None, "z" * 300), (-(2**63), text)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
        removed = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_removed) for r in found.collect() if r.doc_id is not None)
        executed = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Texts without a doc_id come before all others, so those of 1 and 2 are copies of theirs.
    assert removed == [(False, 1, 300, 300), (False, 2, 301, 300), (False, 2, 301, 300)]
    assert any("ReusedExchange" in x and "text#" in x and "hashpartitioning(g#" in x for x in executed.splitlines())


def test_words_met_before_are_not_encoded_again():
    from reviewlake.llm import pieces

    encoder = pieces.Pieces(pieces.read_model(pieces.default_path()))
    encoder.encode(["seldom " + " ".join(f"{a}{b}{c}{d}" for a in "bdfgklmnpr" for b in "aeiou" for c in "bcdfghjklmnpqrstvwxz" for d in map(str, range(20))) for _ in range(1)])
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(160_000)]
    encoder.encode([" ".join(words)])
    learnt = []
    learn = encoder.learn
    encoder.learn = lambda new: learn(learnt.extend(new := list(new)) or new)
    assert len(encoder.cache) > 150_000 and len(encoder.encode(["so seldom"])[1]) and pieces.SPACE + "seldom" not in learnt
