"""Golden cases of the classifier: wording of our own, outcomes by the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import sentiment, topics
from tests import plain_topics


def of(positive=None, negative=None):
    return {t["topic"]: t["polarity"] for t in plain_topics.classify(positive, negative)}


CASES = [
    ("Everything looked spotless", None, {"cleanliness": "positive"}),
    ("It was not clean", None, {"cleanliness": "negative"}),
    ("Not only clean but quiet", None, {"cleanliness": "positive", "noise": "positive"}),
    ("It was not bad at all, but clean", None, {"cleanliness": "positive"}),
    ("never not clean", None, {"cleanliness": "positive"}),
    ("The staff were not friendly", None, {"staff_reception": "negative"}),
    (None, "The staff were not rude", {"staff_reception": "positive"}),
    (None, "no staff", {"staff_reception": "negative"}),
    (None, "The window", {"room_condition": "negative"}),
    ("The bed", None, {"room_condition": "positive"}),
    ("Quiet rooms", "Loud music all night", {"noise": "mixed"}),
    (None, "We couldn’t sleep", {"noise": "negative"}),
    (None, "The wifi didn’t work", {"facilities": "negative"}),
    ("no problem checking in", None, {"check_in": "positive"}),
    (None, "not worth the money", {"value_for_money": "negative"}),
    ("écleané sheets", None, {"cleanliness": "positive"}),
    (None, None, {}),
    ("Check-in was easy and quick", None, {"check_in": "positive"}),
    (None, "The keypad did not work", {"check_in": "negative"}),
    (None, "We were locked out", {"check_in": "negative"}),
    ("attentive staff", None, {"staff_reception": "positive"}),
    (None, "rude manager", {"staff_reception": "negative"}),
    (None, "without any noise", {"noise": "positive"}),
    ("Modern facilities and an elevator", None, {"facilities": "positive"}),
    (None, "no hot water", {"facilities": "negative"}),
    ("Walking distance to shops", None, {"location": "positive"}),
    (None, "far from the centre", {"location": "negative"}),
    ("the location was hard to find", None, {"location": "mixed"}),
    ("Spacious room", None, {"room_condition": "positive"}),
    (None, "tiny room with a broken window", {"room_condition": "negative"}),
    ("Good value, worth the price", None, {"value_for_money": "positive"}),
    (None, "extra charges", {"value_for_money": "negative"}),
    ("unclean but well located", None, {"cleanliness": "negative", "location": "positive"}),
    ("Was it clean? I could not say. Quiet, though", None, {"cleanliness": "positive", "noise": "positive"}),
    ("We loved the garden", "Nothing at all about the food", {}),
]


@pytest.mark.parametrize("positive,negative,expected", CASES)
def test_polarity(positive, negative, expected):
    assert of(positive, negative) == expected


def test_anchor_is_dropped_when_a_specific_match_covers_it():
    (t,) = plain_topics.classify("Great location here", None)
    assert [e["rule"] for e in t["evidence"]] == ["location.positive_access"]
    # An anchor that begins before the specific match stays.
    (t,) = plain_topics.classify(None, "self check-in delay")
    assert [e["rule"] for e in t["evidence"]] == ["check_in.source_anchor", "check_in.negative_experience"]


def test_evidence_order_and_terms():
    t = plain_topics.classify("Clean, clean and tidy", "dirty")[0]
    assert t["terms"] == ["clean", "tidy", "dirty"] and t["fields"] == ["positive_text", "negative_text"] and t["polarity"] == "mixed"
    assert [(e["start"], e["end"]) for e in t["evidence"]] == [(0, 5), (7, 12), (17, 21), (0, 5)]


def test_states_and_sentiment(spark):
    rows = [
        (90, None, None, "positive", "sentiment.score_only_positive"), (75, "", "  ", "mixed", "sentiment.score_only_mixed"), (69, None, None, "negative", "sentiment.score_only_negative"),
        (50, "Nice", None, "mixed", "sentiment.positive_text_low_score"), (70, "Nice", "Nothing!", "positive", "sentiment.positive_text"),
        (85, "N/A", "Cold", "mixed", "sentiment.negative_text_high_score"), (75, None, "Cold", "negative", "sentiment.negative_text"), (95, "Nice", "Cold", "mixed", "sentiment.both_text_channels"),
        (95, None, "There were no problems. Everything was fine", "positive", "sentiment.score_only_positive"), (95, None, "I didn’t experience any issues", "positive", "sentiment.score_only_positive"),
    ]
    df = spark.createDataFrame(rows, "tenths int, positive_text string, negative_text string, label string, rule string")
    assert sentiment.with_sentiment(df).filter((F.col("label") != F.col("sentiment")) | (F.col("rule") != F.col("sentiment_rule"))).count() == 0


def test_mentions_is_ascii_bounded(spark):
    df = spark.createDataFrame([("écleané",), ("uncleaned",), ("CLEAN",), (None,)], "t string")
    assert [r[0] for r in df.select(topics.mentions("cleanliness", F.col("t"))).collect()] == [True, False, True, False]


def expressed(spark, pairs):
    """The topics of texts by column expressions, as the plain classifier gives them."""
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, positive_text string, negative_text string")
    state = lambda c: F.when(F.col(c) != "", "substantive").otherwise("empty")
    found = topics.with_topics(rows.withColumns({"positive_state": state("positive_text"), "negative_state": state("negative_text")}), evidence=True)
    assert "Python" not in found._jdf.queryExecution().toString() and "__positive_text" not in found.columns
    return [[t.asDict(recursive=True) for t in r.topics] for r in found.orderBy("i").collect()]


def compared(spark, pairs):
    assert expressed(spark, pairs) == [plain_topics.classify(p or None, n or None) for p, n in pairs]


def test_expressions_are_the_plain_classifier_on_cases(spark):
    compared(spark, [(p, n) for p, n, _ in CASES] + [("", ""), ("Clean, clean and tidy", "dirty"), ("Great location here", None), (None, "self check-in delay")])


def test_expressions_are_the_plain_classifier_on_fuzzed_texts(spark):
    """Words of the rules, negators, clause ends, joined at random; long texts too."""
    r, words = random.Random(11), ["🙂", "écru", "İstanbul", "_", "a_clean", "’", "couldn’t", "x" * 97, "and", "the", "room", "self", "check-in", "check in", "STAFF", "not only", "Not", "no", "never", "without", "isn't", "but", "however", ".", "; ", "\n", ", ", "!"]
    for *_, pattern, _ in topics.RULES:
        words += [w for w in re.findall("[a-z][a-z' -]{2,}", pattern) if "\\" not in w]
    pairs = []
    for k in range(700):
        text = lambda: " ".join(r.choice(words) for _ in range(r.choice((0, 1, 3, 8, 25)))) if r.random() < 0.9 else None
        pairs.append((text(), text()))
    pairs.append((" ".join(r.choice(words) for _ in range(3000)), None))
    assert sum(bool(plain_topics.classify(p or None, n or None)) for p, n in pairs) > 400
    compared(spark, pairs)


def test_expressions_on_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    compared(spark, [(t, u) for t, u in zip(texts[::2], texts[1::2])])


def test_each_text_once(spark):
    """A third of the rows say the same, some say nothing, some are there twice; columns of any name stay."""
    texts = [("The room was spotless", None), (None, None), ("", "nothing"), ("Not clean at all", "Slow wifi and a cold shower"), (None, "No lift. Staff were not friendly")]
    rows = [(i % 40, i % 3, *(texts[0] if i % 3 == 0 else texts[i % 5]), 50, i % 7, "x") for i in range(120)]
    r = sentiment.with_sentiment(spark.createDataFrame(rows * 2, "token int, property_key int, positive_text string, negative_text string, tenths int, f int, h string"))
    for evidence in (False, True):
        whole, once = topics.with_topics(r, evidence), topics.with_topics_once(r, ("property_key", "token"), evidence)
        assert once.columns == whole.columns and once.schema["topics"].dataType.simpleString() == whole.schema["topics"].dataType.simpleString()
        assert sorted(map(str, once.collect())) == sorted(map(str, whole.collect()))
    assert topics.with_topics_once(r.limit(0), ("token",)).count() == 0
