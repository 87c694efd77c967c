"""Text states and the sentiment decision table, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that say nothing, in any channel and in the negative one.
COMMON_PLACEHOLDERS = ("", "-", "--", ".", "n/a", "na", "nil", "none", "no comment", "no comments", "not applicable", "nothing to add")
NEGATIVE_PLACEHOLDERS = ("all good", "cannot fault anything", "could not fault anything", "everything was fine", "no complaints", "nothing", "nothing bad", "nothing negative", "nothing to dislike")
NEGATIVE_PLACEHOLDER_PATTERNS = (
    r"^(?:i had (?:a )?(?:excellent|good|great|wonderful) stay and )?(?:i )?(?:did not|didn't) experience any (?:issues?|problems?)(?: everything (?:met|exceeded) my expectations)?$",
    r"^(?:there (?:was|were) )?no (?:issues?|problems?)(?: everything (?:was fine|met (?:my )?expectations))?$",
)
#: A score is positive from the first and negative below the second, in tenths.
POSITIVE_FROM, NEGATIVE_BELOW = 80, 70
_SPACE, _SOLID = r"[\s\p{Z}\x{FEFF}]+", r"[^\s\p{Z}\x{FEFF}]"


def bare(text: Column) -> Column:
    """Trimmed, lower case, single spaces, without punctuation at the edges."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _SPACE, " "))
    return F.trim(F.btrim(t, F.lit(".,!?;:")))


def state(text: Column, negative: bool) -> Column:
    """empty, placeholder or substantive."""
    t = bare(text)
    filler = t.isin(*COMMON_PLACEHOLDERS)
    if negative:
        sentence = F.trim(F.regexp_replace(F.regexp_replace(F.translate(t, "’", "'"), r"[.!?;:]+", " "), _SPACE, " "))
        filler = filler | t.isin(*NEGATIVE_PLACEHOLDERS)
        # Both patterns name an issue or a problem; few texts do, and only these are read as sentences.
        filler = filler | ((t.contains("issue") | t.contains("problem")) & sentence.rlike("|".join(NEGATIVE_PLACEHOLDER_PATTERNS)))
    return F.when(~F.coalesce(text, F.lit("")).rlike(_SOLID), "empty").when(filler, "placeholder").otherwise("substantive")


def band(tenths: Column) -> Column:
    return F.when(tenths >= POSITIVE_FROM, "positive").when(tenths < NEGATIVE_BELOW, "negative").otherwise("mixed")


def with_states(reviews: DataFrame) -> DataFrame:
    """Adds the text states."""
    return reviews.withColumns({"positive_state": state(F.col("positive_text"), False), "negative_state": state(F.col("negative_text"), True)})


def with_sentiment(reviews: DataFrame) -> DataFrame:
    """Adds text states, band, sentiment, its rule, and the flag of negative feedback."""
    return labelled(with_states(reviews))


def labelled(stated: DataFrame) -> DataFrame:
    """with_sentiment() for rows that have their text states."""
    r = stated.withColumn("band", band(F.col("tenths")))
    pos, neg, b = F.col("positive_state") == "substantive", F.col("negative_state") == "substantive", F.col("band")
    rule = (
        F.when(pos & neg, "both_text_channels")
        .when(pos, F.when(b == "negative", "positive_text_low_score").otherwise("positive_text"))
        .when(neg, F.when(b == "positive", "negative_text_high_score").otherwise("negative_text"))
        .otherwise(F.concat(F.lit("score_only_"), b))
    )
    label = (
        F.when(pos & neg, "mixed").when(pos, F.when(b == "negative", "mixed").otherwise("positive"))
        .when(neg, F.when(b == "positive", "mixed").otherwise("negative")).otherwise(b)
    )
    r = r.withColumns({"sentiment_rule": F.concat(F.lit("sentiment."), rule), "sentiment": label})
    return r.withColumn("has_negative_feedback", (F.col("sentiment") == "negative") | (F.col("negative_state") == "substantive"))
