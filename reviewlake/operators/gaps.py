"""Bounded differences between what a source advertises and what it returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.ranges import with_previous

#: The tolerated gap, the four totals that must agree, and the score buckets in order.
MOST_GAP, GAP_SHARE = 5, 0.01
TOTALS = ("reviewScoreFilter.ALL", "languageFilter.empty", "timeOfYearFilter.ALL", "customerTypeFilter.ALL")
GAP_KIND = "source_count_gap_v1"
BUCKETS = ("REVIEW_ADJ_SUPERB", "REVIEW_ADJ_GOOD", "REVIEW_ADJ_AVERAGE_PASSABLE", "REVIEW_ADJ_POOR", "REVIEW_ADJ_VERY_POOR")


def tolerance(advertised: Column) -> Column:
    """The largest gap that a property of this size may have; none where the count is invalid."""
    return F.when(advertised >= 0, F.least(F.lit(MOST_GAP), F.floor(advertised * GAP_SHARE).cast("int"))).otherwise(0)


def totals_status(unfiltered: Column, count: Column, totals: Column) -> Column:
    """Whether the totals of a response's filters (an array of counts; absent ones null) agree with its count."""
    known = F.array_compact(totals)
    return (
        F.when(~unfiltered, "not_evaluated_filtered").when(F.size(known) == 0, "unavailable")
        .when(F.forall(known, lambda t: t == count), "consistent").otherwise("inconsistent")
    )


def shortfalls(buckets: DataFrame, keys: tuple[str, ...] = ("property_key",)) -> DataFrame:
    """Per property the headline bucket, the first with the largest shortfall, and whether the buckets explain the gap.

    ``buckets`` has bucket, advertised and retrievable for each key; the five
    buckets must all be there, none may fall short by less than nothing.
    """
    place = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    short = F.col("advertised") - F.col("retrievable")
    per = buckets.groupBy(*keys).agg(
        F.sum("advertised").alias("advertised"), F.sum("retrievable").alias("retrievable"), F.sum(short).alias("gap"), F.min(short).alias("least"),
        F.count_distinct(F.when(place > 0, F.col("bucket"))).alias("known"), F.count("*").alias("n"),
        F.min_by(F.struct("bucket", short.alias("gap")), F.struct((-short).alias("s"), place.alias("p"))).alias("headline"),
    )
    code = (
        F.when((F.col("known") != len(BUCKETS)) | (F.col("n") != len(BUCKETS)), "BUCKET_SET_MISMATCH").when(F.col("least") < 0, "BUCKET_SURPLUS")
        .when(F.col("gap") <= 0, "NO_GAP").when(F.col("gap") > tolerance(F.col("advertised")), "GAP_TOO_LARGE")
    )
    return per.select(*keys, "advertised", "retrievable", "gap", tolerance(F.col("advertised")).alias("tolerated"), F.col("headline.bucket").alias("headline_bucket"), F.col("headline.gap").alias("headline_gap"), F.coalesce(code, F.lit("OK")).alias("verdict"))


def trusted_totals(totals: DataFrame, keys: tuple[str, ...] = ("property_key",)) -> DataFrame:
    """Whether a property's four named totals are all there and equal."""
    named = F.col("source").isin(*TOTALS)
    return totals.groupBy(*keys).agg((F.count("*") == len(TOTALS)).alias("complete"), (F.count_distinct(F.when(named, F.col("source"))) == len(TOTALS)).alias("named"), (F.count_distinct("n") == 1).alias("equal"), F.max("n").alias("total"))


def visible_gap(shown: DataFrame, policy: DataFrame) -> DataFrame:
    """Properties whose shown count exceeds the structured one by no more than their policy allows.

    ``policy`` has a row for each property that may have such a gap, with its
    hotel id and largest gap; without one the gap is not accepted.
    """
    gap = F.col("visible") - F.col("structured")
    out = shown.join(policy.select("property_key", F.col("hotel_id").alias("policy_hotel_id"), "most_gap"), "property_key", "left")
    verdict = F.when(gap == 0, "none").when(F.col("most_gap").isNull(), "no_policy").when(F.col("hotel_id") != F.col("policy_hotel_id"), "identity").when(gap.between(1, F.col("most_gap")), "accepted").otherwise("out_of_range")
    return out.select(*shown.columns, gap.alias("gap"), verdict.alias("verdict"))


def bucket_digest(buckets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A digest of a few evidence rows per key: five buckets at most, in order."""
    place = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    return buckets.groupBy(*keys).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct(place.alias("place"), "bucket", "advertised")))), 256).alias("digest"))


def first_failing(*checks: tuple[str, Column]) -> Column:
    """The code of the first check that is true; null if none is."""
    out = F.lit(None).cast("string")
    for code, failed in reversed(checks):
        out = F.when(F.coalesce(failed, F.lit(False)), code).otherwise(out)
    return out


def monotonic(pages: DataFrame, newest_first: bool = True) -> DataFrame:
    """Rows of collected pages whose date breaks the order of their phase."""
    rows = with_previous(pages, ("property_key", "phase"), ("page_offset", "card_index"), {"epoch": "__earlier"})
    before = F.col("__earlier")
    broken = F.col("epoch") > before if newest_first else F.col("epoch") < before
    return rows.filter(F.coalesce(broken, F.lit(False))).drop("__earlier")


def source_gap(counts: DataFrame, kind: str = GAP_KIND) -> DataFrame:
    """counts with ``evidence`` of a gap, or a ``verdict`` that says why there is none: NONE for equal counts, else the first check that fails.

    Expects advertised, retrievable, totals (struct<source, n> each) and buckets (struct<bucket, advertised>).
    """
    gap = F.col("advertised") - F.col("retrievable")
    places = lambda of, name: F.array_sort(F.transform(of, lambda x: x[name]))
    verdict = first_failing(
        ("INVALID_COUNT", ~F.coalesce((F.col("advertised") >= 0) & (F.col("retrievable") >= 0), F.lit(False))), ("NONE", gap == 0), ("GAP_COUNT_MISMATCH", ~gap.between(1, tolerance(F.col("advertised")))),
        ("TRUSTED_TOTALS_MISMATCH", (places("totals", "source") != F.array(*map(F.lit, sorted(TOTALS)))) | ~F.forall("totals", lambda x: x["n"] == F.col("advertised"))),
        ("SCORE_BUCKETS_MISMATCH", places("buckets", "bucket") != F.array(*map(F.lit, sorted(BUCKETS)))), ("ADVERTISED_BUCKET_SUM_MISMATCH", F.aggregate("buckets", F.lit(0).cast("long"), lambda a, x: a + x["advertised"]) != F.col("advertised")),
    )
    evidence = F.when(verdict.isNull(), F.struct(F.lit(kind).alias("kind"), F.lit(1).alias("version"), F.col("advertised"), F.col("retrievable"), gap.alias("gap")))
    return counts.withColumns({"verdict": F.coalesce(verdict, F.lit("OK")), "evidence": evidence})


def disclosures(attested: DataFrame, buckets: DataFrame, kind: str = GAP_KIND) -> DataFrame:
    """What a stored attestation may say: its counts recomputed from its buckets and compared, field by field.

    ``attested`` has a row for each property: kind, version, advertised,
    retrievable, gap, headline_bucket, headline_gap, headline_advertised and
    headline_retrievable; ``buckets`` its rows of shortfalls(). A row that
    fails has the first reason in ``verdict`` and discloses nothing.
    """
    now = shortfalls(buckets).select("property_key", F.col("advertised").alias("n_advertised"), F.col("retrievable").alias("n_retrievable"), F.col("gap").alias("n_gap"), F.col("headline_bucket").alias("n_bucket"), F.col("headline_gap").alias("n_short"), F.col("verdict").alias("bucket_verdict"))
    named = buckets.select("property_key", F.col("bucket").alias("n_bucket"), F.col("advertised").alias("b_advertised"), F.col("retrievable").alias("b_retrievable"))
    both = attested.join(now, "property_key", "left").join(named, ["property_key", "n_bucket"], "left")
    differ = lambda *pairs: F.array_contains(F.array(*[~F.col(a).eqNullSafe(F.col(b)) for a, b in pairs]), True)
    verdict = first_failing(
        ("INVALID_ATTESTATION", F.col("version") != 1), ("CONTRACT_KIND_MISMATCH", F.col("kind") != kind), ("BUCKETS_MISSING", F.col("bucket_verdict").isNull()), ("BUCKETS_INVALID", F.col("bucket_verdict") != "OK"),
        ("COUNT_MISMATCH", differ(("advertised", "n_advertised"), ("retrievable", "n_retrievable"), ("gap", "n_gap"))),
        ("HEADLINE_MISMATCH", differ(("headline_bucket", "n_bucket"), ("headline_gap", "n_short"), ("headline_advertised", "b_advertised"), ("headline_retrievable", "b_retrievable"))),
    )
    shown = lambda c: F.when(verdict.isNull(), F.col(c))
    return both.select("property_key", F.coalesce(verdict, F.lit("OK")).alias("verdict"), *[shown(c).alias(c) for c in ("advertised", "retrievable", "gap", "headline_bucket", "headline_advertised", "headline_retrievable")])


def category_digest(ratings: DataFrame, keys: tuple[str, ...] = ("property_key",)) -> DataFrame:
    """A digest of a property's few categories by name: name, translation and value only, so that other fields may vary."""
    said = F.array_sort(F.collect_list(F.struct("name", "translation", "value")))
    return ratings.groupBy(*keys).agg(F.sha2(F.to_json(said, {"ignoreNullFields": "false"}), 256).alias("digest"))

