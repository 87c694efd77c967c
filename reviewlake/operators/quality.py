"""Evidence status of properties, quality rows, and the gates of publication and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.gaps import first_failing

STATUSES = ("verified", "source-gap", "collecting", "evidence-error")


def status() -> Column:
    """The ladder of evidence; the order of its steps matters.

    Expects published_run, the counts and hashes of both inventories, present,
    displayed, structured and final counts, gap_attested and gap_valid for a
    source gap, visible_attested and visible_valid for a visible one.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    parity = same("oldest_count", "newest_count") & same("oldest_ids", "newest_ids") & same("oldest_records", "newest_records")
    counts = F.coalesce((F.col("final_count") == F.col("structured")) & (F.col("present") == F.col("structured")), F.lit(False))
    attested, visible = F.coalesce("gap_attested", F.lit(False)), F.coalesce("visible_attested", F.lit(False))
    reconciled = F.coalesce("gap_valid", F.lit(False)) & counts
    return (
        F.when(F.col("published_run").isNull(), "collecting").when(~parity, "evidence-error").when(attested & visible, "evidence-error")
        .when(attested, F.when(reconciled, "source-gap").otherwise("evidence-error"))
        .when(counts & F.coalesce(F.col("displayed") == F.col("structured"), F.lit(False)), "verified")
        .when(counts & visible & F.coalesce("visible_valid", F.lit(False)), "source-gap").otherwise("evidence-error")
    )


def quality_rows(evidence: DataFrame) -> DataFrame:
    """One row for each property, whatever is selected elsewhere."""
    published = F.col("published_run").isNotNull()
    rows = evidence.withColumn("status", status())
    gap = F.when(published & F.col("displayed").isNotNull() & F.col("present").isNotNull(), F.col("displayed") - F.col("present")).otherwise(0)
    note = (
        F.when(F.col("status") == "verified", "Counts, identities and records agree.")
        .when(F.col("status") == "source-gap", F.concat(gap.cast("string"), F.lit(" advertised but not returned; the evidence for it holds.")))
        .when(F.col("status") == "evidence-error", "The stored evidence does not agree.").otherwise("No accepted full publication yet.")
    )
    return rows.select("ordinal", "property_key", "status", F.when(published, F.col("present")).alias("retrievable"), F.when(published, F.col("displayed")).alias("advertised"), gap.alias("source_gap"), note.alias("note"))


def overall(rows: DataFrame) -> DataFrame:
    """The worst status: errors, then collecting, then gaps."""
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    accepted = F.count_if(F.col("status").isin("verified", "source-gap"))
    return rows.agg(F.when(has("evidence-error"), "error").when(has("collecting"), "collecting").when(has("source-gap"), "attention").otherwise("verified").alias("overall"), accepted.alias("accepted"), (F.count("*") - accepted).alias("pending"))


def publication_reasons() -> Column:
    """All reasons why a publication is not authoritative; an empty list if it is.

    The counts of a snapshot are looked at before its gaps, and a gap of the
    source before a visible one.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    gap, visible = F.coalesce("gap_attested", F.lit(False)), F.coalesce("visible_attested", F.lit(False))
    counted = F.col("structured").isNotNull() & same("structured", "final_count") & same("structured", "present")
    checks = [
        ("latest_run_missing", F.col("run_status").isNull()),
        ("latest_run_not_succeeded", F.col("run_status") != "succeeded"),
        ("latest_run_parser_version_mismatch", ~same("run_parser", "expected_parser")),
        ("latest_run_not_complete_inventory", ~F.coalesce("complete_inventory", F.lit(False))),
        ("latest_run_property_mismatch", ~same("run_property", "property_key")),
        ("published_count_mismatch", ~same("present", "final_count")),
        ("latest_run_is_not_latest_full_run", ~same("last_full_run", "published_run")),
        ("full_inventory_attestation_invalid", ~(same("oldest_count", "newest_count") & same("oldest_ids", "newest_ids") & same("oldest_records", "newest_records"))),
        ("source_discrepancy_attestation_invalid", gap & ~F.coalesce("gap_valid", F.lit(False))),
        ("property_snapshot_missing", F.col("structured").isNull()),
        ("property_snapshot_count_mismatch", F.col("structured").isNotNull() & ~counted),
        ("conflicting_count_discrepancy_attestations", counted & gap & visible),
        ("source_discrepancy_snapshot_mismatch", counted & gap & F.coalesce("gap_valid", F.lit(False)) & ~(same("displayed", "gap_advertised") & same("structured", "gap_retrievable"))),
        ("visible_count_discrepancy_invalid", counted & ~gap & ~same("displayed", "structured") & ~F.coalesce("visible_valid", F.lit(False))),
        ("unexpected_visible_count_discrepancy", counted & ~gap & same("displayed", "structured") & visible),
    ]
    return F.when(F.col("published_run").isNull(), F.array(F.lit("publication_missing"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks])))


class NotAuthoritative(RuntimeError):
    pass


def require_authoritative(evidence: DataFrame) -> None:
    """Fails, naming the properties and reasons, unless every publication is authoritative; before any review is read."""
    bad = evidence.withColumn("reasons", publication_reasons()).filter(F.size("reasons") > 0).select("property_key", "reasons").orderBy("property_key").collect()  # of the configured properties
    if bad:
        raise NotAuthoritative("; ".join(f"{r['property_key']}: {', '.join(r['reasons'])}" for r in bad))


def snapshot_invariant() -> Column:
    """exact, structured_gap, visible_gap, unavailable or broken for a snapshot's counts."""
    gap = F.col("displayed") - F.col("structured")
    return (
        F.when(F.col("displayed").isNull(), "unavailable").when(gap == 0, "exact").when((gap > 0) & F.coalesce("gap_attested", F.lit(False)), "structured_gap")
        .when(gap.between(1, 5) & F.coalesce("visible_attested", F.lit(False)), "visible_gap").otherwise("broken")
    )


def count_attestation(pages: DataFrame) -> DataFrame:
    """Per run: whether all pages share one evidence hash, and are as many as two passes, a canary and a head need."""
    expected = 2 * (F.ceil(F.max("total") / 10) + 1) + 1
    return pages.groupBy("run_id").agg((F.count_distinct("evidence_hash") == 1).alias("one_hash"), F.count("*").alias("pages"), expected.alias("expected_pages"), (F.count("*") == expected).alias("complete"))


def first_failure(*checks: tuple[str, Column]) -> Column:
    return first_failing(*checks)
