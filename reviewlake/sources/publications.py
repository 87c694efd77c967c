"""Accepted publications: what readers may see of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension_scan(properties: DataFrame, publications: DataFrame, runs: DataFrame, snapshots: DataFrame, inventories: DataFrame, source_gaps: DataFrame, visible_gaps: DataFrame) -> DataFrame:
    """Enabled properties with the evidence of their accepted run, if they have one; every side but the first is left-joined."""
    out = properties.filter("enabled").join(publications, "property_key", "left")
    for side in (runs, snapshots, inventories, source_gaps, visible_gaps):
        out = out.join(side, "run_id", "left")
    return out.orderBy("ordinal")


def fact_scan(properties: DataFrame, publications: DataFrame, reviews: DataFrame, versions: DataFrame) -> DataFrame:
    """Present reviews of published, enabled properties in their current version, in the base order of all later ties.

    Filters come before the joins, so that they reach the scans; the small
    dimensions are left to Spark's own choice of join.
    """
    live = properties.filter("enabled").select("property_key").join(publications.select("property_key"), "property_key")
    present = reviews.filter(F.col("presence") == "present")
    current = versions.filter("is_current").drop("property_key")
    return present.join(live, "property_key", "left_semi").join(current, "row_id")


def base_order(facts: DataFrame) -> DataFrame:
    return facts.orderBy(F.desc("epoch"), F.asc("row_id"))


def current_reviews(facts: DataFrame, property_key: str) -> DataFrame:
    """One property's present reviews, newest first."""
    return base_order(facts.filter(F.col("property_key") == property_key))


def lookup(table: DataFrame, **keys) -> DataFrame:
    """Rows by key; the conditions reach the scan."""
    for name, value in keys.items():
        table = table.filter(F.col(name) == value)
    return table


def page_evidence(pages: DataFrame, run_id) -> DataFrame:
    return pages.filter(F.col("run_id") == run_id).orderBy("phase", "page_offset")
