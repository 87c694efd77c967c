"""Checks of collected pages, phases and runs, each as rows of violations or verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.operators.gaps import first_failing
from reviewlake.operators.ranges import with_previous
from reviewlake.operators.snapshots import inventory_digest

#: The orders that a page must offer.
SORTERS = ("NEWEST_FIRST", "OLDEST_FIRST")
#: Cards that a page may hold.
LEAST_LIMIT, MOST_LIMIT = 1, 10
PHASE = ("property_key", "phase")


def _exploded(df: DataFrame, keys: tuple[str, ...], checks: dict[str, Column]) -> DataFrame:
    codes = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks.items()]))
    return df.withColumn("code", F.explode(codes)).select(*keys, "code")


def page_violations(pages: DataFrame) -> DataFrame:
    """(property_key, phase, page_offset, code) for what is wrong with the shape of a phase's pages.

    Expects page_offset, page_limit, n_cards, reported and page_hash for each
    page. All windows of a phase share one partitioning, hence one shuffle.
    """
    w = Window.partitionBy(*PHASE).orderBy("page_offset")
    whole = Window.partitionBy(*PHASE)
    last = F.col("page_offset") == F.max("page_offset").over(whole)
    seen = F.min("page_offset").over(Window.partitionBy(*PHASE, "page_hash"))
    rows = pages.withColumns({
        "expected": F.coalesce(F.lag(F.col("page_offset") + F.col("page_limit")).over(w), F.lit(0)),
        "first_reported": F.first("reported").over(w), "last": last, "first_offset": seen,
    })
    full = F.col("n_cards") >= F.col("page_limit")
    return _exploded(rows, (*PHASE, "page_offset"), {
        "LIMIT_RANGE": ~F.col("page_limit").between(LEAST_LIMIT, MOST_LIMIT),
        "TOO_MANY_CARDS": F.col("n_cards") > F.col("page_limit"),
        "OFFSET_GAP": F.col("page_offset") != F.col("expected"),
        "PREMATURE_SHORT_PAGE": ~full & ~F.col("last"),
        "TERMINAL_PAGE_MISSING": full & F.col("last"),
        "EMPTY_FIRST_PAGE": (F.col("page_offset") == 0) & (F.col("n_cards") == 0) & (F.col("reported") > 0),
        "COUNT_MOVED": F.col("reported") != F.col("first_reported"),
        "REPEATED_PAGE": (F.col("n_cards") > 0) & (F.col("page_offset") > F.col("first_offset")),
    })


def card_violations(cards: DataFrame, newest_first: bool) -> DataFrame:
    """(property_key, phase, page_offset, card_index, code) for cards out of order, twice on a page, in no score bucket, or changed within the run."""
    per_token = Window.partitionBy(*PHASE, "token").orderBy("page_offset", "card_index")
    rows = with_previous(cards, PHASE, ("page_offset", "card_index"), {"epoch": "before"}).withColumns({
        "place_on_page": F.row_number().over(Window.partitionBy(*PHASE, "token", "page_offset").orderBy("card_index")),
        "first_hash": F.first("record_hash").over(per_token),
    })
    return _exploded(rows, (*PHASE, "page_offset", "card_index"), {
        "DATE_ORDER": F.col("epoch") > F.col("before") if newest_first else F.col("epoch") < F.col("before"),
        "DUPLICATE_IN_PAGE": F.col("place_on_page") > 1,
        "RECORD_CHANGED": F.col("record_hash") != F.col("first_hash"),
        "NO_SCORE_BUCKET": ~F.col("tenths").between(10, 100),
    })


def phase_verdicts(pages: DataFrame, cards: DataFrame) -> DataFrame:
    """Per phase the counts and the first rule that fails: shape, unique count, or none."""
    shape = pages.groupBy(*PHASE).agg(F.max("reported").alias("reported"), F.count_distinct("reported").alias("counts"), F.count("*").alias("pages"))
    unique = cards.groupBy(*PHASE, "token").agg(F.count("*").alias("n")).groupBy(*PHASE).agg(F.count("*").alias("unique_reviews"), F.sum(F.col("n") - 1).alias("repeats"))
    bad = page_violations(pages).groupBy(*PHASE).agg(F.count("*").alias("violations"))
    out = shape.join(unique, list(PHASE), "left").join(bad, list(PHASE), "left")
    verdict = first_failing(("COUNT_MOVED", F.col("counts") > 1), ("PAGE_SHAPE", F.col("violations") > 0), ("UNIQUE_COUNT_MISMATCH", F.coalesce("unique_reviews", F.lit(0)) != F.col("reported")))
    return out.select(*PHASE, "reported", "pages", F.coalesce("unique_reviews", F.lit(0)).alias("unique_reviews"), F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce(verdict, F.lit("OK")).alias("verdict"))


def _first_page(cards: DataFrame, newest: bool, prefix: str) -> DataFrame:
    """Per property what the canary needs of one first page, a page's cards at most: its identities in order, whether its dates move one way, its count, sorters and evidence."""
    has = lambda c, kind: F.first(c, ignorenulls=True) if c in cards.columns else F.lit(None).cast(kind)
    seen = F.array_sort(F.collect_list(F.struct("card_index", "token", "epoch")))
    page = cards.groupBy("property_key").agg(seen.alias("seen"), F.max("reported").alias("reported"), has("sorters", "array<string>").alias("sorters"), has("evidence", "string").alias("evidence"))
    wrong = (lambda x, y: x["epoch"] < y["epoch"]) if newest else (lambda x, y: x["epoch"] > y["epoch"])
    pairs = F.zip_with(F.slice("seen", F.lit(1), F.size("seen") - 1), F.slice("seen", F.lit(2), F.greatest(F.size("seen") - 1, F.lit(0))), lambda x, y: F.coalesce(wrong(x, y), F.lit(False)))
    fields = {"ids": F.transform("seen", lambda x: x["token"]), "moved": F.exists(pairs, lambda x: x), "reported": F.col("reported"), "sorters": F.col("sorters"), "evidence": F.col("evidence")}
    return page.select("property_key", *[c.alias(f"{prefix}_{k}") for k, c in fields.items()])


def canary(oldest: DataFrame, newest: DataFrame) -> DataFrame:
    """Per property whether both sort orders are there and were applied, and whether counts and evidence agree, from the first page of either order.

    Cards have property_key, card_index, token, epoch and reported; if given,
    sorters (what the page offers) and evidence (a digest of its aggregates)
    are checked too. Of the rules the first that is broken is the verdict: a
    page that is missing, an order that is not offered, dates that move in the
    wrong direction, the same cards in the same order from two on, another
    count, other evidence.
    """
    both = _first_page(oldest, False, "o").join(_first_page(newest, True, "n"), "property_key", "full_outer")
    lacks = lambda p: F.col(f"{p}_sorters").isNotNull() & (F.size(F.array_except(F.array(*map(F.lit, SORTERS)), f"{p}_sorters")) > 0)
    same = (F.col("n_reported") > 1) & (F.size("n_ids") > 1) & (F.size("o_ids") > 1) & (F.col("n_ids") == F.col("o_ids"))
    verdict = first_failing(
        ("MISSING_PAGE", F.col("o_ids").isNull() | F.col("n_ids").isNull()), ("UNSUPPORTED_SORTER", lacks("n") | lacks("o")), ("NON_MONOTONIC_PAGINATION", F.col("n_moved") | F.col("o_moved")),
        ("SORTER_NOT_APPLIED", same), ("MOVING_REVIEW_COUNT", F.col("o_reported") != F.col("n_reported")), ("MOVING_AGGREGATE_COUNTS", F.col("o_evidence") != F.col("n_evidence")),
    )
    return both.select("property_key", F.coalesce(verdict, F.lit("OK")).alias("verdict"))


def head_unchanged(head: DataFrame, newest: DataFrame) -> DataFrame:
    """Per property whether the last head check saw the newest pass's first page again."""
    first = newest.filter("page_offset = 0").select("property_key", F.col("page_hash").alias("first_hash"))
    return head.select("property_key", F.col("page_hash").alias("head_hash")).join(first, "property_key", "left").select("property_key", F.coalesce(F.col("head_hash") == F.col("first_hash"), F.lit(False)).alias("unchanged"))


def finalized(phases: DataFrame, staged: DataFrame, wanted: tuple[str, ...] = ("oldest", "newest")) -> DataFrame:
    """Per property whether a run may be promoted: all phases there and valid, as many staged as counted."""
    counts = staged.groupBy("property_key").agg(F.count_distinct("token").alias("staged"))
    per = phases.groupBy("property_key").agg(F.count_distinct(F.when(F.col("phase").isin(*wanted), F.col("phase"))).alias("phases"), F.bool_and(F.col("verdict") == "OK").alias("valid"), F.min("reported").alias("low"), F.max("reported").alias("high"))
    verdict = first_failing(("PHASE_MISSING", F.col("phases") < len(wanted)), ("PHASE_INVALID", ~F.col("valid")), ("COUNTS_DIFFER", F.col("low") != F.col("high")), ("STAGED_COUNT_MISMATCH", F.coalesce("staged", F.lit(0)) != F.col("high")))
    return per.join(counts, "property_key", "left").select("property_key", F.col("high").alias("final_count"), F.coalesce("staged", F.lit(0)).alias("staged"), F.coalesce(verdict, F.lit("OK")).alias("verdict"))


def attribution(rows: DataFrame, fields: dict[str, str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``mismatched``: normalised columns that differ from the retained card at the given paths; null and missing are one for optional fields."""
    differ = [F.when(~F.col(c).cast("string").eqNullSafe(F.get_json_object("card_json", path)) & ~(F.lit(c in optional) & F.col(c).isNull()), F.lit(c)) for c, path in fields.items()]
    return rows.withColumn("mismatched", F.array_compact(F.array(*differ)))


def register(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Properties after an upsert by key; ``conflict`` where a key comes with another hotel id, or an id with another key."""
    a = existing.select("property_key", F.col("hotel_id").alias("old_id"), F.col("property_name").alias("old_name"))
    b = incoming.select("property_key", F.col("hotel_id").alias("new_id"), F.col("property_name").alias("new_name"))
    both = a.join(b, "property_key", "full_outer")
    taken = existing.select(F.col("hotel_id").alias("new_id"), F.col("property_key").alias("holder"))
    both = both.join(taken, "new_id", "left")
    conflict = first_failing(("HOTEL_ID_CHANGED", F.col("old_id") != F.col("new_id")), ("HOTEL_ID_TAKEN", F.col("holder") != F.col("property_key")))
    change = F.when(F.col("new_id").isNull(), "kept").when(F.col("old_id").isNull(), "added").when(F.col("old_name").eqNullSafe(F.col("new_name")), "unchanged").otherwise("renamed")
    return both.select("property_key", F.coalesce("old_id", "new_id").alias("hotel_id"), F.coalesce("new_name", "old_name").alias("property_name"), change.alias("change"), conflict.alias("conflict"))


def metadata_problems(filters: DataFrame) -> DataFrame:
    """Repeated values and negative counts among a response's filters: (property_key, kind, value, code)."""
    per = filters.groupBy("property_key", "kind", "value").agg(F.count("*").alias("n"), F.min("count").alias("low"))
    return _exploded(per, ("property_key", "kind", "value"), {"DUPLICATE_VALUE": F.col("n") > 1, "NEGATIVE_COUNT": F.col("low") < 0})


def photo_changes(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """How many URL pairs differ in each component; pairs with an unreadable side are only counted.

    Query keys are compared as sets, and values as lists for each shared key.
    """
    part = lambda c, name: F.coalesce(F.try_parse_url(F.col(c), F.lit(name)), F.lit(""))
    changed = lambda name: part(before, name) != part(after, name)
    pieces = lambda c: F.filter(F.split(part(c, "QUERY"), "&"), lambda x: x != "")
    keys = lambda c: F.array_distinct(F.transform(pieces(c), lambda x: F.substring_index(x, "=", 1)))
    of = lambda c, k: F.filter(pieces(c), lambda x: F.substring_index(x, "=", 1) == k)
    readable = (part(before, "HOST") != "") & (part(after, "HOST") != "")
    bare = lambda c: F.regexp_replace(F.col(c), "[?#].*$", "")
    n = lambda c: F.count_if(readable & c)
    return pairs.agg(
        n(F.lit(True)).alias("parseable"), n(changed("PROTOCOL")).alias("protocol"), n(changed("HOST")).alias("host"), n(changed("PATH")).alias("path"), n(changed("QUERY")).alias("query"), n(changed("REF")).alias("fragment"),
        n(F.array_sort(keys(before)) != F.array_sort(keys(after))).alias("query_keys"),
        n(F.exists(F.array_intersect(keys(before), keys(after)), lambda k: of(before, k) != of(after, k))).alias("query_values"),
        n(bare(before) == bare(after)).alias("same_without_query"), F.count_if(~readable).alias("unparsable"),
    )


def manifest_problems(declared: DataFrame, records: DataFrame) -> DataFrame:
    """Per property the first way in which a manifest's row disagrees with the exported records."""
    found = records.groupBy("property_key").agg(F.count("*").alias("n"), F.min("local_date").alias("first"), F.max("local_date").alias("last"))
    verdict = first_failing(("PROPERTY_NOT_DECLARED", F.col("records").isNull()), ("COUNT_MISMATCH", F.col("records") != F.coalesce("n", F.lit(0))), ("DATE_BOUNDS", ~F.col("earliest").eqNullSafe(F.col("first")) | ~F.col("latest").eqNullSafe(F.col("last"))))
    return declared.join(found, "property_key", "full_outer").select("property_key", "records", F.coalesce("n", F.lit(0)).alias("found"), F.coalesce(verdict, F.lit("OK")).alias("verdict"))


def staged(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pages that come to a run, with what becomes of them: STAGED, REPLAYED (there already, alike) or CONFLICT (there with another content, which fails the run)."""
    keys = ["run_id", "page_offset"]
    known = held.select(*keys, F.col("page_hash").alias("__hash"), F.col("n_cards").alias("__n"))
    outcome = F.when(F.col("__hash").isNull(), "STAGED").when((F.col("__hash") == F.col("page_hash")) & (F.col("__n") == F.col("n_cards")), "REPLAYED").otherwise("CONFLICT")
    return incoming.join(known, keys, "left").withColumn("outcome", outcome).drop("__hash", "__n")


def fail_runs(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """runs (run_id, status, error_code) after failures (run_id, code); ``conflict`` where the run is not there or is already published, and so stays."""
    both = runs.join(failures, "run_id", "full_outer")
    found, asked, done = F.col("status").isNotNull(), F.col("code").isNotNull(), F.col("status") == "succeeded"
    conflict = first_failing(("RUN_NOT_FOUND", ~found), ("RUN_ALREADY_PUBLISHED", asked & done))
    fails = asked & found & ~done
    return both.select("run_id", F.when(fails, "failed").otherwise(F.col("status")).alias("status"), F.when(fails, F.col("code")).otherwise(F.col("error_code")).alias("error_code"), conflict.alias("conflict"))


def rechecked(attested: DataFrame, rows: DataFrame, key: str = "property_key") -> DataFrame:
    """Per property the evidence rebuilt from the staged rows against what was attested (inventory_digest()): the first part that moved, or OK."""
    now = inventory_digest(rows, key)
    then = attested.select(key, F.col("n").alias("__n"), F.col("ids_digest").alias("__ids"), F.col("records_digest").alias("__records"))
    both = now.join(then, key, "full_outer")
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    verdict = first_failing(("ATTESTATION_MISSING", F.col("__n").isNull()), ("COUNT_MOVED", differ("n", "__n")), ("IDENTITIES_MOVED", differ("ids_digest", "__ids")), ("RECORDS_MOVED", differ("records_digest", "__records")))
    return both.select(key, "n", "ids_digest", "records_digest", F.coalesce(verdict, F.lit("OK")).alias("verdict"))
