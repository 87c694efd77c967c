"""Snapshots, inventories and versioned history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.operators.ranges import numbered

MISSES_TO_TOMBSTONE = 2


def set_parity(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sizes of intersection, union and differences of two key sets, and whether they are equal."""
    a = left.select(*keys).distinct().withColumn("l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("r", F.lit(True))
    both = a.join(b, list(keys), "full_outer").select(F.coalesce("l", F.lit(False)).alias("l"), F.coalesce("r", F.lit(False)).alias("r"))
    out = both.agg(F.count_if(F.col("l") & F.col("r")).alias("shared"), F.count("*").alias("united"), F.count_if(~F.col("r")).alias("left_only"), F.count_if(~F.col("l")).alias("right_only"))
    return out.withColumn("symmetric", F.col("left_only") + F.col("right_only")).withColumn("parity", F.col("symmetric") == 0)


def inventory_parity(oldest: DataFrame, newest: DataFrame, key: str = "property_key", token: str = "token", hashed: str = "record_hash") -> DataFrame:
    """Per property whether two complete passes hold the same identities and the same records."""
    a = oldest.select(key, token, F.col(hashed).alias("a"))
    b = newest.select(key, token, F.col(hashed).alias("b"))
    per = a.join(b, [key, token], "full_outer").groupBy(key).agg(
        F.count_if(F.col("a").isNotNull()).alias("oldest_count"), F.count_if(F.col("b").isNotNull()).alias("newest_count"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("identity_mismatches"), F.count_if(F.col("a") != F.col("b")).alias("record_mismatches"),
    )
    verdict = F.when(F.col("identity_mismatches") > 0, "IDENTITY_MISMATCH").when(F.col("record_mismatches") > 0, "RECORD_MISMATCH").otherwise("OK")
    return per.withColumn("verdict", verdict)


def inventory_digest(rows: DataFrame, key: str = "property_key", token: str = "token", hashed: str = "record_hash", shards: int = 256) -> DataFrame:
    """Digests of the identities and of the records of each property.

    Order does not matter and nothing is gathered whole: rows are digested in
    shards of bounded size by aggregates of their hashes, and the shards'
    results once more. Equal inventories have equal digests at every size.
    """
    number = lambda *c: F.conv(F.substring(F.md5(F.concat_ws("|", *c)), 1, 15), 16, 10).cast("long")  # noqa: E731  60 bits
    ids, records = number(token), number(token, hashed)
    sharded = rows.groupBy(key, (ids % shards).alias("shard")).agg(
        F.count("*").alias("n"), F.bit_xor(ids).alias("ix"), F.sum(ids.cast("decimal(20,0)")).alias("isum"), F.bit_xor(records).alias("rx"), F.sum(records.cast("decimal(20,0)")).alias("rsum"),
    )
    said = lambda *c: F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("shard", *c)))), 256)
    return sharded.groupBy(key).agg(F.sum("n").alias("n"), said("n", "ix", "isum").alias("ids_digest"), said("n", "rx", "rsum").alias("records_digest"))


def compare(previous: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("property_key", "token"), hashed: str = "record_hash") -> DataFrame:
    """Every key of either snapshot as inserted, updated, unchanged or missing; as duplicate if a snapshot holds it twice, which makes the pair no valid one."""
    a = previous.groupBy(*keys).agg(F.min(hashed).alias("before"), F.count("*").alias("__a"))
    b = current.groupBy(*keys).agg(F.min(hashed).alias("after"), F.count("*").alias("__b"))
    change = (
        F.when((F.col("__a") > 1) | (F.col("__b") > 1), "duplicate").when(F.col("__a").isNull(), "inserted").when(F.col("__b").isNull(), "missing")
        .when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("updated")
    )
    return a.join(b, list(keys), "full_outer").withColumn("change", change).drop("__a", "__b")


def reconcile(pages: DataFrame, reported: DataFrame, key: str = "property_key") -> DataFrame:
    """Per property: unique reviews, repeats across pages, and the first rule that the pages break.

    A token twice on one page, or with two records, is an error; the same
    record on two pages counts as a repeat; the unique tokens must be as many
    as reported.
    """
    twice = pages.groupBy(key, "page", "token").agg(F.count("*").alias("n")).groupBy(key, "token").agg(F.max("n").alias("in_page"))
    tokens = pages.groupBy(key, "token").agg(F.count("*").alias("seen"), F.count_distinct("record_hash").alias("records"))
    per = tokens.join(twice, [key, "token"]).groupBy(key).agg(F.count("*").alias("unique"), (F.sum("seen") - F.count("*")).alias("repeats"), F.max("in_page").alias("in_page"), F.max("records").alias("records"))
    out = reported.join(per, key, "left")
    verdict = F.when(F.col("in_page") > 1, "DUPLICATE_IN_PAGE").when(F.col("records") > 1, "RECORD_CHANGED").when(F.coalesce("unique", F.lit(0)) != F.col("reported"), "COUNT_MISMATCH").otherwise("OK")
    return out.select(key, "reported", F.coalesce("unique", F.lit(0)).alias("unique_reviews"), F.coalesce("repeats", F.lit(0)).alias("repeats"), verdict.alias("verdict"))


def dense_offsets(pages: DataFrame, size: int = 10) -> DataFrame:
    """Pages of a phase whose offset is not the next multiple of the page size."""
    rows = numbered(pages, ("property_key", "phase"), ("page_offset",), "expected_offset")
    return rows.withColumn("expected_offset", F.col("expected_offset") * size).filter(F.col("page_offset") != F.col("expected_offset"))


def repeated_pages(pages: DataFrame) -> DataFrame:
    """Pages that bring the same reviews as an earlier page of their phase."""
    first = F.min("page_offset").over(Window.partitionBy("property_key", "phase", "page_hash"))
    return pages.withColumn("first_offset", first).filter(F.col("page_offset") > F.col("first_offset"))


KEYS = ("property_key", "token")
STATE = ("version", "presence", "misses", "suspect_since", "tombstoned_at", "reactivations", "last_seen_run")


def promote(state: DataFrame | None, staged: DataFrame, run_id: int, complete: bool = True, content: tuple[str, ...] = ("tenths",), tasks: int | None = None) -> DataFrame:
    """The next generation of the current versions, from the last one and a staged run.

    Seen reviews are present again, with a new version if their record changed.
    After a complete run, unseen ones are suspect, and tombstones at the second
    miss in a row; the first time of either state stays. Incremental runs never
    infer absence. ``change`` tells what happened to each row, ``was`` how it
    stood before if that differs; ``content`` names the columns of a record that
    its version carries. ``tasks`` is the number of parts by key in which they
    meet (see ranges.parts()); ``staged`` numbers the rows of an identity in the
    run, in the same parts and order: null if it was not seen, 2 if it came twice.
    """
    dealt = lambda df: df.repartition(tasks, *KEYS) if tasks else df
    again = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.lit(0)))
    s = dealt(staged.select(*KEYS, F.struct("record_hash", *content).alias("new"))).withColumn("staged", again)
    if state is None:
        fields = ", ".join(f"`{c}` {staged.schema[c].dataType.simpleString()}" for c in (*KEYS, "record_hash", *content))
        state = s.sparkSession.createDataFrame([], f"{fields}, version int, presence string, misses int, suspect_since int, tombstoned_at int, reactivations int, last_seen_run int")
    both = dealt(state.select(*KEYS, "record_hash", *content, *STATE)).join(s, list(KEYS), "full_outer")
    seen, old = F.col("new").isNotNull(), F.col("version").isNotNull()
    changed = old & seen & ~F.col("record_hash").eqNullSafe(F.col("new.record_hash"))
    missed = ~seen & F.lit(complete)
    misses = F.when(seen, 0).when(missed, F.col("misses") + 1).otherwise(F.col("misses"))
    presence = F.when(seen, "present").when(missed & (misses >= MISSES_TO_TOMBSTONE), "tombstoned").when(missed, "suspect_missing").otherwise(F.col("presence"))
    since = lambda name, now: F.when(seen, F.lit(None).cast("int")).when(missed & (presence == now), F.coalesce(name, F.lit(run_id))).otherwise(F.col(name))
    change = (
        F.when(~old, "inserted").when(seen & (F.col("presence") != "present"), F.when(changed, "reactivated_updated").otherwise("reactivated"))
        .when(changed, "updated").when(seen, "unchanged").when(missed & (presence != F.col("presence")), presence).otherwise("kept")
    )
    return both.select(
        *KEYS, *[F.when(seen, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("record_hash", *content)],
        F.when(~old, 1).otherwise(F.col("version") + changed.cast("int")).alias("version"),
        presence.alias("presence"), misses.alias("misses"), since("suspect_since", "suspect_missing").alias("suspect_since"), since("tombstoned_at", "tombstoned").alias("tombstoned_at"),
        (F.coalesce("reactivations", F.lit(0)) + (seen & old & (F.col("presence") != "present")).cast("int")).alias("reactivations"),
        F.when(seen, run_id).otherwise(F.col("last_seen_run")).alias("last_seen_run"), change.alias("change"),
        F.when(changed | (presence != F.col("presence")), F.struct("presence", "record_hash", *content)).alias("was"), "staged",
    )


def publish(generation: DataFrame, root: str, number: int) -> str:
    """Writes a generation beside its predecessors and then points to it; readers never see half of one.

    The pointer is a one-row table, overwritten after the data are complete.
    """
    spark = generation.sparkSession
    path = f"{root.rstrip('/')}/gen={number:08d}"
    generation.write.mode("errorifexists").partitionBy("property_key").parquet(path)
    spark.createDataFrame([(number, path)], "generation int, path string").coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/pointer")
    return path


def published(spark, root: str) -> DataFrame:
    """The generation that the newest pointer names."""
    row = spark.read.parquet(f"{root.rstrip('/')}/pointer").orderBy(F.desc("generation")).first()
    return spark.read.parquet(row["path"])


def invariants(generation: DataFrame, tasks: int | None = None) -> DataFrame:
    """Violations of a generation: keys held twice, and states that do not fit their misses. ``tasks`` as for promote()."""
    keyed = generation.select(*KEYS).repartition(tasks, *KEYS) if tasks else generation
    twice = keyed.groupBy("property_key", "token").agg(F.count("*").alias("n")).filter("n > 1").select("property_key", "token", F.lit("TWO_CURRENT").alias("violation"))
    fits = F.when(F.col("presence") == "present", F.col("misses") == 0).when(F.col("presence") == "suspect_missing", F.col("misses") == 1).otherwise(F.col("misses") >= MISSES_TO_TOMBSTONE)
    return twice.unionByName(generation.filter(~fits).select("property_key", "token", F.lit("STATE_MISSES").alias("violation")))


def content_hash(*columns: Column) -> Column:
    """A hash of what may change in a review; equal content under two tokens stays two reviews."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def stop_incremental(pages: DataFrame, horizon_epoch: int) -> DataFrame:
    """Where an incremental pass may stop: the second page in a row that is all known and all older than the horizon."""
    w = Window.partitionBy("property_key").orderBy("page_offset")
    calm = F.col("all_known") & (F.col("newest_epoch") < horizon_epoch)
    two = pages.withColumn("stop", calm & F.coalesce(F.lag(calm).over(w), F.lit(False)))
    return two.filter("stop").groupBy("property_key").agg(F.min("page_offset").alias("stop_offset"))
