"""Canonical review rows: from the driver's tables, and from pages of collected JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The zone of the properties, and the day that the queries take as today.
ZONE, AS_OF = "Australia/Sydney", "2024-01-26"

#: Properties in configured order: key, business name, hotel id.
PROPERTIES = (
    ("view", "Harbour View Suites", 101),
    ("click", "Clickford Arms", 102),
    ("purchase", "Market Street Rooms", 103),
    ("signup", "Signal Hill Lodge", 104),
    ("error", "Terror Bay Cottages", 105),
)

#: Texts written for the adapter, because the driver's prose holds no topic words; chosen by event_id.
POSITIVE_TEXTS = (
    None,
    "The room was spotless and the staff were friendly",
    "Great location, close to the station",
    "Quiet at night and good value",
    "n/a",
    "Not clean at all but easy check-in",
    "Fast wifi and hot water",
)
NEGATIVE_TEXTS = (
    None,
    "nothing",
    "The bathroom was dirty and the street noise was loud",
    "Expensive and slow check-in, but not noisy",
    "No lift",
)

CARD = T.StructType([
    T.StructField("reviewUrl", T.StringType()), T.StructField("reviewedDate", T.LongType()), T.StructField("reviewScore", T.DoubleType()),
    T.StructField("helpfulVotesCount", T.LongType()), T.StructField("isApproved", T.BooleanType()), T.StructField("editUrl", T.StringType()),
    T.StructField("textDetails", T.StructType([T.StructField(k, T.StringType()) for k in ("title", "positiveText", "negativeText", "lang")])),
    T.StructField("bookingDetails", T.StructType([T.StructField("customerType", T.StringType()), T.StructField("roomType", T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])), T.StructField("checkinDate", T.StringType()), T.StructField("checkoutDate", T.StringType()), T.StructField("numNights", T.DoubleType())])),
    T.StructField("guestDetails", T.StructType([T.StructField("username", T.StringType()), T.StructField("countryCode", T.StringType()), T.StructField("countryName", T.StringType()), T.StructField("anonymous", T.BooleanType())])),
    T.StructField("partnerReply", T.StructType([T.StructField("reply", T.StringType())])),
    T.StructField("photos", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("urls", T.ArrayType(T.StructType([T.StructField("size", T.StringType()), T.StructField("url", T.StringType())])))]))),
])
#: Keys that a card must have, null or not.
REQUIRED = ("reviewUrl", "reviewedDate", "reviewScore", "textDetails", "bookingDetails", "guestDetails", "partnerReply", "photos", "positiveHighlights", "negativeHighlights", "helpfulVotesCount", "isApproved", "isTranslatable", "editUrl")


def _pick(texts: tuple, index: Column) -> Column:
    return F.get(F.array(*[F.lit(t).cast("string") for t in texts]), index.cast("int"))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review for each event; only the needed columns are read."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("property_key"),
        F.col("event_id").cast("string").alias("token"),
        F.unix_seconds(stamp).alias("epoch"),
        F.to_date(F.from_utc_timestamp(stamp, ZONE)).alias("local_date"),
        F.pmod(F.floor(F.col("value") * 100).cast("long"), F.lit(101)).cast("int").alias("tenths"),
        _pick(POSITIVE_TEXTS, F.col("event_id") % len(POSITIVE_TEXTS)).alias("positive_text"),
        _pick(NEGATIVE_TEXTS, F.col("event_id") % len(NEGATIVE_TEXTS)).alias("negative_text"),
        F.when(F.col("user_id") % 3 == 0, "Thank you").when(F.col("user_id") % 3 == 1, "").alias("partner_reply"),
        _pick(("en", "de", "fr", None), F.col("user_id") % 4).alias("language"),
        _pick(("couple", "solo_traveller", "family with_children"), F.col("user_id") % 3).alias("guest_type"),
        _pick(("Studio", "Queen Room", None, "Family Suite", None), F.col("user_id") % 5).alias("room"),
        F.get_json_object("props", "$.k").cast("long").alias("helpful"),
    )


def properties(spark: SparkSession) -> DataFrame:
    """The property dimension with its order; a handful of rows."""
    return spark.createDataFrame([(i, k, n, h) for i, (k, n, h) in enumerate(PROPERTIES)], "ordinal int, property_key string, property_name string, hotel_id int")


def review_pages(raw: DataFrame, body: str = "body") -> DataFrame:
    """Cards of collected pages, one row each, parsed, with ``violations`` for keys and figures; contract.checked_cards() checks everything.

    ``raw`` has one JSON response per row. A missing key differs from a null
    one, so presence is checked on the text of each card. A body that can't be
    read, or has no cards, is one row with that violation.
    """
    cards = F.from_json(F.get_json_object(body, "$.data.reviewListFrontend.reviewCard"), "array<string>")
    rows = raw.select("*", F.posexplode_outer(cards).alias("card_index", "card_json"))
    rows = rows.withColumn("card", F.from_json("card_json", CARD)).withColumn("__keys", F.json_object_keys("card_json"))
    missing = F.transform(F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce("__keys", F.array().cast("array<string>"))), lambda k: F.concat(F.lit("missing:"), k))
    c = "card"
    checks = [
        ("identity", F.coalesce(F.col(f"{c}.reviewUrl"), F.lit("")) == ""),
        ("epoch", ~F.coalesce(F.col(f"{c}.reviewedDate").between(1, 253402300799), F.lit(False))),
        ("score", ~F.coalesce(F.col(f"{c}.reviewScore").between(0, 10), F.lit(False))),
        ("score_precision", F.abs(F.col(f"{c}.reviewScore") * 10 - F.round(F.col(f"{c}.reviewScore") * 10)) > 1e-9),
        ("votes", F.col(f"{c}.helpfulVotesCount") < 0),
    ]
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    found = F.when(F.col("card_json").isNull(), F.array(F.lit("no_cards"))).otherwise(F.concat(missing, broken))
    return rows.withColumn("violations", found).drop("__keys")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of a JSONL file: the record, or a flag for a blank or unreadable line; reading goes on after either."""
    return parsed_lines(spark.read.text(path), schema)


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Lines (value) as records or flags."""
    blank = F.trim("value") == ""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(F.when(blank, "blank").when(F.col("value").isNotNull() & parsed["_corrupt_record"].isNotNull(), "bad_json").alias("flag"), parsed.alias("record"), "value")


def config_problems(config: DataFrame, selected: tuple[str, ...] = ()) -> DataFrame:
    """(field, value, n): keys, hotel ids and paths that several properties use; keys of invalid properties (field invalid); selected keys that there are not (unknown)."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in ("property_key", "hotel_id", "path")]))
    twice = config.select(fields.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n")).filter("n > 1")
    bad = (F.coalesce(F.trim("property_key"), F.lit("")) == "") | ~F.coalesce(F.col("hotel_id") > 0, F.lit(False)) | ~F.coalesce(F.col("path").startswith("/"), F.lit(False))
    one = F.lit(1).cast("long").alias("n")
    out = twice.unionByName(config.filter(bad).select(F.lit("invalid").alias("field"), F.col("property_key").alias("value"), one))
    if selected:
        wanted = config.sparkSession.createDataFrame([(k,) for k in selected], "property_key string")
        out = out.unionByName(wanted.join(config, "property_key", "left_anti").select(F.lit("unknown").alias("field"), F.col("property_key").alias("value"), one))
    return out


def selected_properties(config: DataFrame, selected: tuple[str, ...] = ()) -> DataFrame:
    """The configured properties, or those that are selected, in the file's order; fails if the configuration has problems."""
    problems = [f"{r['field']} {r['value']}" for r in config_problems(config, selected).collect()]  # of a configuration
    if problems:
        raise ValueError("; ".join(sorted(problems)))
    chosen = config.filter(F.col("property_key").isin(*selected)) if selected else config
    return chosen.orderBy("ordinal")
