"""Safe export records, their audit, and structural differences of records."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.functions import variants as V
from reviewlake.functions.periods import utc_text
from reviewlake.functions.scalars import canonical_photo, humanized, public_id
from reviewlake.sources.contract import nights

#: The columns of a CSV export, in order.
CSV_COLUMNS = ("property_key", "property_name", "hotel_id", "review_id", "local_date", "score", "positive_text", "negative_text", "language", "partner_reply", "helpful", "room", "guest_type")
#: Keys whose values are secret, as letters and digits in lower case, beside those that end so; keys of a review's own words; secret query keys.
SECRET_KEYS = frozenset("authorization proxyauthorization cookie cookies cookieheader cookiejar setcookie setcookieheaders xbookingcsrftoken xbookingpageviewid xbookingetserializedstate csrftoken bcsrftoken pageviewid serializedstate password passwd clientsecret secret apikey accesskey accesstoken refreshtoken idtoken sessionid sid sourcereviewtoken sourcekey reviewurl editurl username avatarurl".split())
SECRET_ENDS = ("password", "secret", "token")
WORD_KEYS = frozenset("title positivetext negativetext combinedtext reply partnerreply sourcecard html".split())
QUERY_KEYS = frozenset("sid label aid srpvid srepoch session sessionid token csrf csrf_token auth authorization apikey api_key key password".split())
#: Keys that besides these must not be in an export.
UNEXPORTED = frozenset("email phone session csrf rawcardjson".split())


def _plain_key(key: str) -> str:
    return re.sub("[^a-z0-9]", "", key.lower())


def is_secret(key: str) -> bool:
    return _plain_key(key) in SECRET_KEYS or _plain_key(key).endswith(SECRET_ENDS)


def safe_records(reviews: DataFrame, properties: DataFrame) -> DataFrame:
    """Reviews as they may leave: a public id for the token, no raw fields."""
    named = reviews.join(F.broadcast(properties), "property_key")
    return named.select("property_key", "property_name", "hotel_id", public_id(F.col("property_key"), F.col("token")).alias("review_id"), "epoch", "row_id", "local_date", (F.col("tenths") / 10).alias("score"), "positive_text", "negative_text", "language", "partner_reply", "helpful", "room", "guest_type")


def sample(records: DataFrame, each: int | None) -> DataFrame:
    """The first ``each`` records of every property, newest first; all without a number."""
    if each is None:
        return records
    place = F.row_number().over(Window.partitionBy("property_key").orderBy(F.desc("epoch"), "row_id"))
    return records.withColumn("__n", place).filter(F.col("__n") <= each).drop("__n")


def _cell(c: str, kind: str) -> Column:
    text = F.date_format(c, "yyyy-MM-dd") if kind == "date" else F.to_json(F.col(c)) if kind.startswith(("struct", "array", "map")) else F.col(c).cast("string")
    return F.coalesce(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def csv_lines(records: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS) -> DataFrame:
    """A line for each record: every value quoted, null as nothing, objects as JSON."""
    kinds = dict(records.dtypes)
    return records.select(F.concat_ws(",", *[_cell(c, kinds[c]) for c in columns]).alias("line"))


def write_csv(records: DataFrame, path: str, columns: tuple[str, ...] = CSV_COLUMNS) -> None:
    """Text files of lines, with the header in a file of its own that sorts first."""
    csv_lines(records, columns).write.text(f"{path}/rows")
    records.sparkSession.createDataFrame([(",".join(columns),)], "value string").coalesce(1).write.text(f"{path}/header")


#: The columns of a flat export, in order; those of nested fields by their paths in a full record.
FLAT_COLUMNS = ("propertyKey", "propertyName", "bookingHotelId", "reviewId", "reviewedLocalDate", "score", "title", "positiveText", "negativeText", "sourceLanguage", "partnerReply", "helpfulVotesCount", "roomName", "customerType", "numNights", "guestCountry", "guestType")
NESTED = {"roomName": "bookingDetails.roomType.name", "customerType": "bookingDetails.customerType", "numNights": "bookingDetails.numNights", "guestCountry": "guestDetails.countryName", "guestType": "guestDetails.guestTypeTranslation"}


def full_records(reviews: DataFrame, properties: DataFrame) -> DataFrame:
    """The 21 fields of a record as it may leave, in order, and its base order (epoch, row_id).

    Expects the canonical columns, and card_json: booking, guest, photos,
    highlights and flags come from it; a guest or booking that is null there
    stays null, and of a guest seven fields are kept. No token, edit or avatar
    URL leaves. A field that the source lacks is null.
    """
    # The dimension goes to the reviews: by its few keys these would meet in as many tasks.
    r = reviews.join(F.broadcast(properties.select("property_key", "property_name", "hotel_id")), "property_key").withColumn("__card", F.try_parse_json("card_json"))
    v = F.col("__card")
    # Each part is read at once by its type, which makes null of what is no object or list: a let() or a kind for each value would cost most of a record's time.
    r = r.withColumn("__stay", V.at(v, "bookingDetails", "struct<customerType: string, checkinDate: string, checkoutDate: string, stayStatus: string, roomType: struct<id: string, name: string>, numNights: variant>"))
    stay = F.when(F.col("__stay").isNotNull(), F.struct(*[f"__stay.{k}" for k in ("customerType", "checkinDate", "checkoutDate", "stayStatus", "roomType")], nights(F.col("__stay.numNights")).alias("numNights")))
    guest = V.at(v, "guestDetails", "struct<username: string, countryCode: string, countryName: string, anonymous: boolean, guestTypeTranslation: string, joinedDate: bigint, userReviewCount: bigint>")
    # An element that is no object has no values.
    listed = lambda x, made: F.transform(F.coalesce(x, F.array()), made)
    photos = listed(V.at(v, "photos", "array<struct<id: string, kind: string, urls: array<struct<size: string, url: string>>>>"), lambda p: F.struct(p["id"].alias("id"), p["kind"].alias("kind"), listed(p["urls"], lambda u: F.struct(u["size"].alias("size"), canonical_photo(u["url"]).alias("url"))).alias("urls")))
    marks = lambda k: listed(V.at(v, k, "array<struct<start: bigint, end: bigint>>"), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))
    return r.select(
        F.col("property_key").alias("propertyKey"), F.col("property_name").alias("propertyName"), F.col("hotel_id").alias("bookingHotelId"), public_id(F.col("property_key"), F.col("token")).alias("reviewId"),
        F.col("epoch").alias("reviewedEpoch"), utc_text(F.col("epoch")).alias("reviewedAtUtc"), F.col("local_date").alias("reviewedLocalDate"), (F.col("tenths") / 10).alias("score"), F.try_variant_get(v, "$.textDetails.title", "string").alias("title"),
        F.col("positive_text").alias("positiveText"), F.col("negative_text").alias("negativeText"), F.col("language").alias("sourceLanguage"), F.col("partner_reply").alias("partnerReply"), F.col("helpful").alias("helpfulVotesCount"),
        stay.alias("bookingDetails"), guest.alias("guestDetails"),
        photos.alias("photos"), F.struct(marks("positiveHighlights").alias("positive"), marks("negativeHighlights").alias("negative")).alias("highlights"),
        F.try_variant_get(v, "$.textDetails.textTrivialFlag", "long").alias("textTrivialFlag"), F.try_variant_get(v, "$.isApproved", "boolean").alias("isApproved"), F.try_variant_get(v, "$.isTranslatable", "boolean").alias("isTranslatable"),
        "epoch", "row_id",
    )


def json_records(records: DataFrame) -> DataFrame:
    """A JSON line for each full record, nulls written out."""
    return records.select(F.to_json(F.struct(*[c for c in records.columns if c not in ("epoch", "row_id")]), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(records: DataFrame, path: str) -> None:
    """JSON lines in order of property and base order; Spark's committer shows the files only when all are written."""
    json_records(records.orderBy("propertyKey", F.desc("epoch"), "row_id")).write.mode("overwrite").text(path)


def flat_lines(records: DataFrame) -> DataFrame:
    """The 17 columns of full records as CSV lines."""
    return csv_lines(records.select(*[F.col(NESTED.get(c, c)).alias(c) for c in FLAT_COLUMNS]), FLAT_COLUMNS)


def manifest(records: DataFrame) -> DataFrame:
    """Counts and means per property, for the export's manifest."""
    return records.groupBy("property_key", "property_name", "hotel_id").agg(F.count("*").alias("records"), F.avg("score").alias("average"), F.min("local_date").alias("earliest"), F.max("local_date").alias("latest"))


def audited(records: DataFrame, properties: DataFrame, zone: str) -> DataFrame:
    """Records with their issues and the uses they are fit for.

    Of records with one id the first is valid. Weekly use needs identity, id,
    score and date; property use identity and score; the feed all of them and
    a text field of the right type.
    """
    known = properties.select("property_key", F.col("property_name").alias("__name"), F.col("hotel_id").alias("__hotel"))
    r = records.join(F.broadcast(known), "property_key", "left")
    first = F.row_number().over(Window.partitionBy("review_id").orderBy("row_id")) == 1
    checks = {
        "PROPERTY_IDENTITY_MISMATCH": ~F.coalesce((F.col("property_name") == F.col("__name")) & (F.col("hotel_id") == F.col("__hotel")), F.lit(False)),
        "REVIEW_ID_INVALID": ~F.coalesce(F.col("review_id").rlike("^[0-9a-f]{24}$"), F.lit(False)),
        "REVIEW_ID_DUPLICATE": ~first,
        "SCORE_INVALID": ~F.coalesce(F.col("score").between(0, 10) & (F.abs(F.col("score") * 10 - F.round(F.col("score") * 10)) <= 1e-9), F.lit(False)),
        "LOCAL_DATE_MISMATCH": ~F.coalesce(F.to_date(F.from_utc_timestamp(F.timestamp_seconds("epoch"), zone)) == F.col("local_date"), F.lit(False)),
        "VOTES_INVALID": F.coalesce(F.col("helpful") < 0, F.lit(False)),
    }
    r = r.withColumn("issues", F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks.items()])))
    none = lambda *codes: ~F.arrays_overlap("issues", F.array(*map(F.lit, codes)))
    weekly = none("PROPERTY_IDENTITY_MISMATCH", "REVIEW_ID_INVALID", "REVIEW_ID_DUPLICATE", "SCORE_INVALID", "LOCAL_DATE_MISMATCH")
    return r.withColumns({"weekly_ready": weekly, "property_ready": none("PROPERTY_IDENTITY_MISMATCH", "SCORE_INVALID"), "feed_ready": weekly & none("VOTES_INVALID")}).drop("__name", "__hotel")


def issue_counts(records: DataFrame) -> DataFrame:
    return records.select(F.explode("issues").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def readiness(records: DataFrame) -> DataFrame:
    return records.groupBy("property_key").agg(F.count("*").alias("records"), *[F.count_if(F.col(f"{u}_ready")).alias(f"{u}_ready") for u in ("weekly", "property", "feed")])


def averages_recheck(records: DataFrame, declared: DataFrame) -> DataFrame:
    """Properties whose declared mean differs from the records' by more than rounding."""
    found = records.groupBy("property_key").agg(F.avg("score").alias("average"))
    return declared.join(found, "property_key", "left").filter(F.coalesce(F.abs(F.col("average") - F.col("declared")) > 1e-9, F.lit(True)))


def _walk(a, b, path: str, depth: int) -> Iterator[str]:
    kind = lambda x: "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "null" if x is None else type(x).__name__
    if depth > 8:
        return
    if kind(a) != kind(b):
        yield f"{path}:kind"
    elif isinstance(a, dict):
        for k in sorted({*a, *b}):
            at = f"{path}.{k}" if path else k
            if k not in a or k not in b:
                yield f"{at}:{'added' if k in b else 'removed'}"
            else:
                yield from _walk(a[k], b[k], at, depth + 1)
    elif isinstance(a, list):
        if len(a) != len(b):
            yield f"{path}:length"
        for x, y in zip(a, b):
            yield from _walk(x, y, f"{path}[]", depth + 1)
    elif a != b:
        yield f"{path}:value"


@F.pandas_udf(T.ArrayType(T.StringType()))
def changed_paths(before: pd.Series, after: pd.Series) -> pd.Series:
    """Paths at which two JSON records differ; arrays by position, eight levels deep at most; null unless both can be read."""

    def one(a, b):
        try:
            return sorted(set(_walk(json.loads(a), json.loads(b), "", 0)))
        except (TypeError, ValueError):
            return None

    return pd.Series([one(a, b) for a, b in zip(before, after)])


def diff_report(pairs: DataFrame, before: str = "before", after: str = "after", most: int = 64) -> DataFrame:
    """The most frequent differing paths."""
    return pairs.select(F.explode(changed_paths(F.col(before), F.col(after))).alias("path")).groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(most)


@F.pandas_udf(T.ArrayType(T.StringType()))
def sensitive_paths(records: pd.Series) -> pd.Series:
    """Paths of keys that must not leave, at any depth; also of URLs with such a query key."""

    def walk(x, path: str) -> Iterator[str]:
        if isinstance(x, dict):
            for k, v in x.items():
                at = f"{path}.{k}" if path else k
                if is_secret(k) or _plain_key(k) in UNEXPORTED:
                    yield at
                yield from walk(v, at)
        elif isinstance(x, list):
            for v in x:
                yield from walk(v, f"{path}[]")
        elif isinstance(x, str) and any(k.lower() in QUERY_KEYS for k in re.findall(r"[?&]([^=&#]+)=", x)):
            yield f"{path}:url"

    def one(text):
        try:
            return sorted(set(walk(json.loads(text), "")))
        except (TypeError, ValueError, RecursionError):
            return None

    return pd.Series([one(t) for t in records])


MASK, TOO_DEEP, DEEPEST = "[REDACTED]", "[MaxDepth]", 20


#: Headers that are masked in running text.
HEADERS = re.compile(r"\b(authorization|proxy-authorization|cookie|set-cookie|x-booking-csrf-token|x-booking-pageview-id|x-booking-et-serialized-state)\s*[:=]\s*[^\r\n]+", re.I)
_QUERY = re.compile(r"([?&])([^=&#\s]+)=([^&#\s]*)")


def _masked_text(text: str) -> str:
    shown = _QUERY.sub(lambda m: f"{m[1]}{m[2]}={MASK}" if m[2].lower() in QUERY_KEYS else m[0], text)
    return HEADERS.sub(lambda m: f"{m[1]}: {MASK}", shown)


def _masked(x, depth: int = 0):
    if isinstance(x, (dict, list)) and depth >= DEEPEST:
        return TOO_DEEP
    if isinstance(x, dict):
        return {k: MASK if is_secret(k) or _plain_key(k) in WORD_KEYS else _masked(v, depth + 1) for k, v in x.items()}
    if isinstance(x, list):
        return [_masked(v, depth + 1) for v in x]
    return _masked_text(x) if isinstance(x, str) else x


@F.pandas_udf(T.StringType())
def redacted_json(records: pd.Series) -> pd.Series:
    """JSON with the values of secret keys and a review's words masked at any depth, also secrets in URLs and headers; what can't be read is masked whole."""

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(_masked(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return MASK

    return pd.Series([one(t) for t in records])


def category_pivot(scores: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Properties by category; a missing score stays null, and of repeated categories the last wins. Categories that are not ``known`` keep their scores in a map, ``other``."""
    last = scores.groupBy("property_key", "category").agg(F.max_by("score", "place").alias("score"))
    listed = [F.max(F.when(F.col("category") == c, F.col("score"))).alias(c) for c in known]
    rest = F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(F.when(~F.col("category").isin(*known), F.struct("category", "score"))))))
    return last.groupBy("property_key").agg(*listed, rest.alias("other"))


def category_scores(value: Column) -> Column:
    """A JSON list of category scores as structs: those with a number, named by their translation, else their name in words, else "Category"."""
    rows = F.filter(V.items(F.try_parse_json(value)), lambda x: V.number(V.at(x, "value")).isNotNull())
    named = lambda x, k: F.when(F.trim(V.text(V.at(x, k))) != "", V.text(V.at(x, k)))
    return F.transform(rows, lambda x: F.struct(F.coalesce(named(x, "translation"), humanized(named(x, "name")), F.lit("Category")).alias("name"), V.number(V.at(x, "value")).alias("score")))


#: The lines of a job's log that tell something.
PROGRESS = {
    "started": r"^\[[^\]]+\]\s+(?:full|canary):\s+(\S+)$",
    "progress": r"^\[[^\]]+\]\s+progress:\s+(\S+)\s+(oldest-first|newest-first)\s+(\d+)/(\d+)(?:\s+verified)?$",
    "head": r"^\[[^\]]+\]\s+progress:\s+(\S+)\s+final head verified\s+\((\d+) cards\)$",
    "passed": r"^\[[^\]]+\]\s+passed:\s+(\S+)\s+\((\d+) reviews\)$",
    "failed": r"^\[[^\]]+\]\s+failed:\s+(\S+):\s+(\S+)\s*(.*)$",
}


def backoff_ms(attempt: int, base: int = 500, most: int = 30_000, jitter: float = 0.0) -> int:
    """Capped exponential delay before the next attempt, with jitter as a share of it."""
    return math.floor(min(most, base * 2**attempt) * (1 + jitter))


#: Failures that end a collection at once, the one of which so many in a row do, and those that are tried again.
IMMEDIATE, CAPTURE_TIMEOUT, TIMEOUTS = ("RATE_LIMITED", "ACCESS_DENIED", "CHALLENGE", "CHALLENGE_TIMEOUT", "REVIEW_HTTP_ERROR"), "REVIEW_CAPTURE_TIMEOUT", 2
RETRYABLE = ("timeout", "network_error", "temporary_server_error")


def circuit(events: DataFrame) -> DataFrame:
    """Failure codes of runs (run_id, place, code) with the run's capture timeouts in a row so far, and whether collection stops there."""
    w = Window.partitionBy("run_id").orderBy("place")
    timeout = F.coalesce(F.col("code") == CAPTURE_TIMEOUT, F.lit(False))
    rows = events.withColumn("__reset", F.sum((~timeout).cast("int")).over(w))
    row = F.sum(timeout.cast("int")).over(Window.partitionBy("run_id", "__reset").orderBy("place"))
    rows = rows.withColumn("timeouts", row)
    return rows.withColumn("open", F.coalesce(F.col("code").isin(*IMMEDIATE), F.lit(False)) | timeout & (F.col("timeouts") >= TIMEOUTS)).drop("__reset")


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds of a Retry-After header: whole seconds, or an HTTP date against ``now`` (a timestamp); null if it is neither."""
    said = F.trim(value)
    seconds = F.when(said.rlike("^[0-9]{1,13}$"), said.cast("long") * 1000)
    date = F.try_to_timestamp(F.regexp_replace(said, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(seconds, F.when(date.isNotNull(), F.greatest(F.lit(0).cast("long"), F.unix_millis(date) - F.unix_millis(now))))


def backoff_column(attempt: Column, sample: Column, base: int = 500, most: int = 30_000, jitter: float = 0.2) -> Column:
    """Milliseconds before the next attempt (from 1): capped doubling, spread by the jitter to both sides as ``sample`` (0 to 1) says."""
    delay = F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(52))))
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(most)), delay * (1 - jitter + 2 * jitter * sample))) + 0.5).cast("long")


def retry_decisions(failures: DataFrame, most_attempts: int = 3) -> DataFrame:
    """failures (kind, attempt, retry_after, now, sample) with retry, delay_ms, reschedule_ms and reason."""
    limited, again = F.col("kind") == "rate_limited", F.coalesce(F.col("kind").isin(*RETRYABLE), F.lit(False))
    reason = F.when(limited, "rate_limited").when(~again, "not_retryable").when(F.col("attempt") >= most_attempts, "attempt_budget_exhausted").otherwise("temporary_failure")
    retry = F.col("reason") == "temporary_failure"
    return failures.withColumn("reason", reason).withColumns({"retry": retry, "delay_ms": F.when(retry, backoff_column(F.col("attempt"), F.col("sample"))), "reschedule_ms": F.when(F.col("reason") == "rate_limited", retry_after_ms(F.col("retry_after"), F.col("now")))})


def progress(log: DataFrame) -> DataFrame:
    """The state of each job's properties after its log lines (job, line_no, line).

    Five kinds of lines tell something; of each column the last line that sets it counts.
    """
    line = F.trim("line")
    got = lambda k, g: F.nullif(F.regexp_extract(line, PROGRESS[k], g), F.lit(""))
    is_ = {k: line.rlike(p) for k, p in PROGRESS.items()}
    of = F.coalesce(*[got(k, 1) for k in PROGRESS])
    rows = log.withColumns({
        "property_key": of,
        "state": F.when(is_["started"] | is_["progress"], "collecting").when(is_["passed"], "published").when(is_["failed"], "failed"),
        "pass": F.when(is_["progress"], got("progress", 2)).when(is_["head"], "verifying").when(is_["passed"] | is_["failed"], ""),
        "processed": F.coalesce(got("progress", 3), got("passed", 2)).cast("long"), "expected": got("progress", 4).cast("long"), "reviews": got("passed", 2).cast("long"),
        "error_code": got("failed", 2), "error": F.coalesce(got("failed", 3), got("failed", 2)),
    }).filter(F.col("property_key").isNotNull())
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    return rows.groupBy("job", "property_key").agg(last("state").alias("state"), F.nullif(last("pass"), F.lit("")).alias("pass"), *[last(c).alias(c) for c in ("processed", "expected", "reviews", "error_code", "error")])
