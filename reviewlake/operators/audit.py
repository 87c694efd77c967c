"""Audit of a finished export: its JSON lines and its manifest, against the configured properties."""

from __future__ import annotations

import functools
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import variants as V
from reviewlake.functions.periods import local_date, utc_text
from reviewlake.functions.scalars import PHOTO_HOST
from reviewlake.operators.gaps import BUCKETS, tolerance
from reviewlake.operators.ranges import settled

#: The keys of a manifest, of its properties and of a record.
MANIFEST_KEYS = tuple("generatedAt mode samplePerProperty strictAll requestedPropertyCount omittedPropertyKeys properties totalRecords".split())
PROPERTY_KEYS = tuple("propertyKey bookingHotelId publishedRunId publicationGeneration parserVersion totalPublishedReviews exportedReviews currentAverageScore authoritativeFullPublication advertisedReviews retrievableReviews sourceReviewGap sourceDiscrepancyKind sourceDiscrepancyScoreBucket advertisedBucketReviews retrievableBucketReviews".split())
RECORD_KEYS = tuple("propertyKey propertyName bookingHotelId reviewId reviewedEpoch reviewedAtUtc reviewedLocalDate score title positiveText negativeText sourceLanguage partnerReply helpfulVotesCount bookingDetails guestDetails photos highlights textTrivialFlag isApproved isTranslatable".split())
#: Keys that must not leave, in lower case without signs; query keys that carry a session; endings of keys that hold URLs.
FORBIDDEN = tuple("sourcereviewtoken sourcereviewurl reviewurl editurl avatarurl cookie cookies setcookie authorization proxyauthorization session sessionid sessiondata csrf csrftoken xsrf xsrftoken token accesstoken refreshtoken idtoken bearertoken requestheaders responseheaders".split())
SESSION_KEYS = "aid|label|sid|session|sessionid|token|auth|authorization|csrf|xsrf|affiliate|affiliate_id|gclid"
#: The parser, and the kinds of gap that a manifest may name.
PARSER, SOURCE_GAP, VISIBLE_GAP = "2.4.0", "source_gap", "visible_count_gap"

# Possessive: a string ends at one place only, and none is too long for the matcher's stack.
_STRING = r'"((?:[^"\\]++|\\.)*+)"'


def _normal(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def plain_json(text: Column) -> Column:
    """JSON without needless escapes, so that its keys and URLs stand as they are meant; what can't be read stays."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def forbidden_keys(text: Column) -> Column:
    """Whether a JSON text has a key, at any depth, that must not leave: all its strings are taken in turn, those before a colon are keys."""
    return _forbidden_keys(plain_json(text))


def _forbidden_keys(plain: Column) -> Column:
    strings = F.filter(F.regexp_extract_all(plain, F.lit(_STRING + r"\s*:?"), F.lit(0)), lambda x: x.endswith(":"))
    return F.exists(strings, lambda x: _normal(x).isin(*FORBIDDEN))


def session_urls(text: Column) -> Column:
    """Whether a URL under a key that names one has credentials or a session in its query; also in a list of URLs."""
    return _session_urls(plain_json(text))


def _session_urls(plain: Column) -> Column:
    pairs = F.regexp_extract_all(plain, F.lit(_STRING + r"\s*:\s*(?:" + _STRING + r"|\[[^\[\]{}]*\])"), F.lit(0))
    named = F.filter(pairs, lambda p: _normal(F.regexp_extract(p, "^" + _STRING, 1)).rlike("(?:url|uri|href|link)$"))
    return F.exists(named, lambda p: p.rlike(r'"[a-zA-Z][a-zA-Z0-9+.-]*://[^"/?#]*@') | p.rlike(rf'(?i)"[a-z][a-z0-9+.-]*://[^"#]*[?&](?:{SESSION_KEYS})(?:=|&|#|")'))


_ISSUES = "array<struct<code: string, field: string>>"


def _issue(code: str, at: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(at).alias("field"))


def _issues(pairs: list[tuple[str, str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), _issue(code, at)) for code, at, ok in pairs]))


def parse_issues(lines: DataFrame) -> DataFrame:
    """(code, field) for blank and unreadable lines."""
    code = F.when(F.col("value") == "", "JSONL_BLANK_LINE").when(F.try_parse_json("value").isNull(), "JSONL_INVALID_JSON")
    return lines.select(code.alias("code"), F.lit("jsonl").alias("field")).filter(F.col("code").isNotNull())


@functools.lru_cache(maxsize=1_000)
def _keys(keys: tuple[str, ...]) -> tuple[bool, frozenset[str]]:
    """Whether any of an object's keys must not leave, and those that name a URL; most objects have the keys of one before."""
    plain = {k: re.sub("[^a-z0-9]", "", k.lower()) for k in keys}
    return any(p in FORBIDDEN for p in plain.values()), frozenset(k for k, p in plain.items() if p.endswith(("url", "uri", "href", "link")))


def _sensitive(x) -> tuple[bool, bool]:
    """Whether a JSON value has a key, at any depth, that must not leave, and a URL with credentials or a session under a key that names one; lists belong to their key."""
    forbidden = session = False
    left = [(x, False)]
    while left:
        x, named = left.pop()
        kind = type(x)
        if kind is dict:
            bad, urls = _keys(tuple(x))
            forbidden |= bad
            left.extend([(v, k in urls) for k, v in x.items() if (t := type(v)) is dict or t is list or (t is str and k in urls)])
        elif kind is list:
            left.extend([(v, named) for v in x])
        elif named and kind is str and _SESSION_URL.match(x):
            session = True
    return forbidden, session


# Numbers of either kind are one, as in JSON.
_DECODER = json.JSONDecoder(parse_int=float)
_SESSION_URL = re.compile(rf"[a-z][a-z0-9+.-]*://(?:[^/?#]*@|[^#]*[?&](?:{SESSION_KEYS})(?:[=&#]|\Z))", re.I | re.A)
_OWN_PHOTO = re.compile(rf"https://{re.escape(PHOTO_HOST)}(?::[0-9]+)?(?:[/?#]|$)")
#: The kinds of a record's fields that the feed shows, besides null, in order.
_FEED_KINDS = {k: str for k in ("title", "positiveText", "negativeText", "sourceLanguage", "partnerReply")} | {"helpfulVotesCount": float, "bookingDetails": dict, "guestDetails": dict, "highlights": dict, "textTrivialFlag": float, "isApproved": bool, "isTranslatable": bool}
#: What _read() returns.
_READ = "is_object boolean, exact boolean, forbidden boolean, session boolean, property_key string, name string, hotel double, text_id string, score double, epoch long, day string, utc string, content array<string>, photos array<string>"


def _is_count(x) -> bool:
    return type(x) is float and 0 <= x <= V.MOST_SAFE and x.is_integer()


def _text(x) -> str | None:
    """A text as Spark has it, where half a surrogate pair is a question mark."""
    return None if type(x) is not str else x if x.isascii() else x.encode("utf-8", "replace").decode()


def _feed_faults(x: dict) -> list[str]:
    """Fields of a record that the feed can't show."""

    def holds(k: str, kind: type) -> bool:
        v = x.get(k)
        if k == "highlights":
            return type(v) is dict and type(v.get("positive")) is list and type(v.get("negative")) is list
        return v is None or (_is_count(v) if kind is float else type(v) is kind)

    return [f"record.{k}" for k, kind in _FEED_KINDS.items() if not holds(k, kind)]


def _photo_faults(photos) -> list[str]:
    """A field for each photo or URL that is not canonical."""
    if type(photos) is not list:
        return ["record.photos"]
    out = []
    for p in photos:
        urls = p.get("urls") if type(p) is dict else None
        if type(urls) is not list:
            out.append("record.photos")
            continue
        shown = (u.get("url") if type(u) is dict else None for u in urls)
        out.extend("record.photos[].urls[].url" for u in shown if type(u) is not str or not _OWN_PHOTO.match(u))
    return out


def _read_one(line: str | None) -> tuple:
    x = None if line is None else _DECODER.raw_decode(line.lstrip())[0]
    if type(x) is not dict:
        return (False, False, False, False, None, None, None, None, None, None, None, None, [], [])
    number = lambda k: v if type(v := x.get(k)) is float else None
    epoch = x.get("reviewedEpoch")
    return (
        True, x.keys() == _RECORD_SET, *_sensitive(x), _text(x.get("propertyKey")), _text(x.get("propertyName")), number("bookingHotelId"), _text(x.get("reviewId")), number("score"), int(epoch) if _is_count(epoch) and epoch > 0 else None,
        _text(x.get("reviewedLocalDate")), _text(x.get("reviewedAtUtc")), _feed_faults(x), _photo_faults(x.get("photos")),
    )


_RECORD_SET = frozenset(RECORD_KEYS)


def _read(line: Column) -> Column:
    """What the keys and kinds of a line's values tell, in one walk; the line is null or JSON that Spark has read. As expressions over variants this costs more than a millisecond a line."""

    @F.pandas_udf(_READ)
    def read(lines: pd.Series) -> pd.DataFrame:
        columns = zip(*map(_read_one, lines)) if len(lines) else [()] * _READ.count(",")
        names = [field.split()[0] for field in _READ.split(", ")]
        return pd.DataFrame({k: pd.Series(c, dtype=_DTYPES.get(k, object)) for k, c in zip(names, columns)})

    # So that no filter or further column has the lines read again.
    return read.asNondeterministic()(line)


_DTYPES = {"hotel": "float64", "score": "float64", "epoch": "Int64"}


def audited_lines(lines: DataFrame, properties: DataFrame, zone: str) -> DataFrame:
    """A row for each line (line_no, value): ``unread`` says why it can't be read, else it has a record's issues, but for an id's second line, and of each part whether it is at fault.

    Written once, without the text: whatever an audit counts comes from these rows.
    """
    known = properties.select("property_key", F.col("property_name").alias("__name"), F.col("hotel_id").alias("__hotel"))
    code = F.when(F.col("value") == "", "JSONL_BLANK_LINE").when(F.try_parse_json("value").isNull(), "JSONL_INVALID_JSON")
    r = lines.select("line_no", code.alias("unread"), "value")
    r = r.select("line_no", "unread", F.coalesce(F.col("value") != "", F.lit(False)).alias("filled"), _read(F.when(F.col("unread").isNull(), F.col("value"))).alias("__r")).select("line_no", "unread", "filled", "__r.*")
    r = r.join(F.broadcast(known), "property_key", "left").withColumn("__id", F.when(F.col("text_id").rlike("^[a-f0-9]{24}$"), F.col("text_id")))
    scaled = F.col("score") * 10
    checks = {
        "schema": [("RECORD_SCHEMA_MISMATCH", "record", F.col("exact"))],
        "privacy": [("PRIVACY_FIELD_PRESENT", "record", ~F.col("forbidden")), ("SESSION_DATA_PRESENT", "record", ~F.col("session"))],
        "identity": [("PROPERTY_IDENTITY_MISMATCH", "record.property", (F.col("hotel") == F.col("__hotel")) & (F.col("name") == F.col("__name")))],
        "id": [("PUBLIC_REVIEW_ID_INVALID", "record.reviewId", F.col("__id").isNotNull())],
        "score": [("SCORE_INVALID", "record.score", F.col("score").between(0, 10) & (F.abs(scaled - F.round(scaled)) <= 1e-9))],
        "date": [("SYDNEY_LOCAL_DATE_INVALID", "record.reviewedLocalDate", F.col("day") == local_date(F.col("epoch"), zone).cast("string"))],
        "utc": [("UTC_TIMESTAMP_INVALID", "record.reviewedAtUtc", F.col("utc") == utc_text(F.col("epoch")))],
    }
    # A line that is no object at all fails by its schema alone.
    applies = lambda part: F.col("is_object") | F.lit(part == "schema")
    r = r.withColumns({f"__{part}_{i}": applies(part) & ~F.coalesce(ok, F.lit(False)) for part, x in checks.items() for i, (_, _, ok) in enumerate(x)})
    r = r.withColumns({f"__p_{part}": functools.reduce(Column.__or__, [F.col(f"__{part}_{i}") for i in range(len(x))]) for part, x in checks.items()} | {f"__p_{part}": F.size(part) > 0 for part in ("content", "photos")})
    found = lambda *parts: [F.array_compact(F.array(*[F.when(F.col(f"__{part}_{i}"), _issue(c, at)) for part in parts for i, (c, at, _) in enumerate(checks[part])]))]
    listed = lambda c, fields: F.transform(fields, lambda at: _issue(c, at))
    # Most lines have none.
    unless = lambda parts, made: F.when(functools.reduce(Column.__or__, [F.col(f"__p_{p}") for p in parts]), F.concat(*made)).otherwise(F.array().cast(_ISSUES))
    before = unless(_PARTS[:4], found(*_PARTS[:4]))
    after = unless(_PARTS[4:], [*found(*_PARTS[4:7]), listed("FEED_FIELD_INVALID", "content"), listed("PHOTO_URL_NOT_CANONICAL", "photos")])
    return settled(r.select("line_no", "unread", "filled", "property_key", "__id", F.col("score").alias("__score"), "is_object", *[f"__p_{p}" for p in _PARTS], before.alias("__before"), after.alias("__after")))


def audited_records(lines: DataFrame, properties: DataFrame, zone: str) -> DataFrame:
    """A row for each readable line (line_no, value) with its issues and the uses that it is fit for.

    ``issues`` lists (code, field), once for each photo that is at fault. Of
    records with one id the first line is valid. Weekly use needs the schema,
    privacy, identity, id, score and local date; property use schema, privacy,
    identity and score; the feed all of weekly use, the UTC time, the other
    fields and the photos.
    """
    return _records(audited_lines(lines, properties, zone))


#: The parts of a record's issues, in order.
_PARTS = ("schema", "privacy", "identity", "id", "score", "date", "utc", "content", "photos")


def _records(lines: DataFrame) -> DataFrame:
    """audited_records() from audited_lines()."""
    r = lines.filter("unread IS NULL")
    first = r.filter("__id IS NOT NULL").groupBy("__id").agg(F.min("line_no").alias("__first"))
    r = r.join(first, "__id", "left")
    twice = F.col("is_object") & ~F.coalesce(F.col("__id").isNull() | (F.col("line_no") == F.col("__first")), F.lit(False))
    r = r.withColumns({"__twice": twice, "__p_id": F.col("__p_id") | twice})
    none = lambda *parts: F.col("is_object") & ~functools.reduce(Column.__or__, [F.col(f"__p_{p}") for p in parts])
    weekly = ("schema", "privacy", "identity", "id", "score", "date")
    r = r.withColumns({"weekly_ready": none(*weekly), "property_ready": none("schema", "privacy", "identity", "score"), "feed_ready": none(*weekly, "utc", "content", "photos")})
    ready = {use: F.col(f"{use}_ready") for use in ("weekly", "property", "feed")}
    found = F.concat("__before", _issues([("PUBLIC_REVIEW_ID_DUPLICATE", "record.reviewId", ~F.col("__twice"))]), "__after", _issues([(f"ANALYTICS_{use.upper()}_NOT_READY", "record", ok) for use, ok in ready.items()]))
    # Who is ready for all has none.
    issues = F.when(ready["property"] & ready["feed"], F.array().cast(_ISSUES)).otherwise(found)
    counted = none("identity")
    score = F.when(counted & none("score"), F.col("__score"))
    return r.select("line_no", F.when(counted, F.col("property_key")).alias("property_key"), score.alias("score"), issues.alias("issues"), none("id").alias("unique_id"), "weekly_ready", "property_ready", "feed_ready")


def _source_counts_hold(p: Column, most_gap: Column) -> Column:
    """Whether a manifest property's counts fit together: no gap, a visible one within its policy, or an attested one of the source."""
    n = lambda k: V.number(V.at(p, k))
    null = lambda *names: F.lit(True) if not names else V.is_kind(V.at(p, names[0]), "VOID") & null(*names[1:])
    counts = V.is_count(V.at(p, "advertisedReviews")) & V.is_count(V.at(p, "retrievableReviews")) & V.is_count(V.at(p, "sourceReviewGap"))
    gap, named, said = n("sourceReviewGap"), V.text(V.at(p, "sourceDiscrepancyKind")), ("sourceDiscrepancyScoreBucket", "advertisedBucketReviews", "retrievableBucketReviews")
    sums = (n("retrievableReviews") == n("totalPublishedReviews")) & (n("advertisedReviews") - n("retrievableReviews") == gap)
    short = n("advertisedBucketReviews") - n("retrievableBucketReviews")
    attested = V.is_count(V.at(p, "advertisedBucketReviews")) & V.is_count(V.at(p, "retrievableBucketReviews")) & (gap <= tolerance(n("advertisedReviews"))) & V.text(V.at(p, "sourceDiscrepancyScoreBucket")).isin(*BUCKETS) & short.between(1, gap)
    held = F.when(gap == 0, null("sourceDiscrepancyKind", *said)).when(named == VISIBLE_GAP, gap.between(1, most_gap) & null(*said)).when(named == SOURCE_GAP, attested)
    return F.coalesce(counts & sums & held, F.lit(False))


def manifest_properties(manifest: DataFrame, properties: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """A row for each property of a manifest (one row, value): its key, exported count, mean, and issues as (code, field)."""
    rows = manifest.select(F.posexplode(V.items(V.at(F.try_parse_json("value"), "properties"))).alias("place", "p"))
    p = F.col("p")
    of = lambda k: V.at(p, k)
    rows = rows.withColumn("property_key", V.text(of("propertyKey"))).withColumn("__hotel_is", V.number(of("bookingHotelId")))
    known = properties.select("property_key", F.col("hotel_id").alias("__hotel"))
    rows = rows.join(known, "property_key", "left")
    rows = rows.join(policy.select("property_key", F.col("hotel_id").alias("__hotel_is"), "most_gap"), ["property_key", "__hotel_is"], "left") if policy is not None else rows.withColumn("most_gap", F.lit(None).cast("int"))
    right = F.coalesce(F.col("__hotel_is") == F.col("__hotel"), F.lit(False))
    first = rows.filter(right).groupBy("property_key").agg(F.min("place").alias("__first"))
    rows = rows.join(first, "property_key", "left")
    is_object, total, mean = V.is_kind(p, "OBJECT"), V.number(of("totalPublishedReviews")), V.number(of("currentAverageScore"))
    counts = V.is_count(of("totalPublishedReviews")) & V.is_count(of("exportedReviews")) & (total == V.number(of("exportedReviews")))
    generation = V.is_count(of("publicationGeneration")) & (V.number(of("publicationGeneration")) >= 1)
    schema = _issues([("MANIFEST_PROPERTY_INVALID", "manifest.properties[]", V.has_exactly(p, PROPERTY_KEYS))])
    rest = _issues([
        ("MANIFEST_PROPERTY_COVERAGE_MISMATCH", "manifest.properties[]", right & (F.col("place") == F.col("__first"))),
        ("MANIFEST_PROPERTY_INVALID", "manifest.properties[]", (V.text(of("publishedRunId")) != "") & generation & (V.text(of("parserVersion")) == PARSER) & F.try_variant_get(p, "$.authoritativeFullPublication", "boolean")),
        ("MANIFEST_PROPERTY_COUNT_MISMATCH", "manifest.properties[].exportedReviews", counts),
        ("MANIFEST_SOURCE_COUNT_MISMATCH", "manifest.properties[].sourceReviewGap", _source_counts_hold(p, F.col("most_gap"))),
        ("MANIFEST_PROPERTY_INVALID", "manifest.properties[].currentAverageScore", ~(F.coalesce(total == 0, F.lit(False)) & ~V.is_kind(of("currentAverageScore"), "VOID")) & ~(F.coalesce(total > 0, F.lit(False)) & ~F.coalesce(mean.between(0, 10), F.lit(False)))),
    ])
    exported = F.when(counts, V.number(of("exportedReviews")).cast("long"))
    issues = F.concat(schema, F.when(is_object, rest).otherwise(_issues([])))
    return rows.select("place", "property_key", exported.alias("exported"), F.when(counts, mean).alias("average"), (F.col("place") == F.col("__first")).alias("covered"), issues.alias("issues"))


def manifest_issues(manifest: DataFrame, rows: DataFrame, properties: DataFrame, jsonl_rows: DataFrame) -> DataFrame:
    """(code, field) for the manifest as a whole; ``rows``: manifest_properties(); ``jsonl_rows``: one row with n, the lines that are not blank."""
    v = F.try_parse_json("value")
    of = lambda k: V.at(v, k)
    sums = rows.agg(F.count("*").alias("n_rows"), F.sum("exported").alias("total"), F.coalesce(F.bool_and(F.col("exported").isNotNull()), F.lit(True)).alias("complete"), F.count_if(F.coalesce("covered", F.lit(False))).alias("covered"))
    one = manifest.crossJoin(sums).crossJoin(properties.agg(F.count("*").alias("configured"))).crossJoin(jsonl_rows)  # one row each
    stamp = V.text(of("generatedAt"))
    listed, declared = V.is_kind(of("properties"), "ARRAY"), F.when(V.is_count(of("totalRecords")), V.number(of("totalRecords")))
    unless = lambda bad: ~F.coalesce(bad, F.lit(False))
    whole = _issues([
        ("PRIVACY_FIELD_PRESENT", "manifest", ~forbidden_keys(F.col("value"))), ("SESSION_DATA_PRESENT", "manifest", ~session_urls(F.col("value"))),
        ("MANIFEST_NOT_PRODUCTION", "manifest.mode", (V.text(of("mode")) == "all_current_reviews") & F.try_variant_get(v, "$.strictAll", "boolean") & V.is_kind(of("samplePerProperty"), "VOID")),
        ("MANIFEST_FIELD_INVALID", "manifest.generatedAt", stamp.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$") & F.try_to_timestamp(stamp).isNotNull()),
        ("MANIFEST_PROPERTY_COVERAGE_MISMATCH", "manifest.properties", (V.number(of("requestedPropertyCount")) == F.col("configured")) & V.is_kind(of("omittedPropertyKeys"), "ARRAY") & (F.size(V.items(of("omittedPropertyKeys"))) == 0)),
        ("MANIFEST_FIELD_INVALID", "manifest.totalRecords", declared.isNotNull()), ("MANIFEST_FIELD_INVALID", "manifest.properties", listed),
        ("MANIFEST_PROPERTY_COVERAGE_MISMATCH", "manifest.properties", ~listed | ((F.col("n_rows") == F.col("configured")) & (F.col("covered") == F.col("configured")))),
        ("MANIFEST_TOTAL_MISMATCH", "manifest.totalRecords", unless(listed & F.col("complete") & (F.coalesce("total", F.lit(0)) != declared))),
        ("MANIFEST_TOTAL_MISMATCH", "manifest.totalRecords", unless(declared != F.col("n"))),
    ])
    schema = _issues([("MANIFEST_SCHEMA_MISMATCH", "manifest", V.has_exactly(v, MANIFEST_KEYS))])
    found = F.concat(schema, F.when(V.is_kind(v, "OBJECT"), whole).otherwise(_issues([])))
    return one.select(F.explode(found).alias("i")).select("i.code", "i.field").unionByName(rows.select(F.explode("issues").alias("i")).select("i.code", "i.field"))


def property_issues(records: DataFrame, rows: DataFrame, properties: DataFrame) -> DataFrame:
    """(code, field) for configured properties whose exported count or mean is not that of the records."""
    held = records.filter("property_key IS NOT NULL").groupBy("property_key").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.avg("score").alias("mean"))
    last = rows.filter("exported IS NOT NULL").groupBy("property_key").agg(F.max_by(F.struct("exported", "average"), "place").alias("m"))
    both = properties.select("property_key").join(held, "property_key", "left").join(last, "property_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    off = ~F.coalesce(F.abs(F.col("mean") - F.col("m.average")) <= 1e-9, F.lit(False)) | ~F.coalesce(F.col("m.average").between(0, 10), F.lit(False))
    found = _issues([
        ("MANIFEST_PROPERTY_COUNT_MISMATCH", "manifest.properties[].exportedReviews", F.col("m.exported") == F.col("n")),
        ("MANIFEST_PROPERTY_AVERAGE_MISMATCH", "manifest.properties[].currentAverageScore", ~((F.col("n") > 0) & (F.col("scored") == F.col("n")) & off)),
    ])
    return both.select(F.explode(found).alias("i")).select("i.code", "i.field")


def errors(*issues: DataFrame) -> DataFrame:
    """All issues as (code, field, n), in order."""
    found = issues[0]
    for x in issues[1:]:
        found = found.unionByName(x)
    return found.groupBy("code", "field").agg(F.count("*").alias("n")).orderBy("code", "field")


def audited_export(lines: DataFrame, manifest: DataFrame, properties: DataFrame, zone: str, policy: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(errors, counts) of a whole export; it is sound if there are no errors. ``counts`` has one row."""
    read = audited_lines(lines, properties, zone)
    records, rows = settled(_records(read)), manifest_properties(manifest, properties, policy)
    jsonl = read.agg(F.count_if("filled").alias("n"))
    unread = read.filter("unread IS NOT NULL").select(F.col("unread").alias("code"), F.lit("jsonl").alias("field"))
    each = records.select(F.explode("issues").alias("i")).select("i.code", "i.field")
    found = errors(unread, each, manifest_issues(manifest, rows, properties, jsonl), property_issues(records, rows, properties))
    counts = records.agg(F.count("*").alias("parsed_records"), *[F.count_if(f"{c}").alias(f"{c}_rows") for c in ("unique_id", "weekly_ready", "property_ready", "feed_ready")])
    return found, jsonl.select(F.col("n").alias("jsonl_rows")).crossJoin(counts)  # one row each
