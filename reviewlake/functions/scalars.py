"""Scalar derivations on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The domain whose hosts deliver photos in turn, and the host that stands for them in canonical URLs.
PHOTO_DOMAIN, PHOTO_HOST = "photos.example.com", "photo-cdn.invalid"
#: Query keys whose values are never shown.
SECRET_KEYS = "sid|label|aid|srpvid|srepoch|session|sessionid|token|csrf|csrf_token|auth|authorization|apikey|api_key|key|password"


def public_id(key: Column, token: Column) -> Column:
    """24 hex digits that name a review without its token."""
    return F.substring(F.sha2(F.concat(key, F.lit(":"), token), 256), 1, 24)


def share(part: Column, whole: Column) -> Column:
    """Percentage; null on an empty whole."""
    return F.try_divide(part, whole) * 100


def delta(now: Column, before: Column) -> Column:
    return now - before


def direction(change: Column) -> Column:
    return F.when(change.isNull(), "unavailable").when(F.abs(change) < 0.0001, "flat").when(change > 0, "up").otherwise("down")


def tone(score: Column) -> Column:
    return F.when(score >= 8, "excellent").when(score >= 7, "good").when(score >= 5, "mixed").otherwise("poor")


def humanized(text: Column) -> Column:
    """Words of a source label: underscores as spaces, lower case, a capital after each boundary; blank is null."""
    bare = F.lower(F.translate(F.trim(text), "_", " "))
    parts = F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.when(F.trim(text) != "", F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), ""))


def category_key(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """A label's comparison key; aliases name canonical categories, others keep their words."""
    bare = F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit("and")), "[^a-z0-9]+", " "))
    pairs = [F.lit(x) for kv in (aliases or {}).items() for x in kv]
    known = F.create_map(*pairs)[bare] if pairs else F.lit(None).cast("string")
    return F.coalesce(known, F.concat(F.lit("source:"), bare))


def tenths(score: Column) -> Column:
    """A score as whole tenths; null outside 0 to 10 or beyond one decimal."""
    scaled = F.round(score * 10)
    return F.when(score.between(0, 10) & (F.abs(score * 10 - scaled) <= 1e-9), scaled.cast("int"))


def combined_text(*parts: Column) -> Column:
    return F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts])


def property_slug(path: Column) -> Column:
    """The key of a property from its page's path."""
    return F.regexp_replace(F.lower(F.regexp_extract(path, r"/hotel/[a-z]{2}/([^/?#]+?)(?:\.[a-z-]+)?\.html", 1)), "[^a-z0-9]+", "-")


def canonical_page(url: Column) -> Column:
    """Scheme, host and path only; null unless https without credentials."""
    ok = url.rlike(r"^https://[^/@?#\s]+(?:/[^?#\s]*)?(?:[?#].*)?$")
    return F.when(ok, F.regexp_replace(url, "[?#].*$", ""))


def canonical_photo(url: Column, domain: str = PHOTO_DOMAIN, host: str = PHOTO_HOST) -> Column:
    """The URL with its delivery host replaced, every other byte as it is; null unless https, without credentials, blanks or a foreign host."""
    own = rf"(?i:(?:[a-z0-9-]+\.)*{domain.replace('.', chr(92) + '.')})"
    ok = url.rlike(rf"^https://{own}(?::[0-9]+)?(?:[/?#][^\x00-\x20\x7f]*)?$")
    return F.when(ok, F.regexp_replace(url, rf"^https://{own}", f"https://{host}"))


def redacted(text: Column) -> Column:
    """Values of secret query keys and of authorisation headers, masked."""
    queries = F.regexp_replace(text, rf"(?i)([?&](?:{SECRET_KEYS})=)[^&#\s]*", "$1[REDACTED]")
    return F.regexp_replace(queries, r"(?i)\b(authorization|proxy-authorization|cookie|set-cookie|x-booking-csrf-token|x-booking-pageview-id|x-booking-et-serialized-state)\s*[:=]\s*[^\r\n]+", "$1: [REDACTED]")


def visible_count(text: Column) -> Column:
    """The largest "N reviews" of a page's text, with thousands commas."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)([0-9][0-9,]*)\s+reviews?\b"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("long")))


def shows_score(text: Column, expected: Column) -> Column:
    """Whether the text shows the expected number of tenths as a score."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![0-9.])([0-9]{1,2}\.[0-9])(?![0-9])"), F.lit(1))
    return F.exists(found, lambda x: F.round(x.cast("double") * 10) == expected)


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and plain numbers; null if it can't be read."""
    return F.to_json(F.try_parse_json(text))


def response_kind(status: Column, body: Column) -> Column:
    """What an HTTP answer is, before its JSON is trusted."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return (
        F.when(status == 429, "rate_limited").when(status.isin(401, 403) | low.contains("captcha") | low.contains("challenge"), "challenge")
        .when(status >= 500, "server_error").when(~status.between(200, 299), "http_error").when(F.trim(low) == "", "empty")
        .when(F.try_parse_json(body).isNull(), "not_json").otherwise("json")
    )
