"""The contract of collected responses: what each JSON value must be, stated as a table that one small walk checks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.functions import variants as V
from reviewlake.functions.scalars import PHOTO_DOMAIN, canonical_json, canonical_photo


@dataclass(frozen=True)
class Object:
    """An object with its type name, the keys that it must have (null or not), and what some of them hold."""

    typename: str | None
    required: tuple[str, ...] = ()
    fields: dict = field(default_factory=dict)
    nullable: bool = True


@dataclass(frozen=True)
class Array:
    """An array, possibly null, of values of one kind; ``unique`` names a field whose values differ."""

    of: object
    nullable: bool = True
    unique: str | None = None


#: Leaves: TEXT a string, COUNT a whole number from zero, SCORE a number from 0 to 10, ID a string or whole number; with "?" null and missing too.
TEXT, TEXT_, COUNT, COUNT_, FLAG, FLAG_, SCORE, ID, ID_, URL, FILLED, EPOCH, PLAIN_ = "text", "text?", "count", "count?", "flag", "flag?", "score", "id", "id?", "photo url", "filled text", "epoch", "text or number?"

#: The objects of a response, with their type names and required keys.
TEXTS = Object("TextDetails", ("__typename", "title", "positiveText", "negativeText", "textTrivialFlag", "lang"), {"title": TEXT_, "positiveText": TEXT_, "negativeText": TEXT_, "textTrivialFlag": COUNT_, "lang": TEXT_})
ROOM = Object("RoomTranslation", ("__typename", "id", "name"), {"id": ID_, "name": TEXT_})
BOOKING = Object("BookingDetails", ("__typename", "customerType", "roomId", "roomType", "checkoutDate", "checkinDate", "numNights", "stayStatus"), {"customerType": TEXT_, "checkoutDate": TEXT_, "checkinDate": TEXT_, "stayStatus": TEXT_, "roomId": COUNT_, "numNights": COUNT_, "roomType": ROOM})
GUEST = Object("GuestDetails", ("__typename", "username", "avatarUrl", "countryCode", "countryName", "avatarColor", "showCountryFlag", "anonymous", "guestTypeTranslation"), {"username": TEXT_, "avatarUrl": TEXT_, "countryCode": TEXT_, "countryName": TEXT_, "avatarColor": TEXT_, "guestTypeTranslation": TEXT_, "showCountryFlag": FLAG_, "anonymous": FLAG_, "userReviewCount": COUNT_, "joinedDate": COUNT_})
REPLY = Object("PropertyReplyData", ("__typename", "reply"), {"reply": TEXT_})
HIGHLIGHT = Object(None, ("start", "end"), {"start": COUNT, "end": COUNT}, nullable=False)
PHOTO_URL = Object("ReviewPhotoUrl", ("__typename", "size", "url"), {"size": TEXT_, "url": URL}, nullable=False)
PHOTO = Object("ReviewPhoto", ("__typename", "id", "urls", "kind"), {"id": ID_, "kind": TEXT_, "mlTagHighestProbability": PLAIN_, "urls": Array(PHOTO_URL, nullable=False)}, nullable=False)
CARD = Object(
    "ReviewCard",
    ("__typename", "reviewUrl", "guestDetails", "bookingDetails", "reviewedDate", "isTranslatable", "helpfulVotesCount", "reviewScore", "textDetails", "isApproved", "partnerReply", "positiveHighlights", "negativeHighlights", "editUrl", "photos"),
    {
        "reviewUrl": FILLED, "reviewedDate": EPOCH, "reviewScore": SCORE, "textDetails": TEXTS, "helpfulVotesCount": COUNT_, "isApproved": FLAG_, "isTranslatable": FLAG_, "bookingDetails": BOOKING,
        "guestDetails": GUEST, "photos": Array(PHOTO), "positiveHighlights": Array(HIGHLIGHT), "negativeHighlights": Array(HIGHLIGHT), "partnerReply": REPLY, "editUrl": TEXT_,
    },
    nullable=False,
)


def _counted(typename: str, value: str = FILLED) -> Array:
    return Array(Object(typename, (), {"name": FILLED, "value": value, "count": COUNT}, nullable=False), nullable=False, unique="value")


#: The metadata beside a response's cards.
METADATA = {
    "ratingScores": Array(Object("RatingScore", (), {"name": FILLED, "translation": FILLED, "value": SCORE, "ufiScoresAverage": Object("UfiScoreAverage", (), {"ufiScoreLowerBound": SCORE, "ufiScoreHigherBound": SCORE})}, nullable=False), nullable=False, unique="name"),
    "topicFilters": Array(Object("TopicFilter", (), {"id": ID, "name": FILLED, "isSelected": FLAG, "translation": Object("ReviewTopicTranslation", (), {"id": ID, "name": FILLED})}, nullable=False), nullable=False, unique="id"),
    "reviewScoreFilter": _counted("ReviewScoreFilter"), "languageFilter": _counted("LanguageFilter", TEXT), "timeOfYearFilter": _counted("TimeOfYearFilter"), "customerTypeFilter": _counted("CustomerTypeFilter"),
    "roomTypeFilter": Array(Object("RoomTypeFilter", (), {"name": FILLED, "roomTypeId": ID, "count": COUNT, "roomIds": Array(ID, nullable=False)}, nullable=False), unique="roomTypeId"),
    "sorters": Array(Object("ReviewSorter", (), {"name": FILLED, "value": FILLED}, nullable=False), nullable=False, unique="value"),
}


_number = lambda x: type(x) in (int, float)
_whole = lambda x: _number(x) and x == x // 1
# As Spark's matcher reads the end of a text: before a last line break, too.
_PHOTO = re.compile(rf"https://(?i:(?:[a-z0-9-]+\.)*{re.escape(PHOTO_DOMAIN)})(?::[0-9]+)?(?:[/?#][^\x00-\x20\x7f]*)?(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z")
#: Whether a value is what a leaf says.
_HOLDS = {
    TEXT: lambda x: type(x) is str, FILLED: lambda x: type(x) is str and x != "", FLAG: lambda x: type(x) is bool, COUNT: lambda x: _whole(x) and 0 <= x <= V.MOST_SAFE, SCORE: lambda x: _number(x) and 0 <= x <= 10,
    ID: lambda x: type(x) is str and x != "" or _whole(x) and abs(x) <= V.MOST_SAFE, EPOCH: lambda x: _whole(x) and 1 <= x <= 8.64e12, URL: lambda x: type(x) is str and _PHOTO.match(x) is not None, PLAIN_[:-1]: lambda x: type(x) is str or _number(x),
}


def _name(x) -> str:
    """A value as Spark casts it to text."""
    return x if type(x) is str else "" if x is None else json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _broken(x, spec, path: str) -> Iterator[str]:
    """Where a value breaks its spec; a null is like a missing value."""
    at = f"{path}:" if path else ""
    if isinstance(spec, str):
        if not (x is None and spec.endswith("?") or _HOLDS[spec.rstrip("?")](x)):
            yield at + spec.rstrip("?")
    elif x is None and spec.nullable:
        return
    elif isinstance(spec, Array):
        if type(x) is not list:
            yield at + "array"
            return
        for e in x:
            yield from _broken(e, spec.of, f"{path}[]")
        names = [_name(e.get(spec.unique) if type(e) is dict else None) for e in x] if spec.unique else ()
        if len(set(names)) < len(names):
            yield at + "duplicate"
    elif type(x) is not dict:
        yield at + "object"
    else:
        yield from (f"{at}missing {k}" for k in spec.required if k not in x)
        if spec.typename and x.get("__typename") != spec.typename:
            yield at + "type name"
        for low, high, said in (("start", "end", "end before start"), ("ufiScoreLowerBound", "ufiScoreHigherBound", "bounds")):
            if low in spec.fields and high in spec.fields and _number(x.get(low)) and _number(x.get(high)) and x[high] < x[low]:
                yield at + said
        for k, s in spec.fields.items():
            yield from _broken(x.get(k), s, f"{path}.{k}" if path else k)


def _broken_json(text: Column, spec, path: str = "") -> Column:
    """Where JSON that Spark has read and written again breaks its spec. As expressions over variants this costs a millisecond a card, for every value is looked up in interpreted lambdas."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def broken(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(_broken(None if t is None else json.loads(t), spec, path))) for t in texts], dtype=object)

    # So that a filter on what is found, which Spark infers from explode() too, isn't planned beneath it with all that it reads.
    return broken.asNondeterministic()(text)


def violations(v: Column, spec, path: str = "") -> Column:
    """Where a variant breaks its spec, as paths with what is wrong: a sorted list without repeats."""
    return _broken_json(F.to_json(v), spec, path)


def checked_cards(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per card with ``card_json`` and ``violations``; an unreadable body or one without cards has one row, with that violation and no card."""
    parsed = pages.withColumn("__all", F.try_parse_json(F.col(body))).withColumn("__front", V.at(F.col("__all"), "data.reviewListFrontend")).withColumn("__cards", V.array(V.at(F.col("__front"), "reviewCard")))
    problem = F.when(F.col("__all").isNull(), "body:not json").when(~V.is_kind(F.col("__front"), "OBJECT"), "body:no review list").when(F.col("__cards").isNull(), "reviewCard:array")
    rows = parsed.withColumn("__problem", problem).drop("__all", "__front").select("*", F.posexplode_outer("__cards").alias("card_index", "card")).filter(F.col("card").isNotNull() | F.col("__problem").isNotNull())
    rows = rows.withColumn("card_json", F.when(F.col("card").isNotNull(), F.to_json("card"))).drop("__cards", "card").withColumn("__broken", _broken_json(F.col("card_json"), CARD))
    return rows.withColumn("violations", F.when(F.col("__problem").isNotNull(), F.array("__problem")).otherwise(F.col("__broken"))).drop("__problem", "__broken")


#: The lists beside the cards as one object.
_LISTS = Object(None, (), METADATA)


def checked_metadata(pages: DataFrame, body: str = "body") -> DataFrame:
    """pages with ``metadata_violations`` of the lists beside the cards, and ``totals_status`` of their totals against the count."""
    rows = pages.withColumn("__front", V.at(F.try_parse_json(F.col(body)), "data.reviewListFrontend"))
    # The lists alone: the cards are checked elsewhere.
    lists = F.to_json(F.struct(*[V.at(F.col("__front"), k).alias(k) for k in METADATA]))
    return rows.withColumn("metadata_violations", _broken_json(lists, _LISTS)).drop("__front")


def score_violation(v: Column, names: tuple[str, str] = ("score", "reviewScore")) -> Column:
    """A score may come under two names: one at least, from 0 to 10, and equal if both are there; null if all is well."""
    there = lambda x: ~V.is_none(x)
    good = lambda x: V.is_none(x) | F.coalesce(V.number(x).between(0, 10), F.lit(False))
    said = lambda a, b: (
        F.when(~there(a) & ~there(b), "score:missing").when(~good(a) | ~good(b), "score:range")
        .when(there(a) & there(b) & (V.number(a) != V.number(b)), "score:aliases differ")
    )
    return V.let(v, lambda x: V.let(V.at(x, names[0]), lambda a: V.let(V.at(x, names[1]), lambda b: said(a, b))))


def title_violation(v: Column) -> Column:
    """A title never counts towards topics, but must be a string or null."""
    return F.when(~V.is_kind(V.at(v, "title"), "STRING", "VOID", "MISSING"), "title:text")


def nights(v: Column) -> Column:
    """Nights of a booking: a whole number from zero, or null."""
    return V.let(V.number(v), lambda n: F.when((n == F.floor(n)) & n.between(0, V.MOST_SAFE), n.cast("long")))


def record_hash(card_json: Column) -> Column:
    """The digest of a whole card: keys sorted, photo hosts replaced by the one that stands for them."""
    pattern = r'"url":"(https://[^"\\]*)"'

    def shown(whole: Column) -> Column:
        urls = F.array_distinct(F.regexp_extract_all(whole, F.lit(pattern), F.lit(1)))
        return F.aggregate(urls, whole, lambda text, u: F.coalesce(F.replace(text, F.concat(F.lit('"url":"'), u, F.lit('"')), F.concat(F.lit('"url":"'), canonical_photo(u), F.lit('"'))), text))

    return F.sha2(V.let(canonical_json(card_json), shown), 256)
