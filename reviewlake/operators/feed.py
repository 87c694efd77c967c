"""The review feed: validated queries, filters, orders and pages."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.ranges import ranged

#: Sort orders, and limits of a query.
ORDERS = ("newest", "oldest", "highest", "lowest", "helpful")
SENTIMENTS = ("positive", "mixed", "negative", "unclassified")
MOST_PAGES, LEAST_SIZE, MOST_SIZE, DEFAULT_SIZE, MOST_SEARCH = 100_000, 5, 100, 20, 200
#: Rows that a page may skip before they are written in ranges.
SHALLOW = 10_000
MOST_TEXT = {"language": 60, "guest_type": 100, "room": 180}


class InvalidQuery(ValueError):
    pass


@dataclass(frozen=True)
class FeedQuery:
    properties: tuple[str, ...] = ()
    start: date | None = None
    end: date | None = None
    least_tenths: int | None = None
    most_tenths: int | None = None
    sentiments: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    language: str | None = None
    guest_type: str | None = None
    room: str | None = None
    search: str = ""
    sort: str = "newest"
    page: int = 1
    size: int = DEFAULT_SIZE
    known_properties: tuple[str, ...] = field(default=(), repr=False)

    def __post_init__(self) -> None:
        if self.sort not in ORDERS:
            raise InvalidQuery(f"no order {self.sort!r}")
        if bad := set(self.sentiments) - set(SENTIMENTS):
            raise InvalidQuery(f"no sentiment {sorted(bad)}")
        if self.start and self.end and self.start > self.end:
            raise InvalidQuery("the dates are inverted")
        if self.known_properties and (bad := set(self.properties) - set(self.known_properties)):
            raise InvalidQuery(f"no property {sorted(bad)}")
        within = lambda x, low, high, default: default if not isinstance(x, int) or isinstance(x, bool) else max(low, min(high, x))
        object.__setattr__(self, "page", within(self.page, 1, MOST_PAGES, 1))
        object.__setattr__(self, "size", within(self.size, LEAST_SIZE, MOST_SIZE, DEFAULT_SIZE))
        object.__setattr__(self, "search", self.search.strip()[:MOST_SEARCH])
        for name, most in MOST_TEXT.items():
            object.__setattr__(self, name, (getattr(self, name) or "").strip()[:most] or None)
        if self.least_tenths is not None and self.most_tenths is not None and self.least_tenths > self.most_tenths:
            raise InvalidQuery("the scores are inverted")
        for name in ("least_tenths", "most_tenths"):
            if (x := getattr(self, name)) is not None:
                object.__setattr__(self, name, max(0, min(100, x)))


SEARCHED = ("title", "positive_text", "negative_text", "partner_reply", "language", "guest_type", "room", "property_key")


def searchable(columns: list[str]) -> Column:
    """All texts of a review, lower case, a line each; empty ones are left out."""
    return F.lower(F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in SEARCHED if c in columns]))


def scoped(reviews: DataFrame, q: FeedQuery) -> DataFrame:
    """The filters that hold for every section: properties and dates."""
    if q.properties:
        reviews = reviews.filter(F.col("property_key").isin(*q.properties))
    if q.start:
        reviews = reviews.filter(F.col("local_date") >= F.lit(q.start))
    if q.end:
        reviews = reviews.filter(F.col("local_date") <= F.lit(q.end))
    return reviews


def filtered(reviews: DataFrame, q: FeedQuery) -> DataFrame:
    """All filters of the feed; plain columns come first, so that they reach the scan."""
    out = scoped(reviews, q)
    for name in ("language", "guest_type", "room"):
        if (x := getattr(q, name)) is not None:
            out = out.filter(F.col(name) == x)
    if q.least_tenths is not None:
        out = out.filter(F.col("tenths") >= q.least_tenths)
    if q.most_tenths is not None:
        out = out.filter(F.col("tenths") <= q.most_tenths)
    if q.sentiments:
        out = out.filter(F.col("sentiment").isin(*q.sentiments))
    if q.search:
        out = out.filter(F.contains(searchable(out.columns), F.lit(q.search.lower())))
    if q.topics:
        out = out.filter(F.size(F.array_except(F.array(*map(F.lit, q.topics)), F.transform("topics", lambda t: t["topic"]))) == 0)
    return out


def rising(sort: str) -> dict[str, Column]:
    """The sort keys as columns that all rise, by name."""
    if sort in ("newest", "oldest"):
        return {"__k1": -F.col("epoch") if sort == "newest" else F.col("epoch"), "__k2": F.col("public_id")}
    first = {"highest": -F.col("tenths"), "lowest": F.col("tenths"), "helpful": -F.coalesce("helpful", F.lit(0))}[sort]
    return {"__k1": first, "__k2": -F.col("epoch"), "__k3": F.col("row_id")}


def _place(sort: str, row: dict) -> tuple:
    """The sort keys of one row, as rising() has them."""
    if sort in ("newest", "oldest"):
        return (-row["epoch"] if sort == "newest" else row["epoch"]), row["public_id"]
    return {"highest": -row["tenths"], "lowest": row["tenths"], "helpful": -(row["helpful"] or 0)}[sort], -row["epoch"], row["row_id"]


def order(sort: str) -> list[Column]:
    """Complete sort keys: ties end with the public id, or with the order of the rows before sorting."""
    if sort in ("newest", "oldest"):
        return [F.desc("epoch") if sort == "newest" else F.asc("epoch"), F.asc("public_id")]
    first = {"highest": F.desc("tenths"), "lowest": F.asc("tenths"), "helpful": F.desc(F.coalesce("helpful", F.lit(0)))}[sort]
    return [first, F.desc("epoch"), F.asc("row_id")]


def page(reviews: DataFrame, q: FeedQuery) -> tuple[DataFrame, int, int, int]:
    """(rows of the page, total, pages, page shown); a page beyond the last shows the last.

    Of the first SHALLOW rows Spark keeps the top of each partition. Further on
    the rows are written in ranges of their order, and only those ranges are
    sorted that the page lies in.
    """
    rows = filtered(reviews, q)
    total = rows.count()
    pages = -(-total // q.size)
    shown = min(q.page, max(1, pages))
    skip = (shown - 1) * q.size
    if skip <= SHALLOW:
        return rows.orderBy(*order(q.sort)).offset(skip).limit(q.size), total, pages, shown
    keys = rising(q.sort)
    placed = ranged(rows.withColumns(keys), (), tuple(keys))
    parts = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row a range
    before, chosen, first = 0, [], 0
    for part, n in parts:
        if before + n > skip and before < skip + q.size:
            first = before if not chosen else first
            chosen.append(part)
        before += n
    return placed.filter(F.col("__part").isin(chosen)).orderBy(*keys).offset(skip - first).limit(q.size).drop("__part", *keys), total, pages, shown


def after(reviews: DataFrame, q: FeedQuery, last: dict | None) -> DataFrame:
    """The page after a row that was shown last (its columns; none: the first page), by its place in the order: nothing is counted or skipped."""
    rows, keys = filtered(reviews, q).withColumns(rising(q.sort)), rising(q.sort)
    if last is not None:
        at = dict(zip(keys, _place(q.sort, last)))
        later = F.lit(False)
        for k in reversed(keys):
            later = (F.col(k) > F.lit(at[k])) | (F.col(k) == F.lit(at[k])) & later
        rows = rows.filter(later)
    return rows.orderBy(*keys).limit(q.size).drop(*keys)


def filter_options(reviews: DataFrame) -> DataFrame:
    """Distinct non-blank values of the filters, in collation order."""
    fields = ("language", "guest_type", "room")
    each = reviews.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select("x.field", "x.value")
    return each.filter(F.trim("value") != "").distinct().orderBy("field", F.expr("value COLLATE UNICODE"))


def date_bounds(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.min("local_date").alias("earliest"), F.max("local_date").alias("latest"))
