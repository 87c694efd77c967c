"""Checks of JSON values by their kind, as expressions over variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SAFE = 2**53 - 1
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is named: outside of lambdas Spark would work it out at each place."""
    return F.transform(F.array(value), then)[0]


def at(v: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path such as ``a.b``; null where there is none or it has another type."""
    return F.try_variant_get(v, f"$.{path}", kind)


def kind(v: Column) -> Column:
    """STRING, BOOLEAN, OBJECT, ARRAY, NUMBER, VOID (a JSON null) or MISSING."""
    sort = lambda said: F.when(said.isin(*_NUMBERS), "NUMBER").otherwise(said)
    return let(v, lambda x: F.when(x.isNull(), "MISSING").otherwise(let(F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0), sort)))


def number(v: Column) -> Column:
    return let(v, lambda x: F.when(kind(x) == "NUMBER", F.try_variant_get(x, "$", "double")))


def text(v: Column) -> Column:
    return let(v, lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string")))


def is_kind(v: Column, *kinds: str) -> Column:
    return kind(v).isin(*kinds)


def is_count(v: Column) -> Column:
    """A whole number from zero up to the largest that a double tells apart."""
    return let(number(v), lambda n: F.coalesce((n == F.floor(n)) & n.between(0, MOST_SAFE), F.lit(False)))


def is_none(v: Column) -> Column:
    return let(v, lambda x: x.isNull() | F.is_variant_null(x))


def array(v: Column) -> Column:
    """The elements of an array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def object_(v: Column) -> Column:
    """The values of an object by key; null for anything else."""
    return F.try_variant_get(v, "$", "map<string, variant>")


def items(v: Column) -> Column:
    """The elements of an array; none of anything else."""
    return F.coalesce(array(v), F.array().cast("array<variant>"))


def keys(v: Column) -> Column:
    """The keys of an object; none of anything else."""
    return F.coalesce(F.map_keys(object_(v)), F.array().cast("array<string>"))


def has_exactly(v: Column, wanted: tuple[str, ...]) -> Column:
    return F.coalesce(F.sort_array(F.map_keys(object_(v))) == F.array(*map(F.lit, sorted(wanted))), F.lit(False))
