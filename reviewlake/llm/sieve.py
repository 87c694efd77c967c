"""A bitmap of bounded size that tells which rows may have one of some keys, so that only those are shuffled."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and of the whole bitmap (16 MB); beyond that more rows pass, and none is lost.
PER_KEY, MOST_BITS = 64, 1 << 27


def sieve(keys: DataFrame, column: str, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """The bitmap of a long column as rows of 4 KB, and its number of bits. ``keys`` is counted first: pass a written table."""
    bits = min(most_bits, max(1 << 15, 1 << math.ceil(math.log2(PER_KEY * max(1, keys.count())))))
    at = F.pmod(F.col(column), F.lit(bits)) + 1
    found = keys.filter(F.col(column).isNotNull()).select(F.bitmap_bucket_number(at).alias("__bucket"), F.bitmap_bit_position(at).alias("bit"))
    return found.groupBy("__bucket").agg(F.bitmap_construct_agg("bit").alias("__bits")), bits


def sifted(df: DataFrame, key: Column, keys: tuple[DataFrame, int]) -> tuple[DataFrame, DataFrame]:
    """df in two parts: rows whose long key may be among the keys, and rows whose key is not (null too)."""
    bitmap, bits = keys
    at = F.pmod(key, F.lit(bits)) + 1
    met = df.withColumns({"__bucket": F.bitmap_bucket_number(at), "__bit": F.bitmap_bit_position(at)}).join(F.broadcast(bitmap), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.col("__bit") % 8).cast("int")) > 0, F.lit(False))
    return met.filter(may).select(*df.columns), met.filter(~may).select(*df.columns)


def packed(keys: tuple[DataFrame, int]) -> np.ndarray:
    """The bitmap as bytes, MOST_BITS bits at most: bit k is in byte k / 8, the lowest first."""
    bitmap, bits = keys
    out = np.zeros(bits // 8, np.uint8)
    for r in bitmap.collect():
        at = (r["__bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["__bits"], np.uint8)
    return out
