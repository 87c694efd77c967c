"""Trees of hashes: planted differences are found, and few rows are read."""

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import merkle


def made(spark, n, drop=(), change=()):
    return spark.range(n).filter(~F.col("id").isin([-1, *drop])).select(F.when(F.col("id") % 3 > 0, "p").otherwise("q").alias("property_key"), F.col("id").cast("string").alias("token"), F.when(F.col("id").isin([-1, *change]), "other").otherwise(F.md5(F.col("id").cast("string"))).alias("record_hash"))


def scanned(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


def test_planted_differences_and_rows_read(spark, tmp_path):
    n = 200_000
    a = merkle.written(made(spark, n, drop=[5, 77]), str(tmp_path / "a"), bits=12, page_rows=100)
    b = merkle.written(made(spark, n, drop=[123_456], change=[77, 99_999]).unionByName(made(spark, 1).withColumn("token", F.lit("new"))), str(tmp_path / "b"), bits=12, page_rows=100)
    got = sorted((r.token, r.change) for r in merkle.differences(a, b).collect())
    assert got == [("123456", "missing"), ("5", "inserted"), ("77", "inserted"), ("99999", "updated"), ("new", "inserted")]
    ranges = merkle.differing(a, b)
    assert ranges.count() <= 5 and all(scanned(merkle.within(t, ranges)) < n / 100 for t in (a, b))


def test_equal_empty_and_many(spark, tmp_path):
    a, same = (merkle.written(made(spark, 3000), str(tmp_path / x)) for x in ("a", "same"))
    none = merkle.written(made(spark, 0), str(tmp_path / "none"), bits=a.bits)
    assert merkle.differing(a, same).count() == 0 == merkle.differences(a, same).count()
    assert {r.change for r in merkle.differences(a, none).collect()} == {"missing"} and merkle.differences(none, a).count() == 3000
    fine = [merkle.written(made(spark, 3000, change=range(0, 3000, k)), str(tmp_path / f"fine{k}"), bits=12) for k in (2, 3000)]
    assert merkle.differences(*fine).count() == 1499  # more ranges than bounds
    with pytest.raises(ValueError):
        merkle.differing(a, fine[0])
