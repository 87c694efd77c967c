"""Trees of hashes over inventories: where two of them part is found from digests, and only there rows are read.

An inventory is written in the order of its identities' hashes, with a digest
for each small range of hashes. Digests of wider ranges are made of those of
the narrower ones in them. Two inventories are compared from the widest down;
below a range in which they agree nothing is looked at. What is left are the
narrow ranges that differ, of which the file's statistics let the rows be read
without the rest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.operators import snapshots
from reviewlake.operators.ranges import settled

#: Bits of an identity's place; rows of a narrowest range, about; bits from one level to the next.
PLACE_BITS, RANGE_ROWS, STEP = 60, 1000, 4
#: Rows of a page, the least that a read takes; ranges up to which their bounds are written into the filter.
PAGE_ROWS, MOST_BOUNDS = 1000, 500


def _number(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"})), 1, PLACE_BITS // 4), 16, 10).cast("long")


@dataclass(frozen=True)
class Tree:
    """A written inventory: its rows in order of ``__place``, and the digests of 2 ** bits ranges."""

    spark: SparkSession
    root: str
    bits: int
    keys: tuple[str, ...]
    hashed: str

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def leaves(self) -> DataFrame:
        """(range, n, x, s): how many rows, and order-free sums of their hashes; ranges without rows are left out."""
        return self.spark.read.parquet(f"{self.root}/leaves")


def written(rows: DataFrame, root: str, keys: tuple[str, ...] = snapshots.KEYS, hashed: str = "record_hash", bits: int | None = None, page_rows: int = PAGE_ROWS) -> Tree:
    """Writes an inventory with its tree. Trees that are compared need the same ``bits``; without a number they follow from the rows."""
    if bits is None:
        bits = max(0, (max(1, rows.count() // RANGE_ROWS) - 1).bit_length())
    bits = -(-bits // STEP) * STEP
    placed = rows.withColumn("__place", _number(*[F.col(k) for k in keys]))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(n, "__place").sortWithinPartitions("__place", *keys).write.option("parquet.page.row.count.limit", page_rows).parquet(f"{root}/rows")
    tree = Tree(rows.sparkSession, root.rstrip("/"), bits, keys, hashed)
    record = _number(*[F.col(k) for k in keys], F.col(hashed))
    found = tree.rows().groupBy(F.shiftright("__place", PLACE_BITS - bits).alias("range")).agg(F.count("*").alias("n"), F.bit_xor(record).alias("x"), F.sum(record.cast("decimal(38,0)")).alias("s"))
    found.write.parquet(f"{root}/leaves")
    return tree


def _level(leaves: DataFrame, below: int) -> DataFrame:
    """Digests of the ranges that hold 2 ** below narrowest ones."""
    return leaves.groupBy(F.shiftright("range", below).alias("range")).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"))


def differing(left: Tree, right: Tree) -> DataFrame:
    """(range): the narrowest ranges in which two inventories differ; each level looks only below the ranges that differ on the one above."""
    if (left.bits, left.keys) != (right.bits, right.keys):
        raise ValueError("the trees have other ranges or keys")
    a, b, found = left.leaves(), right.leaves(), None
    for below in range(left.bits, -1, -STEP):
        if found is not None:
            a, b = (side.join(found, F.shiftright(side["range"], below + STEP) == found["__above"], "left_semi") for side in (a, b))
        x, y = _level(a, below).alias("x"), _level(b, below).alias("y")
        same = (F.col("x.n") == F.col("y.n")) & (F.col("x.x") == F.col("y.x")) & (F.col("x.s") == F.col("y.s"))
        parted = x.join(y, F.col("x.range") == F.col("y.range"), "full_outer").filter(~F.coalesce(same, F.lit(False)))
        found = settled(parted.select(F.coalesce("x.range", "y.range").alias("__above")))
    return found.withColumnRenamed("__above", "range")


def within(tree: Tree, ranges: DataFrame) -> DataFrame:
    """The rows of some of a tree's ranges. Of few ranges the bounds reach the scan, which skips all pages outside; many are joined."""
    shift = PLACE_BITS - tree.bits
    bounds = [r["range"] for r in ranges.orderBy("range").limit(MOST_BOUNDS + 1).collect()]
    if len(bounds) > MOST_BOUNDS:
        rows = tree.rows()
        return rows.join(ranges, F.shiftright("__place", shift) == ranges["range"], "left_semi")
    merged: list[list[int]] = []
    for r in bounds:
        if merged and merged[-1][1] == r:
            merged[-1][1] = r + 1
        else:
            merged.append([r, r + 1])
    spans = [(F.col("__place") >= a << shift) & (F.col("__place") < b << shift) for a, b in merged]
    return tree.rows().filter(reduce(Column.__or__, spans, F.lit(False)))


def differences(left: Tree, right: Tree) -> DataFrame:
    """Keys that one side lacks, or has with another record, with both records and the kind of difference: inserted, updated or missing."""
    ranges = differing(left, right)
    before, after = (within(t, ranges).select(*t.keys, F.col(t.hashed).alias("record_hash")) for t in (left, right))
    return snapshots.compare(before, after, left.keys).filter("change <> 'unchanged'")
