"""SimHash fingerprints, and their links within a Hamming radius by covering locality-sensitive hashing.

The masks follow Pagh's covering construction. Each of the 64 bits gets a
non-zero code of radius + 1 bits; a table is a non-zero vector v of as many
bits, and its mask keeps the positions whose code has an odd inner product
with v. Any set of ``radius`` positions has codes that span at most ``radius``
dimensions, so some v is orthogonal to all of them: its mask touches none of
the positions, and two fingerprints that differ there alone share its bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import settled, through_pandas
from reviewlake.llm.components import components
from reviewlake.llm.sieve import sieve, sifted
from reviewlake.llm.similar import similar_links

#: Distinct fingerprints that one bucket may hold before its remaining bits are covered again.
BUCKET = 2048


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the XXH64 values of all word shingles; 0 for a text without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) per row; fp holds the 64 bits as a signed long. A null text counts as empty."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "fp": fps.view(np.int64)})

    found = docs.select(through_pandas(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).mapInPandas(run, "doc_id string, text_hash long, fp long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the positions such that any ``radius`` of them are all outside some mask."""
    codes = {p: 1 + i % (2 ** (radius + 1) - 1) for i, p in enumerate(positions)}
    return [sum(1 << p for p, c in codes.items() if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, int]]:
    """A spanning forest of the links within one bucket, as (new vertices, their parent)."""
    out, rest = [], fps
    while rest.size > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and rest.size:
            at = frontier.pop()
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= radius
            if near.any():
                out.append((rest[near], at))
                frontier.extend(rest[near])
                rest = rest[~near]
    return out


def fingerprint_links(distinct: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) over distinct fingerprints ``fp`` that keep every component of "at most radius bits apart".

    Buckets with more than ``bucket`` fingerprints are covered a second time
    over the bits their mask left free, which loses no pair and bounds a group
    by two to the number of bits that are then left.
    """
    masks = covering_masks(list(range(64)), radius)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(sizes, ["t", "key"])
    small = met.filter(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    inner = F.lit(None)
    for t, m in enumerate(masks):
        free = [p for p in range(64) if not m >> p & 1]
        parts = F.array(*[F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("sub")) for s, x in enumerate(covering_masks(free, radius))])
        inner = F.when(F.col("t") == t, parts) if t == 0 else inner.when(F.col("t") == t, parts)
    large = met.filter(F.col("n") > bucket).select("t", "key", "fp", F.explode(inner).alias("x")).groupBy("t", "key", "x").agg(F.collect_list("fp").alias("fps")).select("fps").filter(F.size("fps") > 1)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [x for fps in b["fps"] for x in _forest(np.sort(np.asarray(fps, np.int64)), radius)]
            if found:
                yield pd.DataFrame({"u": np.concatenate([x for x, _ in found]), "v": np.concatenate([np.full(len(x), p, np.int64) for x, p in found])})

    return small.unionByName(large).mapInPandas(run, "u long, v long")


def grouped(docs: DataFrame, words: int, radius: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) per row of docs; root names the component by its least fingerprint."""
    rows = settled(fingerprints(docs, words, doc_id, text))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(fingerprint_links(distinct.select("fp"), radius)).withColumnRenamed("vertex", "fp")
    rooted = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row of docs.

    component_id is the smallest doc_id that links reach from the row. Equal
    fingerprints are always linked, those of texts without words (zero) too;
    repeated rows stay, each with its result; a null doc_id takes part but
    names no component. An empty table gives no rows.
    """
    return grouped(docs, words, radius, doc_id, text).select("doc_id", "fp", "component_id")


def fingerprint_hex(fp="fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def keep_one(docs: DataFrame, words: int = 5, radius: int = 3, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the near copies: of each group one row stays, with all its columns.

    Texts are linked if their fingerprints differ in at most ``radius`` bits,
    or if their shingle sets are alike to ``similarity``. The row that stays is
    the one with the smallest doc_id (one without a doc_id only if none has
    one; of several with that doc_id, the one with the least text hash). Only
    the keys of the rows that go are sent to the documents.
    """
    found = settled(grouped(docs, words, radius, doc_id, text))
    texts = docs.select(F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # A group of equal fingerprints is one vertex; links of texts join such vertices.
    root_of = found.select("text_hash", "root").dropDuplicates(["text_hash"])
    alike = similar_links(texts, words, similarity)
    for end in ("u", "v"):
        alike = alike.join(root_of.withColumnsRenamed({"text_hash": end, "root": f"{end}_root"}), end)
    joined = components(alike.select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))).select(F.col("vertex").alias("root"), F.col("root").alias("whole"))
    found = found.join(joined, "root", "left").withColumn("root", F.coalesce("whole", "root")).drop("whole")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    # Written before the join: its two sides are then plain exchanges, of which Spark can split a hot group's.
    winners = settled(found.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    groups = settled(found.join(winners, "root"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    gone = settled(groups.filter(~is_first).select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash")).distinct())
    # Rows whose text is certainly not among those need not meet them.
    suspects, clear = sifted(docs, F.xxhash64(text), sieve(gone, "__text_hash"))
    kept = suspects.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__doc_id")) & (F.xxhash64(text) == F.col("__text_hash")), "left_anti").unionByName(clear)
    if groups.filter(is_first).groupBy("root").count().filter("count > 1").isEmpty():
        return kept
    columns = kept.columns
    return kept.withColumn("__text_hash", F.xxhash64(text)).dropDuplicates([doc_id, "__text_hash"]).select(*columns)
