"""Links between texts whose word shingles are alike to a given share, beside those of near-equal fingerprints.

A SimHash of 64 bits differs in some ten bits where four fifths of the
shingles agree, far beyond the radius that covering masks can guarantee. So
texts that share a band of minimum hashes are compared by their signatures.
First only a spanning forest of the most similar pairs of bounded groups is
checked on the texts, which joins most copies. Then every pair of a group that
no checked link joins, and whose signatures do not rule it out, is checked too:
texts meet in blocks with their shingle sets, and only links leave a block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import settled
from reviewlake.llm.components import components
from reviewlake.llm.sieve import sieve, sifted

#: Bands of a signature and minimum hashes in each: at a similarity of 0.8 all bands miss once in 15,000 pairs.
BANDS, ROWS = 24, 5
#: Texts of one group that are compared with each other; a larger group is parted by the bands that follow.
GROUP, FURTHER = 100, 6
#: Texts, and bytes of their shingle sets, on each side of a block of pairs of one group (on average; a text is never cut).
BLOCK, BLOCK_BYTES = 1000, 2 << 20
#: Estimated similarity below the wanted one from which a pair is checked: 120 slots put an alike pair lower than that once in 100,000 pairs or less.
SLACK = 0.15

_RANDOM = np.random.default_rng(20240602)
_MULTIPLY, _ADD = _RANDOM.integers(1, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1), _RANDOM.integers(0, 2**64, BANDS * ROWS, np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of the shingles, words in lower case; of the whole text if it has fewer words; none without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(parts) - words + 1)
    return np.unique(np.fromiter((digest(b" ".join(parts[i : i + words])) for i in range(n)), np.uint64, n))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of the multiplied and shifted hash sets."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for a in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[a : a + 1024, None] * _MULTIPLY + _ADD).min(axis=0))
    return least


def _signed_texts(batches: Iterable[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys, sizes, signs, bands = [], [], [], []
        for key, text in zip(b["text_hash"], b["text"]):
            if len(h := shingles(text, words)):
                s = signature(h)
                keys.append(key)
                sizes.append(len(h))
                signs.append((s & np.uint64(255)).astype(np.uint8).tobytes())  # the high bytes of minima are nearly all zero
                bands.append([xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in s.reshape(BANDS, ROWS)])
        if keys:
            yield pd.DataFrame({"text_hash": keys, "n_shingles": sizes, "sign": signs, "bands": bands})


def _forest(keys: np.ndarray, signs: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the most similar pairs (Prim): each text joins by its best link to those before it."""
    out, rest = [], np.arange(len(keys))
    while len(rest) > 1:
        at, rest = rest[0], rest[1:]
        best, origin = np.full(len(rest), -1.0), np.zeros(len(rest), np.int64)
        while len(rest):
            near = (signs[rest] == signs[at]).mean(axis=1)
            up = near > best
            best[up], origin[up] = near[up], at
            k = int(best.argmax())
            if best[k] < least:
                break
            out.append((int(keys[rest[k]]), int(keys[origin[k]])))
            at = rest[k]
            rest, best, origin = (np.delete(x, k) for x in (rest, best, origin))
    return out


def _group_links(batches: Iterable[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = []
        for keys, signs in zip(b["keys"], b["signs"]):
            order = np.argsort(keys)
            found += _forest(np.asarray(keys, np.int64)[order], np.stack([np.frombuffer(signs[i], np.uint8) for i in order]), least)
        if found:
            yield pd.DataFrame([(min(x), max(x)) for x in found], columns=["u", "v"])


def _alike(batches: Iterable[pd.DataFrame], words: int, similarity: float) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = []
        known: dict[int, np.ndarray] = {}
        for u, v, x, y in zip(b["u"], b["v"], b["a"], b["b"]):
            for key, text in ((u, x), (v, y)):
                if key not in known:
                    known[key] = shingles(text, words)
            p, q = known[u], known[v]
            shared = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(shared >= similarity * (len(p) + len(q) - shared))
        if any(keep):
            yield b.loc[keep, ["u", "v"]]


class _Block:
    """One block of a band group: texts that ask, and others that they meet."""

    def __init__(self, b: pa.RecordBatch, r: int) -> None:
        of = lambda name: b.column(name)[r].values
        asks = of("asks").to_numpy(zero_copy_only=False)
        self.band, self.keys, self.asks, self.others = b.column("band")[r].as_py(), of("keys").to_numpy(), np.flatnonzero(asks).tolist(), np.flatnonzero(~asks)
        self.roots = np.unique(of("roots").to_numpy(), return_inverse=True)[1]
        self.signs, self.bands = (np.stack([np.frombuffer(x, kind) for x in of(name).to_pylist()]) for name, kind in (("signs", np.uint8), ("bands", np.int64)))

    def near(self, i: int, least: float) -> np.ndarray:
        """Others of another class whose estimate is high enough, but for those that share an earlier band: each pair is looked at in its first."""
        near = self.others[self.roots[self.others] != self.roots[i]]
        near = near[(self.signs[near] == self.signs[i]).mean(axis=1) >= least] if len(near) else near
        return near[~(self.bands[near, : self.band] == self.bands[i, : self.band]).any(axis=1)] if len(near) else near


def _candidates(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(band, text_hash) of the texts that have a pair to be checked."""
    for b in batches:
        for r in range(b.num_rows):
            block, found = _Block(b, r), []
            for i in block.asks:
                if len(near := block.near(i, least)):
                    found += [block.keys[near], block.keys[i : i + 1]]
            if found:
                keys = np.unique(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block.band, np.int32)), pa.array(keys)], ["band", "text_hash"])


def _unjoined(batches: Iterable[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links between one text that asks and another of its block whose class differs: those that shingle sets bear out.

    A link joins the two classes within the block, so later texts of both need no further one.
    """
    for b in batches:
        for r in range(b.num_rows):
            block, found = _Block(b, r), []
            keys, roots = block.keys, block.roots
            sets = [np.frombuffer(x, np.uint64) for x in b.column("sets")[r].values.to_pylist()]
            sizes = np.array([len(x) for x in sets])
            for i in block.asks:
                near = block.near(i, similarity - SLACK)
                for a in range(0, len(near), 256):
                    part = near[a : a + 256]
                    part = part[roots[part] != roots[i]]
                    if not len(part):
                        continue
                    joined, own = np.concatenate([sets[j] for j in part.tolist()]), sets[i]
                    at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
                    shared = np.add.reduceat(own[at] == joined, np.cumsum(sizes[part]) - sizes[part])
                    for j in part[shared >= similarity * (sizes[part] + sizes[i] - shared)].tolist():
                        if roots[j] != roots[i]:
                            found.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
                            roots[roots == roots[j]] = roots[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])


def _with_sets(batches: Iterable[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for a in range(0, len(b), 500):
            part = b.iloc[a : a + 500]
            yield pd.DataFrame({"text_hash": part["text_hash"], "set": [shingles(t, words).tobytes() for t in part["text"]]})


def _in_blocks(asked: DataFrame, sides: dict, fields: dict[str, str], more: DataFrame | None = None) -> DataFrame:
    """Every block of the members of each band group that ask with every block of all its members, as arrays.

    A member asks if it is not of the class that has most of the group.
    ``sides``: columns (None: one a member) and how much of them a block may
    have; ``more`` adds columns by text_hash.
    """
    of = [f"side{k}" for k in range(len(sides))]
    counts = asked.groupBy("band", "key", "root").agg(F.count("*").alias("size"), *[F.sum(F.lit(1) if c is None else F.col(c)).alias(name) for c, name in zip(sides, of)])
    groups = counts.groupBy("band", "key").agg(F.max(F.struct("size", "root", *of)).alias("most"), F.sum("size").alias("n"), *[F.sum(c).alias(c) for c in of]).filter(F.col("most.size") < F.col("n"))
    side = lambda each: F.greatest(F.lit(1), *[F.ceil(each(c) / most) for c, most in zip(of, sides.values())]).cast("long")
    groups = settled(groups.select("band", "key", F.col("most.root").alias("main"), side(lambda c: F.col(c) - F.col(f"most.{c}")).alias("rows"), side(F.col).alias("columns")))
    members = asked.join(groups, ["band", "key"])
    members = members if more is None else members.join(more, "text_hash")
    number = lambda n: F.pmod(F.xxhash64("text_hash"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ["band", "key", *fields]
    left = members.filter(F.col("root") != F.col("main")).select(*kept, F.lit(True).alias("asks"), number(F.col("rows")).alias("i"), every("columns").alias("j"))
    right = members.select(*kept, F.lit(False).alias("asks"), number(F.col("columns")).alias("j"), every("rows").alias("i"))
    fields = fields | {"asks": "asks"}
    blocks = left.unionByName(right).groupBy("band", "key", "i", "j").agg(F.collect_list(F.struct(*fields)).alias("m"))
    return blocks.select("band", *[F.col(f"m.{x}").alias(y) for x, y in fields.items()])


def _only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of the texts for each key (text_hash) of a written table; texts of other keys are sifted out before any shuffle."""
    wanted, _ = sifted(texts, F.col("text_hash"), sieve(keys, "text_hash"))
    return wanted.join(keys, "text_hash").dropDuplicates(["text_hash"])


def _checked(texts: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v), of a written table, whose texts are alike."""
    ends = settled(pairs.select(F.col("u").alias("text_hash")).unionByName(pairs.select(F.col("v").alias("text_hash"))).distinct())
    held = settled(_only(texts, ends))
    sides = pairs.join(held.select(F.col("text_hash").alias("u"), F.col("text").alias("a")), "u").join(held.select(F.col("text_hash").alias("v"), F.col("text").alias("b")), "v")
    return settled(sides.mapInPandas(lambda x: _alike(x, words, similarity), "u long, v long"))


def similar_links(texts: DataFrame, words: int = 5, similarity: float = 0.8, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) over ``text_hash`` of texts whose shingle sets have a Jaccard similarity of at least ``similarity``.

    ``texts`` has text_hash and text; equal texts may repeat. The edges join
    all texts that such pairs join, but not every pair is an edge. Only pairs
    that share no band, or whose estimate is too low by SLACK, are not checked.
    A group that shares a band is first compared up to ``group`` texts; a larger
    one by further bands, in blocks. Then each group that is not yet one class
    of checked links is compared in blocks of ``block`` texts, every block with
    every other. Texts without words have no links.
    """
    signed = settled(texts.mapInPandas(lambda x: _signed_texts(x, words), "text_hash long, n_shingles long, sign binary, bands array<long>").dropDuplicates(["text_hash"]))
    keyed = signed.select("text_hash", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    # Most texts share no band: what is left is small beside the signatures, and written once for both uses.
    met = settled(keyed.join(sizes, ["band", "key"]))
    listed = F.sort_array(F.collect_list("text_hash")).alias("members")
    small = met.filter(F.col("n") <= group).groupBy("band", "key").agg(listed).select("members")
    # Of a larger group, each member goes to a part for each of the bands that follow; a part that is still too large is dealt out, otherwise in each band and step.
    band = lambda k: F.get("bands", (F.col("band") + k) % BANDS)
    parts = F.explode(F.array(*[F.xxhash64("band", "key", F.lit(k), band(k)) for k in range(1, FURTHER + 1)]))
    crowded = met.filter(F.col("n") > group).join(signed.select("text_hash", "bands"), "text_hash")
    parted = settled(crowded.select("text_hash", parts.alias("part")))
    counts = parted.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = F.xxhash64("part", F.pmod(F.xxhash64("text_hash", "part"), F.ceil(F.col("n") / group)))
    large = parted.join(counts, "part").groupBy(dealt.alias("block")).agg(listed).select("members").filter(F.size("members") > 1)
    # Most groups recur in many bands: each is compared once, and only then meets its signatures.
    groups = small.unionByName(large).distinct().select(F.xxhash64("members").alias("group"), F.explode("members").alias("text_hash"))
    compared = groups.join(signed.select("text_hash", "sign"), "text_hash").groupBy("group").agg(F.collect_list(F.struct("text_hash", "sign")).alias("members"))
    # Plain arrays: structs would become a Python object for each member.
    pairs = settled(compared.select(F.col("members.text_hash").alias("keys"), F.col("members.sign").alias("signs")).mapInPandas(lambda x: _group_links(x, similarity - SLACK), "u long, v long").distinct())
    first = _checked(texts, pairs, words, similarity)
    classes = components(first).select(F.col("vertex").alias("text_hash"), "root")
    placed = settled(met.join(classes, "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash")))
    # Of two texts in different classes, one at least is not in the group's largest class: only those ask, and all are asked.
    packed = F.unhex(F.array_join(F.transform("bands", lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    asked = placed.drop("n").join(signed.select("text_hash", (8 * F.col("n_shingles")).alias("bytes"), "sign", packed.alias("packed")), "text_hash")
    fields = {"text_hash": "keys", "root": "roots", "sign": "signs", "packed": "bands"}
    near = settled(_in_blocks(asked, {None: block}, fields).mapInArrow(lambda x: _candidates(x, similarity - SLACK), "band int, text_hash long").distinct())
    if near.isEmpty():
        return first
    # Only texts with a pair to be checked meet again, now with their shingles.
    sets = settled(_only(texts, settled(near.select("text_hash").distinct())).mapInPandas(lambda x: _with_sets(x, words), "text_hash long, set binary"))
    rest = _in_blocks(settled(asked.join(near, ["band", "text_hash"], "left_semi")), {None: block, "bytes": BLOCK_BYTES}, fields | {"set": "sets"}, sets)
    return first.unionByName(settled(rest.mapInArrow(lambda x: _unjoined(x, similarity), "u long, v long").distinct()))
