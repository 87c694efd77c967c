"""Fingerprints, components, repeated strings and the pipeline against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from reviewlake.llm import components, repeats, simhash, similar
from tests.llm.conftest import SF


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, k, radius=3):
    fps = [brute_fingerprint(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("table", ["rough", "documents"])
def test_near_duplicates(request, table):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex().alias("f"), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3)


def brute_keepers(rows):
    """The smallest doc_id of each group of near copies: near-equal fingerprints, or shingle sets alike to 0.8."""
    fps = [brute_fingerprint(t, 5) for _, t in rows]
    sets = [set(similar.shingles(t, 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if (fps[i] ^ fps[j]).bit_count() <= 3 or shared and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
            root[find(i)] = find(j)
    groups: dict = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [min((d for d in g if d is not None), default=None) for g in groups.values()]


@pytest.mark.parametrize("group", [500, 4])
def test_similar_links(spark, group):
    """Edits that leave four fifths of the shingles and more, found in whole and in parted groups; others are left alone."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(6):
        base = [r.choice(words) for _ in range(200)]
        for edits in (0, 1, 2, 3, 4, 20, 30):
            copy = base[:]
            for k in r.sample(range(200), edits):
                copy[k] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "text_hash long, text string")
    got = components.components(similar.similar_links(df, 5, 0.8, group)).collect()
    sets = [set(similar.shingles(t, 5).tolist()) for _, t in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    expected = components.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))
    assert similar.similar_links(df.limit(0)).count() == 0


def near_threshold(families):
    """Families of 40 texts near 0.79, some pairs of which reach 0.80: (text_hash, text) and the alike pairs."""
    r = random.Random(17)
    words, texts = [f"w{i}" for i in range(5000)], []
    for _ in range(families):
        base = [r.choice(words) for _ in range(1000)]
        places = r.sample(range(6, 994, 2), 480)
        for n in range(40):
            own = set()
            while len(own) < (11 if n < 2 else 12):
                k = r.choice(places)
                if all(abs(k - x) > 5 for x in own):
                    own.add(k)
            texts.append(" ".join(r.choice(words) if k in own else w for k, w in enumerate(base)))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    sets = [set(similar.shingles(t, 5).tolist()) for _, t in rows]
    return rows, {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def test_similar_links_near_the_threshold(spark):
    """A true link is found where both of its texts are more like others by estimate, and those are no copies."""
    rows, pairs = near_threshold(5)
    got = components.components(similar.similar_links(spark.createDataFrame(rows, "text_hash long, text string"))).collect()
    expected = components.components(spark.createDataFrame(sorted(pairs), "u long, v long")).collect()
    assert len(pairs) >= 5 and sorted(map(tuple, got)) == sorted(map(tuple, expected))


def test_similar_links_in_crowded_groups(spark):
    """Groups beyond the bound, and classes beyond a block, lose no link."""
    rows, pairs = near_threshold(5)
    got = components.components(similar.similar_links(spark.createDataFrame(rows, "text_hash long, text string"), group=4, block=7)).collect()
    expected = components.components(spark.createDataFrame(sorted(pairs), "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))


def test_estimates_tell_long_texts_apart():
    r = random.Random(4)
    one, other = ("".join(f"w{r.randrange(9999)} " for _ in range(1000)) for _ in range(2))
    a, b = (np.frombuffer(next(similar._signed_texts([pd.DataFrame({"text_hash": [1], "text": [t]})], 5))["sign"][0], np.uint8) for t in (one, other))
    assert (a == b).mean() < 0.1


def test_near_duplicates_of_nothing(nothing, rough):
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(rough)
    assert kept.columns == rough.columns
    rows = [(r.doc_id, r.text) for r in rough.select("doc_id", "text").collect()]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(brute_keepers(rows), key=str)


def test_masks_cover():
    masks = simhash.covering_masks(list(range(64)), 3)
    assert len(masks) == 15 and all(any(not m & d for m in masks) for d in (1 << a | 1 << b | 1 << c for a, b, c in itertools.combinations(range(64), 3)))


def test_large_buckets_lose_no_link(spark):
    r = random.Random(1)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(300)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    same = lambda e: sorted(map(tuple, components.components(e).collect()))
    pairs = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 3]
    expected = same(spark.createDataFrame(pairs, "u long, v long"))
    for bucket in (2, 10, 5000):
        assert same(simhash.fingerprint_links(df, 3, bucket)) == expected


@pytest.mark.parametrize("most", [1 << 27, 1 << 15])
def test_sieve_loses_no_key(spark, most):
    from reviewlake.llm.sieve import sieve, sifted

    r = random.Random(3)
    keys = [r.randrange(-(2**63), 2**63) for _ in range(3000)] + [0, -1, -(2**63), 2**63 - 1]
    others = [r.randrange(-(2**63), 2**63) for _ in range(3000)]
    rows = spark.createDataFrame([(k,) for k in [*keys, *others, None]], "k long")
    may, clear = sifted(rows, F.col("k"), sieve(spark.createDataFrame([(k,) for k in [*keys, None]], "k long"), "k", most))
    may, clear = [x.k for x in may.collect()], [x.k for x in clear.collect()]
    assert set(keys) <= set(may) and None in clear and len(may) + len(clear) == len(keys) + len(others) + 1
    assert len(clear) > (2900 if most > 1 << 15 else 2400)
    may, clear = sifted(rows, F.col("k"), sieve(rows.limit(0), "k"))
    assert may.count() == 0 and clear.count() == rows.count()


def test_long_chains_and_stars(spark):
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    star = spark.range(1001, 1200).select(F.col("id").alias("u"), F.lit(1000).cast("long").alias("v"))
    got = components.components(chain.unionByName(star)).groupBy("root").count().collect()
    assert {(r.root, r["count"]) for r in got} == {(0, 201), (1000, 200)}
    assert components.components(chain.limit(0)).count() == 0


def brute_repeats(docs, size):
    """docs: (doc_id, bytes); a null doc_id comes first."""
    order = lambda d: (d is not None, d or 0)
    first: dict = {}
    for d, t in sorted(docs, key=lambda x: order(x[0])):
        for p in range(len(t) - size + 1):
            key = t[p : p + size]
            first[key] = min(first.get(key, (order(d), p)), (order(d), p))
    out = []
    for d, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - size + 1):
            if first[t[p : p + size]] < (order(d), p):
                gone[p : p + size] = True
        runs = int((np.diff(np.concatenate(([0], gone.view(np.int8), [0]))) == 1).sum())
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("table,size,seed", [("rough", 100, 32), ("documents", 100, 32), ("rough", 20, 5)])
def test_repeats(request, table, size, seed):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    got = repeats.without_repeats(docs, size, seed).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, size)


def test_repeats_fuzz(spark, nothing):
    r = random.Random(5)
    for trial in range(4):
        size, seed = r.choice([(20, 6), (12, 12), (30, 5), (100, 32)])
        pool = ["".join(r.choices("abc", k=r.randint(0, 3 * size))) for _ in range(4)]
        rows = [(i, "".join(r.choice(pool)[r.randint(0, 5) :] for _ in range(r.randint(0, 4)))) for i in range(12)]
        got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), size, seed).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute_repeats([(d, t.encode()) for d, t in rows], size)
    assert repeats.without_repeats(nothing).count() == 0


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(0)
    for _ in range(100):
        data = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(0, 400)).astype(np.uint8)
        h, anchor, first, last = repeats.anchors(data, 20, 6)
        seeds = repeats._seed_hashes(data, 6)
        assert np.repeat(anchor, last - first + 1).tolist() == [p + int(np.argmin(seeds[p : p + 15])) for p in range(max(0, len(data) - 19))]


def test_pipeline(spark):
    """Each stage takes what the one before kept; what it drops is what brute force drops."""
    cp = pytest.importorskip("corpus_pipeline")
    import sentencepiece

    from reviewlake.llm import lines, pieces, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in cp.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF).cache())
        assert seen[-1].columns == docs.columns, name
    start, good, lined, single, clean = ([tuple(r) for r in x.select("doc_id", "text").collect()] for x in seen)
    verdict = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert {d for d, _ in good} == {d for d, _ in start if verdict[d]}
    assert sorted(lined) == sorted((r.doc_id, r.text) for r in lines.drop_boilerplate(seen[1]).collect())
    assert all(r.n_chars == len(r.text) for r in seen[2].collect())
    assert {d for d, _ in single} == set(brute_keepers(lined))
    assert {d for d, _ in clean} <= {d for d, _ in single}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    assert {r.doc_id: list(r.ids) for r in cp.run(spark, SF).collect()} == {d: sp.encode(t) for d, t in clean}


@pytest.mark.parametrize("k", range(5))
def test_stages_take_rough_and_empty_tables(spark, rough, nothing, k):
    """Nulls in any column, very long texts, ties, repeated rows, clashing names and no rows: each stage has a result."""
    cp = pytest.importorskip("corpus_pipeline")
    name, stage = cp.STAGES[k]
    bare = rough.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (rough, bare):
        out = stage(spark, docs, SF)
        n = out.count()
        assert name == "tokenize" or out.columns == docs.columns
        assert n == docs.count() if name in ("line_dedup", "tokenize") else 0 < n <= docs.count()
    assert stage(spark, nothing, SF).count() == 0
