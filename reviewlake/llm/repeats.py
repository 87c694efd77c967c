"""Exact removal of repeated byte strings by sorting sampled suffixes.

A window is ``size`` bytes; a byte goes if a window over it also starts
earlier (smaller doc_id, or the same document and an earlier place).

1.  Anchors. Each window is assigned to the place in it whose ``SEED`` bytes
    hash lowest (the leftmost of equals), which depends on the window's bytes
    alone: equal windows have equal anchors at equal offsets. Neighbouring
    windows share an anchor, so the suffixes that need sorting are a few
    hundredths of all.
2.  Filter. Anchors are range-partitioned by sampled splitters on their hash
    and sorted; only those whose hash has a neighbour of equal hash go on. The
    splitters may cut through one hash: the first and the last hash of each
    partition always go on, whatever the next partition holds.
3.  Suffixes. The suffixes at the remaining anchors are range-partitioned by
    sampled splitters on their leading bytes (and document, so that a frequent
    beginning spreads over buckets). Equal suffixes that one map task
    holds are combined before, so a passage with many copies arrives as a few
    rows. Within a bucket, multikey quicksort orders the suffixes to the right
    of the anchors, and the reversed prefixes to their left, by eight bytes at
    a time. A window with ``o`` bytes before the anchor equals another if both
    share ``size - o`` bytes to the right and ``o`` to the left, that is, if
    they lie in the same run of either order: runs are compared as numbers.
4.  Boundaries. The first and the last group of equal beginnings in a bucket may
    go on in its neighbours, and a very large one is not held in memory. Their
    windows are compared across buckets by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a window, and of the string whose hash makes an anchor.
SIZE, SEED = 100, 32
#: Bytes of text that are hashed at a time, and rows of a bucket that are sorted at a time (whole groups of equal seeds).
PASS_BYTES, SORT_ROWS = 1 << 16, 60_000
#: Rows of one group of equal leading bytes that are held and sorted; a larger group is compared window by window.
MOST_ROWS = 200_000

_MIX = np.uint64(0xD6E8FEB86659FD93)
_RANDOM = np.random.default_rng(20240601).integers(0, 2**64, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


_FORWARD, _BACKWARD = _powers(_STEP, PASS_BYTES * 2), _powers(_BACK, PASS_BYTES * 2)


def _seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the ``seed`` bytes from each place, by differences of running sums; blockwise for long data."""
    n = len(data) - seed + 1
    out = np.empty(max(n, 0), np.uint64)
    for a in range(0, n, PASS_BYTES):
        part = data[a : a + PASS_BYTES + seed - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_RANDOM[part] * _BACKWARD[: len(part)], out=sums[1:])
        h = (sums[seed:] - sums[:-seed]) * _FORWARD[: len(part) - seed + 1]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        out[a : a + len(h)] = h
    return out


def anchors(data: np.ndarray, size: int = SIZE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, first window, last window) for each run of windows of one text with one anchor."""
    if len(data) < size:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    h = _seed_hashes(data, seed)
    width = size - seed + 1
    n = len(h) - width + 1
    rows = -(-len(h) // width)
    padded = np.full(rows * width, np.uint64(2**64 - 1))
    padded[: len(h)] = h
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    # A window's anchor is the first place from it on that holds its least hash; only places that are some window's least come in question.
    held = _is_least(h, least, width)
    candidate = np.flatnonzero(held)
    at = np.cumsum(held)[:n] - held[:n]
    anchor = candidate[at]
    wrong = np.flatnonzero(h[anchor] != least)
    while len(wrong):
        at[wrong] += 1
        anchor[wrong] = candidate[at[wrong]]
        wrong = wrong[h[anchor[wrong]] != least[wrong]]
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    return h[anchor[first]], anchor[first], first, last


def _is_least(h: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash equals the least of a window over them: of the greatest minimum over the windows that hold them."""
    n = len(h)
    padded = np.zeros(n + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    total = len(padded)
    rows = -(-total // width)
    wide = np.zeros(rows * width, np.uint64)
    wide[:total] = padded
    blocks = wide.reshape(rows, width)
    ahead = np.maximum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    most = np.maximum(behind[:n], ahead[width - 1 : width - 1 + n])
    return h <= most


def multikey(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): the rows of a matrix of words in order, and the words that each shares with the one before it.

    Multikey quicksort, a word a step: rows equal so far are parted by the
    next word; a row that stands alone is not looked at again.
    """
    n, width = words.shape
    order, shared = np.arange(n), np.full(n, width, np.int64)
    group, active = np.zeros(n, np.int64), np.arange(n)
    for k in range(width):
        rows = order[active]
        by = np.lexsort((words[rows, k], group[active]))
        rows = rows[by]
        order[active] = rows
        key, together = words[rows, k], group[active]
        same = np.concatenate(([False], together[1:] == together[:-1]))
        new = same & np.concatenate(([False], key[1:] != key[:-1]))
        shared[active[new]] = k
        starts = np.where(~same | new, active, 0)
        group[active] = np.maximum.accumulate(starts)
        first = ~same | new
        alone = first & np.concatenate((first[1:], [True]))
        active = active[~alone]
        if not len(active):
            break
    if n:
        shared[0] = 0
    return order, shared


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    """The strings as rows of big-endian words, filled up with zero bytes."""
    width = max(8, -(-width // 8) * 8)
    return np.array(parts, dtype=f"S{width}").view(np.uint8).reshape(len(parts), width).view(">u8").astype(np.uint64) if parts else np.zeros((0, width // 8), np.uint64)


def _common(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bytes shared with the row before) of the rows."""
    order, shared = multikey(words)
    out = shared * 8
    at = np.flatnonzero(shared[1:] < words.shape[1]) + 1
    k = shared[at]
    apart = (words[order[at], k] ^ words[order[at - 1], k]).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
    out[at] += apart.argmax(axis=1)
    return order, out


def _runs(order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """For each row the number of its run of rows that share ``least`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < least)
    return out


def bucket_spans(doc: np.ndarray, anchor: np.ndarray, right: list[bytes], left: list[bytes], size: int = SIZE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes under windows that start earlier too, for whole groups of equal seeds.

    Row i stands for the windows of its document with ``o`` bytes before the
    anchor, where size - len(right) <= o <= len(left); left is reversed.
    """
    by = np.lexsort((anchor, doc))
    doc, anchor = doc[by], anchor[by]
    right, left = [right[i] for i in by], [left[i] for i in by]
    least_o = size - np.fromiter(map(len, right), np.int64, len(right))
    most_o = np.fromiter(map(len, left), np.int64, len(left))
    ranked_right, ranked_left = _common(_matrix(right, size)), _common(_matrix(left, size - seed))
    out = []
    open_from = np.full(len(doc), -1, np.int64)
    for o in range(size - seed + 2):
        gone = np.zeros(len(doc), bool)
        rows = np.flatnonzero((least_o <= o) & (o <= most_o))
        if len(rows) > 1:
            key = (_runs(*ranked_right, size - o)[rows] << 32) | _runs(*ranked_left, o)[rows]
            _, first, of = np.unique(key, return_index=True, return_inverse=True)
            origin = rows[first][of]
            gone[rows] = (doc[rows] != doc[origin]) | (anchor[rows] != anchor[origin])
        begun, ended = gone & (open_from < 0), ~gone & (open_from >= 0)
        if ended.any():
            i = np.flatnonzero(ended)
            out.append((by[i], anchor[i] - (o - 1), anchor[i] - open_from[i] + size))
            open_from[i] = -1
        open_from[begun] = o
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


#: Bits for the places of a run within a packed long, and those of an anchor's hash that the filter does without: what it lets pass is compared.
_SPAN, _SPARED = 10, np.uint64(20)
#: Stands for no doc_id, before all others.
_NO_ID = -(2**63)


def _anchor_rows(batches: Iterable[pd.DataFrame], size: int, seed: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        found, keys = [], []
        for d, t in zip(b["d"], b["text"]):
            data = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            for a in range(0, max(1, len(data) - size + 1), PASS_BYTES):
                # Pieces of a long text overlap by all but one byte of a window: each window falls into one piece.
                h, anchor, first, last = anchors(data[a : a + PASS_BYTES + size - 1], size, seed)
                if len(h):
                    found.append((h >> _SPARED, ((first + a) << (2 * _SPAN)) | ((last - first) << _SPAN) | (anchor - first)))
                    keys.append(np.full(len(h), d, np.int64))
        if found:
            yield pd.DataFrame({"h": np.concatenate([x for x, _ in found]).view(np.int64), "d": np.concatenate(keys), "at": np.concatenate([x for _, x in found])})


def _repeated(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by h those whose h a neighbour has, and the first and last h whatever their neighbours."""
    tail, first = None, True
    for b in batches:
        if not len(b):
            continue
        h = b["h"].to_numpy()
        if tail is not None:
            b = pd.concat([tail, b], ignore_index=True)
            h = b["h"].to_numpy()
        same = h[1:] == h[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if first:
            keep |= h == h[0]
        elif tail_sent:
            keep[0] = False  # sent with its group before
        first = False
        # The last row waits for the next batch, if it has not already been sent.
        tail, tail_sent = b.iloc[-1:], bool(keep[-1]) or (len(b) == 1 and tail_sent)
        yield b.loc[keep, ["d", "at"]]
    if tail is not None and not tail_sent:
        yield tail[["d", "at"]]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _suffix_rows(batches: Iterable[pd.DataFrame], size: int, seed: int, held: int = 100_000) -> Iterator[pd.DataFrame]:
    """Windows' bytes around the anchors of each document; copies of what this task saw earlier become spans at once.

    Rows to sort have the bytes in ``whole``, their place in ``start`` and the
    anchor's place in them in ``at``; settled rows have a span in ``start`` and
    ``end`` instead. ``lead`` is the first bytes at the anchor, or spreads
    settled rows over the buckets.
    """
    seen: dict[bytes, tuple[int, int]] = {}
    for b in batches:
        rows = []
        for d, th, t, places in zip(b["d"], b["th"], b["text"], b["places"]):
            data = t.encode("utf-8", "surrogatepass")
            settled = []
            for at in np.unique(places).tolist():
                first = at >> (2 * _SPAN)
                last, inner = first + (at >> _SPAN & (1 << _SPAN) - 1), at & (1 << _SPAN) - 1
                whole = data[first : last + size]
                if len(whole) < last + size - first:
                    continue  # of a text that shares this one's key
                key = hashlib.blake2b(whole, digest_size=16, salt=inner.to_bytes(2, "little")).digest()
                origin = seen.get(key)
                if origin is not None and origin < (d, first):
                    settled.append((first, last + size))
                    continue
                if len(seen) >= held:
                    seen.clear()
                seen[key] = (d, first)
                rows.append((d, th, first, 0, inner, whole))
            rows += [(d, th, start, end, int.from_bytes(hashlib.blake2b(b"%d %d" % (d, start), digest_size=3).digest(), "little"), None) for start, end in _merged(settled)]
        if rows:
            yield pd.DataFrame(rows, columns=["d", "th", "start", "end", "at", "whole"])


def _windows(rows: Iterable[tuple], size: int, seen: dict[bytes, tuple[int, int]], held: int) -> Iterator[tuple]:
    """Each window of the rows by its digest; those of which this task saw an earlier one become spans at once."""
    for d, th, first, whole in rows:
        settled = []
        for k in range(len(whole) - size + 1):
            key = hashlib.blake2b(whole[k : k + size], digest_size=16).digest()
            origin = seen.get(key)
            if origin is not None and origin < (d, first + k):
                settled.append((first + k, first + k + size))
                continue
            if len(seen) >= held:
                seen.clear()
            seen[key] = (d, first + k)
            yield d, th, first + k, first + k + size, key
        for start, end in _merged(settled):
            yield d, th, start, end, None


def _bucket_rows(batches: Iterable[pd.DataFrame], size: int, seed: int, most: int = MOST_ROWS, held: int = 200_000) -> Iterator[pd.DataFrame]:
    """Spans from rows sorted by their leading bytes, and window digests where a group may go on in another bucket.

    Whole groups of equal leads are sorted together, many at a time. The first
    and the last group of a bucket may be cut by a splitter, and a group of
    more than ``most`` rows is not held: their windows are compared by digest
    across buckets instead.
    """
    columns = ["d", "th", "start", "end", "digest"]
    seen: dict[bytes, tuple[int, int]] = {}

    def sorted_(rows: list[tuple]) -> pd.DataFrame:
        d, start, at = (np.fromiter((r[k] for r in rows), np.int64, len(rows)) for k in (0, 2, 3))
        row, a, b = bucket_spans(d, start + at, [r[4][r[3] :] for r in rows], [r[4][: r[3]][::-1] for r in rows], size, seed)
        th = np.fromiter((r[1] for r in rows), np.int64, len(rows))
        return pd.DataFrame({"d": d[row], "th": th[row], "start": a, "end": b, "digest": None})

    def compared(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        for a in range(0, len(rows), 1000):
            out = list(_windows(((d, th, first, whole) for d, th, first, _, whole in rows[a : a + 1000]), size, seen, held))
            if out:
                yield pd.DataFrame(out, columns=columns)

    group: list[tuple] = []
    whole_groups: list[tuple] = []
    lead, first, large = None, True, False
    for b in batches:
        done = b["whole"].isna()
        if done.any():
            yield b.loc[done, ["d", "th", "start", "end"]].assign(digest=None)
        for r in b.loc[~done, ["d", "th", "start", "at", "whole"]].itertuples(index=False, name=None):
            own = r[4][r[3] : r[3] + seed]
            if own != lead:
                if first or large:
                    yield from compared(group)
                    first = first and lead is None
                else:
                    whole_groups += group
                    if len(whole_groups) >= SORT_ROWS:
                        yield sorted_(whole_groups)
                        whole_groups = []
                group, lead, large = [], own, False
            group.append(r)
            if len(group) >= most:
                large = True
                yield from compared(group)
                group = []
    yield from compared(group)
    if whole_groups:
        yield sorted_(whole_groups)


def _kept(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed runs)."""
    runs = _merged(spans)
    edges = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), sum(b - a for a, b in runs), len(runs)


def without_repeats(docs: DataFrame, size: int = SIZE, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the bytes left).

    Texts are taken as UTF-8, whole, and windows never cross documents. A null
    text counts as empty; texts under ``size`` bytes lose nothing. Rows with
    one doc_id are one document to the order: a window at the same place of
    both is not earlier. A null doc_id comes before all others. Other columns
    are ignored; an empty table gives no rows. With a seed of up to ``size``
    bytes the result is the same for any seed.
    """
    prepared = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    # All rows without a doc_id are one document to the order, but not one group: there only equal texts are.
    group = F.when(F.col("d") == _NO_ID, F.xxhash64("th")).otherwise(F.col("d"))
    # Both joins deal the same columns by the same key, so that Spark shuffles the texts once for both.
    prepared = prepared.select("d", "th", "text", group.alias("g"))
    anchored = prepared.select(F.col("g").alias("d"), "text").mapInPandas(lambda x: _anchor_rows(x, size, seed), "h long, d long, at long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    again = anchored.repartitionByRange(n, "h", "d").sortWithinPartitions("h").mapInPandas(_repeated, "d long, at long")
    places = again.groupBy(F.col("d").alias("g")).agg(F.collect_list("at").alias("places"))
    suffixes = prepared.join(places, "g").select("d", "th", "text", "places").mapInPandas(lambda x: _suffix_rows(x, size, seed), "d long, th long, start int, end int, at int, whole binary")
    # Settled rows have no bytes to sort by: a number spreads them.
    lead = F.coalesce(F.expr(f"substring(whole, at + 1, {seed})"), F.unhex(F.lpad(F.hex("at"), 6, "0")))
    found = suffixes.repartitionByRange(n, lead, "d").sortWithinPartitions(lead, "d", "start").mapInPandas(lambda x: _bucket_rows(x, size, seed), "d long, th long, start long, end long, digest binary")
    # Windows of cut or large groups: all but the earliest of each digest go. Their tasks have combined equal ones before.
    key = F.coalesce("digest", F.unhex(F.lpad(F.hex(F.xxhash64("d", "start", "end")), 16, "0")))
    earliest = F.min(F.when(F.col("digest").isNotNull(), F.struct("d", "start"))).over(Window.partitionBy("key"))
    spans = found.withColumn("key", key).withColumn("earliest", earliest).filter(F.col("digest").isNull() | (F.struct("d", "start") > F.col("earliest")))
    by_doc = spans.groupBy(group.alias("g")).agg(F.collect_list(F.struct("th", "start", "end")).alias("spans"))

    def finish(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, th, t, found in zip(b["d"], b["th"], b["text"], b["spans"]):
                data = t.encode("utf-8", "surrogatepass")
                kept, gone, runs = _kept(data, [(s["start"], s["end"]) for s in found if s["th"] == th] if found is not None else [])
                rows.append((d, len(data), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = prepared.join(by_doc, "g", "left").select("d", "th", "text", "spans").mapInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))
