"""Language-model scores: the smoothed n-grams of the corpus as a weighted automaton with failure arcs.

The model is as large as the corpus makes it, so no task holds it whole. Texts
are packed in chunks; of each chunk the distinct n-grams go, sorted by hash and
cut by hash range, to the tasks that add them up over all chunks, and only the
totals come back, in the order of the request. With them a chunk builds the
part of the automaton that its own texts can reach, which scores them exactly
as the whole one would: a state is a history that was learnt, an arc a learnt
n-gram, and a failure arc leads to the history without its first word, at the
price of that history's smoothing weight. An n-gram comes once from each chunk,
however frequent it is, so no key is hot.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import settled, through_pandas

#: Words of the longest n-gram; one document in so many isn't learnt from; the addend of the base score.
ORDER, HELD_OUT, ADDEND = 3, 10, 0.1
#: Tokens of a chunk, above which it ends with the document; n-grams of one hash range, about; tokens of a lane.
CHUNK_TOKENS, RANGE_KEYS, LANE = 1_200_000, 1_000_000, 512
#: Bits of the hash that tells n-grams apart: words, and longer ones, on which only the model's weights rest.
WORD_BITS, GRAM_BITS = 64, 56
#: Numbers of the begin and the end of a text in every chunk; no word is spelled as they are.
BEGIN, END = 0, 1
_MARKS = (b"", b"\n")


def squeezed(a: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(_planes(a.astype(np.uint64)))


def spread(b: bytes) -> np.ndarray:
    return _unplaned(zstandard.ZstdDecompressor().decompress(b)).view(np.int64)


def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplaned(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


PACKED = "chunk long, doc_ids array<string>, held binary, sizes binary, ids binary, words binary, n_tokens long, n_train long, n_train_docs long"


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of texts as word numbers, with the hash of each word of a chunk; every text begins and ends with a mark."""

    def row(seq: int, ids: list[str], held: list[bool], parts: list[np.ndarray], vocabulary: dict[bytes, int]) -> pd.DataFrame:
        sizes = np.array([len(p) for p in parts])
        learnt = sizes[~np.array(held)]
        words = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
        made = (TaskContext.get().partitionId() << 32 | seq, ids, np.array(held, np.uint8).tobytes(), squeezed(sizes), squeezed(np.concatenate(parts)), words.tobytes(), int(sizes.sum() - len(sizes)), int(learnt.sum() - len(learnt)), len(learnt))
        return pd.DataFrame([made], columns=[c.split()[0] for c in PACKED.split(", ")])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq = 0

        def fresh():
            vocabulary = defaultdict(count().__next__)
            for mark in _MARKS:
                vocabulary[mark]
            return [], [], [], vocabulary, 0

        ids, held, parts, vocabulary, size = fresh()
        for b in batches:
            for key, out, t in zip(b["doc_id"], b["held"], b["text"]):
                words = (t or "").encode("utf-8", "surrogatepass").lower().split()
                part = np.empty(len(words) + 2, np.int32)
                part[0], part[-1] = BEGIN, END
                part[1:-1] = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
                ids.append(key)
                held.append(bool(out))
                parts.append(part)
                size += len(part)
                if size >= chunk_tokens:
                    yield row(seq, ids, held, parts, vocabulary)
                    seq += 1
                    ids, held, parts, vocabulary, size = fresh()
        if ids:
            yield row(seq, ids, held, parts, vocabulary)

    rest = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % HELD_OUT
    return docs.select(through_pandas(doc_id).alias("doc_id"), (rest == 0).alias("held"), F.col(text).alias("text")).mapInPandas(run, PACKED)


class Grams:
    """The n-grams of a chunk, order by order: sorted ``keys``, the place of one of each (``first``), their number at each place (``at``, else -1)."""

    def __init__(self, row) -> None:
        self.ids, self.sizes = spread(row.ids).astype(np.int32), spread(row.sizes)
        self.held = np.frombuffer(row.held, np.uint8).astype(bool)
        self.words = np.frombuffer(row.words, np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.keys, self.first, self.at = [], [], []

    def orders(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, places by key, begin of each key among them, whether each place is learnt from) of each order in turn."""
        hashes = self.words[self.ids]
        key, depth = hashes, np.arange(len(self.ids), dtype=np.int32) - np.repeat(self.starts, self.sizes).astype(np.int32)
        for n in range(order):
            where = np.flatnonzero(depth >= n).astype(np.int32)
            cut = key[where] >> np.uint64(64 - (GRAM_BITS if n else WORD_BITS))
            by = np.argsort(cut)
            cut, where = cut[by], where[by]
            begins = np.flatnonzero(np.concatenate(([True], cut[1:] != cut[:-1]))) if len(cut) else np.zeros(0, np.int64)
            yield cut[begins], where, begins, ~np.repeat(self.held, self.sizes)[where]
            if n < order - 1:
                key = _joined(np.roll(key, 1), hashes)

    def read(self, order: int) -> Grams:
        for keys, where, begins, _ in self.orders(order):
            at = np.full(len(self.ids), -1, np.int32)
            at[where] = np.repeat(np.arange(len(keys), dtype=np.int32), np.diff(np.append(begins, len(where))))
            self.keys.append(len(keys))
            self.first.append(where[begins])
            self.at.append(at)
        return self


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a history's hash and the next word's."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _requests(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """(n, part, chunk, keys, counts): of each chunk its n-grams by order and range of their hashes."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                for n, (keys, _, begins, learnt) in enumerate(Grams(row).orders(order)):
                    counts = np.add.reduceat(learnt, begins, dtype=np.int64) if len(keys) else begins
                    parts = (keys >> np.uint64((GRAM_BITS if n else WORD_BITS) - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(keys)]
                    made = [(n, int(parts[i]), row.chunk, _planes(np.diff(keys[i:j], prepend=np.uint64(0))), squeezed(counts[i:j])) for i, j in zip(cuts, cuts[1:])]
                    yield pd.DataFrame(made, columns=["n", "part", "chunk", "keys", "counts"])

    return chunks.select("chunk", "held", "sizes", "ids", "words").mapInPandas(run, "n int, part long, chunk long, keys binary, counts binary")


def _totals(requests: DataFrame) -> DataFrame:
    """(chunk, n, part, totals): the learnt count over all chunks of each n-gram asked for; and one row a range, without a chunk, that describes its n-grams."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asked = [np.cumsum(_unplaned(k)) for k in rows["keys"]]
        ends, keys = np.cumsum([len(a) for a in asked]), np.concatenate(asked)
        by = np.argsort(keys)
        keys = keys[by]
        begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        found = np.add.reduceat(np.concatenate([spread(c) for c in rows["counts"]])[by], begins)
        replies = np.empty(len(keys), np.int64)
        replies[by] = np.repeat(found, np.diff(np.append(begins, len(keys))))
        back = [squeezed(x) for x in np.split(replies, ends[:-1])]
        held = found[found > 0]
        power = np.frexp(held.astype(float))[1] - 1
        sums = np.zeros(64, np.int64)
        np.add.at(sums, power, held)
        kinds = np.concatenate((np.bincount(power, minlength=64), sums))
        made = [(c, key[0], key[1], t, None) for c, t in zip(rows["chunk"].tolist(), back)] + [(None, key[0], key[1], None, kinds)]
        return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in zip(("chunk", "n", "part", "totals", "kinds"), zip(*made))})

    return requests.groupBy("n", "part").applyInPandas(run, "chunk long, n int, part long, totals binary, kinds array<long>")


def _weight(once: float, histories: Sequence[tuple[float, float]]) -> float:
    """The smoothing weight K at which histories fail as often as n-grams were seen once: sum of c * K / (c + K) over them.

    A next word is new about as often as it was seen once (Good and Turing);
    ``histories`` has numbers of histories and their mean count c.
    """
    low, high = 1e-3, 1e6
    for _ in range(100):
        mid = math.sqrt(low * high)
        low, high = (mid, high) if sum(m * c * mid / (c + mid) for m, c in histories) < once else (low, mid)
    return low


class Weights:
    """What the automaton has of the whole corpus: learnt tokens, distinct ones, and a smoothing weight for each order."""

    def __init__(self, tokens: int, texts: int, kinds: dict[int, Sequence[int]], order: int) -> None:
        self.tokens = tokens
        self.distinct = sum(kinds.get(0, [])[:64]) - (texts > 0)
        classes = lambda n: [(a, b / a) for a, b in zip(kinds.get(n, [])[:64], kinds.get(n, [])[64:]) if a]
        self.smooth = [_weight(sum(kinds.get(n, [])[:1]), classes(n - 1) if n else [(1, tokens)] if tokens else []) for n in range(order)]


class Automaton:
    """The part of the model that a chunk's texts reach.

    State 0 is the empty history. ``arcs`` holds state * words + word in order;
    an arc has a log10 probability and a next state, a state a failure arc.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], weights: Weights) -> None:
        order, self.words = len(totals), int(grams.ids.max()) + 1
        begins = 1 + np.concatenate(([0], np.cumsum([len(t) for t in totals])))
        self.fail = np.zeros(int(begins[order - 1]), np.int64)
        self.fail_weight = np.zeros(len(self.fail))
        k = weights.smooth[0]
        least = k / (weights.distinct + 1)
        self.unknown = math.log10(least / (weights.tokens + k))
        arcs, weight, to = [], [], []
        below = np.zeros(0)
        for n, c in enumerate(totals):
            first = grams.first[n]
            if n:
                k = weights.smooth[n]
                history, suffix = grams.at[n - 1][first - 1], grams.at[n - 1][first]
                p = (c + k * below[suffix]) / (totals[n - 1][history] + k)
                source = begins[n - 1] + history
            else:
                p, source, suffix = (c + least) / (weights.tokens + k), np.zeros(len(c), np.int64), None
            states = begins[n] + np.arange(len(c))
            shorter = begins[n - 1] + suffix if n else np.zeros(len(c), np.int64)
            if n < order - 1:
                self.fail[states] = shorter
                self.fail_weight[states] = np.log10(weights.smooth[n + 1] / (c + weights.smooth[n + 1]))
            known = c > 0
            arcs.append((source * self.words + grams.ids[first])[known])
            weight.append(np.log10(p[known]))
            to.append((states if n < order - 1 else shorter)[known].astype(np.int32))
            below = p
        self.arcs = np.concatenate(arcs)
        del arcs, states, shorter, source, p, below
        by = np.argsort(self.arcs)
        self.arcs, self.weight, self.to = self.arcs[by], np.concatenate(weight)[by], np.concatenate(to)[by]
        self.order = order

    def scores(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
        """log10 probability of each text, read once from left to right from the state ``begin``; texts in lanes, which advance together.

        A long text is cut into lanes. A lane that begins within a text reads
        the words before it, as many as a history has, without counting them,
        and so stands where the text's own reading would.
        """
        cuts = [(d, s + i, min(s + z, s + i + LANE)) for d, (s, z) in enumerate(zip(starts.tolist(), sizes.tolist())) for i in range(0, z, LANE)]
        doc, a, z = (np.array(x, np.int64) for x in zip(*cuts))
        inner = a > starts[doc]
        lead = np.where(inner, np.minimum(self.order - 1, a - starts[doc]), 0)
        # The mark that begins a text is no token: the state after it is given.
        at = np.where(inner, a - lead, a + 1)
        state = np.where(inner, 0, begin)
        fresh = inner & (at == starts[doc])
        at[fresh] += 1
        lead[fresh] -= 1
        state[fresh] = begin
        by = np.argsort(at - z, kind="stable")
        doc, at, z, lead, state = doc[by], at[by], z[by], lead[by], state[by]
        total = np.zeros(len(doc))
        left = z - at
        live = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
        for step, n in enumerate(live.tolist()):
            word, counts = ids[at[:n] + step], step >= lead[:n]
            gained, todo = np.zeros(n), np.arange(n)
            while len(todo):
                key = state[todo] * self.words + word[todo]
                found = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
                met = self.arcs[found] == key if len(self.arcs) else np.zeros(len(todo), bool)
                gained[todo[met]] += self.weight[found[met]]
                state[todo[met]] = self.to[found[met]]
                todo = todo[~met]
                lost = state[todo] == 0
                gained[todo[lost]] += self.unknown
                todo = todo[~lost]
                gained[todo] += self.fail_weight[state[todo]]
                state[todo] = self.fail[state[todo]]
            total[:n] += np.where(counts, gained, 0)
        return np.bincount(doc, weights=total, minlength=len(starts))


SCORED = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", chunk_tokens: int = CHUNK_TOKENS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the texts whose crc32 of doc_id as text isn't divisible by
    HELD_OUT. Tokens are words, ASCII letters in lower case, and one end a
    text. A null text counts as empty; a null doc_id as an empty one, which is
    held out. Repeated rows are learnt and scored each. With nothing to learn
    from every score is 0. An empty table gives no rows; other columns are
    ignored. p(w | h) = (c(hw) + K * p(w | h')) / (c(h) + K), where h' lacks the
    first word of h and K is fitted for each order from the counts of counts.
    """
    chunks = settled(packed(docs, doc_id, text, chunk_tokens))
    sums = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_train", "n_train_docs")]).first()
    bits = max(0, math.ceil(math.log2(max(1, sums[0] / range_keys))))
    totals = settled(_totals(_requests(chunks, order, bits)))
    described = totals.filter("chunk IS NULL").select("n", F.posexplode("kinds")).groupBy("n", "pos").agg(F.sum("col").alias("x"))
    kinds: dict[int, list[int]] = {n: [0] * 128 for n in range(order)}
    for r in described.collect():  # 128 figures an order
        kinds[r["n"]][r["pos"]] = r["x"]
    weights = Weights(sums[1], sums[2], kinds, order)

    def run(key: tuple, chunk: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        row = next(chunk.itertuples())
        grams = Grams(row).read(order)
        replies = replies.sort_values(["n", "part"])
        found = [np.concatenate([spread(t) for t in replies["totals"][replies["n"] == n]] or [np.zeros(0, np.int64)]) for n in range(order)]
        auto = Automaton(grams, found, weights)
        c = found[0][grams.at[0]].astype(float)
        token = np.ones(len(c), bool)
        token[grams.starts] = False
        base = np.log10((c + ADDEND) / (weights.tokens + ADDEND * (weights.distinct + 1)))
        added = lambda x: np.add.reduceat(np.where(token, x, 0), grams.starts)
        mark = int(grams.at[0][grams.starts[0]])
        begin = 1 + mark if order > 1 and found[0][mark] else 0
        return pd.DataFrame({"doc_id": list(row.doc_ids), "held_out": grams.held, "n_tokens": grams.sizes - 1, "n_known": added(c > 0), "train_tokens": weights.tokens, "base_score": added(base), "score": auto.scores(grams.ids, grams.starts, grams.sizes, begin)})

    sent = chunks.select("chunk", "doc_ids", "held", "sizes", "ids", "words")
    got = totals.filter("chunk IS NOT NULL").select("chunk", "n", "part", "totals")
    out = sent.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInPandas(run, SCORED)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
