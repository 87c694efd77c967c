"""SentencePiece encoding and decoding by batched numpy Viterbi over the piece lattice.

Distinct words of equal length advance together, a character a step. Every
substring that may be a piece is looked up by a hash among the sorted keys of
the pieces, and each step keeps one backpointer a word. For a unigram model
the step takes the maximum of the summed scores. For a BPE model, whose scores
are only the order of merges, it takes the one piece that merging would leave
at the end of the prefix: the candidate that stands validly after the prefix's
own last piece. Both give the reference library's ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNIGRAM, BPE = 1, 2
#: Words kept with their ids between batches, and characters up to which a word is encoded with others.
CACHE, LONGEST = 400_000, 48
#: Bytes of text that are encoded at a time; a longer text is taken alone, whole.
PASS_BYTES = 2 << 20
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protocol-buffer message, as (number, value)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        elif tag & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if tag & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and settings of a SentencePiece model file with an identity normaliser."""
    pieces, scores, kinds, spec, norm = [], [], [], {}, {}
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
            kinds.append(own.get(3, 1))
        elif number == 2:
            spec = dict(_fields(value))
        elif number == 3:
            norm = dict(_fields(value))
    if norm.get(2) or norm.get(4, 1):
        raise ValueError("only models that keep white space and normalise nothing are supported")
    return {"pieces": pieces, "scores": scores, "kinds": kinds, "type": spec.get(3, UNIGRAM), "dummy": bool(norm.get(3, 1)), "digest": hashlib.sha256(data).hexdigest()}


def _hash(chars: np.ndarray) -> np.ndarray:
    """Prefix hashes of the rows of a matrix of code points, a row of results for each length."""
    out = np.zeros((chars.shape[1] + 1, chars.shape[0]), np.uint64)
    for i in range(chars.shape[1]):
        out[i + 1] = out[i] * _BASE + chars[:, i] + np.uint64(7)
    return out


class Lookup:
    """Values of unsigned 64-bit keys, for whole arrays of keys: spread, sorted, with the place where each range of high bits begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 18) -> None:
        keys = keys * _SPREAD
        order = np.argsort(keys)
        self.keys, self.values, self.shift = np.append(keys[order], np.uint64(0)), np.append(values[order], -1), np.uint64(64 - bits)
        bounds = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.begin = bounds.astype(np.int32)
        self.fine = np.uint64(64 - bits - 4)
        self.some = np.zeros(1 << (bits + 4), bool)
        self.some[(keys >> self.fine).astype(np.int64)] = True
        self.deepest = int(np.diff(np.append(bounds, len(keys))).max(initial=0))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        keys = keys * _SPREAD
        out = np.full(len(keys), -1, np.int64)
        open_ = np.flatnonzero(self.some[(keys >> self.fine).astype(np.int64)])
        keys = keys[open_]
        at = self.begin[(keys >> self.shift).astype(np.int64)]
        for _ in range(self.deepest):
            if not len(open_):
                break
            own = self.keys[at]
            found = own == keys
            out[open_[found]] = self.values[at[found]]
            more = own < keys
            open_, keys, at = open_[more], keys[more], np.minimum(at[more] + 1, len(self.keys) - 1)
        return out


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, model: dict) -> None:
        self.type, self.dummy, self.names = model["type"], model["dummy"], model["pieces"]
        kinds = model["kinds"]
        self.unknown = kinds.index(2)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.names, kinds)) if k == 6}
        self.control = {i for i, k in enumerate(kinds) if k == 3}
        usable = [i for i, k in enumerate(kinds) if k in (1, 4)]
        self.score = np.array(model["scores"], np.float64)
        self.least = min((self.score[i] for i in usable), default=0.0) - 10.0
        self.ids = {self.names[i]: i for i in usable}
        self.longest = max(map(len, self.ids), default=1)
        keys = np.array([self._key(p) for p in self.ids], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.piece_of = Lookup(keys, np.array(list(self.ids.values()), np.int64))
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        # Pieces of several characters hold none of the others, which therefore part words as spaces do.
        inner = re.escape("".join(sorted({c for p in self.ids if len(p) > 1 for c in p} - {SPACE}))) or "a"
        self.word = re.compile(f"{SPACE}+[{inner}]*|[{inner}]+|[^{inner}{SPACE}]")
        self.said = [b"" if i in self.control else p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(self.names)]
        for byte, i in self.bytes.items():
            self.said[i] = bytes([byte])
        self.bytes_of = pa.array(self.said, pa.binary())
        self._forget()
        if self.type == BPE:
            self._derive()

    @staticmethod
    def _key(piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * int(_BASE) + ord(c) + 7) % (1 << 64)
        return value

    def _derive(self) -> None:
        """For each piece the two that merging joins last, and all pairs that join, by sorted keys."""
        size = len(self.names)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size + 1, -np.inf)
        pairs = []
        reachable = np.ones(size + 1, bool)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                continue
            self.rank[i] = -self.score[i]
            pairs += [((self.ids[piece[:k]] << 32) | self.ids[piece[k:]], i) for k in range(1, len(piece)) if piece[:k] in self.ids and piece[k:] in self.ids]
            merged, last = self._merge(piece)
            if len(merged) > 1:
                reachable[i] = False
            else:
                self.left[i], self.right[i] = last
        self.reachable = reachable
        keys, joined = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        self.pair_of = Lookup(keys.astype(np.uint64), joined)

    def _merge(self, word: str) -> tuple[list[str], tuple[int, int] | None]:
        """Plain merging with a heap: the parts, and the ids joined last. For single words and for deriving pieces."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(parts) and (i := self.ids.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, b, parts[a], parts[b]))

        for a in range(len(word) - 1):
            offer(a)
        last = None
        while heap:
            _, a, b, x, y = heapq.heappop(heap)
            if parts[a] != x or parts[b] != y or after[a] != b:
                continue
            last = (self.ids.get(x, -1), self.ids.get(y, -1))
            parts[a], parts[b] = x + y, None
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        return [p for p in parts if p is not None], last

    def _joined(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the piece that x and y make; infinite if none. Unknown characters have id -1."""
        joined = self.pair_of(((x << 32) | y).astype(np.uint64))
        return np.where((joined >= 0) & (x >= 0) & (y >= 0), self.rank[joined], np.inf)

    def _valid(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the pieces a and b next to each other.

        Their histories are undone, the later merge first. While x and y stood
        side by side they must not have joined before either grew on; of equal
        ranks the left one goes first.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        grow_x, grow_y = np.full(len(a), np.inf), np.full(len(a), np.inf)
        while len(live):
            joined = self._joined(x, y)
            bad = (joined < grow_x) & (joined <= grow_y) & np.isfinite(joined)
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~bad & ((self.left[x] >= 0) & (x >= 0) | (self.left[y] >= 0) & (y >= 0))
            live, x, y, grow_x, grow_y, rx, ry = (v[more] for v in (live, x, y, grow_x, grow_y, rx, ry))
            undo = rx > ry
            grow_x, grow_y = np.where(undo, rx, grow_x), np.where(undo, grow_y, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, their number by word) for words of one length; -1 is an unknown character."""
        size, n = len(words[0]), len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.uint64)
        prefix = _hash(chars)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0.0
        taken, ids = np.zeros((size + 1, n), np.int64), np.full((size + 1, n), -1, np.int64)
        for end in range(1, size + 1):
            if self.type == BPE:
                self._last_merged(prefix, end, ids, taken)
                continue
            for length in range(min(end, self.longest), 0, -1):
                begin = end - length
                piece = self.piece_of(prefix[end] - prefix[begin] * self.powers[length])
                row = np.flatnonzero(piece >= 0) if length > 1 else np.arange(n)
                own = piece[row]
                value = best[begin, row] + np.where(own >= 0, self.score[own], self.least)
                up = value > best[end, row]
                row, own = row[up], own[up]
                best[end, row], taken[end, row], ids[end, row] = value[up], length, own
        steps, at, live = [], np.full(n, size), np.arange(n)
        while len(live):
            here = at[live]
            step = np.full(n, -2, np.int64)
            step[live] = ids[here, live]
            steps.append(step)
            at[live] = here - taken[here, live]
            live = live[at[live] > 0]
        path = np.stack(steps[::-1], axis=1)
        return path[path != -2], (path != -2).sum(axis=1)

    def _last_merged(self, prefix: np.ndarray, end: int, ids: np.ndarray, taken: np.ndarray) -> None:
        """Sets the last piece of each word's prefix up to ``end``: the only one that is valid, so short ones are tried first."""
        rows = np.arange(prefix.shape[1])
        for length in range(1, min(end, self.longest) + 1):
            begin = end - length
            piece = self.piece_of(prefix[end, rows] - prefix[begin, rows] * self.powers[length])
            at = np.flatnonzero((piece >= 0) & self.reachable[piece]) if length > 1 else np.arange(len(rows))
            if begin and len(at):
                at = at[self._valid(ids[begin, rows[at]], piece[at])]
            if len(at):
                taken[end, rows[at]], ids[end, rows[at]] = length, piece[at]
                rows = np.delete(rows, at)
                if not len(rows):
                    return

    def _spelled(self, word: str, ids: list[int]) -> list[int]:
        """Unknown characters as their bytes, or as the unknown id where the model has none."""
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in word[at].encode("utf-8", "replace")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at += 1 if i < 0 else len(self.names[i])
        return out

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.flat, self.sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def _put(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        if len(flat) and flat.min() < 0:
            ends = np.cumsum(sizes)
            parts = [x if x.min() >= 0 else np.array(self._spelled(w, x.tolist())) for w, x in zip(words, np.split(flat, ends[:-1]))]
            flat, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
        self.cache.update(zip(words, range(len(self.cache), len(self.cache) + len(words))))
        self.flat.append(flat.astype(np.int32))
        self.sizes.append(sizes)

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words that the cache lacks: those of one length together, runs of spaces and very long words by plain merging."""
        groups: dict[int, list[str]] = {}
        for w in words:
            plain = self.type == BPE and (len(w) > LONGEST or w.startswith(SPACE * 2))
            groups.setdefault(0 if plain else len(w), []).append(w)
        for w in groups.pop(0, []):
            ids = [self.ids.get(p, -1) for p in self._merge(w)[0]]
            self._put([w], np.array(ids, np.int64), np.array([len(ids)]))
        for size, group in groups.items():
            most = 8_000 if size <= LONGEST else 16
            for a in range(0, len(group), most):
                self._put(group[a : a + most], *self.lattice(group[a : a + most]))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts; a null or empty text has no ids."""
        if len(self.cache) > CACHE:
            self._forget()
        split = [self.word.findall((SPACE if self.dummy else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        every = list(chain.from_iterable(split))
        self.learn(set(every).difference(self.cache))
        self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        flat, sizes = self.flat[0], self.sizes[0]
        index = np.fromiter(map(self.cache.__getitem__, every), np.int64, len(every))
        n = sizes[index]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[index] - total[:-1], n) + np.arange(total[-1])]
        return total[np.concatenate(([0], np.cumsum([len(ws) for ws in split], dtype=np.int64)))], ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids: bytes are put together, control pieces say nothing."""
        text = b"".join(map(self.said.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


    def decoded(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of all id lists at once: the pieces' bytes are taken and joined as arrays."""
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), self.bytes_of.take(pa.array(ids)))
        try:
            texts = pc.binary_join(lists, b"").cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no text
            return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])], pa.string())
        return pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts) if self.dummy else texts


_LOADED: dict[tuple[str, int], Pieces] = {}


def loaded(model: dict) -> Pieces:
    """The encoder of a model, built once in each Python worker."""
    key = (model["digest"], model["type"])
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", decoded: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) per row of docs, by the model at ``path`` (read on the driver).

    With a name in ``decoded``, a column of that name has the text that the ids
    decode to, from the same pass: a second one would take another Python
    worker for each task. A null or empty text has no ids. Texts are taken whole; repeated rows are
    encoded alike; other columns are ignored; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_model(path or default_path()))
    names = ["doc_id", "ids", *([decoded] if decoded else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(held.value)
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            begin = 0
            while begin < b.num_rows:
                end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + PASS_BYTES, "right")))
                part = b.slice(begin, end - begin)
                offsets, ids = pieces.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                columns = [part.column("doc_id"), lists]
                if decoded:
                    columns.append(pieces.decoded(offsets, ids))
                yield pa.RecordBatch.from_arrays(columns, names)
                begin = end

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in ``out``; null ids give null. Decoding what encode gave returns the text, but for U+2581, which reads as a space."""
    held = encoded.sparkSession.sparkContext.broadcast(read_model(path or default_path()))

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = loaded(held.value | {"type": UNIGRAM})
        for b in batches:
            yield b.map(lambda x: None if x is None else pieces.decode(x.tolist()))

    return encoded.withColumn(out, texts(F.col(ids)))
