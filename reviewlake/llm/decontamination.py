"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with
other values has the same template. Windows of five template tokens of the
texts are hash-joined with those of the benchmark; where enough windows of an
item line up, the slots must be filled consistently. Since case tells names,
texts are also read without it, names as literal words: a copy in other letter
case is found so. A third way takes neighbouring slots of one type as one, so
that a value may have another number of words.

Of an item's D windows, S must be found, so of any D - S + 1 of them one at
least: those that the fewest items have are its marks, and only marks are
joined. A bitmap of bounded size keeps the other windows of the texts from the
join. Texts and items that share a mark then meet and are compared whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import settled, through_pandas
from reviewlake.llm.sieve import packed, sieve, sifted

#: Words of a window, the share of an item's windows that must be found, and the share of its slots that must agree.
WORDS, SIMILARITY, CONSISTENT = 5, 0.8, 0.8
#: Bytes of text that are read at a time; a longer text is taken alone, whole.
PASS_BYTES = 2 << 20
#: Items that a text meets in one row; with more it is sent several times.
MEETS = 64
#: Words kept with their codes between passes.
CACHE = 500_000

TOKEN = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+(?:['’-][^\W\d_]+)*|[%°€$£¥]")
LITERAL, NUMBER, NAME, UNIT = range(4)

#: Number words, and units that count as such after a number.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kmh w kw v a hz".split())
SIGNS = frozenset("%°€$£¥")

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Ways to read a text: with all placeholders; with names as literal words, whatever their case; with neighbouring slots of one type as one; word for word.
TYPED, FOLDED, JOINED, WHOLE = range(4)
_WAY = [np.uint64(xxhash.xxh64_intdigest(f"way {k}")) for k in (TYPED, FOLDED, JOINED, WHOLE)]
_SLOT = {k: np.uint64(xxhash.xxh64_intdigest(f"<{k}>")) for k in (NUMBER, NAME, UNIT)}


def kind(word: str) -> int:
    """The slot type of one token; UNIT for words holds only right after a number."""
    if word[0].isdigit() or word.lower() in NUMBER_WORDS:
        return NUMBER
    if word in SIGNS or word.lower() in UNITS:
        return UNIT
    return NAME if word[0].isupper() and len(word) > 1 and word[1:] != word[1:].upper() else LITERAL


class View(NamedTuple):
    """Texts read in one way: template hashes, slot types and texts of their places, and the token each begins with (None: one token a place)."""

    hashes: np.ndarray
    kinds: np.ndarray
    text: np.ndarray
    first: np.ndarray | None = None

    def values(self, tokens: list[str]) -> list[str]:
        """What stands at each place, without case."""
        if self.first is None:
            return [w.casefold() for w in tokens]
        cuts = [*self.first.tolist(), len(tokens)]
        return [" ".join(tokens[a:b]).casefold() for a, b in zip(cuts, cuts[1:])]


class Templates:
    """Template codes of texts; remembers the codes of some CACHE words."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.hashes, self.kinds, self.signs = np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool)

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > CACHE:
            self._forget()
        new = list(words.difference(self.known))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.hashes = np.concatenate([self.hashes, np.fromiter((xxhash.xxh64_intdigest(w.casefold()) for w in new), np.uint64, len(new))])
        self.kinds = np.concatenate([self.kinds, np.fromiter(map(kind, new), np.int8, len(new))])
        self.signs = np.concatenate([self.signs, np.fromiter((w in SIGNS for w in new), bool, len(new))])

    def views(self, texts: list[str]) -> tuple[list[str], list[View]]:
        """The tokens of all texts, and the texts read in each way."""
        split = [TOKEN.findall(t) if t else [] for t in texts]
        tokens = list(chain.from_iterable(split))
        self._learn(set(tokens))
        at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        text = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        words, kinds = self.hashes[at], self.kinds[at]
        follows = np.concatenate(([False], text[1:] == text[:-1]))[: len(text)]
        units = kinds == UNIT
        kinds[units & ~self.signs[at] & ~(follows & np.concatenate(([False], kinds[:-1] == NUMBER))[: len(text)])] = LITERAL
        folded = words.copy()
        for k in (NUMBER, UNIT):
            folded[kinds == k] = _SLOT[k]
        names = kinds == NAME
        typed = np.where(names, _SLOT[NAME], folded)
        first = np.flatnonzero(~follows | (kinds == LITERAL) | np.concatenate(([True], kinds[1:] != kinds[:-1]))[: len(text)])
        return tokens, [View(typed, kinds, text), View(folded, np.where(names, np.int8(LITERAL), kinds), text), View(typed[first], kinds[first], text[first], first), View(words, np.zeros(len(words), np.int8), text)]


def windows(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """One hash for each window of ``words`` template tokens."""
    n = len(hashes) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = (out ^ (hashes[k : k + n] >> np.uint64(7))) * _MULTIPLIER + hashes[k : k + n]
    return (out ^ (out >> np.uint64(31))) * _MULTIPLIER


def item_windows(tokens: list[str], views: list[View], words: int = WORDS) -> list[tuple[int, int, np.ndarray]]:
    """(way, words of a window, windows) of one item in each way; an item of fewer than ``words`` tokens is one window, word for word."""
    if len(tokens) < words:
        return [(WHOLE, len(tokens), windows(views[WHOLE].hashes, len(tokens)) ^ _WAY[WHOLE])] if tokens else []
    return [(way, words, windows(v.hashes, words) ^ _WAY[way]) for way, v in enumerate(views[:WHOLE])]


class Probe:
    """Some benchmark items, for comparison with whole texts."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, templates: Templates | None = None) -> None:
        self.words, self.templates = words, templates or Templates()
        # An entry for each item and way, in this order: number, key, tokens, way, words of a window, view, windows.
        self.items: list[tuple] = []
        for n, (i, t) in enumerate(items):
            tokens, views = self.templates.views([t or ""])
            self.items += [(n, i, tokens, way, size, views[way], w) for way, size, w in item_windows(tokens, views, words)]
        self.sizes = sorted({size for *_, way, size, _, _ in self.items if way == WHOLE})
        # Of equal windows of an item the first: a text's windows meet each item and way once.
        firsts = [np.unique(w, return_index=True)[1] for *_, w in self.items]
        self.distinct = [len(x) for x in firsts]
        hashes = np.concatenate([x[-1][at] for x, at in zip(self.items, firsts)]) if firsts else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(firsts)), self.distinct)[order]
        self.place = np.concatenate(firsts)[order] if firsts else np.zeros(0, np.int64)

    def matched(self, text: str | None, similarity: float = SIMILARITY, consistent: float = CONSISTENT) -> list[tuple]:
        """(key, matched, windows, slots, agreeing, exact) for each item that the text contains, by the first way that finds it."""
        tokens, views = self.templates.views([text or ""])
        read = [(way, self.words) for way in (TYPED, FOLDED, JOINED)] + [(WHOLE, n) for n in self.sizes]
        per = {x: windows(views[x[0]].hashes, x[1]) ^ _WAY[x[0]] for x in read}
        own = np.concatenate([per[x] for x in read])
        left, right = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        n = right - left
        at = np.flatnonzero(n)
        if not len(at):
            return []
        left, n = left[at], n[at]
        starts = np.cumsum([0, *(len(per[x]) for x in read)])
        where = np.repeat(at - starts[np.searchsorted(starts, at, "right") - 1], n)
        row = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out, last = [], -1
        items, place = self.item[row], self.place[row]
        order = np.argsort(items, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(items[order])) + 1):
            k = int(items[part[0]])
            number, key, _, way, size, _, _ = self.items[k]
            if number == last or len(np.unique(place[part])) < similarity * self.distinct[k]:
                continue
            if found := self._aligned(k, tokens, views[way], per[way, size], where[part], place[part], similarity, consistent):
                last = number
                out.append((key, *found))
        return out

    def _aligned(self, k: int, tokens: list[str], view: View, own: np.ndarray, where: np.ndarray, place: np.ndarray, similarity: float, consistent: float) -> tuple | None:
        """The first alignment, among runs of nearly equal diagonals, that has enough windows and agreeing slots."""
        _, _, item_tokens, way, size, item_view, item_own = self.items[k]
        theirs, ours, kinds = item_view.values(item_tokens), view.values(tokens), item_view.kinds
        slack = max(2, len(theirs) // 5)
        diagonal = where - place
        order = np.lexsort((where, diagonal))
        diagonal, place = diagonal[order], place[order]
        need = similarity * self.distinct[k]
        ends = np.searchsorted(diagonal, diagonal + slack, "right")
        starts = np.unique(diagonal, return_index=True)[1]
        for a in starts.tolist():
            b = int(ends[a])
            if b - a < need:
                continue
            matched = len(np.unique(place[a:b]))
            if matched < need:
                continue
            slots = sorted({(j + s, j + d + s) for d in range(int(diagonal[a]), int(diagonal[a]) + slack + 1) for j in self._equal(item_own, own, d) for s in range(size) if kinds[j + s] != LITERAL})
            if item_view.first is not None:
                # A name beside the item, as of a sentence's first word, may have joined its first or last value.
                ours = self._trimmed(slots, theirs, ours)
            filled: dict = defaultdict(Counter)
            for j, i in slots:
                filled[int(kinds[j]), theirs[j]][ours[i]] += 1
            agreeing = sum(c.most_common(1)[0][1] for c in filled.values())
            if agreeing >= consistent * len(slots):
                # Read without names, an item has its own values if all its windows are found.
                whole = way != FOLDED or matched == self.distinct[k]
                return matched, self.distinct[k], len(slots), agreeing, whole and all(theirs[j] == ours[i] for j, i in slots)
        return None

    @staticmethod
    def _equal(item: np.ndarray, own: np.ndarray, d: int) -> list[int]:
        """Places of an item whose window stands d places further on in the text."""
        a, b = max(0, -d), min(len(item), len(own) - d)
        return (np.flatnonzero(item[a:b] == own[a + d : b + d]) + a).tolist() if a < b else []

    @staticmethod
    def _trimmed(slots: list[tuple[int, int]], theirs: list[str], ours: list[str]) -> list[str]:
        """Values of a text: those at an item's ends without words that do not belong to the value, where that is known."""
        out = list(ours)
        for j, i in slots:
            if j in (0, len(theirs) - 1):
                known = [theirs[j], *[ours[b] for a, b in slots if theirs[a] == theirs[j] and a not in (0, len(theirs) - 1)]]
                fits = [x for x in known if f" {ours[i]}".endswith(f" {x}") and j == 0 or f"{ours[i]} ".startswith(f"{x} ") and j]
                out[i] = max(fits, key=len, default=ours[i])
        return out


def _marks(items: DataFrame, words: int, similarity: float) -> DataFrame:
    """(h, item, size): for each item, of a written table, the windows of which a text that contains it must have one; size is the words of the window."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for b in batches:
            for item, text in zip(b["item"], b["item_text"]):
                for way, size, w in item_windows(*templates.views([text]), words):
                    if len(w := np.unique(w)):
                        yield pd.DataFrame({"item": item, "way": way, "size": size, "h": w.view(np.int64), "n": len(w)})

    each = settled(items.mapInPandas(run, "item long, way int, size int, h long, n long"))
    common = each.groupBy("h").agg(F.count("*").alias("items"))
    place = F.row_number().over(Window.partitionBy("item", "way").orderBy("items", "h"))
    needed = F.ceil(F.col("n") * similarity - 1e-9)
    return settled(each.join(common, "h").withColumn("place", place).filter(F.col("place") <= F.col("n") - needed + 1).select("h", "item", "size").distinct())


def _marked(batches: Iterable[pd.DataFrame], words: int, sizes: list[int], bitmap: np.ndarray) -> Iterator[pd.DataFrame]:
    """(th, h): the windows of the texts that the bitmap knows."""
    templates = Templates()
    read = [(way, words) for way in (TYPED, FOLDED, JOINED)] + [(WHOLE, n) for n in sizes]
    mask = np.uint64(8 * len(bitmap) - 1)

    def known(h: np.ndarray) -> np.ndarray:
        at = h & mask
        return bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0

    for b in batches:
        keys, ends = b["th"].to_numpy(), np.cumsum(b["text"].str.len().to_numpy())
        begin = 0
        while begin < len(b):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PASS_BYTES, "right")))
            _, views = templates.views(b["text"].iloc[begin:end].tolist())
            found = []
            for way, size in read:
                v = views[way]
                h = windows(v.hashes, size) ^ _WAY[way]
                at = np.flatnonzero(known(h))
                at = at[known(h[at] >> np.uint64(37))]
                at = at[v.text[at] == v.text[at + size - 1]]
                if len(at):
                    found.append(np.stack([keys[begin + v.text[at]], h[at].view(np.int64)]))
            if found:
                th, h = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pd.DataFrame({"th": th, "h": h})
            begin = end


def _meetings(texts: DataFrame, benchmark: DataFrame, item_text: str, item_id: str, words: int, similarity: float) -> tuple[DataFrame, tuple]:
    """(th, items: array<struct<item, item_text>>) for the texts (th, text) that share a mark with an item, and a sieve of these th.

    A text has several rows if it meets more than MEETS items.
    """
    said = F.coalesce(F.col(item_text), F.lit(""))
    items = settled(benchmark.filter(F.col(item_id).isNotNull()).select(F.xxhash64(said).alias("item"), said.alias("item_text")).dropDuplicates(["item_text"]))
    marks = _marks(items, words, similarity)
    sizes = sorted(r["size"] for r in marks.select("size").distinct().collect() if r["size"] < words)
    # Two bits for each mark; the bitmap has 16 MB at most, whatever the benchmark's size.
    bits = packed(sieve(marks.select(F.explode(F.array("h", F.shiftrightunsigned("h", 37))).alias("h")), "h"))
    held = texts.sparkSession.sparkContext.broadcast(bits)
    marked = texts.mapInPandas(lambda x: _marked(x, words, sizes, held.value), "th long, h long")
    pairs = settled(marked.join(marks.select("h", "item"), "h").select("th", "item").distinct())
    per = pairs.groupBy("th").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("item"), F.ceil(F.col("n") / MEETS))
    listed = pairs.join(per, "th").join(items, "item").groupBy("th", part.alias("part")).agg(F.collect_list(F.struct("item", "item_text")).alias("items"))
    return listed.select("th", "items"), sieve(per, "th")


def _compared(batches: Iterable[pd.DataFrame], words: int, similarity: float) -> Iterator[tuple[pd.DataFrame, list[list[tuple]]]]:
    """Each batch with what its rows' texts contain of their items."""
    templates = Templates()
    for b in batches:
        yield b, [Probe([(x["item"], x["item_text"]) for x in items], words, templates).matched(t, similarity) for t, items in zip(b["text"], b["items"])]


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs and benchmark item that it contains, word for word (in any letter case) or with other values,
    of as many words or not.

    Columns: doc_id, item_id, matched and windows (distinct template windows
    found, and those of the item), slots and agreeing (aligned placeholders,
    and those filled consistently), exact (the slots hold the item's own
    values). Items of fewer than ``words`` tokens are found word for word
    only. Null and empty texts and items without tokens match nothing;
    items without an item_id are left out; repeated rows and repeated items
    each give their rows.
    """
    rows = docs.select(through_pandas(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    meetings, keys = _meetings(rows.select("th", "text"), benchmark, item_text, item_id, words, similarity)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, found in _compared(batches, words, similarity):
            if out := [(key, *m) for key, each in zip(b["doc_id"], found) for m in each]:
                yield pd.DataFrame(out, columns=["doc_id", "item", "matched", "windows", "slots", "agreeing", "exact"])

    suspects, _ = sifted(rows, F.col("th"), keys)
    out = suspects.join(meetings, "th").select("doc_id", "text", "items").mapInPandas(run, "doc_id string, item long, matched long, windows long, slots long, agreeing long, exact boolean")
    named = benchmark.filter(F.col(item_id).isNotNull()).select(F.xxhash64(F.coalesce(F.col(item_text), F.lit(""))).alias("item"), F.col(item_id).alias("item_id"))
    return out.join(named, "item").select(F.col("doc_id").cast("long").alias("doc_id"), "item_id", "matched", "windows", "slots", "agreeing", "exact")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that contain no benchmark item, with all their columns; only rows that share a mark with an item are shuffled."""
    rows = docs.select(F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    meetings, keys = _meetings(rows, benchmark, item_text, item_id, words, similarity)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, found in _compared(batches, words, similarity):
            yield b.loc[[bool(x) for x in found], ["th", "md5"]]

    met = sifted(rows, F.col("th"), keys)[0].join(meetings, "th").select("th", F.md5("text").alias("md5"), "text", "items")
    gone = settled(met.mapInPandas(run, "th long, md5 string").distinct().withColumnsRenamed({"th": "__th", "md5": "__md5"}))
    suspects, clear = sifted(docs, F.xxhash64(text), keys)
    return suspects.join(gone, (F.xxhash64(text) == F.col("__th")) & (F.md5(text) == F.col("__md5")), "left_anti").unionByName(clear)
