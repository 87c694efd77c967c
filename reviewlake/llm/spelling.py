"""Spelling variants: words one edit apart, by forward and backward minimal acyclic automata.

A pair of words that differ by one edit agrees in the first half of the shorter
word or in the rest of it. Words are dealt out by length and half, so that such
a pair meets once. Where words meet, those that share beginnings form one
minimal automaton, those that share ends another of the reversed words; each
state knows how many words lie behind it, so that a path is a word's number. A
word reads its half exactly and goes on with one error.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import checkpointed, settled, through_pandas

#: Shortest word and fewest occurrences; a form is this much more frequent; one run in so many loses a letter.
LEAST_LENGTH, LEAST_COUNT, TIMES, MISSPELT = 5, 3, 2, 97
#: Distinct words that a task counts before it passes them on; rows of one bucket; rows of a half above which it is halved again.
COUNTED, BUCKET_ROWS, HALF_ROWS = 500_000, 50_000, 50_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters of all texts with ASCII letters in lower case, some of them misspelt by rule; those of the least length, counted in parts."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for b in batches:
            for key, t in zip(b["doc_id"], b["text"]):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(_RUN.findall((t or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % MISSPELT == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= LEAST_LENGTH:
                        found[word] += n
                if len(found) >= COUNTED:
                    yield pd.DataFrame(list(found.items()), columns=["word", "n"])
                    found.clear()
        if found:
            yield pd.DataFrame(list(found.items()), columns=["word", "n"])

    return docs.select(through_pandas(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "word string, n long")


class Words:
    """A minimal acyclic automaton of sorted distinct words, which it numbers in their order from 0.

    Arcs are kept as state * 256 + letter, in order, with the state that they
    lead to and the number of words before those behind them.
    """

    def __init__(self, words: Sequence[bytes]) -> None:
        known: dict[tuple, int] = {}
        kept: list[tuple] = []
        behind: list[int] = []
        open_: list[list] = [[False, []]]

        def close(depth: int, word: bytes) -> None:
            while len(open_) > depth:
                final, arcs = open_.pop()
                state = (final, tuple(arcs))
                number = known.setdefault(state, len(kept))
                if number == len(kept):
                    kept.append(state)
                    behind.append(final + sum(behind[to] for _, to in arcs))
                if open_:
                    open_[-1][1].append((word[len(open_) - 1], number))

        last = b""
        for word in words:
            same = 0
            for x, y in zip(last, word):
                if x != y:
                    break
                same += 1
            close(same + 1, last)
            open_.extend([False, []] for _ in word[same:])
            open_[-1][0] = True
            last = word
        close(0, last)
        self.root = len(kept) - 1
        self.final = np.array([final for final, _ in kept])
        self.begins = np.cumsum([0, *(len(arcs) for _, arcs in kept)])
        self.arcs = np.array([s << 8 | letter for s, (_, arcs) in enumerate(kept) for letter, _ in arcs], np.int64)
        self.to = np.array([to for _, arcs in kept for _, to in arcs], np.int64)
        before = []
        for final, arcs in kept:
            n = int(final)
            for _, to in arcs:
                before.append(n)
                n += behind[to]
        self.before = np.array(before, np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lanes that have the arc, arcs)."""
        key = state << 8 | letter
        arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
        met = np.flatnonzero(self.arcs[arc] == key)
        return met, arc[met]

    def near(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, word number, place of the error): words got from a query by replacing a letter or inserting one, after its first ``exact`` letters.

        Queries are words of the automaton. All advance together, a letter a
        step: clean lanes have no error yet, dirty ones had theirs. What is
        inserted isn't the next letter, so that a word is found once.
        """
        out = []
        clean, state, number = np.arange(len(starts)), np.full(len(starts), self.root), np.zeros(len(starts), np.int64)
        dirty = tuple(np.zeros(0, np.int64) for _ in range(4))
        i = 0
        while len(clean) or len(dirty[0]):
            # The errors at this place.
            may = exact[clean] <= i
            q, s, x = clean[may], state[may], number[may]
            many = self.begins[s + 1] - self.begins[s]
            lane = np.repeat(np.arange(len(q)), many)
            arc = np.arange(len(lane)) - np.repeat(np.cumsum(many) - many, many) + self.begins[s][lane]
            inner = i < sizes[q]
            other = ~inner[lane] | ((self.arcs[arc] & 255) != letters[np.where(inner, starts[q] + i, 0)][lane])
            lane, arc = lane[other], arc[other]
            made = (q[lane], self.to[arc], x[lane] + self.before[arc], np.full(len(lane), i))
            dirty = tuple(np.concatenate(p) for p in zip(dirty, made))
            replaced = tuple(p[inner[lane]] for p in made)
            # Lanes at the end of their query are done; the others read its next letter.
            end = sizes[dirty[0]] == i
            done = end & self.final[dirty[1]]
            out.append((dirty[0][done], dirty[2][done], dirty[3][done]))
            q, s, x, e = (p[~end] for p in dirty)
            met, arc = self.step(s, letters[starts[q] + i])
            dirty = tuple(np.concatenate(p) for p in zip((q[met], self.to[arc], x[met] + self.before[arc], e[met]), replaced))
            on = sizes[clean] > i
            clean, state, number = clean[on], state[on], number[on]
            met, arc = self.step(state, letters[starts[clean] + i])
            clean, state, number = clean[met], self.to[arc], number[met] + self.before[arc]
            i += 1
        return tuple(np.concatenate(p) for p in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(3))


def _same_beginning(letters: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each pair of words."""
    out, live, i, least = np.zeros(len(a), np.int64), np.arange(len(a)), 0, np.minimum(a_size, b_size)
    while len(live):
        live = live[least[live] > i]
        live = live[letters[a[live] + i] == letters[b[live] + i]]
        i += 1
        out[live] = i
    return out


def _laid(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.cumsum(sizes) - sizes, sizes


def near_pairs(words: list[bytes], of: np.ndarray, shorter: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words that belong to one half: ``words`` sorted and distinct; by row the word, and its half.

    A half is (shorter, head, tail): pairs whose shorter word has so many
    letters, and that agree in the first ``head`` and the last ``tail`` ones
    of it; the first difference lies between.
    """
    letters, starts, sizes = _laid(words)
    found = []
    for backward in (False, True):
        rows = np.flatnonzero((tail > head) == backward)
        if not len(rows):
            continue
        members = np.unique(of[rows])
        own = [words[k] for k in members]
        if backward:
            turned = [w[::-1] for w in own]
            by = sorted(range(len(own)), key=turned.__getitem__)
            own, members = [turned[k] for k in by], members[by]
        asked = rows[sizes[of[rows]] == shorter[rows]]
        place = np.empty(len(words), np.int64)
        place[members] = np.arange(len(members))
        laid, begins, lengths = _laid(own)
        mine = place[of[asked]]
        q, number, error = Words(own).near(laid, begins[mine], lengths[mine], (tail if backward else head)[asked])
        row, u, v = asked[q], of[asked[q]], members[number]
        differ = _same_beginning(letters, starts[u], sizes[u], starts[v], sizes[v]) if backward else error
        once = (sizes[u] < sizes[v]) | (u < v)  # words of one length ask for each other
        right = once & (differ >= head[row]) & ((tail[row] == 0) | (differ < shorter[row] - tail[row]))
        found.append((u[right], v[right]))
    return tuple(np.concatenate(p) for p in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.xxhash64("shorter", "head", "tail", F.expr("substring(word, 1, head)"), F.expr("right(word, tail)")))


def halves(words: DataFrame, most: int = HALF_ROWS) -> DataFrame:
    """(word, n, shorter, head, tail, key): every word with each half by which it can meet another.

    Halves with more than ``most`` rows are halved again, by where between
    head and tail the first difference lies; that loses no pair. What can't be
    halved has one letter between, so it is as small as the alphabet.
    """
    size = F.length("word")
    ways = F.filter(F.array(size, size - 1), lambda m: m >= LEAST_LENGTH)
    step = words.withColumn("shorter", F.explode(ways)).withColumn("x", F.explode(F.expr("array(struct(shorter div 2 as head, 0L as tail), struct(0L as head, shorter - shorter div 2 as tail))")))
    now, out = settled(_keyed(step.select("word", "n", F.col("shorter").cast("int"), F.col("x.head").cast("int").alias("head"), F.col("x.tail").cast("int").alias("tail")))), None
    while True:
        crowded = settled(now.filter("shorter - head - tail > 1").groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > most).select("key"))
        if crowded.isEmpty():
            return out.unionByName(now) if out is not None else now
        kept = now.join(crowded, "key", "left_anti").select(now.columns)
        out = kept if out is None else out.unionByName(kept)
        again = now.join(crowded, "key").withColumn("half", F.expr("(shorter - head - tail) div 2"))
        again = again.withColumn("x", F.explode(F.expr("array(struct(head + half as head, tail as tail), struct(head as head, shorter - head - half as tail))")))
        now = settled(_keyed(again.select("word", "n", "shorter", F.col("x.head").cast("int").alias("head"), F.col("x.tail").cast("int").alias("tail"))))


def neighbours(words: DataFrame, bucket_rows: int = BUCKET_ROWS, half_rows: int = HALF_ROWS) -> DataFrame:
    """(word, n_near, best struct(less, word)): by task the number of near words and the best of them, that with the largest n (less is -n)."""
    rows = settled(halves(words, half_rows))
    buckets = max(1, rows.count() // bucket_rows)

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        raw = [w.encode("latin-1") for w in b["word"]]
        names = sorted(set(raw))
        at = {w: k for k, w in enumerate(names)}
        of = np.array([at[w] for w in raw])
        n = np.zeros(len(names), np.int64)
        n[of] = b["n"].to_numpy()
        u, v = near_pairs(names, of, *(b[c].to_numpy(np.int64) for c in ("shorter", "head", "tail")))
        one, two = np.concatenate((u, v)), np.concatenate((v, u))
        by = np.lexsort((two, -n[two], one))
        one, two = one[by], two[by]
        first = np.flatnonzero(np.diff(one, prepend=-1))
        said = lambda which: pd.Series([names[k].decode("latin-1") for k in which], dtype=object)
        return pd.DataFrame({"word": said(one[first]), "n_near": np.diff(np.append(first, len(one))), "less": -n[two[first]], "best": said(two[first])})

    found = rows.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInPandas(run, "word string, n_near long, less long, best string")
    return found.select("word", "n_near", F.struct("less", F.col("best").alias("word")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: forms are followed to the last, by doubling; a form's count is at least twice the word's, so there are no rings."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = checkpointed(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS, half_rows: int = HALF_ROWS) -> DataFrame:
    """One row per word: word, form, root, n, n_near and form_n.

    Words are those of LEAST_LENGTH letters and LEAST_COUNT occurrences. Two
    are near if one edit makes them equal. A word's form is its near word with
    the largest n (of equals the first in code-point order) if that is TIMES
    its own n; its root is the last form that forms lead to, or itself. A null
    text has no words, a null doc_id counts as empty; repeated rows count
    each; without words there are no rows; other columns are ignored.
    """
    words = settled(occurrences(docs, doc_id, text).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT))
    near = neighbours(words, bucket_rows, half_rows)
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less: long, word: string>").alias("best"))
    both = none.unionByName(near.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best"))
    counted = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.less") >= TIMES * F.col("n")
    rows = settled(counted.select("word", "n", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
