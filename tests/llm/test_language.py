"""Language-model scores against counts and recursion in plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from reviewlake.llm import backoff
from reviewlake.llm.queries import QUERIES
from tests.llm.conftest import SF


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class Plain:
    """The same model by counts of tuples, and p(w | h) by its definition."""

    def __init__(self, rows, order):
        self.grams, texts = Counter(), 0
        for d, t in rows:
            if not held_out(d):
                words = ["<s>", *tokens_of(t)]
                texts += 1
                self.grams.update(tuple(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1))
        self.n = sum(c for g, c in self.grams.items() if len(g) == 1) - texts
        self.v = sum(len(g) == 1 for g in self.grams) - (texts > 0)
        by = defaultdict(list)
        for g, c in self.grams.items():
            by[len(g)].append(c)
        self.k = [self.fitted(by[n].count(1), by[n - 1] if n > 1 else [self.n] * (self.n > 0)) for n in range(1, order + 1)]
        self.order = order

    @staticmethod
    def fitted(once, histories):
        classes = defaultdict(list)
        for c in histories:
            classes[c.bit_length()].append(c)
        means = [(len(x), sum(x) / len(x)) for x in classes.values()]
        low, high = 1e-3, 1e6
        for _ in range(100):
            mid = math.sqrt(low * high)
            low, high = (mid, high) if sum(m * c * mid / (c + mid) for m, c in means) < once else (low, mid)
        return low

    def p(self, history, word):
        c, k = self.grams[(*history, word)], self.k[len(history)]
        if not history:
            return (c + k / (self.v + 1)) / (self.n + k)
        return (c + k * self.p(history[1:], word)) / (self.grams[tuple(history)] + k)

    def row(self, doc_id, text):
        words, score = ["<s>", *tokens_of(text)], 0
        for i in range(1, len(words)):
            score += math.log10(self.p(tuple(words[max(0, i - self.order + 1) : i]), words[i]))
        own = [self.grams[(w,)] for w in words[1:]]
        base = sum(math.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1))) for c in own)
        return doc_id, held_out(doc_id), len(own), sum(c > 0 for c in own), self.n, round(base, 6), round(score, 6)


def compared(found, rows, order):
    plain = Plain(rows, order)
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found.collect())
    assert got == Counter(plain.row(*r) for r in rows)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_scores_of_rough_texts(rough, order):
    rows = [tuple(r) for r in rough.select("doc_id", "text").collect()]
    compared(backoff.scored(rough, order, chunk_tokens=700, range_keys=400), rows, order)


def test_op11(spark, documents):
    compared(QUERIES["op11_lm_scoring"](spark, SF), [tuple(r) for r in documents.select("doc_id", "text").collect()], backoff.ORDER)


def test_nothing_to_learn_from(spark, nothing):
    assert backoff.scored(nothing).count() == 0
    alone = spark.createDataFrame([(d, "a b") for d in range(200) if held_out(d)], "doc_id long, text string")
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in backoff.scored(alone).collect()} == {(3, 0, 0, 0.0, 0.0)}


def test_a_model_is_a_distribution(documents):
    """Of every history the words and the unknown one sum to one."""
    rows = [tuple(r) for r in documents.select("doc_id", "text").limit(40).collect()]
    plain = Plain(rows, 3)
    words = [g[0] for g in plain.grams if len(g) == 1 and g[0] != "<s>"]
    for history in [(), ("<s>",), *[g for g in plain.grams if len(g) == 2][:20], ("never", "seen")]:
        assert math.isclose(sum(plain.p(history, w) for w in words) + plain.p(history, "\n"), 1)


def test_held_out_texts_are_likelier_than_by_words_alone(spark, documents):
    rows = [r for r in QUERIES["op11_lm_scoring"](spark, SF).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
