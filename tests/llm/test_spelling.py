"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reviewlake.llm import spelling
from reviewlake.llm.queries import QUERIES
from tests.llm.conftest import SF


def counted(rows):
    out = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(n):
    by = {}
    for w in n:
        for i in range(len(w)):
            for key in (w[:i] + "*" + w[i + 1 :], w[:i] + w[i + 1 :]):
                by.setdefault(key, set()).add(w)
        by.setdefault(w, set()).add(w)
    near = {w: set() for w in n}
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if b != a and is_near(a, b)}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    rows = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def test_op12(spark, documents):
    expected = variants(counted((r.doc_id, r.text) for r in documents.collect()))
    assert len(expected) > 500 and any(r[1] for r in expected) and rows_of(QUERIES["op12_spelling_variants"](spark, SF)) == expected


@pytest.mark.parametrize(("bucket", "half"), [(50_000, 50_000), (300, 6)])
def test_small_halves_lose_nothing(spark, rough, bucket, half):
    r = random.Random(5)
    words = ["".join(r.choice("abé") for _ in range(r.randint(4, 9))) for _ in range(300)] + ["x" * 600, "x" * 601, "x" * 300 + "y" + "x" * 300]
    texts = [(k, " ".join(r.choice(words) + r.choice(["", ",", "×", "ÿ"]) for _ in range(400))) for k in range(12)]
    docs = rough.select("doc_id", "text", "h", "kept").unionByName(spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS h", "'k' AS kept")).selectExpr("*", "h AS word", "h AS n", "kept AS root")
    expected = variants(counted((x.doc_id, x.text) for x in docs.collect()))
    assert rows_of(spelling.grouped(docs, bucket_rows=bucket, half_rows=half)) == expected


def test_no_words(spark, nothing):
    assert spelling.grouped(nothing).count() == 0
    assert spelling.grouped(spark.createDataFrame([(1, "a bc, 12"), (2, None)], "doc_id long, text string")).count() == 0


def test_automaton_numbers_words_and_shares_ends():
    words = sorted({f"{a}{b}".encode() for a in ("re", "un", "") for b in ("lock", "locked", "clock", "clocked")})
    auto = spelling.Words(words)
    for k, w in enumerate(words):
        state, number = np.array([auto.root]), 0
        for letter in w:
            met, arc = auto.step(state, np.array([letter]))
            assert len(met)
            state, number = auto.to[arc], number + int(auto.before[arc][0])
        assert auto.final[state[0]] and number == k
    assert len(auto.final) < 20
