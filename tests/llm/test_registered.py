"""The registered queries over whole tables, each against brute force."""

import hashlib
import re
from collections import Counter

import pytest
import sentencepiece

from reviewlake.llm import decontamination, markup, pieces
from reviewlake.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF
from tests.llm.test_copies import brute_components, brute_repeats
from tests.llm.test_native import measures, pii_of
from tests.llm.test_scans import secrets_of


def rows_of(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


@pytest.fixture(scope="module")
def texts(spark, documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


def got(spark, name, *columns):
    df = QUERIES[name](spark, SF)
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()))


def digest(spans, names):
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_all_are_registered():
    assert [re.match(r"op(\d+)_", q)[1] for q in QUERIES] == [str(n) for n in range(1, 14)] and set(ORACLES) <= set(QUERIES)


def test_op2(spark, texts):
    names = ("assign", "access", "hex")
    expected = [(d, *(sum(k == j for _, k, _ in s) for j in range(3)), digest(s, names)) for d, t in texts for s in [secrets_of(t)]]
    found = QUERIES["op2_secret_scan"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found) == sorted(expected)
    base = {d: {f"{names[k]}:{a}:{b}" for a, k, b in secrets_of(t)} for d, t in texts}
    assert all(base[r.doc_id] <= set(r.spans.split(",")) and r.n_spans == len([x for x in r.spans.split(",") if x]) for r in found)


def test_op4(spark, texts):
    assert got(spark, "op4_suffix_array_dedup") == sorted(brute_repeats([(d, (t or "").encode()) for d, t in texts], 100))


def test_op5(spark, texts):
    expected = [(d, *n, hashlib.sha256(",".join(said).encode()).hexdigest()) for d, t in texts for n, said in [pii_of(t)]]
    assert got(spark, "op5_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(expected)


def test_op6(spark, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    expected = [(d, len(ids), ids, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in texts for ids in [sp.encode(t or "")]]
    assert got(spark, "op6_sentencepiece") == sorted(expected)


def test_op7(spark):
    expected = [(p, u, markup.main_text(h), len(markup.main_text(h))) for p, u, h in rows_of(spark, "pages")]
    assert got(spark, "op7_html_extraction") == sorted(expected) and all(x[3] for x in expected)


def test_op8(spark, texts):
    assert got(spark, "op8_simhash_near_dedup") == sorted(brute_components(texts, 3))


def test_op9(spark, texts):
    found = QUERIES["op9_quality_rules"](spark, SF).collect()
    m = {d: measures(t) for d, t in texts}
    assert len(found) == len(texts)
    for r in found:
        failed = m[r.doc_id][0] < 50 or 100 * m[r.doc_id][4] > 50 * m[r.doc_id][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m[r.doc_id] and r.base_failed == failed and r.kept == (not failed and r.quality >= 0.5)


def test_op10(spark, texts):
    probe = decontamination.Probe(rows_of(spark, "benchmark"))
    expected = Counter((d, *m) for d, t in texts for m in probe.matched(t))
    assert expected and Counter(map(tuple, QUERIES["op10_decontamination"](spark, SF).collect())) == expected
