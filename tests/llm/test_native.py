"""Line dedup, quality rules and PII against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from reviewlake.llm import boosting, lines, pii, quality
from tests.llm.conftest import SF

BLANK = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def measures(text):
    w, rows = words_of(text), [x for x in (text or "").split("\n") if x.strip(BLANK)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if twice[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(rows) - len(set(rows)), len(covered)


@pytest.mark.parametrize("table", ["rough", "documents"])
def test_measures(request, table):
    docs = request.getfixturevalue(table)
    got = quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    expected = []
    for r in docs.select("doc_id", "text").collect():
        m = measures(r.text)
        expected.append((r.doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_quality_of_nothing(nothing, rough):
    assert quality.judged(nothing).count() == 0 and quality.keep_good(nothing).count() == 0
    assert quality.keep_good(rough).columns == rough.columns


def test_quality_on_labels(spark):
    """Held-out labels, which the rules never see: good documents of 50 words stay, bad ones go."""
    sf = "/root/testdata/sf0.01"
    found = quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "base_failed", "kept").filter("NOT base_failed")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    counts = {(r.label, r.kept): r["count"] for r in found.join(labels, "doc_id").groupBy("label", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0
    assert counts.get((0, False), 0) >= 0.95 * (counts.get((0, False), 0) + counts.get((0, True), 0))


def test_keep_good_agrees_with_judged(documents):
    kept = sorted(r.doc_id for r in quality.keep_good(documents).select("doc_id").collect())
    assert kept == sorted(r.doc_id for r in quality.judged(documents).filter("kept").collect())


@pytest.mark.parametrize("shared", ["cast(0 as bigint)", "shiftleft(pmod(xxhash64(__words[i], __words[i + 1], __words[i + 2]), 3), 58)"])
def test_windows_of_one_hash_are_told_apart(spark, monkeypatch, shared):
    """Windows with one hash whose places interleave: the words decide."""
    monkeypatch.setattr(quality, "_HASH", shared)
    r = random.Random(3)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, "a b c x a b c", "a b", "a b c"]
    got = quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_repeat_words").collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: measures(t)[4] for i, t in enumerate(texts)}


def brute_fit(votes, rounds=25):
    """Expectation-maximisation over single documents, rule by rule."""
    docs = [p for p, n in votes for _ in range(n)]
    good = np.array([{0: 0.98, 1: 0.5}.get(p.count("-"), 0.02) for p in docs])
    for _ in range(rounds):
        logs = []
        for weight in (good, 1 - good):
            total = np.full(len(docs), np.log((weight.sum() + 1) / (len(docs) + 2)))
            for r in range(len(docs[0])):
                own = np.array([p[r] for p in docs])
                for v in "-0+":
                    total[own == v] += np.log((weight[own == v].sum() + 0.5) / (weight.sum() + 1.5))
            logs.append(total)
        good = 1 / (1 + np.exp(logs[1] - logs[0]))
    return dict(zip(docs, good))


def test_fit_is_expectation_maximisation():
    r = random.Random(6)
    for votes in ([("+++", 900), ("--+", 60), ("-++", 5), ("00+", 20), ("---", 30)], [("".join(r.choice("-0+") for _ in range(4)), r.randint(1, 30)) for _ in range(20)]):
        votes = list(dict(votes).items())
        expected = brute_fit(votes)
        assert all(abs(q - expected[p]) < 1e-9 for p, q in quality.fit(votes).items())
    good = quality.fit([("+++", 900), ("--+", 60), ("-++", 5), ("---", 30)])
    assert good["+++"] > 0.9 and good["--+"] < 0.1 and good["---"] < 0.01
    assert quality.fit([]) == {}


def test_distinct_words_are_counted_in_blocks(spark):
    """The share of distinct words doesn't fall with the length of a text."""
    r = random.Random(8)
    texts = [" ".join(r.choice(["a", "b", "c", "dd", "e1"]) for _ in range(n)) for n in (0, 1, 99, 100, 101, 350)] + [None]
    rows = quality.with_measures(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "__m").select("text", "__m.n_distinct_words").collect()
    assert all(n == sum(len(set(w[i : i + 100])) for i in range(0, len(w), 100)) for t, n in rows for w in [(t or "").split()])


def test_kept_follows_the_posterior(documents):
    """Patterns by hand from the measures; kept and quality are those of expectation-maximisation over them."""
    per = lambda a, b: a / max(b, 1)

    def pattern(m):
        votes = [(per(m.n_symbols, m.n_words), 0.25, 0.05), (-per(m.n_plain_chars, m.word_chars), -0.75, -0.9), (per(m.n_shouts, m.n_words), 0.2, 0.05), (per(m.n_capitals, m.word_chars), 0.4, 0.15), (per(m.n_repeat_words, m.n_words), 0.4, 0.15)]
        out = ["-" if x > bad else "+" if x < good else "0" for x, bad, good in votes]
        distinct, mean = per(m.n_distinct_words, m.n_words), per(m.word_chars, m.n_words)
        out.append("-" if distinct < 0.3 else "+" if distinct > 0.5 else "0")
        for x, bad, good in ((per(m.n_dup_lines, m.n_lines), 0.5, 0.2), (per(m.n_marks, m.n_words), 0.15, 0.05)):
            out.append("-" if x > bad else "+" if x < good else "0")
        return "".join(out) + ("-" if mean < 2 or mean > 15 else "+" if 3 <= mean <= 10 else "0")

    rows = quality.judged(documents).collect()
    expected = brute_fit(list(Counter(map(pattern, rows)).items()))
    for x in rows:
        assert x.pattern == pattern(x) and abs(x.quality - expected[x.pattern]) < 1e-6 and x.kept == (not x.base_failed and x.quality >= 0.5)


def boilerplate_free(rows, ratio, least):
    host = lambda s: "" if s is None else "=" + s
    totals, seen = Counter(host(r.source) for r in rows), Counter()
    for r in rows:
        for x in {x.strip(BLANK) for x in (r.text or "").split("\n")} - {""}:
            seen[host(r.source), x] += 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * totals[k[0]]}
    out = []
    for r in rows:
        if r.text is None:
            out.append((r.doc_id, None, 0))
            continue
        parts = r.text.split("\n")
        kept = [x for x in parts if (host(r.source), x.strip(BLANK)) not in bad]
        out.append((r.doc_id, "\n".join(kept), len(parts) - len(kept)))
    return out


@pytest.mark.parametrize("table,ratio,least", [("rough", 0.05, 2), ("documents", 0.05, 2), ("documents", 0.2, 5)])
@pytest.mark.parametrize("broadcast", [True, False])
def test_lines(request, monkeypatch, table, ratio, least, broadcast):
    if not broadcast:
        monkeypatch.setattr(lines, "BROADCAST_LINES", -1)
    docs = request.getfixturevalue(table)
    got = lines.drop_boilerplate(docs, ratio, least, dropped="n_dropped")
    assert got.columns == [*docs.columns, "n_dropped"]
    rows = docs.select("doc_id", "text", "source").collect()
    expected = boilerplate_free(rows, ratio, least)
    assert ratio == 0.2 or sum(x[2] for x in expected) > 0
    assert sorted(map(tuple, got.select("doc_id", "text", "n_dropped").collect()), key=str) == sorted(expected, key=str)


def test_lines_oracle(documents, nothing):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = sorted(c.execute(lines.ORACLE_SQL).fetchall())
    assert sorted(map(tuple, lines.drop_boilerplate(documents, dropped="n").select("doc_id", "text", "n").collect())) == expected
    assert lines.drop_boilerplate(nothing).count() == 0


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def only_digits(s):
    return re.sub("[^0-9]", "", s)


PII = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(only_digits(s)) <= 19 and luhn(only_digits(s))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(only_digits(s)) <= 15),
)


def pii_of(text):
    spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PII) for m in re.finditer(p, text or "") if ok(m[0]))
    said = [f"{pii.KINDS[k][0]}:{a}:{b}" for a, k, b in spans]
    return [sum(k == j for _, k, _ in spans) for j in range(4)], said


HARD = ["a@b.c_d@e.f", "x@y.com.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.000255.1.1", "4111 1111 1111 1111-4111-1111-1111-1111", "+1 2", "++1 (743) 555-3824-", "🙂 a@b.cd é 10.0.0.1", "@" * 2000, "1" * 50_000, "a" * 50_000 + "@b.c"]


def test_pii(spark, rough, documents, nothing):
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for docs in (hard, rough, documents):
        rows = sorted(docs.select("doc_id", "text").collect(), key=str)
        got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find(docs).collect())
        assert got == Counter((r.doc_id, *pii_of(r.text)[0], hashlib.sha256(",".join(pii_of(r.text)[1]).encode()).hexdigest()) for r in rows)
    for r in pii.find(documents).collect():
        assert set(pii_of(r.text)[1]) <= set(r.spans.split(","))
    assert pii.find(nothing).count() == 0


def test_pii_extra_spans(spark):
    rows = [(0, "My phone: 743-555-3824 and SSN 123-45-6789, order #12345678"), (1, "ISBN 12345678 costs $12345678")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "local_phone:10:22,national_id:31:42", 1: ""}
    shown = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert shown == {0: "My phone: <LOCAL_PHONE> and SSN <NATIONAL_ID>, order #12345678", 1: rows[1][1]}


def test_boosting_held_out():
    """Examples with words that were not learnt from: precision and recall over the further kinds."""
    held = pii.examples(1000, 99, pii.UNSEEN)
    said = [(pii.probability(x) >= pii.thresholds()[pii.KINDS[int(x[0])][0]] - 1e-9, y) for x, y in held]
    hits = sum(p and y for p, y in said)
    assert hits >= 0.9 * sum(p for p, _ in said) and hits >= 0.85 * sum(y for _, y in said)


def test_thresholds_hold_on_held_out_examples():
    held = pii.examples(pii.EXAMPLES, 3)
    for name, t in pii.thresholds().items():
        taken = [y for x, y in held if pii.KINDS[int(x[0])][0] == name and pii.probability(x) >= t]
        assert t > 1 or sum(taken) >= pii.PRECISION * len(taken) > 0


def test_spark_sees_the_features(spark):
    """The expressions over spans and context say what features() says, and so do the trees."""
    r = random.Random(8)
    rows = []
    for _ in range(300):
        span = "".join(r.choice("0123456789AB-(). ") for _ in range(r.randint(1, 24)))
        rows.append((r.randrange(4, 8), span, r.choice([*sum(pii.LEARNT, ()), *sum(pii.UNSEEN, ()), "x", '"', "é "]) if r.random() < 0.9 else ""))
    df = spark.createDataFrame(rows, "kind int, span string, before string")
    from pyspark.sql import functions as F

    for kind in range(4, 8):
        c = pii._columns(kind, F.col("span"), F.col("before"))
        odds = boosting.expression(pii.model()[0], c)
        for x in df.filter(F.col("kind") == kind).select("span", "before", F.array(*c).alias("f"), odds.alias("odds")).collect():
            assert x.f == pii.features(kind, x.span, x.before) and abs(x.odds - boosting.value(pii.model()[0], x.f)) < 1e-9
