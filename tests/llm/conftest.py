import random

import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rough(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    r = random.Random(7)
    words = ["the", "Of", "and", "rain", "über", "🙂", "ça", "token", "=", "abcdef12", "a@b.cd", "10.0.0.1", "\n", "\t", "x" * 40, "+1 (743) 555-3824", "漢字", "  ", "%%", "!!"]
    texts = [None, "", " ", "\n\n", "one", "one two", "a b c", "x" * 30_000, "ab " * 20_000] + [" ".join(r.choice(words) for _ in range(r.randint(1, 150))) for _ in range(40)]
    texts += [texts[20], texts[20], texts[25] + " end"]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", None, "clash", 1) for i, t in enumerate(texts)]
    # Keys that doubles can't hold, beside nulls.
    rows += [(2**53 + k, texts[20 + k % 3], "en", "s1", None, "clash", 1) for k in (1, 2, 3)] + [(-(2**62) - 1, "token = abcdef99", "en", None, None, None, None)]
    rows += [rows[15], rows[15], (None, "no id here", None, "s1", None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC + ", kept string, h int").withColumnsRenamed({}).selectExpr("*", "h as `d`", "kept as `words`", "h as `found`", "h as `key`", "kept as `fp`", "h as `m`", "h as `n`", "kept as `text_hash`", "kept as `items`", "h as `chunk`", "kept as `word`").repartition(3)


@pytest.fixture(scope="session")
def nothing(rough):
    return rough.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
