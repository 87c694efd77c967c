"""Hard negatives against brute force in Python and the oracle."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from reviewlake.llm import negatives
from reviewlake.llm.queries import QUERIES
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    fit = []
    for k, v, label in rows:
        if None in (k, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit.append((k, [math.floor(256 * np.float64(np.float32(x))) for x in v], (label + 1) % 10 if k % 7 == 0 else label))
    out = Counter()
    for i, (a, q, mine) in enumerate(fit):
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), k, label == mine) for j, (k, v, label) in enumerate(fit) if j != i and len(v) == len(q))
        for top, p, _ in [s for s in scored if s[2]][:5]:
            near = [(s, k) for s, k, same in scored if not same and 80 * -top <= 100 * -s <= 100 * -top][:5]
            out.update((a, p, rank, k, -top, -s) for rank, (s, k) in enumerate(near, 1))
    return out


def found(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_op13_and_its_sql(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, c = found(QUERIES["op13_hard_negatives"](spark, SF)), duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    sql = c.execute(negatives.ORACLE_SQL)
    at = [[d[0] for d in sql.description].index(x) for x in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]
    assert got and got == brute(rows) == Counter(tuple(r[k] for k in at) for r in sql.fetchall())


@pytest.mark.parametrize(("part", "block", "leaf"), [(8192, 4096, 64), (90, 2, 3)])
def test_rough_rows(spark, part, block, leaf):
    """Nulls, numbers that aren't finite, ties, repeated rows, other lengths, no components, very large ones, clashing names."""
    r = random.Random(3)
    rows = [(k, [r.choice((-0.5, 0.0, 0.25, 1.0, 1 / 3)) for _ in range(4)], r.randint(0, 2)) for k in range(250)]
    rows += [rows[100], rows[0], rows[7], (None, [1.0] * 4, 1), (300, None, 1), (300, [1.0] * 4, None), (400, [1.0, None, 0.0, 0.0], 1), (400, [float("nan")] * 4, 1), (401, [float("inf")] * 4, 1)]
    rows += [(500, [], 0), (501, [], 0), (502, [], 1), (600, [1.0, 2.0], 1), (601, [1.0, 1.5], 1), (602, [0.9, 1.9], 2), (700, [3e6] * 3, 4), (701, [3e6, 3e6, 2.9e6], 5), (702, [2.9e6] * 3, 5), (703, [2.8e6] * 3, 6)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "label AS row", "'x' AS vector", "1 AS part", "2 AS score").repartition(3)
    assert found(negatives.mined(df, part_rows=part, block_anchors=block, leaf=leaf)) == brute(rows)


def test_empty_table(spark):
    assert negatives.mined(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.mined(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).count() == 0


def test_balls_hold_their_rows_and_searches_skip_some():
    r = np.random.default_rng(1)
    points = np.floor(np.concatenate([r.normal(c, 3, (200, 8)) for c in (-60, 0, 60)]))
    tree = negatives.BallTree(points, np.zeros(len(points), np.int64), 16)
    q = negatives.Query(tree, points[0])
    for rows, a, b in zip(tree.rows, q.least, q.most):
        assert a <= (points[rows] @ points[0]).min() and (points[rows] @ points[0]).max() <= b
    best = tree.best(q, 5, np.arange(len(points)), same=0)
    assert [x for x, _ in best] == sorted((points @ points[0]).astype(int).tolist(), reverse=True)[:5] and len(q.seen) < sum(c is None for c in tree.children) / 2
