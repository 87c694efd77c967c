"""Hard-negative mining: exact searches by inner product in per-partition ball trees.

Rows are dealt out evenly by hash, anchors in blocks; each pair of a part of
the rows and a block of anchors meets in one task, which builds a ball tree of
its rows. A ball bounds the inner products of its rows from both sides:
q.c - |q| r and q.c + |q| r. A search takes balls best first, skips those whose
products all lie outside its window, and ends when the next ball lies strictly
beneath the k-th best so far.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import settled

#: Fixed by contract: one row in so many is an anchor; its positives; the negatives of a positive; their least share of its score, in hundredths.
EVERY, POSITIVES, NEGATIVES, SHARE = 100, 5, 5, 80
#: Rows of a part, anchors of a block, rows of a leaf.
PART_ROWS, BLOCK_ANCHORS, LEAF_ROWS = 8192, 4096, 256
#: Levels by which components are made whole numbers; bounds are widened by this share for rounding.
LEVELS, SLACK = 256, 1e-9


class BallTree:
    """Balls over the rows of ``points``; ``only`` is the label of a ball whose rows have but one, else None."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        size = np.abs(points).max(initial=0)
        # Products of doubles are whole up to 2 ** 53; beyond that Python's integers keep them so.
        self.points = points if size * size * max(1, points.shape[1]) < 2.0**53 else np.array([[int(x) for x in p] for p in points], object)
        self.labels = labels
        self.rows: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.only: list = []
        centers, radii = [], []
        todo = [np.arange(len(points))]
        while todo and len(points):
            rows = todo.pop(0)
            own = points[rows]
            center = own.mean(axis=0)
            far = np.sqrt(((own - center) ** 2).sum(axis=1))
            self.rows.append(rows)
            self.only.append(labels[rows[0]] if (labels[rows] == labels[rows[0]]).all() else None)
            centers.append(center)
            radii.append(far.max())
            if len(rows) <= leaf or far.max() == 0:
                self.children.append(None)
                continue
            # Halves by the direction between two rows far apart.
            one = own[far.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            by = np.argsort(own @ (other - one), kind="stable")
            self.children.append((len(self.rows) + len(todo), len(self.rows) + len(todo) + 1))
            todo += [rows[by[: len(by) // 2]], rows[by[len(by) // 2 :]]]
        self.centers, self.radii = np.array(centers), np.array(radii)
        self.norms = np.sqrt((self.centers**2).sum(axis=1)) if centers else np.zeros(0)

    def best(self, query: Query, k: int, order: np.ndarray, same: object = None, other: object = None, without: int = -1, low: float = -np.inf, high: float = np.inf) -> list[tuple[int, int]]:
        """(score, row) of the k rows with the largest scores within [low, high], ties by ``order``: those labelled ``same``, or not labelled ``other``."""
        found: list[tuple[int, int, int]] = []
        heap = [(-query.most[0], 0)] if self.rows else []
        while heap:
            bound, ball = heapq.heappop(heap)
            if len(found) == k and -bound < found[-1][0]:
                break
            if -bound < low or query.least[ball] > high or same is not None and self.only[ball] not in (None, same) or other is not None and self.only[ball] == other:
                continue
            if self.children[ball]:
                for child in self.children[ball]:
                    heapq.heappush(heap, (-query.most[child], child))
                continue
            rows, scores = self.rows[ball], query.scores(ball)
            right = scores >= (max(low, found[-1][0]) if len(found) == k else low)
            right &= scores <= high
            right &= self.labels[rows] == same if same is not None else self.labels[rows] != other
            at = np.flatnonzero(right)
            at = at[rows[at] != without]
            if len(at):
                at = at[np.lexsort((order[rows[at]], -scores[at]))[:k]]
                found = sorted(found + [(int(scores[i]), int(order[rows[i]]), int(rows[i])) for i in at], key=lambda x: (-x[0], x[1]))[:k]
        return [(s, r) for s, _, r in found]


class Query:
    """One query against a tree: least and largest inner product that the rows of each ball can have, and the scores of the leaves that it has been to."""

    def __init__(self, tree: BallTree, vector: np.ndarray) -> None:
        self.tree, self.seen = tree, {}
        self.vector = vector if tree.points.dtype != object else np.array([int(x) for x in vector], object)
        norm = np.sqrt((vector**2).sum())
        middle, reach = (tree.centers @ vector, norm * tree.radii) if tree.rows else (np.zeros(0), np.zeros(0))
        slack = SLACK * (1 + norm * (tree.norms + tree.radii)) if tree.rows else 0
        self.least, self.most = (middle - reach - slack).tolist(), (middle + reach + slack).tolist()

    def scores(self, ball: int) -> np.ndarray:
        if ball not in self.seen:
            self.seen[ball] = self.tree.points[self.tree.rows[ball]] @ self.vector
        return self.seen[ball]


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(row, vec_id, label, size, vector) of the rows that take part: labels moved on and components made whole as the contract has it."""
    v, finite = F.col(embedding).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    fit = F.col(label).isNotNull() & F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(v, finite)
    key, said = F.col(vec_id).cast("long"), F.col(label).cast("long")
    return rows.filter(fit).select(
        F.monotonically_increasing_id().alias("row"), key.alias("vec_id"), F.when(key % 7 == 0, (said + 1) % 10).otherwise(said).alias("label"),
        F.size(embedding).alias("size"), F.transform(v, lambda x: F.floor(x * LEVELS).cast("double")).alias("vector"),
    )


def _matrix(vectors: pd.Series, size: int) -> np.ndarray:
    return np.array(list(vectors), np.float64).reshape(len(vectors), size)


def _meeting(rows: DataFrame, anchors: DataFrame, parts: int, blocks: int, run, schema: str) -> DataFrame:
    """Each part of the rows with each block of the anchors of its size, in one task each."""
    dealt = rows.withColumns({"part": F.pmod(F.xxhash64("row"), F.lit(parts)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    asked = anchors.withColumns({"block": F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))})
    keys = ("part", "block", "size")
    return dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, schema)


def _first(found: DataFrame, keys: tuple[str, ...], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mined(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", part_rows: int = PART_ROWS, block_anchors: int = BLOCK_ANCHORS, leaf: int = LEAF_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, by the contract's rules.

    Rows without vec_id, label or vector, or with a component that is null or
    not finite, take no part. Rows with one vec_id are rows of their own; a row
    isn't its own positive, a repeated row is. Vectors of another length don't
    meet an anchor; those without components score 0. Without an anchor, a
    positive or a negative in the window there are no rows; other columns are
    ignored.
    """
    all_rows = settled(usable(rows, vec_id, embedding, label))
    anchors = all_rows.filter(F.col("vec_id") % EVERY == 0)
    n, n_anchors = all_rows.count(), anchors.count()
    parts, blocks = max(1, -(-n // part_rows)), max(1, -(-n_anchors // block_anchors))

    def positives(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if own.empty or asked.empty:
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("anchor", "row", "vec_id", "score")})
        tree = BallTree(_matrix(own["vector"], key[2]), own["label"].to_numpy(), leaf)
        ids, numbers = own["vec_id"].to_numpy(), own["row"].to_numpy()
        order = np.empty(len(own), np.int64)
        order[np.lexsort((numbers, ids))] = np.arange(len(own))
        place = {r: k for k, r in enumerate(numbers.tolist())}
        made = []
        for a in asked.itertuples():
            q = Query(tree, np.asarray(a.vector, np.float64))
            made += [(a.row, numbers[r], ids[r], s) for s, r in tree.best(q, POSITIVES, order, same=a.label, without=place.get(a.row, -1))]
        return pd.DataFrame(made, columns=["anchor", "row", "vec_id", "score"])

    found = _meeting(all_rows, anchors, parts, blocks, positives, "anchor long, row long, vec_id long, score long")
    pairs = settled(_first(found, ("anchor",), POSITIVES).select("anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = pairs.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("positive", "positive_score")).alias("windows"))
    searching = settled(anchors.join(windows, "row"))

    def negatives(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor", "positive", "row", "vec_id", "score"]
        if own.empty or asked.empty:
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in names})
        tree = BallTree(_matrix(own["vector"], key[2]), own["label"].to_numpy(), leaf)
        ids, numbers = own["vec_id"].to_numpy(), own["row"].to_numpy()
        order = np.empty(len(own), np.int64)
        order[np.lexsort((numbers, ids))] = np.arange(len(own))
        made = []
        for a in asked.itertuples():
            q = Query(tree, np.asarray(a.vector, np.float64))
            for w in a.windows:
                top = int(w["positive_score"])
                low = -(-SHARE * top // 100)  # the least whole score with 80 * positive <= 100 * it
                if low <= top:
                    made += [(a.row, w["positive"], numbers[r], ids[r], s) for s, r in tree.best(q, NEGATIVES, order, other=a.label, low=low, high=top)]
        return pd.DataFrame(made, columns=names)

    near = _meeting(all_rows, searching, parts, blocks, negatives, "anchor long, positive long, row long, vec_id long, score long")
    kept = _first(near, ("anchor", "positive"), NEGATIVES).select("anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return kept.join(pairs.join(named, "anchor"), ["anchor", "positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = f"""
WITH fit AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor({LEVELS} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vector
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.row, b.vec_id, coalesce(list_sum([x[1] * x[2] FOR x IN list_zip(a.vector, b.vector)]), 0) AS score
  FROM fit a JOIN fit b ON a.vec_id % {EVERY} = 0 AND a.row <> b.row AND len(a.vector) = len(b.vector)),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= {POSITIVES}),
found AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id, n.row) AS rank
  FROM positives p JOIN pairs n ON p.anchor = n.anchor AND NOT n.same AND {SHARE} * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score, CAST(negative_score AS BIGINT) AS negative_score FROM found WHERE rank <= {NEGATIVES}
"""
