"""Exact top-k inner product search, block at a time, with bounds.

Candidates are cut into blocks of neighbours in ``vec_id`` order, and 16 neighbouring blocks form a group. In a task,
every block has a forward index (its integer matrix) and its term maxima and minima. The bound of a block for a
query q is the sum over terms of max(q_t * max_t, q_t * min_t): no vector of the block scores higher.

Two rounds, each streaming queries past groups:

1. Per query and group: the group's bound, and the k-th score inside the block of the largest bound. The largest of these
   k-th scores is a floor below which the query's final k-th score cannot be.
2. Only pairs of query and group whose bound reaches the floor are formed. In a task a query takes the group's blocks in
   falling order of bounds and scores them until the next bound falls below its k-th score so far (or its floor). Equal
   bounds are still scored, so ties are exact.

The lists of a query, at most k rows per group, are merged by a window. Values are integers; products and sums are exact in
double precision up to 2**53, beyond which the job is ended with a message.

Edge cases: vectors that are NULL, empty or hold NULL or non-finite components take no part, as query or candidate; a
query is never its own candidate, and rows that repeat its id are not either; with fewer candidates than k all are
returned; a repeated query row gives its answer once for each row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.sharding import numbered
from tidemark.llm.vectors import best, matrix, streamed, usable
from tidemark.session import written

BLOCK, BLOCKS_PER_GROUP = 256, 16


class Blocks:
    """The forward indexes and bounds of one group."""

    def __init__(self, rows: pa.Table):
        numbers = rows.column("block").to_numpy()
        self.ids = rows.column("id").to_numpy()
        values = matrix(rows.column("vec"))
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        self.spans = list(zip([0, *cuts], [*cuts, len(numbers)]))
        self.values = values
        self.high = np.array([values[a:b].max(axis=0) for a, b in self.spans])
        self.low = np.array([values[a:b].min(axis=0) for a, b in self.spans])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """queries x blocks."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        if np.abs(q).max(initial=0) * np.abs(self.values).max(initial=0) * q.shape[1] >= 2**53:
            raise ValueError("components too large for exact scores")
        return up @ self.high.T + down @ self.low.T

    def scored(self, block: int, queries: np.ndarray) -> np.ndarray:
        a, b = self.spans[block]
        return queries @ self.values[a:b].T


def _columns(run: pa.RecordBatch):
    return run.column("qno").to_pylist(), run.column("id").to_pylist(), matrix(run.column("vec")), run.column("floor").to_pylist()


def _floors(k: int):
    def search(rows: pa.Table):
        index = Blocks(rows)

        def chunk(run: pa.RecordBatch, group: int):
            qno, own, q, _ = _columns(run)
            bounds = index.bounds(q)
            first = bounds.argmax(axis=1)
            floors = np.full(len(qno), -np.inf)
            for block in np.unique(first):
                mine = np.flatnonzero(first == block)
                a, b = index.spans[block]
                scores = index.scored(block, q[mine])
                for i, row in zip(mine, scores):
                    row = row[index.ids[a:b] != own[i]]
                    if len(row) >= k:
                        floors[i] = np.partition(row, len(row) - k)[len(row) - k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(qno, pa.int64()), pa.array([group] * len(qno), pa.int64()), pa.array(bounds.max(axis=1)), pa.array(floors)],
                ["qno", "grp", "bound", "floor"],
            )

        return chunk

    return search


def _lists(k: int):
    def search(rows: pa.Table):
        index = Blocks(rows)

        def chunk(run: pa.RecordBatch, group: int):
            qno, own, q, floor = _columns(run)
            bounds = index.bounds(q)
            order = np.argsort(-bounds, axis=1, kind="stable")
            tops: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(qno)
            kth = np.array([-np.inf if f is None else f for f in floor])
            alive = np.arange(len(qno))
            for step in range(len(index.spans)):
                alive = alive[bounds[alive, order[alive, step]] >= kth[alive]]
                for block in np.unique(order[alive, step]):
                    mine = alive[order[alive, step] == block]
                    a, b = index.spans[block]
                    for i, row in zip(mine, index.scored(block, q[mine])):
                        near = np.flatnonzero((row >= kth[i]) & (index.ids[a:b] != own[i]))
                        scores = np.concatenate([tops[i][0], row[near]])
                        ids = np.concatenate([tops[i][1], index.ids[a:b][near]])
                        at = best(scores, ids, k)
                        tops[i] = scores[at], ids[at]
                        if len(at) == k:
                            kth[i] = max(kth[i], scores[at[-1]])
            n = [len(s) for s, _ in tops]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(qno, np.int64), n)),
                    pa.array(np.repeat(np.array(own, np.int64), n)),
                    pa.array(np.concatenate([i for _, i in tops])),
                    pa.array(np.concatenate([s for s, _ in tops]).astype(np.int64)),
                ],
                ["qno", "query_id", "vec_id", "score"],
            )

        return chunk

    return search


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """The k candidates of the largest inner product for every query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Both inputs have ``id`` and ``vec``, an array of doubles that hold integers.
    """
    rows, n = numbered(candidates.select("id", "vec").where(usable(F.col("vec"))), ["id"])
    at = F.col("row_number")
    groups = rows.select(
        "id", "vec", (at - F.pmod(at, F.lit(block))).alias("block"), F.call_function("div", at, F.lit(block * BLOCKS_PER_GROUP)).alias("grp")
    )
    asked = written(queries.select("id", "vec").where(usable(F.col("vec"))).withColumn("qno", F.monotonically_increasing_id()))
    last = max(0, n - 1) // (block * BLOCKS_PER_GROUP)
    everywhere = asked.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("grp"), F.lit(None).cast("double").alias("floor")
    )
    seen = written(streamed(groups, everywhere, _floors(k), "qno long, grp long, bound double, floor double"))
    floors = seen.groupBy("qno").agg(F.max("floor").alias("floor"))
    kept = seen.drop("floor").join(floors, "qno").where(F.col("bound") >= F.col("floor")).select("qno", "grp", "floor")
    lists = streamed(groups, kept.join(asked, "qno"), _lists(k), "qno long, query_id long, vec_id long, score long")
    order = Window.partitionBy("qno").orderBy(F.col("score").desc(), "vec_id")
    ranked = lists.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def quantised(vector) -> object:
    """floor(256 * x) of every component, as whole numbers in doubles."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))


def op10_block_topk(spark, sf_dir: str) -> DataFrame:
    """For every 50th vector the 5 candidates of the largest integer inner product."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding")))
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("vec"))
    return exact_topk(vectors.where(F.col("id").isNotNull()), vectors.where(F.col("id") % 50 == 0), k=5)


QUERIES = {"op10_block_topk": op10_block_topk}

ORACLE = {
    "op10_block_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
