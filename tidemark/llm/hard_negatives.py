"""Hard-negative mining by threshold joins over an inverted index cut by norm bounds.

For an anchor, its positives are the highest-scoring other rows of its label, and the negatives of a positive are the highest-scoring rows
of other labels whose score lies in a window below the positive's. Scores are inner products of whole numbers. Both searches are joins
"all pairs of a score of at least t" with bounds by the inequality of Cauchy and Schwarz:

* Dimensions have one order, those of little energy over the whole table first, and are cut into blocks of 16. A row's first dimensions are
  left out of the index for threshold t as long as their norm times the query's stays below t: a row that meets a query only
  there cannot reach t. What is indexed of a block of dimensions is a matrix of the rows that have it, those with most dimensions first.
* Partial scores are accumulated from the last block to the first. After each block, a pair whose partial score and remaining norms
  (query's times row's, over what is not accumulated yet) stay below t goes, and so does one that surely lies above the window; a row that
  no query of the chunk needs is taken out of the matrices. What was not indexed is added for the survivors.
* t starts at a high score of a small sample of rows and is lowered until the window is full (or its lower edge is reached); only queries whose
  windows are not full go on. When a window holds k rows at or above t, its first k are among them, so results are exact.

Rows are numbered in the order of label and norm and cut into groups, so a hot label is spread over groups and a label's groups are a
range. A task holds one group and streams chunks of anchors past it. Anchors go to the groups of their label for positives, and for
negatives to all groups but those inside their label, except where the largest norm of a run of groups (at most 1,000 such
norms are known to the driver, whatever the input) shows that the window cannot be reached. A group gives at most k rows for each
window; a window function merges them. Anchors are a stated query set, and each is sent once to a group of some 8,000 rows.

Edge cases: rows with a NULL id, a NULL label or a vector that is NULL, empty or holds NULL or non-finite components take no part; vectors
of different lengths count as filled up with zeros; rows with the anchor's id are not among its positives; a repeated anchor row
gives its answer once for each row, repeated candidates count each; with too few rows all are returned, and an anchor without positives or a
positive without negatives gives no row; windows of negative scores are empty; where scores may exceed 2**53 they are computed exactly
without pruning and end at the limits of 64 bits; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.sharding import numbered
from tidemark.llm.topk import quantised
from tidemark.llm.vectors import QUERY_CHUNK, best, usable
from tidemark.session import written

CELLS = 1 << 19  # numbers in a group's matrix
BLOCK = 16
SAMPLE = 128
RUNS = 1000
SURE = 1 + 1e-9  # bounds are rounded up by more than their floating-point error
LIMIT = 2**63 - 1
POSITIVE = "qno long, slot int, id long, score long"


def padded(column: pa.Array, order: np.ndarray) -> np.ndarray:
    """A list column as a matrix with its dimensions in ``order``; short lists are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), len(order)))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out[:, order]


class Group:
    """The rows of one group: their vectors, and the norms of their first dimensions up to each block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.edges = [*range(0, x.shape[1], BLOCK), x.shape[1]]
        self.norms = norms_before(x, self.edges)
        self.largest = float(np.abs(x).max(initial=0))
        self.sample = np.unique(np.linspace(0, len(ids) - 1, min(SAMPLE, len(ids))).astype(int))

    def postings(self, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows with an indexed block, those with most blocks first, and how many of them each block has.

        A row's blocks are indexed from the one on before whose end its norm reaches ``theta``.
        """
        first = np.maximum((self.norms * SURE < theta).sum(axis=1) - 1, 0) if theta > 0 else np.zeros(len(self.ids), int)
        blocks = len(self.edges) - 1
        if theta > 0:
            first[self.norms[:, -1] * SURE < theta] = blocks  # nowhere near
        rows = np.argsort(first, kind="stable")
        counts = np.searchsorted(first[rows], np.arange(blocks), side="right")
        return rows[: counts[-1]], counts

    def join(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the group, and the scores of every query with them; a score outside [low, high] may be anything outside."""
        edges, blocks = self.edges, len(self.edges) - 1
        before = norms_before(q, edges)
        norms = before[:, -1]
        with np.errstate(divide="ignore", invalid="ignore"):
            per_norm = np.where(norms > 0, low / norms, np.where(low > 0, np.inf, -np.inf))
        rows, counts = self.postings(float(per_norm.min(initial=np.inf)))
        firsts = np.searchsorted(counts, np.arange(len(rows)), side="right")
        scores = np.zeros((len(q), len(rows)))
        for j in range(blocks - 1, -1, -1):
            n = int(np.searchsorted(firsts, j, side="right"))
            scores[:, :n] += q[:, edges[j] : edges[j + 1]] @ self.x[rows[:n], edges[j] : edges[j + 1]].T
            at = np.maximum(firsts, j)
            left = before[:, at] * (self.norms[rows, at] * SURE)
            alive = ((scores + left >= low[:, None]) & (scores - left <= high[:, None])).any(axis=0)
            if alive.mean() < 0.75 if len(alive) else False:
                rows, firsts, scores = rows[alive], firsts[alive], scores[:, alive]
        for j in range(blocks):  # what was not indexed
            n = int(np.searchsorted(firsts, j, side="right"))
            if n < len(rows):
                scores[:, n:] += q[:, edges[j] : edges[j + 1]] @ self.x[rows[n:], edges[j] : edges[j + 1]].T
        return rows, scores


def norms_before(x: np.ndarray, edges: list[int]) -> np.ndarray:
    """The norm of the dimensions before each edge, per row."""
    squares = np.cumsum(np.hstack([np.zeros((len(x), 1)), x * x]), axis=1)
    return np.sqrt(squares[:, edges])


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size, held to the limits of 64 bits."""
    sums = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return np.array([[max(-LIMIT - 1, min(LIMIT, int(s))) for s in row] for row in sums], object).reshape(len(q), len(x))


def windows_filled(group: Group, q: np.ndarray, takes, windows: list[list[tuple[int, float, float]]], k: int) -> Iterator[tuple[int, int, np.ndarray, list[int]]]:
    """(query, slot, rows, scores): the k best rows of each window of each query within a group.

    ``windows``: per query (slot, lower edge, upper edge); ``takes(queries, rows)``: which pairs may count at all, as a matrix.
    """
    if np.abs(q).max(initial=0) * group.largest * q.shape[1] >= 2**53:
        everything = np.arange(len(group.ids))
        for i in range(len(q)):
            scores, allowed = exact_scores(q[i : i + 1], group.x)[0], takes(np.array([i]), everything)[0]
            for slot, low, high in windows[i]:
                near = [r for r in everything[allowed] if low <= scores[r] <= high]
                near = sorted(near, key=lambda r: (-scores[r], group.ids[r]))[:k]
                yield i, slot, np.array(near, int), [int(scores[r]) for r in near]
        return
    # Where to start: the highest score of the sample within each window, then its 8th, 64th, then the window's edge.
    tried = q @ group.x[group.sample].T
    seen = takes(np.arange(len(q)), group.sample)
    steps: dict[tuple[int, int], list[float]] = {}
    for i, wanted in enumerate(windows):
        for slot, low, high in wanted:
            inside = np.sort(tried[i][seen[i] & (tried[i] >= low) & (tried[i] <= high)])[::-1]
            steps[i, slot] = [float(low), *[float(inside[p]) for p in (63, 7, 0) if p < len(inside)]]
    edges = {(i, slot): (low, high) for i, wanted in enumerate(windows) for slot, low, high in wanted}
    while steps:
        asked = sorted({i for i, _ in steps})
        level = {key: way.pop() for key, way in steps.items()}
        low = np.array([min(t for (i, _), t in level.items() if i == a) for a in asked])
        high = np.array([max(edges[key][1] for key in level if key[0] == a) for a in asked], float)
        rows, scores = group.join(q[asked], low, high)
        allowed = takes(np.array(asked), rows)
        at = {a: n for n, a in enumerate(asked)}
        for key, t in level.items():
            n = at[key[0]]
            near = np.flatnonzero(allowed[n] & (scores[n] >= t) & (scores[n] <= edges[key][1]))
            if len(near) >= k or t <= edges[key][0]:
                near = near[best(scores[n][near], group.ids[rows[near]], k)]
                yield *key, rows[near], [int(s) for s in scores[n][near]]
                del steps[key]


def _streamed(candidates: DataFrame, queries: DataFrame, order: np.ndarray, search, schema: str) -> DataFrame:
    """``search(group, queries)`` for every group of ``candidates`` (grp, id, label, vec) and every chunk of its ``queries``
    (grp, qno, id, label, vec, positives)."""
    nothing = [F.lit(None).cast("long").alias("qno"), F.lit(None).cast("array<long>").alias("positives")]
    rows = candidates.select("grp", F.lit(0).alias("kind"), "id", "label", "vec", *nothing).unionByName(
        queries.select("grp", F.lit(1).alias("kind"), "id", "label", "vec", "qno", "positives")
    )

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, k = (b.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "kind"))
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(k) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
                for at in range(lo, hi, QUERY_CHUNK if hi > lo and k[lo] else max(hi - lo, 1)):
                    yield b.slice(at, min(QUERY_CHUNK, hi - at) if k[lo] else hi - lo)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, group = None, [], None
        for r in runs(batches):
            grp, kind = r.column("grp")[0].as_py(), r.column("kind")[0].as_py()
            if grp != now:
                now, held, group = grp, [], None
            if kind == 0:
                held.append(r)
                continue
            if held and group is None:
                table = pa.Table.from_batches(held)
                group = Group(table.column("id").to_numpy(), table.column("label").to_numpy(), padded(table.column("vec"), order))
                held = []
            if group is not None:
                yield from search(group, r, padded(r.column("vec"), order))

    return rows.repartition("grp").sortWithinPartitions("grp", "kind", "id", "qno").mapInArrow(run, schema)


def _batch(qno: np.ndarray, group: Group, found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    parts = [(qno[i], slot, group.ids[rows], scores) for i, slot, rows, scores in found if len(rows)]
    if parts:
        n = [len(p[2]) for p in parts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([p[0] for p in parts], n), pa.int64()),
                pa.array(np.repeat([p[1] for p in parts], n), pa.int32()),
                pa.array(np.concatenate([p[2] for p in parts]), pa.int64()),
                pa.array([s for p in parts for s in p[3]], pa.int64()),
            ],
            ["qno", "slot", "id", "score"],
        )


def _positives(k: int):
    def search(group: Group, r: pa.RecordBatch, q: np.ndarray):
        own, labels = (r.column(c).to_numpy() for c in ("id", "label"))

        def takes(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return (group.labels[rows] == labels[queries][:, None]) & (group.ids[rows] != own[queries][:, None])

        windows = [[(0, -np.inf, np.inf)]] * len(q)
        yield from _batch(r.column("qno").to_numpy(), group, windows_filled(group, q, takes, windows, k))

    return search


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest whole score s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _negatives(k: int, low: int, high: int):
    def search(group: Group, r: pa.RecordBatch, q: np.ndarray):
        labels = r.column("label").to_numpy()

        def takes(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return group.labels[rows] != labels[queries][:, None]

        windows = []
        for positives in r.column("positives").to_pylist():
            edges = [(slot, *window(s, low, high)) for slot, s in enumerate(positives)]
            windows.append([e for e in edges if e[1] <= e[2]])
        yield from _batch(r.column("qno").to_numpy(), group, windows_filled(group, q, takes, windows, k))

    return search


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def energies(rows: DataFrame) -> np.ndarray:
    """The sum of squares of every dimension, as long as the longest vector: one row a dimension reaches the driver."""

    def squares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0)
        for b in batches:
            lengths = b.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            wide = padded(b.column(0), np.arange(lengths.max(initial=0)))
            sums = np.square(wide).sum(axis=0)
            if len(sums) > len(total):
                sums, total = total, sums
            total[: len(sums)] += sums
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["dim", "energy"])

    sums = rows.select("vec").mapInArrow(squares, "dim int, energy double").groupBy("dim").agg(F.sum("energy").alias("energy"))
    return np.array([e for _, e in sorted(map(tuple, sums.collect()))])


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, cells: int = CELLS) -> DataFrame:
    """For every anchor and each of its positives the best negatives with low * positive_score <= 100 * score <= high * positive_score.

    Both inputs have ``id`` and ``label`` (numbers) and ``vec``, an array of doubles that hold whole numbers. Gives ``anchor_id``, ``positive_id``,
    ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.
    """
    fit = usable(F.col("vec")) & F.col("id").isNotNull() & F.col("label").isNotNull()
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    columns = [F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vec", norm.alias("norm")]
    asked = written(anchors.where(fit).select(*columns).withColumn("qno", F.monotonically_increasing_id()))
    placed, n = numbered(rows.where(fit).select(*columns), ["label", "norm"])
    energy = energies(placed)
    order = np.argsort(energy, kind="stable")
    size = max(1, cells // max(1, len(order)))
    groups = written(placed.withColumn("grp", F.call_function("div", "row_number", F.lit(size).cast("long"))).drop("row_number"))
    last = max(0, n - 1) // size
    per_run = last // RUNS + 1  # consecutive groups whose largest norm is known together
    run_no = F.call_function("div", "grp", F.lit(per_run).cast("long"))
    norms = dict(map(tuple, groups.groupBy(run_no.alias("run")).agg(F.max("norm")).collect()))  # RUNS rows at most

    spans = groups.groupBy("label").agg(F.min("grp").alias("from"), F.max("grp").alias("to"))
    ours = asked.join(spans, "label").withColumn("grp", F.explode(F.sequence("from", "to"))).withColumn("positives", F.lit(None).cast("array<long>"))
    best_of = written(_ranked(_streamed(groups, ours, order, _positives(positives), POSITIVE), positives, "qno").drop("slot"))

    scores = best_of.groupBy("qno").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))  # at most ``positives`` each
    windows = scores.select("qno", F.transform("p", lambda p: p["score"]).alias("positives"))
    edges = F.transform("positives", lambda s: s.cast("double") * low / 100)
    known = F.array(*[F.struct(F.lit(r).cast("long").alias("run"), F.lit(float(v)).alias("norm")) for r, v in sorted(norms.items())])
    known = known.cast("array<struct<run:bigint,norm:double>>")  # an empty one has no type of its own
    reached = F.filter(known, lambda r: r["norm"] * F.col("norm") * (1 + 1e-6) >= F.array_min(edges))
    theirs = asked.join(windows, "qno").join(spans, "label").withColumn("run", F.explode(reached)).select("*", F.col("run.run").alias("no"))
    begins = F.col("no") * F.lit(per_run).cast("long")
    theirs = theirs.withColumn("grp", F.explode(F.sequence(begins, F.least(begins + (per_run - 1), F.lit(last).cast("long")))))
    # A group strictly inside the label's range holds that label only.
    theirs = theirs.where((F.col("grp") <= F.col("from")) | (F.col("grp") >= F.col("to")))
    found = _streamed(groups, theirs, order, _negatives(negatives, low, high), POSITIVE)
    nearest = _ranked(found, negatives, "qno", "slot").select("qno", (F.col("slot") + 1).alias("p_rank"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    chosen = best_of.select("qno", F.col("rank").alias("p_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = asked.select("qno", F.col("id").alias("anchor_id"))
    return nearest.join(chosen, ["qno", "p_rank"]).join(named, "qno").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_threshold_negatives(spark, sf_dir: str) -> DataFrame:
    """For every 100th vector, its 5 positives and the 5 negatives next below each; every 7th vector's label is one further."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), quantised(F.col("embedding")).alias("vec"))
    return hard_negatives(vectors, vectors.where(F.col("id") % 100 == 0))


QUERIES = {"op11_threshold_negatives": op11_threshold_negatives}

ORACLE = {
    "op11_threshold_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same,
    CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), p AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same
  ) WHERE nth <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
}
