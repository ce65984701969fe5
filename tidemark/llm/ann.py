"""Approximate nearest neighbours by learned partitions: a balanced partition of a neighbour graph, a classifier as router.

Fit, on a sample of at most ``SAMPLE`` distinct vectors (the rows with the smallest hash of id and vector): the k-nearest-
neighbour graph of the sample is cut into ``parts`` balanced parts (a balanced split along principal directions, then
moves of points to the part most of their neighbours are in, while sizes allow); a network with one hidden layer learns
to predict, from the vector alone, the parts of a point and its neighbours.

Index: every row goes to its most probable part. Parts larger than ``GROUP_ROWS`` are split into groups of about that many
rows, so a vector that makes up a third of all rows does not land in one task.

Search: a query goes to its most probable parts until their probabilities sum to ``MASS``, ``LEAST`` parts at least, is
scored against every row of their groups by dense products, and the near candidates are scored again from the original
vectors, one pair like any other, so that equal vectors get equal scores. The lists, at most k rows per group, are
merged by a window.

The only thing broadcast is the network, whose size is fixed by the parameters. Recall is measured in the tests.

Edge cases: vectors that are NULL, empty, zero or hold NULL or non-finite components take no part; a query is never its
own candidate; with fewer candidates than k those found are returned (with one part, all); a repeated query row gives
its answer once for each row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vectors import matrix, streamed, usable
from tidemark.session import written

SAMPLE = 4096
GROUP_ROWS = 4096
PART_ROWS = 1024  # rows of a part the number of parts aims at, up to MOST_PARTS
MOST_PARTS = 64
MASS, LEAST = 0.98, 4
NEIGHBOURS, HIDDEN, EPOCHS = 10, 128, 40


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other points, in chunks of rows."""
    k = min(k, len(x) - 1)
    near = np.zeros((len(x), max(k, 0)), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        if k > 0:
            near[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return near


def _split(x: np.ndarray, members: np.ndarray, parts: int, first: int, label: np.ndarray) -> None:
    """Balanced split of ``members`` into ``parts`` by halves along the principal direction."""
    if parts == 1 or len(members) == 0:
        label[members] = first
        return
    centred = x[members] - x[members].mean(axis=0)
    direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    order = members[np.argsort(centred @ direction, kind="stable")]
    left = parts // 2
    cut = len(order) * left // parts
    _split(x, order[:cut], left, first, label)
    _split(x, order[cut:], parts - left, first + left, label)


def balanced_partition(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 10) -> np.ndarray:
    """Part of each point: few neighbour links between parts, no part above ``slack`` times the mean size."""
    label = np.zeros(len(x), np.int64)
    _split(x, np.arange(len(x)), parts, 0, label)
    most = math.ceil(slack * len(x) / parts)
    sizes = np.bincount(label, minlength=parts)
    source = np.repeat(np.arange(len(x)), near.shape[1])
    both = np.concatenate([source, near.ravel()]), np.concatenate([near.ravel(), source])
    order = np.argsort(both[0], kind="stable")
    to, starts = both[1][order], np.searchsorted(both[0][order], np.arange(len(x) + 1))
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(label[to[starts[i] : starts[i + 1]]], minlength=parts)
            now = label[i]
            votes_open = np.where(sizes < most, votes, -1)
            best = int(votes_open.argmax())
            if votes_open[best] > votes[now]:
                sizes[now] -= 1
                sizes[best] += 1
                label[i] = best
                moved += 1
        if not moved:
            break
    return label


class Router:
    """One hidden layer; ``probabilities`` of parts for unit vectors."""

    def __init__(self, w1, b1, w2, b2):
        self.w1, self.b1, self.w2, self.b2 = w1, b1, w2, b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray) -> Router:
        """Cross entropy with the given part shares, Adam, fixed seed."""
        rng = np.random.default_rng(1)
        d, m = x.shape[1], target.shape[1]
        p = [rng.normal(0, math.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, m)), np.zeros(m)]
        first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(EPOCHS):
            rate = 0.01 * 0.5 * (1 + math.cos(math.pi * epoch / EPOCHS))
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                h = np.maximum(x[at] @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                z = np.exp(z - z.max(axis=1, keepdims=True))
                g = (z / z.sum(axis=1, keepdims=True) - target[at]) / len(at)
                back = (g @ p[2].T) * (h > 0)
                step += 1
                for i, grad in enumerate((x[at].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                    first[i] += 0.1 * (grad - first[i])
                    second[i] += 0.001 * (grad * grad - second[i])
                    p[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        return cls(*p)


def fit_router(vectors: np.ndarray, parts: int) -> Router:
    x = unit(np.unique(vectors, axis=0))
    parts = max(1, min(parts, len(x) // 8))
    near = neighbour_graph(x, NEIGHBOURS)
    label = balanced_partition(x, near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), 2.0)
    for j in range(near.shape[1]):
        np.add.at(target, (np.arange(len(x)), label[near[:, j]]), 1.0)
    return Router.fit(x, target / target.sum(axis=1, keepdims=True))


def trained(vectors: DataFrame, parts: int, sample: int = SAMPLE) -> Router | None:
    """A router fitted in one task on the bounded sample; None for an empty table."""

    def run(batches):
        tables = [b for b in batches if b.num_rows]
        if tables:
            model = fit_router(matrix(pa.Table.from_batches(tables).column("vec")), parts)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    chosen = vectors.select("vec").orderBy(F.xxhash64("id", "vec")).limit(sample)
    row = chosen.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else None


def _candidates(k: int):
    def search(rows: pa.Table):
        ids, values = rows.column("id").to_numpy(), matrix(rows.column("vec"))
        units = unit(values)

        def chunk(run: pa.RecordBatch, group: int):
            qno, own, q = run.column("qno").to_pylist(), run.column("id").to_pylist(), matrix(run.column("vec"))
            found = []
            for i, row in enumerate(unit(q) @ units.T):
                near = np.flatnonzero(ids != own[i])
                if len(near) > k:
                    s = row[near]
                    near = near[s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9]
                score = cosine(values[near], q[i])
                top = np.lexsort((ids[near], -score))[:k]
                found.append((near[top], score[top]))
            n = [len(at) for at, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(qno, np.int64), n)),
                    pa.array(np.repeat(np.array(own, np.int64), n)),
                    pa.array(ids[np.concatenate([at for at, _ in found])]),
                    pa.array(np.concatenate([s for _, s in found])),
                ],
                ["qno", "query_id", "vec_id", "score"],
            )

        return chunk

    return search


def cosine(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines with ``q``, summed in component order for every pair alike."""
    scale = np.maximum(np.abs(rows).max(axis=1, initial=0), 1e-300), max(np.abs(q).max(), 1e-300)
    rows, q = rows / scale[0][:, None], q / scale[1]
    dot, a, b = np.zeros(len(rows)), np.zeros(len(rows)), 0.0
    for j in range(len(q)):
        dot += rows[:, j] * q[j]
        a += rows[:, j] * rows[:, j]
        b += q[j] * q[j]
    return np.clip(dot / np.sqrt(a * b), -1.0, 1.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, sample: int = SAMPLE, mass: float = MASS, least: int = LEAST) -> DataFrame:
    """About the k nearest by cosine: ``query_id``, ``rank``, ``vec_id``, ``score``; inputs have ``id`` and ``vec``."""
    vec = F.col("vec")
    part = usable(vec) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select("id", "vec").where(F.col("id").isNotNull()).where(part)
    n = rows.count()
    router = trained(rows, min(MOST_PARTS, max(1, n // PART_ROWS)), sample)
    model = pickle.dumps(router)

    def routed(most: float, atleast: int, schema: list[str]):
        def run(batches):
            net = pickle.loads(model)
            for b in batches:
                if net is None or not b.num_rows:
                    continue
                p = net.probabilities(unit(matrix(b.column("vec"))))
                order = np.argsort(-p, axis=1, kind="stable")
                before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
                taken = (before < most) | (np.arange(p.shape[1]) < atleast)
                at, rank = np.nonzero(taken)
                out = b.select(schema).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(order[at, rank])], [*schema, "part"])

        return run

    indexed = written(rows.mapInArrow(routed(0.0, 1, ["id", "vec"]), "id long, vec array<double>, part long"))
    # A row per part: how many groups it is split into.
    splits = {p: -(-c // GROUP_ROWS) for p, c in indexed.groupBy("part").count().collect()}
    table = F.create_map(*[F.lit(x) for kv in (splits or {-1: 1}).items() for x in kv])
    groups_of = F.coalesce(table[F.col("part")], F.lit(0))
    spread = F.pmod(F.monotonically_increasing_id(), groups_of.cast("long"))
    index = indexed.where(groups_of > 0).select("id", "vec", (F.col("part") * 2**32 + spread).cast("long").alias("grp"), F.lit(0).cast("long").alias("block"))
    asked = queries.select("id", "vec").where(part).withColumn("qno", F.monotonically_increasing_id())
    sent = asked.mapInArrow(routed(mass, least, ["id", "vec", "qno"]), "id long, vec array<double>, qno long, part long")
    sent = sent.where(groups_of > 0).withColumn("split", F.explode(F.sequence(F.lit(0), groups_of - 1)))
    sent = sent.select("qno", "id", "vec", (F.col("part") * 2**32 + F.col("split")).cast("long").alias("grp"), F.lit(None).cast("double").alias("floor"))
    lists = streamed(index, sent, _candidates(k), "qno long, query_id long, vec_id long, score double")
    order = Window.partitionBy("qno").orderBy(F.col("score").desc(), "vec_id")
    ranked = lists.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_learned_partitions(spark, sf_dir: str) -> DataFrame:
    """For every 50th vector the 5 nearest found by cosine."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return nearest(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


QUERIES = {"op1_learned_partitions": op1_learned_partitions}
