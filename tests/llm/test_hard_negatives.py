import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as hn

SCHEMA = "id long, label long, vec array<double>, grp string, positives int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)


def plain(rows, anchors, low=80, high=100, k=5):
    def score(a, b):
        return sum(int(x) * int(y) for x, y in zip(a, b))

    def fit(r):
        return r[0] is not None and r[1] is not None and r[2] and all(x is not None and np.isfinite(x) for x in r[2])

    rows, out = [r for r in rows if fit(r)], []
    for a, label, v in filter(fit, anchors):
        near = sorted((-score(v, w), i) for i, x, w in rows if x == label and i != a)[:k]
        for s, p in near:
            below = [(-score(v, w), i) for i, x, w in rows if x != label]
            below = sorted(b for b in below if low * -s <= 100 * -b[0] <= high * -s)[:k]
            out += [(a, p, n + 1, i, -s, -b) for n, (b, i) in enumerate(below)]
    return sorted(out)


def mined(spark, rows, anchors, **options):
    got = hn.hard_negatives(table(spark, rows), table(spark, anchors), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("cells,width", [(1 << 19, 40), (40 * 32, 40), (3 * 64, 3)])
def test_like_the_plain_version(spark, cells, width):
    """Few values, so many ties; one hot label; groups of many and of few rows."""
    rng = np.random.default_rng(width + cells)
    rows = [(i, int(rng.integers(0, 4)) if i % 3 else 9, [float(x) for x in rng.integers(-4, 9, width)]) for i in range(500)]
    anchors = rows[::25]
    assert mined(spark, rows, anchors, cells=cells) == plain(rows, anchors)


def test_edges(spark):
    bad = [(None, 1, [1.0]), (3, None, [9.0, 9.0]), (4, 1, None), (5, 1, []), (6, 1, [None, 2.0]), (7, 2, [float("nan")]), (8, 2, [float("inf"), 1.0])]
    good = [(0, 1, [10.0, 5.0]), (0, 1, [10.0, 5.0]), (1, 1, [10.0]), (2, 2, [9.0, 0.0, 44.0]), (2, 2, [9.0, 0.0, 44.0]), (9, 3, [0.0, 0.0]), (10, 3, [-5.0, 0.0])]
    assert mined(spark, bad + good, bad + good) == plain(bad + good, bad + good)
    assert mined(spark, [], []) == [] and mined(spark, good, []) == [] and mined(spark, bad, bad) == []


def test_scores_beyond_doubles_are_exact(spark):
    big = float(2**30)
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 3.0]), (2, 2, [big, 2.0]), (3, 2, [big, 4.0]), (4, 2, [big, 3.0])]
    assert mined(spark, rows, rows[:1]) == plain(rows, rows[:1])
    huge = [(i, i % 2, [1e300]) for i in range(4)]
    assert {r[-1] for r in mined(spark, huge, huge[:1])} == {hn.LIMIT}


def test_index_leaves_out_and_finds_all():
    """For every threshold, all pairs at or above it; a high one leaves most of the index out."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(300, 64)) * np.linspace(0.1, 1, 64))
    group, q = hn.Group(np.arange(300), np.zeros(300, int), x), x[:8]
    truth = q @ x.T
    for t in (-1e9, 0.0, 1e5, 5e5, 1e6, 3e6, 1e9):
        rows, scores = group.join(q, np.full(8, t), np.full(8, np.inf))
        for i in range(8):
            assert set(np.flatnonzero(truth[i] >= t)) == set(rows[scores[i] >= t]), t
        same = scores == truth[:, rows]
        assert same[scores >= t].all()
    rows, counts = group.postings(0.8 * np.linalg.norm(x, axis=1).max())
    assert 0 < counts[-1] < 150 and counts[0] < counts[-1]


def test_window_edges():
    for p in range(-30, 60):
        low, high = hn.window(p, 80, 100)
        assert list(range(low, high + 1)) == [s for s in range(-99, 99) if 80 * p <= 100 * s <= 100 * p]


def test_anchor_groups_are_a_range(spark):
    """A hot label's anchors reach all its groups, and none inside it for negatives: rows sent are counted by the plan's result."""
    rows = [(i, 0 if i < 200 else 1, [float(i % 17 + 1), 1.0]) for i in range(300)]
    assert mined(spark, rows, rows[:3], cells=40) == plain(rows, rows[:3])
    extra = table(spark, rows).withColumn("no", F.lit(1)).withColumn("score", F.lit("s")).withColumn("run", F.lit(2))
    assert sorted(map(tuple, hn.hard_negatives(extra, extra.where("id < 3"), cells=40).collect())) == plain(rows, rows[:3])
