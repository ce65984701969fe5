"""Sets cut into regions of positions give the same rows, and no task gets a whole set."""

import random

import pytest

from tidemark.operators import txnset as X

OWNERS = [f"o{n}" for n in range(6)]


def table(spark, rows):
    return spark.createDataFrame(rows, "owner string, source string, lo bigint, hi bigint").repartition(3)


def random_rows(seed):
    """Short, long and repeated intervals, some over many regions and words, some before 0, and owners without any."""
    rng, rows = random.Random(seed), []
    for owner in OWNERS[:5]:
        for source in ("s", None):
            for _ in range(rng.randint(0, 25)):
                lo = rng.randint(-20, 260)
                rows += [(owner, source, lo, lo + rng.choice([0, 0, 1, 2, 5, 63, 64, 90]))] * rng.choice([1, 1, 3])
    return rows


def points(rows):
    held = {}
    for owner, source, lo, hi in rows:
        held.setdefault((owner, source), set()).update(range(lo, hi + 1))
    return held


def spans(numbers):
    lows = sorted(n for n in numbers if n - 1 not in numbers)
    return list(zip(lows, sorted(n for n in numbers if n + 1 not in numbers), strict=True))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("region,rows_per_task,seed", [(1 << 16, 10**9, 1), (4, 10**9, 2), (4, 3, 3), (32, 10**9, 4), (32, 3, 5)])
def test_regions_change_nothing(spark, monkeypatch, region, rows_per_task, seed):
    monkeypatch.setattr(X, "REGION", region)
    rows = random_rows(seed)
    held, data = points(rows), table(spark, rows)
    merged = X.coalesce_intervals(data, rows_per_task=rows_per_task).localCheckpoint()
    want = sorted(((o, s or "", lo, hi) for (o, s), n in held.items() for lo, hi in spans(n)))
    assert sorted((r.owner, r.source or "", r.lo, r.hi) for r in merged.collect()) == want

    asked = [(a, b) for a in OWNERS for b in OWNERS]
    pairs = spark.createDataFrame(asked, "a string, b string")
    lacking = lambda a, b: {s: held.get((a, s), set()) - held.get((b, s), set()) for s in ("s", None)}
    want = sorted((a, b, s or "", lo, hi) for a, b in asked for s, n in lacking(a, b).items() for lo, hi in spans(n))
    for sets, done in ((data, False), (merged, True)):
        got = X.txn_subtract(sets, pairs, rows_per_task=rows_per_task, merged=done).collect()
        assert sorted((r.a, r.b, r.source or "", r.lo, r.hi) for r in got) == want

    relation = {(r.a, r.b): (r.b_in_a, r.a_in_b) for r in X.txn_relation(merged, pairs, rows_per_task, merged=True).collect()}
    assert relation == {(a, b): (not any(lacking(b, a).values()), not any(lacking(a, b).values())) for a, b in asked}

    got = X.interval_containment(merged, pairs, rows_per_task=rows_per_task).collect()
    inside = lambda r: set(range(r.lo, r.hi + 1)) <= held.get((r.b, r.source), set())
    assert len(got) == sum(len(spans(n)) for (o, _), n in held.items() for b in OWNERS)
    assert all(r.contained == inside(r) for r in got)


def test_open_ends_stay_alone(spark):
    """An interval without an end counts where nothing covers its start, once, and ends nothing."""
    rows = [("o", "s", 5, None), ("o", "s", 5, None), ("o", "s", 1, 3), ("o", "s", 6, 6), ("o", "s", 2, None), ("o", "s", 70_000, None), ("o", "s", 70_001, 200_000)]
    got = X.coalesce_intervals(table(spark, rows)).collect()
    assert sorted((r.lo, r.hi or 0) for r in got) == [(1, 3), (5, 0), (6, 6), (70_000, 0), (70_001, 200_000)]


@pytest.mark.parametrize("name", ["txn_subtract", "interval_containment"])
def test_one_long_set_is_many_tasks(spark, name):
    """A set below ``rows_per_task`` was one task's; its windows go by region."""
    one = spark.range(1, 200_000, 2).selectExpr("'a' owner", "'s' source", "id lo", "id hi")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert "hashpartitioning(a#" in (text := plan(getattr(X, name)(one, pairs))) and "region#" in text.split("hashpartitioning(a#", 1)[1].split(")")[0]


def test_intervals_of_a_word_move_as_one_row(spark):
    rows = spark.range(0, 6400).selectExpr("'a' owner", "'s' source", "id lo", "id hi").repartition(2)
    assert X._runs(rows, ["owner", "source"]).count() == 100


def test_one_long_set_is_swept_by_region(spark, monkeypatch):
    """The sweep for relations sorts within regions, whatever ``rows_per_task`` is."""
    swept = []
    stored = X.written
    monkeypatch.setattr(X, "written", lambda df: swept.append(df.columns) or stored(df))
    one = spark.range(1, 200_000, 2).selectExpr("'a' owner", "'s' source", "id lo", "id hi")
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert [r.relation for r in X.txn_relation(one, pairs, merged=True).collect()] == ["Behind"]
    assert any({"region", "pos"} <= set(columns) for columns in swept)
