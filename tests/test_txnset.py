"""Interval algebra against plain Python sets."""

import random

import pytest

from tidemark.operators import txnset as X


def intervals(spark, rows):
    return spark.createDataFrame(rows, "owner string, source string, lo bigint, hi bigint")


def parse(spark, text):
    rows = X.txn_parse(spark.createDataFrame([(text,)], "txn_set string")).collect()
    return sorted((r.source, r.lo, r.hi) for r in rows)


def test_parse(spark):
    assert parse(spark, "u:1-5:7,\n v : 3") == [("u", 1, 5), ("u", 7, 7), ("v", 3, 3)]
    assert parse(spark, "") == [] == parse(spark, None)
    assert parse(spark, "u:tag:1-5") == [("u:tag", 1, 5)]
    assert parse(spark, "u:1-3:t1:1-5:9:t2:7") == [("u", 1, 3), ("u:t1", 1, 5), ("u:t1", 9, 9), ("u:t2", 7, 7)]
    uuid = "3e11fa47-71ca-11e1-9e33-c80aa9429562"
    assert parse(spark, f"{uuid}:1-5:11-18") == [(uuid, 1, 5), (uuid, 11, 18)]


GOOD = ["u:1", "u:1-1", "U:1-5 , u : 7", ",u:1,,", "", " \n", "u:t:1", "u:9223372036854775806", "u:007"]
BAD = [
    "u", "u:", ":1-3", ":", "u:0", "u:0-4", "u:5-3", "u:1-2-10", "u:1-", "u:-1", "u:--1", "u:1:", "u:1::2", "u:x", "u:x:", "u:t:1:s", "u:1.5", "u:+1",
    "u:1-x", "u:9223372036854775807", "u:99999999999999999999", "u:1,v", "::t:1", ":t:1", "u:" + "t" * 40 + ":1", "u:t-1:3", "u;1-3", "1-3", "u:1-3:8-2",
]


def test_strict_grammar(spark):
    rows = spark.createDataFrame([(t, i) for i, t in enumerate([*GOOD, *BAD, None])], "txn_set string, n int")
    assert sorted(r.n for r in X.txn_rejects(rows).collect()) == list(range(len(GOOD), len(GOOD) + len(BAD)))
    assert parse(spark, "U:1-5,u : 7,V:T1:3") == [("u", 1, 5), ("u", 7, 7), ("v:t1", 3, 3)]


def named(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    return rows.select(X.set_id(rows.text).alias("set_id"), "text")


def test_interned_sets_are_parsed_once_and_merged(spark):
    ids = {r.text: r.set_id for r in named(spark, ["u:1-3:4-6", "U:1-3: 4-6", "u:9-2", ""]).collect()}
    assert ids["u:1-3:4-6"] == ids["U:1-3: 4-6"]
    got = X.interned(named(spark, ["u:1-3:4-6", "U:1-3: 4-6", "u:9-2", "", "v:5-9:1-2:7-30"])).collect()
    assert sorted((r.source, r.lo, r.hi) for r in got if not r.bad) == [("u", 1, 6), ("v", 1, 2), ("v", 5, 30)]
    assert [r.set_id for r in got if r.bad] == [ids["u:9-2"]]


def test_only_blocks_that_differ_are_compared(spark):
    """Of two long histories that differ in one place, the spans of that block move, and the relation is that of the whole sets."""
    long = [f"{i * 70_000 + 1}-{i * 70_000 + 9}" for i in range(400)]
    texts = ["u:" + ":".join(long), "u:" + ":".join(long[:200] + ["14000015"] + long[200:]), "u:" + ":".join(reversed(long)), "v:1"]
    rows = named(spark, texts).collect()
    sets, ids = X.interned(named(spark, texts)), [r.set_id for r in rows]
    pairs = spark.createDataFrame([(ids[0], ids[1]), (ids[0], ids[2]), (ids[0], ids[3])], "a string, b string")
    sides = X.differing_sides(sets, pairs).collect()
    count = {k: sum(r.b == ids[k] for r in sides) for k in (1, 2, 3)}
    assert count[1] <= 5 and count[2] == 0 and count[3] == 401
    extras = {r.b: (r.a_extra, r.b_extra) for r in X.side_extras(X.differing_sides(sets, pairs), ["a", "b"], small=True).collect()}
    assert extras == {ids[1]: (False, True), ids[3]: (True, True)}


def test_random_texts_by_digests(spark):
    """Extras and differences by block digests equal those of plain sets; blocks of a few positions, so that they matter."""
    rng, texts, points = random.Random(8), [], []
    for _ in range(30):
        spans = [(rng.choice("uv"), lo := rng.randint(1, 40), lo + rng.randint(0, 5)) for _ in range(rng.randint(0, 7))]
        texts.append(",".join(f"{s}:{a}-{b}" for s, a, b in spans))
        points.append({(s, n) for s, a, b in spans for n in range(a, b + 1)})
    ids = [r.set_id for r in named(spark, texts).collect()]
    asked = {(i, j) for i in range(30) for j in range(30) if texts[i] != texts[j]}
    pairs = spark.createDataFrame([(ids[i], ids[j]) for i, j in asked], "a string, b string")
    before, X.BLOCK = X.BLOCK, 4
    try:
        sides = X.differing_sides(X.interned(named(spark, texts)), pairs).cache()
    finally:
        X.BLOCK = before
    extras = {(r.a, r.b): (r.a_extra, r.b_extra) for r in X.side_extras(sides, ["a", "b"], small=True).collect()}
    lacking = {}
    for r in X.side_subtract(sides, ["a", "b"], small=True).collect():
        lacking.setdefault((r.a, r.b), set()).update((r.source, n) for n in range(r.lo, r.hi + 1))
    sides.unpersist()
    for i, j in asked:
        pair, a, b = (ids[i], ids[j]), points[i], points[j]
        assert extras.get(pair, (False, False)) == (bool(a - b), bool(b - a))
        assert lacking.get(pair, set()) == a - b


def test_coalesce(spark):
    rows = [("o", "s", 6, 9), ("o", "s", 1, 5), ("o", "s", 12, 20), ("o", "s", 13, 14), ("o", "s", 15, 21), ("o", "t", 7, 7)]
    got = {tuple(r) for r in X.coalesce_intervals(intervals(spark, rows)).collect()}
    assert got == {("o", "s", 1, 9), ("o", "s", 12, 21), ("o", "t", 7, 7)}


PINNED = {
    "equal": ([("s", 1, 5), ("s", 6, 9)], [("s", 1, 9)], "Equal"),
    "behind": ([("s", 1, 9)], [("s", 2, 5)], "Behind"),
    "ahead": ([("s", 1, 9)], [("s", 1, 9), ("t", 7, 7)], "Ahead"),
    "diverged": ([("s", 1, 9)], [("s", 1, 5), ("t", 1, 1)], "Diverged"),
    "empty a": ([], [("s", 1, 1)], "Ahead"),
    "empty b": ([("s", 1, 1)], [], "Behind"),
    "both empty": ([], [], "Equal"),
}


def test_relations(spark):
    rows = [(f"{n}/{side}", *i) for n, (a, b, _) in PINNED.items() for side, s in (("a", a), ("b", b)) for i in s]
    pairs = spark.createDataFrame([(f"{n}/a", f"{n}/b") for n in PINNED], "a string, b string")
    got = {r.a[:-2]: r.relation for r in X.txn_relation(intervals(spark, rows), pairs).collect()}
    assert got == {n: want for n, (_, _, want) in PINNED.items()}


@pytest.mark.parametrize("rows_per_task", [10**9, 8])
def test_random_sets(spark, rows_per_task):
    rng = random.Random(3)
    rows, points = [], {}
    for owner in range(40):
        points[f"o{owner}"] = set()
        for _ in range(rng.randint(0, 8)):
            lo, source = rng.randint(1, 30), rng.choice("st")
            hi = lo + rng.randint(0, 6)
            rows.append((f"o{owner}", source, lo, hi))
            points[f"o{owner}"] |= {(source, n) for n in range(lo, hi + 1)}
    pairs = [(f"o{i}", f"o{j}") for i in range(40) for j in range(i + 1, min(i + 6, 40))]
    data, asked = intervals(spark, rows), spark.createDataFrame(pairs, "a string, b string")

    def spread(df):
        out = {p: set() for p in pairs}
        for r in df.collect():
            out[(r.a, r.b)] |= {(r.source, n) for n in range(r.lo, r.hi + 1)}
        return out

    missing = X.txn_subtract(data, asked, rows_per_task=rows_per_task)
    assert spread(missing) == {(a, b): points[a] - points[b] for a, b in pairs}
    names = {(True, True): "Equal", (True, False): "Behind", (False, True): "Ahead", (False, False): "Diverged"}
    got = {(r.a, r.b): r.relation for r in X.txn_relation(data, asked, rows_per_task=rows_per_task).collect()}
    assert got == {(a, b): names[(points[b] <= points[a], points[a] <= points[b])] for a, b in pairs}
    merged = X.coalesce_intervals(data, rows_per_task=rows_per_task)
    for r in X.interval_containment(merged, asked, rows_per_task=rows_per_task).collect():
        assert r.contained == ({(r.source, n) for n in range(r.lo, r.hi + 1)} <= points[r.b])


@pytest.mark.parametrize("per_block,rows_per_task", [(128, 10**9), (7, 10**9), (7, 20)])
def test_many_owners_in_blocks(spark, per_block, rows_per_task, monkeypatch):
    """Two hundred owners over several words, and over many blocks; nested, equal, empty and diverged sets."""
    monkeypatch.setattr(X, "OWNERS_PER_BLOCK", per_block)
    rng, rows, points = random.Random(6), [], {}
    for n in range(200):
        owner, most = f"o{n}", rng.choice([3, 6, 12])
        points[owner] = {(s, i) for s in "st" for i in range(1, most) if rng.random() < 0.93} if n % 9 else set()
        rows += [(owner, s, i, i) for s, i in points[owner]]
    asked = [(f"o{rng.randrange(200)}", f"o{rng.randrange(200)}") for _ in range(400)] + [("o1", "o1"), ("nobody", "o2"), ("o3", "nobody")]
    asked = sorted(set(asked))
    got = {(r.a, r.b): r.relation for r in X.txn_relation(intervals(spark, rows), spark.createDataFrame(asked, "a string, b string"), rows_per_task=rows_per_task).collect()}
    names = {(True, True): "Equal", (True, False): "Behind", (False, True): "Ahead", (False, False): "Diverged"}
    held = lambda o: points.get(o, set())
    assert got == {(a, b): names[(held(b) <= held(a), held(a) <= held(b))] for a, b in asked}
    assert set(got.values()) == set(names.values())
