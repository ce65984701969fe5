"""Sets read by rows and by shape agree with the reading token by token."""

import random

from pyspark.sql import functions as F

from tests.test_txnset import BAD, GOOD
from tidemark.operators import txnset as X

BITS = ["u", "v1", "t", "_x", "1", "5", "0", "00", "19", "9223372036854775806", "9223372036854775807", "99999999999999999999", ":", ":", ":", "-", ",", " ", " ", "é", "t" * 33]


def texts(spark):
    rng = random.Random(4)
    made = ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 9))) for _ in range(800)]
    spans = lambda: ":".join(f"{a}-{a + rng.randint(-1, 9)}" if rng.random() < 0.5 else str(a) for a in (rng.randint(0, 40) for _ in range(rng.randint(1, 3))))
    made += [",".join(rng.choice(["u:", "v:t:", "U:1:t2:", "u::", ":"]) + spans() for _ in range(rng.randint(1, 2))) for _ in range(600)]
    made += ["u:" + ":".join(f"{n}-{n + 1}" for n in range(1, 600, 3)), ",".join(f"u{n}:t:{n}" for n in range(1, 300))]
    return spark.createDataFrame(list(enumerate([*made, *GOOD, *BAD, None])), "n int, txn_set string").repartition(4).localCheckpoint()


def test_reading_agrees_token_by_token(spark):
    rows = texts(spark)
    want = {r.n for r in rows.where(X.malformed(F.col("txn_set"))).select("n").collect()}
    assert {r.n for r in X.txn_rejects(rows).collect()} == want and 300 < len(want) < 1350
    spans = rows.select("n", F.explode(X.set_spans(F.col("txn_set"))).alias("s")).where("not s.bad").select("n", "s.source", "s.lo", "s.hi")
    got = X.txn_parse(rows)
    assert got.exceptAll(spans).count() == 0 == spans.exceptAll(got).count()


def test_long_sets_are_read_in_a_pass(spark):
    """A text's spans are met once: time and stack do not grow with the square or the depth of its length."""
    long = ["u:" + ":".join(f"{n}-{n + 1}" for n in range(1, 60_000, 3)), ",".join(f"u{n}:t:{n}" for n in range(1, 20_001)), "u" + ":t:1" * 20_000]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate([*long, long[0] + ":5-4"])], "n int, txn_set string")
    assert [r.n for r in X.txn_rejects(rows).collect()] == [3]
    assert {r.n: r["count"] for r in X.txn_parse(rows).groupBy("n").count().collect()} == {n: 20_000 for n in range(4)}


def test_reading_makes_rows_and_not_arrays_of_spans(spark):
    """Every token used to be read through nested functions of arrays, and texts twice over."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([("u:1",)], "txn_set string")
    assert "lambdafunction" not in plan(X.txn_parse(rows))
    assert "lambdafunction" in plan(rows.where(X.malformed(F.col("txn_set"))))
