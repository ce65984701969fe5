"""Cutting hot keys into chunks must not change a row. The bound is set so low that most keys are hot."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ordered import latest, over_keys, total
from tidemark.operators import archive as A
from tidemark.operators import membership as M
from tidemark.operators import temporal as B
from tidemark.operators import txnset as X
from tidemark.plans import recovery

NODE = ["node"]
ORDER = ["at_us", "event_id"]
RULES = {
    "segment_order": lambda t, n: A.segment_order(t.segments.select("lineage", "seq", "name"), n),
    "newest_full_asof": lambda t, n: A.newest_full_asof(t.targets, t.fulls, n),
    "fallback_fulls": lambda t, n: A.fallback_fulls(t.fulls, n),
    "replay_plan": lambda t, n: A.replay_plan(t.archived, t.fulls, n),
    "restore_readiness": lambda t, n: recovery.restore_readiness(t.targets, t.fulls, t.archived, 7200, rows_per_task=n),
    "coalesce": lambda t, n: X.coalesce_intervals(t.txn_intervals, rows_per_task=n),
    "relation": lambda t, n: X.txn_relation(t.txn_intervals, t.owner_pairs, rows_per_task=n),
    "subtract": lambda t, n: X.txn_subtract(t.txn_intervals, t.owner_pairs, rows_per_task=n),
    "containment": lambda t, n: X.interval_containment(X.coalesce_intervals(t.txn_intervals), t.owner_pairs, rows_per_task=n),
    "verdict": lambda t, n: M.bootstrap_verdict(t.answers, t.reports, t.declared, M.waived_peers(t.answers, 1, n)),
    "dwell": lambda t, n: B.continuous_dwell(t.polls, 6 * 3600, n),
    "stuck": lambda t, n: B.stuck_member(t.polls, 6 * 3600, n),
    "streak": lambda t, n: B.failure_streak(t.polls, rows_per_task=n),
    "gate": lambda t, n: B.heal_gate(t.polls.where("attempt"), 3, 3600, n),
    "budget": lambda t, n: B.heal_budget(t.polls, 3, 3600, 8 * 3600, n),
    "alert": lambda t, n: B.edge_alert(t.polls, n),
    "fall_rise": lambda t, n: B.fall_rise(t.polls, rows_per_task=n),
    "incidents": lambda t, n: B.incident_dedupe(
        t.polls.select("node", F.col("at_us").alias("start_us"), (F.col("at_us") + 10**7).alias("end_us"), "event_id"),
        rows_per_task=n,
    ),
    "transitions": lambda t, n: B.transitions(t.polls, "state", NODE, ORDER, n),
    "roles": lambda t, n: B.role_changes(t.polls, NODE, ORDER, n),
}
BOUNDS = {"segment_order": 1, "replay_plan": 2, "coalesce": 97, "relation": 97, "subtract": 97, "containment": 97, "verdict": 1, "divergence": 1}


@pytest.mark.parametrize("name", RULES)
def test_chunks_change_nothing(tables, name):
    rows = lambda n: sorted(map(repr, RULES[name](tables, n).collect()))
    plain = rows(10**9)
    assert plain
    assert rows(BOUNDS.get(name, 5)) == plain


def test_repeated_intervals_in_chunks(tables):
    twice = tables.txn_intervals.unionByName(tables.txn_intervals)
    rows = lambda df, n: sorted(map(repr, X.coalesce_intervals(df, rows_per_task=n).collect()))
    assert rows(twice, 50) == rows(tables.txn_intervals, 10**9)


def test_one_node_holds_most_rows(spark, tables):
    hot = tables.polls.withColumn("node", F.when(F.col("node") % 3 > 0, 0).otherwise(F.col("node")))
    rows = lambda n: sorted(map(repr, B.stuck_member(hot, 3600, n).collect()))
    assert rows(40) == rows(10**9)


def test_nulls_in_key_and_order(spark):
    rows = [(k, t, i, i % 3 == 0) for k in ("a", None) for i, t in enumerate([None, None, 5, 5, 5, 6, 7, None])]
    df = spark.createDataFrame(rows, "node string, at_us bigint, event_id bigint, up boolean").repartition(3)
    walk = lambda o: o.carry(seen=total(F.lit(1)), last=latest(F.when(F.col("up"), F.col("event_id")))).df.drop("_chunk")
    for backward in (False, True):
        run = lambda n: sorted(map(repr, over_keys(df, NODE, ORDER, walk, n, backward=backward).collect()))
        assert len(run(10**9)) == len(rows) and run(2) == run(10**9)


def test_bursts_split(spark):
    """One key, one clock value for nearly all rows: no chunk holds much more than the bound."""
    df = spark.range(5000).select(F.lit("a").alias("node"), F.when(F.col("id") < 10, F.col("id")).otherwise(99).alias("at_us"), F.col("id").alias("event_id"))
    chunks = []
    over_keys(df, NODE, ORDER, lambda o: chunks.append(o) or o.df.drop("_chunk"), 100)
    hot = [o.df for o in chunks if o.chunk][0].groupBy("_chunk").count().agg(F.max("count")).first()[0]
    assert hot <= 300


CHAINS = {"budget": 5, "fall_rise": 5, "stuck": 5, "alert": 5, "coalesce": 97}


@pytest.mark.parametrize("name", CHAINS)
def test_a_hot_plan_reads_its_rows_twice(tables, name):
    """However many carries a rule chains: the last one's rows and their summaries, and the keys that are not hot."""
    plan = RULES[name](tables, CHAINS[name])._jdf.queryExecution().executedPlan().toString()
    stored = [line for line in plan.split("\n") if "FileScan parquet" in line and "_chunk" in line]
    assert 1 <= len(stored) <= 2
