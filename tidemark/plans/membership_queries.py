"""Registered queries on transaction sets and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import fnv1a_32
from tidemark.operators import membership as M
from tidemark.operators import txnset as X
from tidemark.plans.tables import Tables
from tidemark.session import written


def txn_parse(t: Tables) -> DataFrame:
    """Per supplier and source the spans read, and under NULL the number of malformed sets."""
    spans = X.txn_parse(t.txn_texts).groupBy("l_suppkey", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("lo").alias("sum_lo"), F.sum("hi").alias("sum_hi")
    )
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("sum_lo", "bigint"), ("sum_hi", "bigint"))]
    rejects = X.txn_rejects(t.txn_texts).groupBy("l_suppkey", F.lit(None).cast("string").alias("source"))
    return spans.unionByName(rejects.agg(F.count(F.lit(1)).alias("n")).select("l_suppkey", "source", "n", *nothing))


def coalesce_intervals(t: Tables) -> DataFrame:
    return X.coalesce_intervals(t.txn_intervals)


def _merged(t: Tables) -> DataFrame:
    """The sets as a replica fleet would store them: merged once, compared often."""
    return written(X.coalesce_intervals(t.txn_intervals))


def interval_containment(t: Tables) -> DataFrame:
    return X.interval_containment(_merged(t), t.owner_pairs)


def txn_relation(t: Tables) -> DataFrame:
    return X.txn_relation(_merged(t), t.owner_pairs, merged=True)


def txn_subtract(t: Tables) -> DataFrame:
    return X.txn_subtract(_merged(t), t.owner_pairs, merged=True)


def member_view_scan(t: Tables) -> DataFrame:
    return M.member_view_scan(t.member_views)


def active_members(t: Tables) -> DataFrame:
    return M.active_members(t.member_views).groupBy("cluster", "round", "observer").agg(F.count(F.lit(1)).alias("n_active"))


def peer_list(t: Tables) -> DataFrame:
    return M.peer_list(t.node_configs)


def seed_rank(t: Tables) -> DataFrame:
    return M.rank_of_self(t.node_configs)


def name_verdict(t: Tables) -> DataFrame:
    probes = t.events.select(
        "event_id",
        (F.col("event_id") % 5 + 1).alias("rcode"),
        (F.col("value") < 1).alias("is_literal"),
        (F.col("event_type") != "view").alias("has_resolver"),
        (F.col("value") > 150).alias("timed_out"),
    )
    return M.name_verdict(probes).select("event_id", "rcode", "verdict")


def online_members(t: Tables) -> DataFrame:
    return M.online_members(t.member_views, "host-m2")


def writable_primary(t: Tables) -> DataFrame:
    return M.writable_primary(t.member_views)


def primary_count_audit(t: Tables) -> DataFrame:
    return M.primary_count_audit(t.member_views)


def self_row_lookup(t: Tables) -> DataFrame:
    return M.self_row_lookup(t.member_views)


def node_state_rollup(t: Tables) -> DataFrame:
    flags = t.reports.select("cluster", F.floor(F.col("round") / 7).alias("round"), "node", "prelog", "generation")
    return M.node_state_rollup(t.member_views, flags)


def next_generation(t: Tables) -> DataFrame:
    waived = M.waived_peers(t.answers, 1).select("cluster", "round", F.col("observer").alias("node"))
    return M.next_generation(t.answers, t.reports, waived)


def progress_signature(t: Tables) -> DataFrame:
    return M.progress_signature(t.progress_parts)


def identity_uniqueness(t: Tables) -> DataFrame:
    return M.identity_uniqueness(
        t.read("supplier").select(F.col("s_nationkey").alias("cluster"), F.col("s_name").alias("host"))
    )


def derived_server_id(t: Tables) -> DataFrame:
    return t.read("customer").select("c_custkey", fnv1a_32(F.col("c_name")).alias("server_id"))


def donor_pick(t: Tables) -> DataFrame:
    return M.donor_pick(t.answers)


def handoff_target(t: Tables) -> DataFrame:
    return M.handoff_target(M.member_view_scan(t.member_views))


def confirmed_peer(t: Tables) -> DataFrame:
    """Each week, the first polled peer that is a writable primary in its own view."""
    weekly = t.answers.select("cluster", F.floor(F.col("round") / 7).alias("round"), "observer", "peer", "seed_rank")
    return M.confirmed_peer(weekly, t.member_views)


def live_identity(t: Tables) -> DataFrame:
    return M.live_identity(t.answers)


def identity_collision(t: Tables) -> DataFrame:
    return M.identity_collision(t.answers, t.reports)


def pairwise_relation(t: Tables) -> DataFrame:
    return M.pairwise_relation(t.answers, t.reports).select("cluster", "round", "observer", "peer", "relation")


def diverged_winner(t: Tables) -> DataFrame:
    judged = M.diverged_winner(M.standings(t.answers, t.reports)).where(F.col("peer_wins").isNotNull())
    return judged.select("cluster", "round", "observer", "peer", "peer_wins")


def bootstrap_verdict(t: Tables) -> DataFrame:
    answers, reports, declared = t.stored_polls(*M.JUDGED)
    return M.bootstrap_verdict(answers, reports, declared, M.waived_peers(answers, 1))


def copy_required(t: Tables) -> DataFrame:
    return M.copy_required(t.answers, t.reports)


def identity_action(t: Tables) -> DataFrame:
    return M.identity_action(t.answers, t.reports)


def divergence_report(t: Tables) -> DataFrame:
    return M.divergence_report(t.answers, t.reports)


def prelog_detection(t: Tables) -> DataFrame:
    return M.prelog_detection(t.reports.withColumn("marker", F.col("prelog")))


QUERIES = {
    f.__name__: f
    for f in (
        txn_parse, coalesce_intervals, interval_containment, txn_relation, txn_subtract, member_view_scan,
        active_members, peer_list, seed_rank, name_verdict, online_members, writable_primary,
        primary_count_audit, self_row_lookup, node_state_rollup, next_generation, progress_signature,
        identity_uniqueness, derived_server_id, donor_pick, handoff_target, confirmed_peer, live_identity,
        identity_collision, pairwise_relation, diverged_winner, bootstrap_verdict, copy_required,
        identity_action, divergence_report, prelog_detection,
    )
}
