"""Bootstrap verdicts as a stream, from polls to the dwell.

Two stateful operators in a row, and with ``rules.stable_verdict`` three: a watermarked aggregate gathers what an observer heard and said in a round
and lets the round go once the watermark has passed it; keyed state then knows which peers have been unreachable for how long and gives the
verdict; the dwell follows. The aggregate gives rounds away in their order, so the rules after it need no delay of their own.

Rows equal those of ``membership.bootstrap_verdict`` over the same polls, in whatever order and batches these arrive within the delay.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import txnset
from tidemark.operators.membership import LOWEST_PRIORITY
from tidemark.streaming import rules

OBSERVER = ["cluster", "observer"]
HEARD = ["peer", "seed_rank", "answer", "group_active", "prelog", "generation", "txn_set"]
SAID = ["seed_rank", "prelog", "generation", "txn_set"]


def rounds(answers: DataFrame, reports: DataFrame, declared: DataFrame, delay: str) -> DataFrame:
    """Streams of polls and reports to one row per (cluster, observer, round), given away when the watermark is past the round.

    ``polls`` holds what each peer answered with its relation to the observer's own set, ``report`` what the observer said of itself (NULL if
    nothing), ``own_bad`` whether its set is malformed, ``peers`` the declared ones. A second of ``delay`` is a round. A row holds one
    observer's peers. Polls that come again count once; of several reports of a round the greatest counts. Rows later than the watermark are
    dropped and counted by the engine (``numRowsDroppedByWatermark``).
    """
    heard = answers.select(*OBSERVER, "round", F.struct(*HEARD).alias("poll"))
    said = reports.select("cluster", F.col("node").alias("observer"), "round", F.struct(*SAID).alias("report"))
    both = heard.unionByName(said, allowMissingColumns=True)
    timed = both.withColumn("__event_time", F.timestamp_seconds("round")).withWatermark("__event_time", delay)
    gathered = timed.groupBy(*OBSERVER, "round", "__event_time").agg(
        F.collect_set("poll").alias("polls"), F.max("report").alias("report")
    )
    peers = declared.groupBy(*OBSERVER).agg(F.array_sort(F.collect_set(F.struct("seed_rank", "peer"))).alias("peers"))
    own = F.col("report.txn_set")
    return gathered.join(peers, OBSERVER, "left").select(
        *OBSERVER,
        "round",
        F.transform("polls", lambda p: _compared(p, own)).alias("polls"),
        F.col("report").dropFields("txn_set").alias("report"),
        own.isNotNull().alias("own_known"),
        txnset.malformed(own).alias("own_bad"),
        "peers",
    )


def _compared(poll: Column, own: Column) -> Column:
    """The poll with how the peer's set stands to ``own`` instead of the set."""
    heard = F.when(poll["answer"] == "state", poll["txn_set"])
    return poll.dropFields("txn_set").withField("relation", txnset.text_relation(own, heard))


def _settled(poll: Mapping, my_rank: int, my_generation: int) -> str:
    """The poll's relation; a divergence goes to the higher generation, on a tie to the earlier declared node."""
    if poll["relation"] != "Diverged":
        return poll["relation"]
    theirs = poll["generation"] or 0
    if theirs == my_generation and poll["seed_rank"] is None:
        return "Diverged"
    wins = theirs > my_generation if theirs != my_generation else poll["seed_rank"] < my_rank
    return "Ahead" if wins else "Behind"


def bootstrap_rule(waive_after: int | None = None) -> rules.Rule:
    """The verdict on each row of ``rounds``; peers unreachable for ``waive_after`` rounds without a break are waived (None: never)."""

    def step(state, row):
        gone = dict(state[0]) if state else {}
        polls = {p["peer"]: p for p in row.polls}
        for p in polls.values():
            if p["answer"] == "unreachable":
                gone.setdefault(p["peer"], row.round)
            else:
                gone.pop(p["peer"], None)
        state = (gone,) if gone else None
        if row.report is None:
            return state, None
        if not row.own_known:
            return state, (None, None)

        def waived(peer):
            asked = polls.get(peer)
            return waive_after is not None and asked and asked["answer"] == "unreachable" and row.round - gone[peer] >= waive_after

        rank = LOWEST_PRIORITY if row.report["seed_rank"] is None else row.report["seed_rank"]
        prelog, generation = bool(row.report["prelog"]), row.report["generation"] or 0
        first, expected = {}, [(p["seed_rank"], p["peer"]) for p in row.peers or [] if not waived(p["peer"])]
        for seed_rank, peer in expected:
            poll = polls.get(peer)
            found = _settled(poll, rank, generation) if poll else "Unknown"
            if found == "Equal":
                theirs = bool(poll["prelog"])
                found = "winner" if (theirs if theirs != prelog else seed_rank < rank) else found
            first.setdefault(found, peer)
            if poll and poll["group_active"]:
                first["live"] = peer
        if not expected:
            return state, ("UNDECIDABLE" if row.own_bad else "SAFE", None)
        if "live" in first or "Unknown" in first:
            return state, ("JOIN" if "live" in first else "UNDECIDABLE", None)
        for found, verdict in (("Diverged", "DIVERGED"), ("Ahead", "WAIT"), ("winner", "DEFER")):
            if found in first:
                return state, (verdict, first[found])
        return state, ("SAFE", None)

    return rules.Rule("gone MAP<STRING, BIGINT>", "verdict STRING, peer STRING", step, ("round",), 1_000_000)


def bootstrap_verdicts(
    answers: DataFrame, reports: DataFrame, declared: DataFrame, delay: str, waive_after: int | None = None
) -> DataFrame:
    """(cluster, observer, round, verdict, peer) of the streams ``answers`` and ``reports``; ``declared`` is a table.

    Feed it to ``rules.apply(verdicts, OBSERVER, rules.stable_verdict(n))`` for verdicts that stayed SAFE.
    """
    return rules.apply(rounds(answers, reports, declared, delay), OBSERVER, bootstrap_rule(waive_after))
