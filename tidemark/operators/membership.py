"""Membership rules over histories of member views and peer polls.

Tables: member_views(cluster, round, observer, member_id, host, state, role) ·
reports(cluster, round, node, seed_rank, ...what a node says of itself) ·
answers(cluster, round, observer, peer, seed_rank, answer, group_active, state, role,
txn_set, prelog, generation, uuid, group_name): one row per poll of a peer, the peer's
fields NULL unless ``answer = 'state'``.

A poll table already holds the pairs that were compared, so nothing here builds pairs
within a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.ordered import ROWS_PER_TASK
from tidemark.operators import txnset
from tidemark.operators.temporal import held
from tidemark.session import written

VIEW = ["cluster", "round", "observer"]
NODE = ["cluster", "round", "node"]
POLL = ["cluster", "round", "observer", "peer"]

#: What a node says of itself that a bootstrap verdict reads.
JUDGED = ["group_active", "txn_set", "prelog", "generation"]

# Member states and roles, and the rank of a host nobody declared.
ACTIVE_STATES = ("ONLINE", "RECOVERING")
LOWEST_PRIORITY = 2147483647


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def member_view_scan(member_rows: DataFrame) -> DataFrame:
    return member_rows.withColumn("host", F.coalesce("host", F.lit("")))


def active_members(member_views: DataFrame) -> DataFrame:
    return member_views.where(F.col("state").isin(*ACTIVE_STATES))


def peer_list(configs: DataFrame) -> DataFrame:
    """configs(node, self, seeds) to the declared hosts other than the node itself, in order."""
    return seed_rank(configs).where(F.lower("host") != F.lower("self")).select("node", "host", "seed_rank")


def seed_rank(configs: DataFrame) -> DataFrame:
    """Declared hosts with their 0-based place; blank entries do not count."""
    hosts = F.filter(F.transform(F.split("seeds", ","), X.host_label), lambda h: h != "")
    return configs.select("node", "self", F.posexplode(hosts).alias("seed_rank", "host"))


def rank_of_self(configs: DataFrame) -> DataFrame:
    """Each node's own place; a node missing from its list has the lowest priority."""
    own = seed_rank(configs).where(F.lower("host") == F.lower("self"))
    ranks = own.groupBy("node").agg(F.min("seed_rank").alias("seed_rank"))
    return configs.select("node").join(ranks, "node", "left").fillna(LOWEST_PRIORITY, ["seed_rank"])


def name_verdict(probes: DataFrame) -> DataFrame:
    """Only an authoritative "no such name" (rcode 3) proves a name gone."""
    gone = _true((F.col("rcode") == 3) & ~F.col("is_literal") & F.col("has_resolver") & ~F.col("timed_out"))
    return probes.withColumn("verdict", F.when(gone, "gone").otherwise("exists_or_unknown"))


def online_members(member_views: DataFrame, absent_host: str) -> DataFrame:
    """ONLINE members per view, and whether ``absent_host`` is none of them."""
    online = F.col("state") == "ONLINE"
    return member_views.groupBy(*VIEW).agg(
        F.count_if(online).alias("n_online"),
        (~F.bool_or(_true(online & (F.col("host") == absent_host)))).alias("host_absent"),
    )


def _is_self() -> Column:
    return F.lower("member_id") == F.lower("observer")


def writable_primary(member_views: DataFrame) -> DataFrame:
    """True where the observer sees itself ONLINE and PRIMARY and a majority reachable."""
    own = _is_self() & (F.col("state") == "ONLINE") & (F.col("role") == "PRIMARY")
    majority = F.count_if(F.col("state") != "UNREACHABLE") * 2 > F.count(F.lit(1))
    return member_views.groupBy(*VIEW).agg((majority & F.bool_or(_true(own))).alias("writable"))


def primary_count_audit(member_views: DataFrame) -> DataFrame:
    """Writable primaries per cluster and round: none, one or a split brain."""
    n = F.count_if("writable")
    state = F.when(n == 0, "no_writer").when(n == 1, "ok").otherwise("split_brain")
    return writable_primary(member_views).groupBy("cluster", "round").agg(n.alias("n_primaries"), state.alias("state"))


def self_row_lookup(member_views: DataFrame) -> DataFrame:
    return member_views.where(_is_self()).select(*VIEW, "host", "state", "role")


def node_state_rollup(member_views: DataFrame, flags: DataFrame) -> DataFrame:
    """One report per node: own row, member counts, flags(cluster, round, node, prelog, generation)."""
    seen = member_views.groupBy(*VIEW).agg(
        F.max(F.when(_is_self(), F.struct("state", "role"))).alias("own"),
        F.count(F.lit(1)).alias("members_total"),
        F.count_if(F.col("state") != "UNREACHABLE").alias("members_reachable"),
    )
    said = flags.groupBy(*NODE).agg(F.bool_or("prelog").alias("prelog"), F.max("generation").alias("generation"))
    return seen.withColumnRenamed("observer", "node").join(said, NODE, "left").select(
        *NODE,
        _true(F.col("own.state").isin(*ACTIVE_STATES)).alias("group_active"),
        F.col("own.state").alias("member_state"),
        F.col("own.role").alias("member_role"),
        "members_total",
        "members_reachable",
        _true(F.col("prelog")).alias("prelog"),
        F.coalesce("generation", F.lit(0).cast("bigint")).alias("generation"),
    )


def next_generation(answers: DataFrame, reports: DataFrame, waived: DataFrame) -> DataFrame:
    """One above every generation heard of, for the nodes in ``waived``."""
    heard = answers.groupBy("cluster", "round", F.col("observer").alias("node")).agg(F.max("generation").alias("heard"))
    zero = F.lit(0).cast("bigint")
    top = F.greatest(F.coalesce("heard", zero), F.coalesce("generation", zero), zero)
    return (
        reports.join(waived.select(*NODE).distinct(), NODE, "left_semi")
        .join(heard, NODE, "left")
        .select(*NODE, (top + 1).alias("next_generation"))
    )


def progress_signature(parts: DataFrame) -> DataFrame:
    """parts(node, round, part, detail) to one comparable text per node and round.

    Parts are ``executed`` (one row), ``received`` and ``copy`` (any number, in no order).
    Both halves of every row's digest are added up, so no group is ever collected; absent parts read "none".
    """
    half = lambda at: F.conv(F.substring(F.md5("detail"), at, 16), 16, 10).cast("decimal(38,0)")
    both = lambda part: [F.sum(F.when(F.col("part") == part, half(at))).cast("string") for at in (1, 17)]
    summed = lambda part: F.coalesce(F.concat(*[x for s in both(part) for x in (s, F.lit("."))][:-1]), F.lit("none"))
    executed = F.coalesce(
        F.max(F.when(F.col("part") == "executed", F.regexp_replace("detail", r"\s+", ""))), F.lit("none")
    )
    return parts.groupBy("node", "round").agg(
        F.concat_ws("|", executed, summed("received"), summed("copy")).alias("signature")
    )


def identity_uniqueness(nodes: DataFrame) -> DataFrame:
    """nodes(cluster, host): are the derived 32-bit ids as many as the nodes?"""
    ids = nodes.groupBy("cluster", X.fnv1a_32(F.col("host")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return ids.groupBy("cluster").agg(
        F.sum("n").alias("n_nodes"),
        F.count(F.lit(1)).alias("n_ids"),
        (F.max("n") == 1).alias("unique"),
        F.max("id").alias("largest_id"),
    )


# Picks


def donor_pick(answers: DataFrame) -> DataFrame:
    """The active peer to copy from: a PRIMARY, else any; of equals the last declared."""
    active = answers.where(_true(F.col("group_active")))
    weight = F.struct(_true(F.col("role") == "PRIMARY"), F.col("seed_rank"))
    return active.groupBy(*VIEW).agg(F.max_by("peer", weight).alias("donor"))


def handoff_target(member_views: DataFrame) -> DataFrame:
    """The healthy secondary other than the observer with the smallest host name."""
    fit = (F.col("state") == "ONLINE") & (F.col("role") == "SECONDARY") & ~_is_self()
    return member_views.groupBy(*VIEW).agg(
        F.min(F.when(fit, F.struct("host", "member_id"))).getField("member_id").alias("target")
    )


def confirmed_peer(answers: DataFrame, member_views: DataFrame) -> DataFrame:
    """The first declared peer that sees itself as a writable primary."""
    proven = writable_primary(member_views).where("writable").select(
        "cluster", "round", F.col("observer").alias("peer")
    )
    return answers.join(proven, ["cluster", "round", "peer"]).groupBy(*VIEW).agg(
        F.min_by("peer", "seed_rank").alias("confirmed")
    )


def live_identity(answers: DataFrame) -> DataFrame:
    """Group name and generation of the first active peer that advertises a name."""
    live = answers.where(_true(F.col("group_active")) & F.col("group_name").isNotNull())
    first = F.min(F.struct("seed_rank", "group_name", "generation"))
    return live.groupBy("cluster", "round", F.col("observer").alias("node")).agg(first.alias("f")).select(
        *NODE, F.col("f.group_name").alias("live_name"), F.coalesce("f.generation", F.lit(0)).alias("live_generation")
    )


def identity_collision(answers: DataFrame, reports: DataFrame) -> DataFrame:
    """The first active peer that carries the node's own uuid."""
    mine = reports.select("cluster", "round", F.col("node").alias("observer"), F.lower("uuid").alias("mine"))
    same = answers.where(_true(F.col("group_active"))).join(mine, VIEW).where(F.lower("uuid") == F.col("mine"))
    return same.groupBy(*VIEW).agg(F.min_by("peer", "seed_rank").alias("collides_with"))


# History comparison


def _own_sets(reports: DataFrame) -> DataFrame:
    return reports.select("cluster", "round", F.col("node").alias("observer"), F.col("txn_set").alias("own_set"))


def _unequal() -> Column:
    """Are both sets of a poll known, and their texts different?"""
    return F.col("known") & (F.col("a") != F.col("b"))


def _compared(answers: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polls with ``a`` and ``b``, the ids of the observer's own set and of the one it heard, and ``known``; and the interned sets. Both are stored.

    An id is NULL where there is no text. ``known`` are polls of which both sets are there and well formed, which is judged by a text's
    shape; only sets of known polls that differ are read.
    """
    read = lambda side: {side: txnset.text_id(F.col(f"{side}_text")), f"{side}_fit": ~txnset.faulty(F.col(f"{side}_text"))}
    own = _own_sets(reports).select(*VIEW, txnset.packed(F.col("own_set")).alias("a_text")).withColumns(read("a"))
    said = F.when(F.col("answer") == "state", txnset.packed(F.col("txn_set")))
    heard = answers.withColumn("b_text", said).withColumns(read("b"))
    known = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a_fit") & F.col("b_fit")
    polls = heard.join(own, VIEW, "left").withColumn("known", F.coalesce(known, F.lit(False))).drop("a_fit", "b_fit")
    polls = written(polls.withColumns({t: F.when(_unequal(), F.col(t)) for t in ("a_text", "b_text")}))
    each = F.array(*[F.struct(F.col(side).alias("set_id"), F.col(f"{side}_text").alias("text")) for side in ("a", "b")])
    texts = polls.where(_unequal()).select(F.explode(each).alias("e")).select("e.*")
    return polls.drop("a_text", "b_text"), written(txnset.interned(texts))


def pairwise_relation(answers: DataFrame, reports: DataFrame) -> DataFrame:
    """Each poll with how the peer's history, as the observer heard it, stands to the observer's own, or Unknown.

    Unknown are polls without a set, and all polls of an observer whose own set is missing; so are malformed sets. Each pair of
    different sets is compared once, however many polls have it.
    """
    polls, sets = _compared(answers, reports)
    pairs = polls.where(_unequal()).select("a", "b").distinct()
    extras = txnset.side_extras(txnset.differing_sides(sets, pairs), ["a", "b"], small=True)
    relation = F.when(F.col("known"), txnset.extras_relation()).otherwise("Unknown")
    return polls.join(extras, ["a", "b"], "left").withColumn("relation", relation).drop("a_extra", "b_extra", "known", "a", "b")


def diverged_peer_wins(my_gen: Column, my_rank: Column, peer_gen: Column, peer_rank: Column) -> Column:
    """The higher generation wins a divergence, on a tie the earlier declared node."""
    return F.when(peer_gen != my_gen, peer_gen > my_gen).otherwise(peer_rank < my_rank)


def diverged_winner(standings: DataFrame) -> DataFrame:
    """Standings with ``peer_wins`` for diverged peers, NULL for others."""
    wins = diverged_peer_wins(F.col("my_generation"), F.col("my_rank"), F.col("generation"), F.col("seed_rank"))
    return standings.withColumn("peer_wins", F.when(F.col("relation") == "Diverged", wins))


def standings(answers: DataFrame, reports: DataFrame) -> DataFrame:
    """Each poll's relation next to the observer's own rank, flag and generation."""
    own = reports.select(
        "cluster",
        "round",
        F.col("node").alias("observer"),
        F.col("seed_rank").alias("my_rank"),
        F.col("prelog").alias("my_prelog"),
        F.col("generation").alias("my_generation"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        pairwise_relation(answers, reports)
        .join(own, VIEW, "left")
        .withColumns(
            {
                "my_rank": F.coalesce("my_rank", F.lit(LOWEST_PRIORITY)),
                "my_prelog": _true(F.col("my_prelog")),
                "my_generation": F.coalesce("my_generation", zero),
                "generation": F.coalesce("generation", zero),
                "prelog": _true(F.col("prelog")),
            }
        )
    )


def decide(standings: DataFrame) -> DataFrame:
    """The bootstrap verdict of every (cluster, round, observer) that polled anyone.

    standings(..., peer, seed_rank, relation, prelog, my_rank, my_prelog, group_active).
    """
    first = lambda when: F.min_by(F.when(when, F.col("peer")), F.when(when, F.col("seed_rank")))
    relation = F.col("relation")
    wins_tie = F.when(F.col("prelog") != F.col("my_prelog"), F.col("prelog")).otherwise(
        F.col("seed_rank") < F.col("my_rank")
    )
    seen = standings.groupBy(*VIEW).agg(
        F.bool_or(_true(F.col("group_active"))).alias("live"),
        F.bool_or(relation == "Unknown").alias("unknown"),
        first(relation == "Diverged").alias("diverged"),
        first(relation == "Ahead").alias("ahead"),
        first((relation == "Equal") & wins_tie).alias("winner"),
    )
    verdict = (
        F.when(F.col("live"), "JOIN")
        .when(F.col("unknown"), "UNDECIDABLE")
        .when(F.col("diverged").isNotNull(), "DIVERGED")
        .when(F.col("ahead").isNotNull(), "WAIT")
        .when(F.col("winner").isNotNull(), "DEFER")
        .otherwise("SAFE")
    )
    named = {"DIVERGED": "diverged", "WAIT": "ahead", "DEFER": "winner"}
    peer = F.coalesce(*[F.when(F.col("verdict") == v, F.col(c)) for v, c in named.items()])
    return seen.withColumn("verdict", verdict).select(*VIEW, "verdict", peer.alias("peer"))


def waived_peers(answers: DataFrame, dwell: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Polls (cluster, round, observer, peer) that need not be answered: unreachable now, and for ``dwell`` without a break."""
    gone = held(answers, ["cluster", "observer", "peer"], ["round"], F.col("answer") == "unreachable", dwell, rows_per_task)
    return gone.where("fired").select(*POLL)


def bootstrap_verdict(
    answers: DataFrame,
    reports: DataFrame,
    declared: DataFrame,
    waived: DataFrame | None = None,
) -> DataFrame:
    """Verdict per reporting node and round.

    Every peer in ``declared`` (cluster, observer, peer, seed_rank) counts, unless ``waived`` has it for the round: one that was
    not polled or did not answer is Unknown, so silence never makes a node SAFE. A node without declared peers is SAFE; one whose
    own set is missing has no verdict (NULL), and one whose own set is malformed is never SAFE. Divergence is settled before deciding.
    """
    everyone = _own_sets(reports)
    expected = everyone.select(*VIEW).join(declared.select("cluster", "observer", "peer", "seed_rank"), ["cluster", "observer"])
    if waived is not None:
        expected = expected.join(waived.select(*POLL), POLL, "left_anti")
    settled = diverged_winner(standings(answers, reports)).withColumn(
        "relation",
        F.when(F.col("peer_wins"), "Ahead").when(~F.col("peer_wins"), "Behind").otherwise(F.col("relation")),
    )
    heard = expected.join(settled.drop("seed_rank"), POLL, "left").fillna("Unknown", ["relation"])
    unheard = F.when(txnset.malformed(F.col("own_set")), "UNDECIDABLE").otherwise("SAFE")
    verdict = F.when(F.col("own_set").isNotNull(), F.coalesce("verdict", unheard))
    peer = F.when(F.col("own_set").isNotNull(), F.col("peer"))
    return everyone.join(decide(heard), VIEW, "left").select(*VIEW, verdict.alias("verdict"), peer.alias("peer"))


def copy_required(answers: DataFrame, reports: DataFrame) -> DataFrame:
    """Must the node be copied because the live group holds data its log never carried?"""
    group = answers.groupBy("cluster", "round", F.col("observer").alias("node")).agg(
        F.bool_or(_true(F.col("group_active") & F.col("prelog"))).alias("group_prelog")
    )
    empty = F.regexp_replace("txn_set", r"\s+", "") == ""
    return reports.join(group, NODE, "left").select(
        *NODE, (_true(F.col("group_prelog")) & ~_true(F.col("prelog")) & _true(empty)).alias("copy_required")
    )


def identity_action(answers: DataFrame, reports: DataFrame) -> DataFrame:
    """NONE, HOLD (another name but pinned) or ADOPT with the greater generation."""
    differs = F.col("live_name").isNotNull() & ~F.col("live_name").eqNullSafe(F.col("group_name"))
    own = F.coalesce("generation", F.lit(0).cast("bigint"))
    action = F.when(~differs, "NONE").when(F.col("pinned"), "HOLD").otherwise("ADOPT")
    return reports.join(live_identity(answers), NODE, "left").select(
        *NODE,
        action.alias("action"),
        F.when(action == "ADOPT", F.greatest(own, "live_generation")).otherwise(own).alias("generation"),
    )


def divergence_report(answers: DataFrame, reports: DataFrame) -> DataFrame:
    """What nodes hold that the first active peer's answer lacks, as intervals: the evidence of what would be discarded.

    Where either set is missing or malformed nothing can be said, and there is no row.
    """
    polls, sets = _compared(answers, reports)
    live = polls.where(_true(F.col("group_active")) & F.col("txn_set").isNotNull())
    first = live.groupBy(*VIEW).agg(F.min_by(F.struct("peer", "a", "b", "known"), "seed_rank").alias("f")).select(*VIEW, "f.*")
    known = first.where(_unequal()).drop("known")
    orphaned = txnset.side_subtract(txnset.differing_sides(sets, known.select("a", "b").distinct()), ["a", "b"], small=True)
    return known.join(orphaned, ["a", "b"]).drop("a", "b")


def prelog_detection(volumes: DataFrame) -> DataFrame:
    """volumes(..., fresh, marker, txn_set, checked): data that predates the node's log?

    A used volume with an empty set holds such data, and a marker remembers it. A node not
    yet checked gives no answer.
    """
    found = F.col("marker") | (~F.col("fresh") & (F.regexp_replace("txn_set", r"\s+", "") == ""))
    return volumes.select(
        *NODE,
        F.when(F.col("checked"), _true(found)).alias("prelog"),
        F.when(F.col("checked"), "state").otherwise("not_ready").alias("answer"),
    )
