"""Conditions over time, over the histories of many nodes.

Each rule reads polls(keys, at, order ..., observation) where ``at`` is a number that rises
with time (microseconds, rounds) and ``order`` makes the rows of a key unique. All of them
walk a key's rows through ``over_keys``: one shuffle and one sort per rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import ROWS_PER_TASK, Ordered, latest, lowest, over_keys, previous, total

# Defaults of the time rules, in seconds or counts.
GONE_DWELL_S = 1800
STABLE_DWELL_S = 15
STUCK_DWELL_S = 900
LEDGER_RESET_S = 3600
HEAL_CAP, HEAL_BASE_S, BACKOFF_SHIFT_MAX = 5, 60, 16
STREAK_ALERT = 3
FALL, RISE = 2, 2
HEALTHY_RUN_S = 60
MICROS = 1_000_000


def _one(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def _held_since(rows: Ordered, condition: Column, at: str) -> Ordered:
    """Adds ``since``: where the unbroken stretch of ``condition`` that holds now began."""
    rows = rows.columns(_on=F.coalesce(condition, F.lit(False))).carry(_was=previous(F.col("_on")))
    begins = F.col("_on") & ~F.coalesce("_was", F.lit(False))
    rows = rows.carry(since=latest(F.when(begins, F.col(at))))
    return rows.columns(since=F.when(F.col("_on"), F.col("since")))


def held(
    polls: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    condition: Column,
    dwell: int,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rows on which ``condition`` holds, ``since`` when without a break, and ``fired`` at the dwell.

    ``order[0]`` is the clock, and ``dwell`` is in its unit.
    """
    at = order[0]

    def walk(rows: Ordered) -> DataFrame:
        on = _held_since(rows, condition, at).where(F.col("_on")).df
        fired = F.col(at) - F.col("since") >= dwell
        return on.select(*keys, *order, "since", fired.alias("fired"))

    return over_keys(polls, keys, order, walk, rows_per_task)


def continuous_dwell(
    polls: DataFrame, dwell_s: int = GONE_DWELL_S, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """polls(node, at_us, event_id, verdict): since when each gone name is gone, and for long enough?

    Anything but "gone" ends the stretch, also an answer that says nothing.
    """
    gone = F.col("verdict") == "gone"
    return held(polls, ["node"], ["at_us", "event_id"], gone, dwell_s * MICROS, rows_per_task)


def stable_verdict(
    verdicts: DataFrame, dwell_rounds: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Bootstrap verdicts that stayed SAFE, round after round, for the dwell."""
    safe = F.col("verdict") == "SAFE"
    return held(verdicts, ["cluster", "observer"], ["round"], safe, dwell_rounds, rows_per_task)


def transitions(
    polls: DataFrame, value: str, keys: Sequence[str], order: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Rows whose ``value`` differs from the row before; a key's first row counts."""

    def walk(rows: Ordered) -> DataFrame:
        seen = rows.carry(_before=previous(F.struct(value))).df
        same = F.col("_before").isNotNull() & F.col(f"_before.{value}").eqNullSafe(F.col(value))
        return seen.where(~same).select(*keys, *order, value)

    return over_keys(polls, keys, order, walk, rows_per_task)


def role_changes(
    polls: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """(keys, order, old_role, new_role) wherever a node's role changed."""

    def walk(rows: Ordered) -> DataFrame:
        seen = rows.where(F.col("role").isNotNull()).carry(old_role=previous(F.col("role"))).df
        changed = seen.where(F.col("old_role") != F.col("role"))
        return changed.select(*keys, *order, "old_role", F.col("role").alias("new_role"))

    return over_keys(polls, keys, order, walk, rows_per_task)


def stuck_member(polls: DataFrame, dwell_s: int = STUCK_DWELL_S, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """polls(node, at_us, event_id, state, signature): ERROR or RECOVERING rows, stuck since when.

    RECOVERING with a new signature is progress and restarts the clock; ERROR keeps a clock
    that runs. Any other state stops it. ONLINE also forgets the signature, other states
    and ERROR keep it.
    """
    state, stuck = F.col("state"), F.col("state").isin("ERROR", "RECOVERING")
    recovering = state == "RECOVERING"
    memory = F.when(recovering, F.struct(F.col("signature").alias("sig"))).when(
        state == "ONLINE", F.struct(F.lit("").alias("sig"))
    )

    def walk(rows: Ordered) -> DataFrame:
        rows = rows.carry(
            _sig=previous(memory), _was=previous(F.coalesce(stuck, F.lit(False)))
        )
        progress = recovering & (F.col("signature") != F.coalesce("_sig.sig", F.lit("")))
        restart = F.coalesce(stuck, F.lit(False)) & (progress | ~F.coalesce("_was", F.lit(False)))
        rows = rows.columns(_restart=F.when(restart, F.col("at_us"))).carry(since=latest(F.col("_restart")))
        fired = F.col("at_us") - F.col("since") >= dwell_s * MICROS
        return rows.where(stuck).df.select("node", "at_us", "event_id", "state", "since", fired.alias("fired"))

    return over_keys(polls, ["node"], ["at_us", "event_id"], walk, rows_per_task)


def failure_streak(boots: DataFrame, alert_at: int = STREAK_ALERT, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """boots(node, at_us, event_id, event): failed starts in a row, and the alert on reaching a count.

    A ``start`` counts at once, ``ready`` clears, ``planned_stop`` takes one back but never
    below zero. A walk that may not fall below zero equals the free walk minus its lowest
    value since the last clearing.
    """
    step = F.when(F.col("event") == "start", 1).when(F.col("event") == "planned_stop", -1).otherwise(0)
    epochs = over_keys(
        boots,
        ["node"],
        ["at_us", "event_id"],
        lambda rows: rows.carry(
            epoch=total(_one(F.col("event") == "ready")), walk=total(step.cast("bigint"))
        ).df.select("node", "at_us", "event_id", "event", "epoch", "walk", step.cast("bigint").alias("step")),
        rows_per_task,
    )

    def floored(rows: Ordered) -> DataFrame:
        # Before the first step of a key's history the walk stands at zero.
        rows = rows.carry(_low=lowest(F.least(F.col("walk"), F.when(F.col("epoch") == 0, F.lit(0).cast("bigint")))))
        streak = F.col("walk") - F.col("_low")
        alert = (F.col("event") == "start") & (streak >= alert_at)
        return rows.df.select("node", "at_us", "event_id", "event", streak.alias("streak"), alert.alias("alert"))

    return over_keys(epochs, ["node", "epoch"], ["at_us", "event_id"], floored, rows_per_task)


def backoff_gap_seconds(attempts: Column, base_s: int | Column) -> Column:
    """Seconds to wait after attempt n: base x 2^(n-1), the doubling capped, the product saturating."""
    base = (F.lit(base_s) if isinstance(base_s, int) else base_s).cast("decimal(20,0)")
    times = F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(BACKOFF_SHIFT_MAX))).cast("decimal(10,0)")
    wide = F.least((base * times).cast("decimal(38,0)"), F.lit(9223372036854775807).cast("decimal(38,0)"))
    return F.when(attempts > 0, wide.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def heal_verdict(attempts: Column, last_s: Column, now_s: Column, cap: int = HEAL_CAP, base_s: int = HEAL_BASE_S) -> Column:
    """CAP when the budget is spent, BACKOFF inside the pause after the last attempt, else GO."""
    due = F.coalesce(last_s, F.lit(0)).cast("decimal(38,0)") + backoff_gap_seconds(attempts, base_s).cast("decimal(38,0)")
    return F.when(attempts >= cap, "CAP").when(now_s < due, "BACKOFF").otherwise("GO")


def heal_gate(
    attempts: DataFrame, cap: int = HEAL_CAP, base_s: int = HEAL_BASE_S, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """attempts(node, at_us, event_id): the gate's verdict on each recorded attempt, given those before it."""

    def walk(rows: Ordered) -> DataFrame:
        rows = rows.carry(n=total(F.lit(1).cast("bigint"), inclusive=False), _last=previous(F.col("at_us")))
        n = F.coalesce("n", F.lit(0).cast("bigint"))
        seconds = lambda c: F.floor(F.col(c) / MICROS)
        verdict = heal_verdict(n, seconds("_last"), seconds("at_us"), cap, base_s)
        return rows.df.select("node", "event_id", n.alias("attempts_before"), verdict.alias("verdict"))

    return over_keys(attempts, ["node"], ["at_us", "event_id"], walk, rows_per_task)


def heal_budget(
    polls: DataFrame,
    cap: int = HEAL_CAP,
    base_s: int = HEAL_BASE_S,
    reset_s: int = LEDGER_RESET_S,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """polls(node, at_us, event_id, state, attempt): the gate on each attempt, the ledger
    cleared whenever the node has stayed ONLINE for ``reset_s``."""

    def walk(rows: Ordered) -> DataFrame:
        rows = _held_since(rows, F.col("state") == "ONLINE", "at_us")
        reset = F.col("_on") & (F.col("at_us") - F.col("since") >= reset_s * MICROS)
        mark = F.when(F.col("attempt"), F.struct(F.col("at_us").alias("last"))).when(
            reset, F.struct(F.lit(None).cast("bigint").alias("last"))
        )
        rows = rows.columns(_reset=reset).carry(
            _all=total(_one(F.col("attempt")), inclusive=False), _mark=previous(mark)
        )
        done = F.coalesce("_all", F.lit(0).cast("bigint"))
        rows = rows.columns(_all=done, _cleared=F.when(F.col("_reset"), done)).carry(_base=latest(F.col("_cleared")))
        n = F.col("_all") - F.coalesce("_base", F.lit(0).cast("bigint"))
        seconds = lambda c: F.floor(F.col(c) / MICROS)
        verdict = heal_verdict(n, seconds("_mark.last"), seconds("at_us"), cap, base_s)
        return rows.where(F.col("attempt")).df.select(
            "node", "event_id", n.alias("attempts_before"), verdict.alias("verdict")
        )

    return over_keys(polls, ["node"], ["at_us", "event_id"], walk, rows_per_task)


def edge_alert(polls: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """polls(node, at_us, event_id, primary_up): the polls that raise "no primary".

    One alert per outage; a failed poll (``primary_up`` NULL) changes nothing. If polls have ``backends``, the backends that were
    asked, an alert names those of its poll.
    """
    named = [c for c in polls.columns if c == "backends"]

    def walk(rows: Ordered) -> DataFrame:
        seen = rows.where(F.col("primary_up").isNotNull()).carry(_was=previous(F.col("primary_up"))).df
        return seen.where(~F.col("primary_up") & F.coalesce("_was", F.lit(True))).select("node", "at_us", "event_id", *named)

    return over_keys(polls, ["node"], ["at_us", "event_id"], walk, rows_per_task)


def fall_rise(polls: DataFrame, fall: int = FALL, rise: int = RISE, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """polls(node, at_us, event_id, passed): is the server up after each check?

    ``fall`` failures in a row take it down, ``rise`` passes bring it up; NULL before either.
    """

    def walk(rows: Ordered) -> DataFrame:
        rows = rows.carry(_rn=total(F.lit(1).cast("bigint")), _was=previous(F.col("passed")))
        turned = ~F.col("passed").eqNullSafe(F.col("_was"))
        rows = rows.columns(_turn=F.when(turned, F.col("_rn"))).carry(_from=latest(F.col("_turn")))
        streak = F.col("_rn") - F.col("_from") + 1
        decided = F.when(streak >= F.when(F.col("passed"), rise).otherwise(fall), F.col("passed"))
        rows = rows.columns(_decided=decided).carry(up=latest(F.col("_decided")))
        return rows.df.select("node", "at_us", "event_id", "passed", "up")

    return over_keys(polls, ["node"], ["at_us", "event_id"], walk, rows_per_task)


def incident_dedupe(runs: DataFrame, healthy_s: int = HEALTHY_RUN_S, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """runs(node, start_us, end_us, event_id), each ended by a failure: the failures that alert.

    The first does, and every one whose run had lasted ``healthy_s``.
    """

    def walk(rows: Ordered) -> DataFrame:
        seen = rows.carry(_earlier=previous(F.lit(True))).df
        lasted = F.col("end_us") - F.col("start_us") >= healthy_s * MICROS
        return seen.where(F.col("_earlier").isNull() | lasted).select("node", "start_us", "event_id")

    return over_keys(runs, ["node"], ["start_us", "event_id"], walk, rows_per_task)
