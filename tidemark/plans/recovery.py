"""Composite recovery plans: is an instant restorable, and what did the table hold then."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.ordered import ROWS_PER_TASK
from tidemark.operators import archive as A
from tidemark.operators import replay as R
from tidemark.operators.log_index import SegmentIndex


def restore_readiness(
    targets: DataFrame,
    fulls: DataFrame,
    segments: DataFrame,
    rotate_s: int = A.ROTATE_INTERVAL_S,
    target_aware: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One verdict per requested instant: NO_FULL, GAP, SHORT or OK.

    A gap refuses the request wherever it lies. ``target_aware=True`` ignores a gap when the
    run before it already reaches the target.
    """
    chosen = A.newest_full_asof(targets, fulls, rows_per_task)
    plans = A.replay_plan(segments, fulls, rows_per_task)
    reach = F.when(F.col("run_length") == 0, F.col("taken_at")).otherwise(
        F.when(F.col("run_last_ts").isNotNull(), F.least("run_last_ts", "target"))
    )
    gap = F.col("gap_next").isNotNull()
    if target_aware:
        gap &= F.coalesce(F.col("run_last_ts") < F.col("target"), F.lit(True))
    lag = X.whole_seconds_between(F.col("achieved"), F.col("target"))
    bound = A.lag_bound_seconds(F.lit(rotate_s))
    return (
        chosen.join(plans, [*A.lineage_keys(chosen, plans), "start_seq", "start_file"], "left")
        .withColumn("achieved", F.when(~gap & F.col("lineage").isNotNull(), reach))
        .withColumn("lag_s", lag)
        .withColumn(
            "verdict",
            F.when(F.col("lineage").isNull(), "NO_FULL")
            .when(gap, "GAP")
            .when(F.coalesce(lag <= bound, F.lit(False)), "OK")
            .otherwise("SHORT"),
        )
    )


def point_in_time_table(
    snapshot: DataFrame,
    change_log: DataFrame,
    readiness: DataFrame,
    keys: Sequence[str] = ("key",),
    payload: Sequence[str] = ("image",),
    index: SegmentIndex | None = None,
) -> DataFrame:
    """The keyed table at each approved request's target; requests not ``OK`` give no rows. ``index`` is the log's, if it is kept.

    ``snapshot([archive_id], lineage, [dump_key], key, image)`` is what the full backups hold.
    """
    dump = [c for c in ("archive_id", "lineage", "dump_key") if c in snapshot.columns and c in readiness.columns]
    approved = readiness.where(F.col("verdict") == "OK").select(
        "request_id", *A.lineage_keys(readiness), "dump_key", "start_seq", "start_pos", "target"
    )
    replayed = A.stop_cut(change_log, approved, index)
    base = snapshot.join(approved.select("request_id", *dump), dump)
    return R.fold(base, replayed, ["request_id", *keys], ["seq", "pos"], list(payload))
