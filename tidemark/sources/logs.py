"""Scans of edge statistics and structured logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Places of proxy, server and status in an edge statistics line.
PROXY_AT, SERVER_AT, STATUS_AT, LEAST_COLUMNS = 0, 1, 17, 18


def edge_stats_scan(lines: DataFrame) -> DataFrame:
    """Statistics lines to (other columns, proxy, server, status); shorter lines are dropped."""
    cells = F.split("line", ",", -1)
    keep = [c for c in lines.columns if c != "line"]
    return lines.withColumn("_cells", cells).where(F.size("_cells") >= LEAST_COLUMNS).select(
        *keep,
        F.col("_cells")[PROXY_AT].alias("proxy"),
        F.col("_cells")[SERVER_AT].alias("server"),
        F.col("_cells")[STATUS_AT].alias("status"),
    )


def log_signal_scan(lines: DataFrame, files: DataFrame, pattern: str, on: Sequence[str] = ("file",)) -> DataFrame:
    """JSON log lines whose message matches ``pattern`` and whose ``on`` columns are a row of ``files``.

    ``file`` comes from the line, other columns of ``on`` from ``lines``. File names repeat in every lineage, so name what tells
    them apart.
    """
    parsed = F.from_json("line", "message STRING, file STRING")
    found = lines.withColumn("_p", parsed).select(
        *[c for c in lines.columns if c != "line"], F.col("_p.message").alias("message"), F.col("_p.file").alias("file")
    )
    return found.where(F.col("message").rlike(pattern)).join(files.select(*on).distinct(), list(on), "left_semi")
