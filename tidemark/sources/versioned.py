"""A state table replaced as a whole: readers see the old version or the new one, never a torn one."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import folders

KEEP, HOLD_S = 8, 3600


class VersionedTable:
    """Versions under ``root/data/<n>``; a row in ``root/published/<n>`` makes one visible.

    The data is written first and the row after it, so a failed write leaves nothing that
    a reader would pick. Writing the same version again replaces it, which makes replayed
    micro-batches harmless. ``root`` must be a folder every executor reaches.

    The newest published number is the current version: a reader lists names and reads one row, however many versions were ever
    written. Each write then lets go of versions that are neither among the last ``keep`` nor younger than ``hold_s`` seconds, the
    publication first and the data after it; a reader may hold a version for so long.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = KEEP, hold_s: float = HOLD_S):
        if keep < 2:
            raise ValueError("a writer that comes again needs the version before")
        self.spark, self.root, self.keep, self.hold_s = spark, root.rstrip("/"), keep, hold_s

    def current_version(self) -> int | None:
        # A name may be there before its row is: then the one before it counts.
        for version in sorted(folders.numbered(self.spark, f"{self.root}/published"), reverse=True):
            try:
                if self.spark.read.schema("version BIGINT").json(f"{self.root}/published/{version}").where(F.col("version") == version).limit(1).count():
                    return version
            except AnalysisException:  # let go of meanwhile
                continue
        return None

    def read(self) -> DataFrame | None:
        version = self.current_version()
        return None if version is None else self.spark.read.parquet(f"{self.root}/data/{version}")

    def write(self, df: DataFrame, version: int | None = None) -> int:
        if version is None:
            current = self.current_version()
            version = 0 if current is None else current + 1
        df.write.mode("overwrite").parquet(f"{self.root}/data/{version}")
        mark = self.spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
        mark.coalesce(1).write.mode("overwrite").json(f"{self.root}/published/{version}")
        self.vacuum()
        return version

    def vacuum(self) -> list[int]:
        """Lets go of old versions and gives their numbers."""
        ages = folders.numbered(self.spark, f"{self.root}/published")
        kept = set(sorted(ages)[-self.keep :])
        old = [v for v, age in ages.items() if v not in kept and age >= self.hold_s]
        for version in old:
            folders.remove(self.spark, f"{self.root}/published/{version}")
            folders.remove(self.spark, f"{self.root}/data/{version}")
        return sorted(old)
