"""A keyed table kept current from a change stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.replay import latest_per_key
from tidemark.sources import folders
from tidemark.sources.versioned import HOLD_S, KEEP


class LiveTable:
    """Rows live in hash buckets of their key. A batch adds a delta to each bucket it touches; reading merges a bucket's parts.

    ``root/data/<part>/bucket=<b>`` holds changes folded per key; a part is named after the batch that wrote it. ``root/published/<batch>``
    lists every bucket's parts with their rows, oldest first; it is written after the data and makes the batch visible. A replayed
    batch starts from the publication before it and overwrites its own files. Deleted keys stay as markers, so an old
    change that comes again cannot bring a key back.

    Parts of a bucket shrink from the oldest to the newest: a delta is merged with the newest parts before it for as long as
    the next is not more than twice as large as what is merged so far. So a bucket has about log2(rows) parts at most, and a row is
    rewritten as often at most, while a batch that touches few keys of a large bucket writes few rows. Deltas and merged parts are
    aggregates by key, written in files of a bounded size: no task owns a bucket.

    The driver knows the list of parts only. Each batch lets go of parts that no publication needs that is among the last
    ``keep`` or younger than ``hold_s`` seconds.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        keys: Sequence[str],
        order: Sequence[str],
        payload: Sequence[str],
        buckets: int = 256,
        keep: int = KEEP,
        hold_s: float = HOLD_S,
    ):
        if keep < 2:
            raise ValueError("a batch that comes again needs the publication before")
        self.spark, self.root, self.buckets, self.keep, self.hold_s = spark, root.rstrip("/"), buckets, keep, hold_s
        self.keys, self.order, self.payload = list(keys), list(order), list(payload)
        self.columns = [*self.keys, *self.order, "op", *self.payload]
        self._applied: tuple[int, dict[int, list[tuple[str, int]]]] | None = None  # spares a running stream the list

    def _published(self, batch: int) -> dict[int, list[tuple[str, int]]] | None:
        """Every bucket's parts (name, rows), oldest first; None where the publication is not complete."""
        try:
            rows = self.spark.read.schema("bucket INT, at INT, part STRING, n BIGINT, parts BIGINT").json(f"{self.root}/published/{batch}").collect()
        except AnalysisException:
            return None
        if not rows or len(rows) != rows[0].parts:
            return None
        out: dict[int, list[tuple[str, int]]] = {}
        for r in sorted(rows, key=lambda r: (r.bucket, r.at)):
            out.setdefault(r.bucket, []).append((r.part, r.n))
        return out

    def _manifest(self, before: int | None = None) -> dict[int, list[tuple[str, int]]]:
        """The newest publication, of those before a batch if one is named."""
        for batch in sorted(folders.numbered(self.spark, f"{self.root}/published"), reverse=True):
            if (before is None or batch < before) and (found := self._published(batch)) is not None:
                return found
        return {}

    def _rows(self, parts: Sequence[tuple[int, str]]) -> DataFrame | None:
        paths = [f"{self.root}/data/{part}/bucket={b}" for b, part in parts]
        return self.spark.read.parquet(*paths).select(*self.columns) if paths else None

    def _folded(self, rows: DataFrame) -> DataFrame:
        return latest_per_key(rows.select(*self.columns), self.keys, self.order, [*self.order, "op", *self.payload])

    def _write(self, rows: DataFrame, part: str) -> dict[int, int]:
        """The rows of each bucket, after they are stored as ``part``."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        out = rows.withColumn("bucket", bucket).hint("rebalance", "bucket")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/{part}")
        try:
            stored = self.spark.read.option("basePath", f"{self.root}/data/{part}").parquet(f"{self.root}/data/{part}")
        except AnalysisException:  # an empty batch leaves no files
            return {}
        return {r.bucket: r["count"] for r in stored.groupBy("bucket").count().collect()}  # a row a bucket

    def read(self) -> DataFrame | None:
        """The table as of the last published batch."""
        rows = self._rows([(b, part) for b, parts in self._manifest().items() for part, _ in parts])
        return None if rows is None else self._folded(rows).where(F.col("op") != "delete").select(*self.keys, *self.payload)

    def apply_batch(self, changes: DataFrame, batch_id: int) -> None:
        running = self._applied is not None and self._applied[0] < batch_id
        manifest = dict(self._applied[1]) if running else self._manifest(before=batch_id)
        delta = self._write(self._folded(changes), f"{batch_id}")
        if not delta:
            return
        merged: list[tuple[int, str]] = []
        stays: dict[int, list[tuple[str, int]]] = {}
        for bucket, rows in delta.items():
            parts = list(manifest.get(bucket, []))
            taken = []
            while parts and parts[-1][1] <= 2 * rows:
                part, n = parts.pop()
                taken.append((bucket, part))
                rows += n
            if taken:
                merged += [*taken, (bucket, f"{batch_id}")]
            stays[bucket] = parts
        sizes = self._write(self._folded(self._rows(merged)), f"{batch_id}-merged") if merged else {}
        for bucket, rows in delta.items():
            newest = (f"{batch_id}-merged", sizes[bucket]) if bucket in sizes else (f"{batch_id}", rows)
            manifest[bucket] = [*stays[bucket], newest]
        entries = [(b, at, part, n) for b, parts in manifest.items() for at, (part, n) in enumerate(parts)]
        published = self.spark.createDataFrame([(*e, len(entries)) for e in entries], "bucket INT, at INT, part STRING, n BIGINT, parts BIGINT")
        published.coalesce(1).write.mode("overwrite").json(f"{self.root}/published/{batch_id}")
        self._applied = (batch_id, manifest)
        self.vacuum()

    def vacuum(self) -> None:
        """Lets go of publications that are old, and of parts that no publication left names."""
        ages = folders.numbered(self.spark, f"{self.root}/published")
        last = max(ages, default=0)
        kept = set(sorted(ages)[-self.keep :]) | {b for b, age in ages.items() if age < self.hold_s}
        for batch in set(ages) - kept:
            folders.remove(self.spark, f"{self.root}/published/{batch}")
        if set(ages) == kept:
            return
        needed = {(b, part) for batch in kept for b, parts in (self._published(batch) or {}).items() for part, _ in parts}
        for part in folders.names(self.spark, f"{self.root}/data"):
            if int(part.split("-")[0]) >= last:
                continue  # written by a batch under way
            for name in folders.names(self.spark, f"{self.root}/data/{part}"):
                if name.startswith("bucket=") and (int(name[7:]), part) not in needed:
                    folders.remove(self.spark, f"{self.root}/data/{part}/{name}")
            if not any(n.startswith("bucket=") for n in folders.names(self.spark, f"{self.root}/data/{part}")):
                folders.remove(self.spark, f"{self.root}/data/{part}")

    def start(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = changes.writeStream.foreachBatch(self.apply_batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
