"""Scans of an archive: object keys, backup metadata, segment indexes, decoded logs, dump heads."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as X

BACKUP_META = T.StructType(
    [
        T.StructField("taken_at", T.StringType()),
        T.StructField("binlog_file", T.StringType()),
        T.StructField("binlog_pos", T.DecimalType(20, 0)),
        T.StructField("server_uuid", T.StringType()),
        T.StructField("mysql_version", T.StringType()),
    ]
)


def below_root(place: Column, root: str) -> Column:
    """The key of a file: its place below ``root``, without scheme, bucket or folders above."""
    at = urlsplit(root)
    folders = f"{at.netloc}{at.path}".strip("/")
    return F.regexp_replace(place, rf"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?/*\Q{folders}\E/*", "")


def list_objects(spark: SparkSession, root: str, archive_id: str) -> DataFrame:
    """(archive_id, key) of every file below ``root``, keys relative to it; file contents are not read.

    The driver lists the files, and Spark passes over empty ones and over names with a leading dot or underscore; ``listing.list_by_tasks``
    does neither.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.lit(archive_id).alias("archive_id"), below_root(F.col("path"), root).alias("key"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line); ``line_no`` rises within a file."""
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line_no"),
        F.col("value").alias("line"),
    )


def read_backup_texts(spark: SparkSession, root: str, archive_id: str) -> DataFrame:
    """(archive_id, key, text) of the metadata objects below ``root``, keys relative to it; the dumps are not opened."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.meta.json")
    texts = files.text(root, wholetext=True)
    key = below_root(F.col("_metadata.file_path"), root)
    return texts.select(F.lit(archive_id).alias("archive_id"), key.alias("key"), F.col("value").alias("text"))


def _below(base_path: str) -> str:
    base = base_path.strip("/")
    return rf"^\Q{base}/\Eserver-" if base else "^server-"


def key_lineage(key: Column, base_path: str) -> Column:
    """Lineage named by an object key, NULL for a key of another shape."""
    return F.nullif(F.regexp_extract(key, _below(base_path) + r"([^/]+)/", 1), F.lit(""))


def archive_listing(objects: DataFrame, base_path: str) -> DataFrame:
    """Keys of the archive's own shape as (archive_id, lineage, kind, name, seq)."""
    shape = _below(base_path) + r"([^/]+)/(full|binlog)/.*?([^/]*)$"
    return objects.where(F.col("key").rlike(shape)).select(
        "archive_id",
        "key",
        F.regexp_extract("key", shape, 1).alias("lineage"),
        F.regexp_extract("key", shape, 2).alias("kind"),
        F.regexp_extract("key", shape, 3).alias("name"),
        X.log_seq(F.regexp_extract("key", shape, 3)).alias("seq"),
    )


def _parsed_metadata(texts: DataFrame, base_path: str) -> DataFrame:
    meta = F.from_json("text", BACKUP_META)
    candidates = texts.where(F.col("key").endswith(".meta.json") & F.col("key").contains("/full/"))
    parsed = candidates.withColumn("lineage", key_lineage(F.col("key"), base_path)).withColumn("meta", meta)
    return parsed.select(
        "archive_id",
        "key",
        "lineage",
        F.regexp_replace("key", r"\.meta\.json$", ".sql.gz").alias("dump_key"),
        X.parse_rfc3339(F.col("meta.taken_at")).alias("taken_at"),
        F.col("meta.binlog_file").alias("start_file"),
        X.log_seq(F.col("meta.binlog_file")).alias("start_seq"),
        F.col("meta.binlog_pos").try_cast("bigint").alias("start_pos"),
        F.when(F.col("meta.server_uuid").isNotNull(), F.col("meta.mysql_version")).alias("version"),
    )


def _complete() -> Column:
    need = ["lineage", "taken_at", "start_file", "start_pos", "version"]
    return ~F.exists(F.array(*[F.col(c).isNull() for c in need]), lambda missing: missing)


def full_backup_scan(texts: DataFrame, base_path: str) -> DataFrame:
    """Usable full backups. The lineage is the key's, whatever the metadata says."""
    return _parsed_metadata(texts, base_path).where(_complete()).drop("key")


def full_backup_rejects(texts: DataFrame, base_path: str) -> DataFrame:
    """Metadata entries that could not be used; they never hide the good ones."""
    return _parsed_metadata(texts, base_path).where(~_complete()).select("archive_id", "key")


def segment_index_scan(lines: DataFrame) -> DataFrame:
    """(lineage, line) index text to (lineage, name, seq); blank lines dropped."""
    name = X.basename(F.trim("line"))
    return lines.select("lineage", name.alias("name"), X.log_seq(name).alias("seq")).where(F.col("name") != "")


def event_header_scan(lines: DataFrame) -> DataFrame:
    """One ``ts`` per event header line of a decoded log, other columns kept."""
    keep = [c for c in lines.columns if c != "line"]
    headers = lines.where(F.col("line").rlike(X.EVENT_HEADER))
    return headers.select(*keep, F.explode(X.header_times(F.col("line"))).alias("ts"))


def dump_coordinate_scan(lines: DataFrame) -> DataFrame:
    """(file, line_no, line) of dumps to (file, start_file, start_pos).

    Only the first line that names a coordinate counts, also when it turns out incomplete.
    """
    naming = lines.where(X.names_coordinate(F.col("line")))
    first = naming.groupBy("file").agg(F.min_by("line", "line_no").alias("line"))
    at = X.coordinate(F.col("line"))
    return first.where(at.isNotNull()).select(
        "file", at.getField("file").alias("start_file"), at.getField("pos").alias("start_pos")
    )
