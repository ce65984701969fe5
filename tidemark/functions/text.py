"""Scalar functions on names, times and texts. All of them are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats of backup metadata, log headers and dump heads.
RFC3339_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
RFC3339_SHAPE = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
EVENT_HEADER = r"^#\d{6}\s*\d+:\d+:\d+\s+server\s+id(\s|$)"
HEADER_PARTS = r"^#(\d{2})(\d{2})(\d{2})\s*(\d+):(\d+):(\d+)\s+server\s+id(?:\s|$)"
COORDINATE_MARKS = ("CHANGE MASTER TO", "CHANGE REPLICATION SOURCE TO")
FILE_KEYS = r"(?:MASTER_LOG_FILE|SOURCE_LOG_FILE)='([^']*)'"
POSITION_KEYS = r"(?:MASTER_LOG_POS|SOURCE_LOG_POS)=(\d+)"
UUID_SHAPE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def parse_rfc3339(text: Column) -> Column:
    """An instant; NULL without an offset, for a bare date or for anything else."""
    normal = F.upper(F.regexp_replace(text, " ", "T"))
    return F.when(text.rlike(RFC3339_SHAPE), F.try_to_timestamp(normal))


def format_rfc3339_millis(instant: Column) -> Column:
    return F.date_format(instant, RFC3339_MILLIS)


def whole_seconds_between(earlier: Column, later: Column) -> Column:
    """Seconds from ``earlier`` to ``later``, cut toward zero."""
    return F.timestamp_diff("SECOND", earlier, later)


def log_seq(name: Column) -> Column:
    """Number after the last dot of a log file name; NULL for any other name."""
    return F.when(
        F.substring_index(name, ".", -1).rlike(r"^\+?\d+$"), F.substring_index(name, ".", -1).try_cast("bigint")
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def trim_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "^/+|/+$", "")


def host_label(address: Column) -> Column:
    """Host part of ``host:port``."""
    return F.substring_index(F.trim(address), ":", 1)


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID_SHAPE), F.lit(False))


def header_times(line: Column) -> Column:
    """The instant of a decoded event header line, as an array of one, or none for other text.

    Two-digit years 70-99 are 19xx. The epoch itself marks an artificial event, not a time.
    The line must match ``EVENT_HEADER``.
    """
    part = lambda i: F.regexp_extract(line, HEADER_PARTS, i)
    number = lambda i: part(i).try_cast("int")
    stamp = F.try_make_timestamp(
        F.when(number(1) >= 70, number(1) + 1900).otherwise(number(1) + 2000),
        number(2),
        number(3),
        number(4),
        number(5),
        F.when(number(6) < 60, part(6).try_cast("decimal(16,6)")),
    )
    # An array of one keeps the instant from being computed for each of its uses.
    stamps = F.transform(F.array(stamp), lambda s: s)
    return F.filter(stamps, lambda s: F.unix_seconds(s) > 0)


def names_coordinate(line: Column) -> Column:
    return F.greatest(*[line.contains(mark) for mark in COORDINATE_MARKS])


def coordinate(line: Column) -> Column:
    """(file, pos) named by a dump's coordinate line; NULL when either part is missing."""
    file = F.regexp_extract(line, FILE_KEYS, 1)
    pos = F.regexp_extract(line, POSITION_KEYS, 1).try_cast("bigint")
    return F.when(line.rlike(FILE_KEYS) & pos.isNotNull(), F.struct(file.alias("file"), pos.alias("pos")))


def fnv1a_32(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes, 0 mapped to 1."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    starts = F.sequence(F.lit(1), F.length(hexed), F.lit(2))
    byte = lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("bigint")
    folded = F.aggregate(
        F.when(F.length(hexed) > 0, starts).otherwise(F.array().cast("array<int>")),
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda acc, i: (acc.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(4294967295)),
    )
    return F.when(folded == 0, F.lit(1).cast("bigint")).otherwise(folded)


def heal_ledger(raw: Column) -> Column:
    """(attempts, last_unix) from ledger text. No text is a clean ledger; garbage is a spent one."""
    shape = r"^\s*(\d+)\s+(\d+)(\s|$)"
    attempts = F.regexp_extract(raw, shape, 1).try_cast("int")
    last = F.regexp_extract(raw, shape, 2).try_cast("bigint")
    spent = F.struct(F.lit(2147483647).alias("attempts"), F.lit(None).cast("bigint").alias("last_unix"))
    clean = F.struct(F.lit(0).alias("attempts"), F.lit(0).cast("bigint").alias("last_unix"))
    read = F.struct(attempts.alias("attempts"), last.alias("last_unix"))
    return F.when(raw.isNull(), clean).when(attempts.isNotNull() & last.isNotNull(), read).otherwise(spent)


def counter_or_zero(raw: Column) -> Column:
    """A stored counter; absent or garbled text counts as 0."""
    return F.coalesce(F.trim(raw).try_cast("bigint"), F.lit(0).cast("bigint"))
