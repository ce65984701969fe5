"""All registered queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import (
    archive_oracle,
    archive_queries,
    membership_oracle,
    membership_queries,
    temporal_oracle,
    temporal_queries,
)
from tidemark.plans.tables import Tables

_BUILDERS = {**archive_queries.QUERIES, **membership_queries.QUERIES, **temporal_queries.QUERIES}
_SQL = {**archive_oracle.ORACLE, **membership_oracle.ORACLE, **temporal_oracle.ORACLE}


def without_zone(df: DataFrame) -> DataFrame:
    """Instants as zone-free timestamps, the type of the given tables."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _callable(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: without_zone(build(Tables(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _callable(build) for name, build in _BUILDERS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
