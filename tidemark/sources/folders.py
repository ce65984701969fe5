"""Names in a folder of any store Spark reaches, and their removal."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> dict[str, float]:
    """The names directly in a folder and how many seconds ago each changed; nothing where there is no folder."""
    place, store = _at(spark, path)
    if not store.exists(place):
        return {}
    now = time.time()
    return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in store.listStatus(place)}


def numbered(spark: SparkSession, path: str) -> dict[int, float]:
    """Those names that are numbers."""
    return {int(n): age for n, age in names(spark, path).items() if n.isdigit()}


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all in it."""
    place, store = _at(spark, path)
    store.delete(place, True)
