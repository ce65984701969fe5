"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round of stars. ``edges`` are (u, v), u > v.

    Large star: every node links its larger neighbours to the smallest of its neighbours and itself. Small star: every node links
    its smaller neighbours and itself to the smallest of them.
    """
    seen = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = seen.where(F.col("v") > F.col("u")) if large else edges
    moved = out.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); the label is the smallest node of the component.

    Every round is stored in the shared folder; rounds grow with the logarithm of the largest distance. A node with any
    number of links is combined map-side and its join is split by adaptive execution; tables that grow are merged, never sent to all.
    """
    ends = links.where(F.col("a") != F.col("b"))
    edges = written(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
        edges = written(_stars(_stars(edges, large=True), large=False))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
