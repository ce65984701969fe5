"""Exact Jaccard similarity join of word-shingle sets by grouped prefixes, and its connected components.

Two documents link when 100 * |intersection| >= percent * |union|. Shingles are ordered, rare ones first; two sets that link
share a shingle in their prefixes, the first n - ceil(percent * n / 100) + 1 shingles of a set of size n. Steps:

1. Copies and order. Equal texts are collapsed. Over all distinct texts, shingles that occur in one only are told from the others,
   which are counted in a table (``marks``, 20 MB whatever the input). The order is: those of one text, then by (count, hash).
   Any fixed order gives the same links; by this one the prefix of a text with enough shingles of its own pairs with nothing.
2. Classes and groups. Documents of equal sets are one class, which one document stands for: they link without being
   compared. Classes of one size and one prefix are one group.
3. Group pairs. In each list of groups that share a
   shingle, every group is paired with one leader of about its size, whose prefix is the most frequent: of a base and its
   many variants the base. Members of a group are paired with the one that stands for it.
4. Expand and verify: the sets of paired members are compared in full. Links make components.
5. The rest: two members can still link only if their groups share a prefix shingle, or are one group, and they are in different
   components so far. All those pairs that size and position allow are compared, and the new links join components.

So a thousand near copies cost a thousand comparisons, not a million, and no link between components is lost: pairs that are never
compared are in one component anyway. Lists are joined, never collected nor broadcast; hot keys are combined map-side or
split by adaptive execution.

Hashes are 64 bits: sets are taken for equal when the hashes of all their shingles are.

Edge cases: texts without words have the empty set, link with nothing and are their own component; a NULL id counts as larger than all,
and a component of such rows has the component id NULL; rows that repeat an id are documents of their own with that id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import returning, small_batches
from tidemark.llm.components import components
from tidemark.llm.copies import first_copies
from tidemark.llm.marks import BLOBS, bitmap, marked, members, often, packing
from tidemark.llm.rolling import U, mixed
from tidemark.llm.shingles import shingle_sets, sliced
from tidemark.session import written

LAST = (1 << 63) - 1


def needed(n, percent: int):
    """Shingles a set of n must have in common with a partner at least."""
    return -(-percent * n // 100)


# -- sets -----------------------------------------------------------------------------------------------------------

SETS = "doc long, row_key long, n int, cid long, gid long, weight double, tokens array<struct<token: long, pos: int>>"


def _every_shingle(words: int, keep):
    def each(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        texts = keep(b).column("text").to_pylist()
        for lo, hi in sliced(texts):
            yield shingle_sets(texts[lo:hi], words)[0]

    return packing(each)


def _summed(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the stretches that end at ``ends``."""
    total = np.concatenate([[0], np.cumsum(h, dtype=h.dtype)]).astype(h.dtype)
    return np.diff(total[np.concatenate([[0], ends])])


def _sets(words: int, percent: int, marks, slots, keep):
    """Per text the size and hash of its set, the hash of its prefix, the prefix's mean frequency and its marked shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in map(keep, batches):
            texts = b.column("text").to_pylist()
            for lo, hi in sliced(texts):
                h, n = shingle_sets(texts[lo:hi], words)
                of = np.repeat(np.arange(hi - lo), n)
                shared, count = marked(h, marks), often(h, slots)
                cid = mixed(_summed(mixed(h ^ U(0x5851F42D4C957F2D)), np.cumsum(n)) + n.astype(U))
                order = np.lexsort((h, count, shared, of))
                size = np.where(n > 0, n - needed(n, percent) + 1, 0)
                pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                inside = pos < size[of]
                order, pos, of = order[inside], pos[inside], of[inside]
                ends = np.cumsum(size)
                salted = mixed(h[order] + mixed(pos.astype(U)))
                gid = mixed(_summed(salted, ends) + n.astype(U) * U(0x9E3779B97F4A7C15))
                weight = _summed(count[order].astype(np.float64), ends) / np.maximum(size, 1)
                kept = shared[order]
                starts = np.concatenate([[0], np.cumsum(np.bincount(of[kept], minlength=hi - lo))])
                pairs = pa.StructArray.from_arrays([pa.array(h[order][kept].view(np.int64)), pa.array(pos[kept], pa.int32())], ["token", "pos"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *b.select(["doc", "row_key"]).slice(lo, hi - lo).columns,
                        pa.array(n, pa.int32()),
                        pa.array(cid.view(np.int64), mask=n == 0),
                        pa.array(gid.view(np.int64)),
                        pa.array(weight),
                        pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs),
                    ],
                    ["doc", "row_key", "n", "cid", "gid", "weight", "tokens"],
                )

    return returning(run)


# -- verification ---------------------------------------------------------------------------------------------------


def _linked(words: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("text_a").to_pylist(), b.column("text_b").to_pylist()
            sizes = [max(x, y, key=len) for x, y in zip(left, right)]
            for lo, hi in sliced(sizes):
                x, n = shingle_sets(left[lo:hi], words)
                y, m = shingle_sets(right[lo:hi], words)
                both = np.concatenate([x, y])
                of = np.concatenate([np.repeat(np.arange(hi - lo), n), np.repeat(np.arange(hi - lo), m)])
                order = np.lexsort((both, of))
                both, of = both[order], of[order]
                same = (both[1:] == both[:-1]) & (of[1:] == of[:-1])
                common = np.bincount(of[1:][same], minlength=hi - lo)
                ok = np.flatnonzero(100 * common >= percent * (n + m - common))
                yield b.select(["a", "b"]).slice(lo, hi - lo).take(pa.array(ok))

    return returning(run)


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts link."""
    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    return _merged(_merged(pairs, left, "a"), right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_linked(words, percent), "a long, b long")


def _merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input: neither is collected to be broadcast, however small it turns out."""
    return left.join(right.hint("merge"), on, how)


def _fits(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


# -- the join -------------------------------------------------------------------------------------------------------


def similarity_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, row_key, n_shingles, component, component_id) of every row of ``docs`` (doc_id, text).

    ``row_key`` is a hash of id and text; ``component`` identifies the component, NULL for texts without words, and
    ``component_id`` is the smallest id in it.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text")
    )
    keyed = rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "row_key", "text")
    once, keep, others = first_copies(keyed, "doc")
    marks, counters, _ = bitmap(once.select("text", "text_hash").mapInArrow(_every_shingle(words, keep), BLOBS))
    slots = docs.sparkSession.sparkContext.broadcast(counters)
    sets = written(once.mapInArrow(_sets(words, percent, marks, slots, keep), SETS))
    first = F.min(F.struct("doc", "row_key", "n", "gid", "weight", "tokens"))
    classes = written(sets.where(F.col("n") > 0).groupBy("cid").agg(first.alias("r")).select("cid", "r.*"))
    lead = F.min(F.struct("cid", "n", "weight", "tokens"))
    groups = written(classes.groupBy("gid").agg(lead.alias("r"), F.count("*").alias("members")).select("gid", "members", F.col("r.cid").alias("lead"), "r.n", "r.weight", "r.tokens"))
    tokens = groups.select("gid", "n", "weight", F.explode("tokens").alias("t")).select("t.token", "t.pos", "gid", "n", "weight")
    shared = tokens.groupBy("token").agg(F.count("*").alias("size")).where(F.col("size") > 1).select("token")
    tokens = written(_merged(tokens, shared, "token"))
    # Leaders: per list and size band the group of the most frequent prefix.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    banded = tokens.withColumn("band", band)
    lists = banded.groupBy("token", "band").agg(F.max(F.struct("weight", "gid", "n")).alias("leader"), F.count("*").alias("size")).where(F.col("size") > 1)
    led = _merged(banded, lists.select("token", "band", F.col("leader.gid").alias("leader"), F.col("leader.n").alias("leader_n")), ["token", "band"])
    led = led.where((F.col("gid") != F.col("leader")) & _fits(F.col("n"), F.col("leader_n"), percent))
    ranked = led.groupBy("gid", "leader").agg(F.count("*").alias("shared"))
    stars = ranked.groupBy("gid").agg(F.max_by("leader", F.struct("shared", "leader")).alias("leader"))
    heads = groups.select("gid", "lead")
    led_by = written(_merged(stars, heads, "gid").select("leader", F.col("lead").alias("a")))
    star_pairs = _merged(led_by, heads.select(F.col("gid").alias("leader"), F.col("lead").alias("b")), "leader")
    inner = _merged(classes.select("cid", "gid"), groups.where(F.col("members") > 1).select("gid", "lead"), "gid").where(F.col("cid") != F.col("lead"))
    pairs = written(star_pairs.select("a", "b").unionByName(inner.select(F.col("cid").alias("a"), F.col("lead").alias("b"))).distinct())

    # Texts of the classes that have any candidate; others are not moved.
    open_groups = tokens.select("gid").unionByName(groups.where(F.col("members") > 1).select("gid")).distinct()
    wanted = written(_merged(classes, open_groups, "gid", "left_semi").select("cid", "gid", "n", "row_key"))
    there = members(wanted.select(F.xxhash64("row_key")))

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in map(keep, batches):
            few = b.filter(pa.array(marked(b.column("h").to_numpy().view(U), there)))
            yield few.select(["row_key", "text"])

    few = once.select("row_key", "text", "text_hash", F.xxhash64("row_key").alias("h")).mapInArrow(candidates, "row_key long, text string")
    texts = written(_merged(few, wanted.select("row_key", "cid"), "row_key").select("cid", "text"))
    others = written(others)
    for read in (marks, slots, there):
        read.destroy()
    keep.release()

    links = written(verified(pairs, texts, words, percent))
    labels = components(links)
    # The rest: members of groups that share a token, or of one group, in different components.
    placed = _merged(wanted.select("cid", "gid", "n"), labels.withColumnRenamed("node", "cid"), "cid", "left")
    placed = written(placed.withColumn("label", F.coalesce("label", "cid")))
    parts = _merged(tokens.select("token", "pos", "gid"), placed, "gid")
    several = parts.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where(F.col("x") != F.col("y")).select("token")
    left = _merged(parts, several, "token")
    right = left.select("token", *[F.col(c).alias(f"{c}_b") for c in ("cid", "label", "n", "pos")])
    n, m = F.col("n"), F.col("n_b")
    reach = 1 + F.least(n - F.col("pos") - 1, m - F.col("pos_b") - 1)
    crossed = _merged(left, right, "token").where((F.col("label") < F.col("label_b")) & _fits(n, m, percent) & (reach * (100 + percent) >= (n + m) * percent))
    mixed_groups = placed.groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y")).where(F.col("x") != F.col("y")).select("gid")
    one = _merged(placed, mixed_groups, "gid")
    within = _merged(one.select("gid", "cid", "label"), one.select("gid", F.col("cid").alias("cid_b"), F.col("label").alias("label_b")), "gid").where(F.col("label") < F.col("label_b"))
    rest = crossed.select(F.col("cid").alias("a"), F.col("cid_b").alias("b")).unionByName(within.select(F.col("cid").alias("a"), F.col("cid_b").alias("b"))).distinct()
    more = written(verified(written(rest), texts, words, percent))
    final = components(links.unionByName(more))

    named = _merged(classes.select("cid", "doc"), final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    of_class = _merged(named, smallest, "label").select("cid", F.col("label").alias("component"), "component_id")
    placed_sets = written(_merged(sets.select("doc", "row_key", "n", "cid"), of_class, "cid", "left"))
    # Rows whose text occurs again take the place of the row that stands for it.
    stands = others.where(F.col("doc") == F.col("first")).select("digest", "row_key").distinct()
    of_text = _merged(stands, placed_sets.drop("doc"), "row_key").drop("row_key")
    copies = _merged(others.select("doc", "row_key", "digest"), of_text, "digest").drop("digest")
    out = _merged(placed_sets, stands.select("row_key"), "row_key", "left_anti").unionByName(copies)
    doc_id = F.nullif("doc", F.lit(LAST))
    component_id = F.when(F.col("cid").isNull(), doc_id).otherwise(F.nullif("component_id", F.lit(LAST)))
    return out.select(doc_id.alias("doc_id"), "row_key", F.col("n").cast("long").alias("n_shingles"), "component", component_id.alias("component_id"))


def op6_grouped_prefix_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles agree by 90 percent or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similarity_components(docs, words=3, percent=90).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op6_grouped_prefix_join": op6_grouped_prefix_join}
