"""Interval algebra on transaction sets.

A set is rows (owner, source, lo, hi) with both ends included. Every rule here is one sweep
over the ends of intervals: +1 where one opens, -1 just past where it closes, equal
positions summed first, or over the starts of merged intervals. Long sets are cut into regions of positions: what is open
where a region begins comes from one summary row a region, and joins the region's rows as one more row, so regions are
swept side by side in one sort. No interval is ever joined with another.

Sets that arrive as texts are interned: each distinct text is parsed once and named by a digest, and pairs of such
sets are compared by digests of their blocks first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import _CHUNK, ROWS_PER_TASK, Ordered, highest, latest, none_above, over_keys, toggled, total
from tidemark.session import written


SPAN, TAG = r"^[0-9]{1,19}(-[0-9]{1,19})?$", "^[a-z_][a-z0-9_]{0,31}$"
LAST = (1 << 63) - 2
#: Spans of one interned set are digested in blocks of this many positions.
BLOCK = 1 << 16
#: Sweeps over sets are cut at multiples of this position.
REGION = 1 << 16


def packed(text: Column) -> Column:
    """A set text without white space; ids and tags are compared without case."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def set_spans(text: Column) -> Column:
    """All spans of a set text as (source, lo, hi, bad), read token by token.

    A set is entries divided by commas, empty ones allowed. An entry is a source that is not empty, then spans, then tags each
    followed by spans (``src:1-3:t1:1-5:t2:7``; a tag's source is ``src:t1``), at least one span in all. A span is ``n`` or ``n-m`` with
    1 <= n <= m below 2^63 - 1. Whatever breaks this rule appears as a bad span.
    """
    return F.flatten(F.transform(F.filter(F.split(packed(text), ","), lambda e: e != ""), _entry))


def _entry(entry: Column) -> Column:
    marked = F.split(entry, ":(?=[a-z_])")
    return F.flatten(F.transform(marked, lambda part, at: _part(entry, part, at, F.size(marked))))


def _part(entry: Column, part: Column, at: Column, parts: Column) -> Column:
    """The spans behind a source or a tag."""
    bits = F.split(part, ":")
    return F.transform(_given(part, bits, at, parts), lambda span: _span(_source(entry, bits, at), _named(entry, bits, at), span))


def _source(entry: Column, bits: Column, at: Column) -> Column:
    return F.when(at == 0, bits[0]).otherwise(F.concat(F.substring_index(entry, ":", 1), F.lit(":"), bits[0]))


def _named(entry: Column, bits: Column, at: Column) -> Column:
    return F.when(at == 0, bits[0] != "").otherwise(bits[0].rlike(TAG) & ~entry.startswith(":"))


def _given(part: Column, bits: Column, at: Column, parts: Column) -> Column:
    """The span texts of a part; one that lacks them has one bad span, but for a source before a tag."""
    lacking = F.when((at == 0) & (parts > 1) & (part != ""), F.slice(bits, 2, F.lit(0))).otherwise(F.array(F.lit("")))
    return F.when(F.size(bits) > 1, F.slice(bits, F.lit(2), F.greatest(F.size(bits) - 1, F.lit(0)))).otherwise(lacking)


def _numbers(span: Column) -> tuple[Column, Column]:
    return F.substring_index(span, "-", 1).try_cast("bigint"), F.substring_index(span, "-", -1).try_cast("bigint")


def _good(named: Column, span: Column, lo: Column, hi: Column) -> Column:
    return F.coalesce(named & span.rlike(SPAN) & (lo >= 1) & (lo <= hi) & (hi <= LAST), F.lit(False))


def _span(source: Column, named: Column, span: Column) -> Column:
    lo, hi = _numbers(span)
    return F.struct(source.alias("source"), lo.alias("lo"), hi.alias("hi"), (~_good(named, span, lo, hi)).alias("bad"))


def malformed(text: Column) -> Column:
    """Does a set text break the rule of ``set_spans``? NULL does not: it is no text."""
    return F.coalesce(F.exists(set_spans(text), lambda s: s["bad"]), F.lit(False))


#: The shape of a set that ``set_spans`` finds no fault with but in its numbers. No quantifier gives back, so length costs no stack.
_SPANS, _TAG = "(?::[0-9]{1,19}+(?:-[0-9]{1,19}+)?+)++", ":[a-z_][a-z0-9_]{0,31}+"
SHAPE = rf"^(?:,++|[^,:]++(?:{_SPANS}(?:{_TAG}{_SPANS})*+|(?:{_TAG}{_SPANS})++)(?=,|\z))*+\z"


def faulty(packed_text: Column) -> Column:
    """``malformed`` for a packed text by its shape; left to look at are spans of 0, spans of two numbers, and numbers too long for any table."""
    two = F.regexp_extract_all(packed_text, F.lit(":([0-9]+-[0-9]+)"), F.lit(1))
    backward = F.exists(two, lambda s: F.substring_index(s, "-", 1).cast("bigint") > F.substring_index(s, "-", -1).cast("bigint"))
    numbers = F.when(packed_text.rlike("[0-9]{19}"), malformed(packed_text)).otherwise(packed_text.rlike(":0+(?![0-9])") | backward)
    return F.when(packed_text.rlike(SHAPE), numbers).otherwise(packed_text.isNotNull())


def txn_parse(sets: DataFrame, text: str = "txn_set") -> DataFrame:
    """Set texts ``src:1-5:7,src2:tag:3`` to rows (other columns, source, lo, hi).

    White space, line breaks and case do not matter. An empty or NULL text gives no rows. A tagged source keeps its tag in
    ``source``. Bad spans give no row here, and their set is in ``txn_rejects``. Entries, parts and spans become rows one after the other,
    by the rule of ``set_spans``.
    """
    keep = [c for c in sets.columns if c != text]
    entries = sets.select(*keep, F.explode(F.split(packed(F.col(text)), ",")).alias("_entry")).where(F.col("_entry") != "")
    marked = entries.select(*keep, "_entry", F.split("_entry", ":(?=[a-z_])").alias("_parts"))
    parts = marked.select(*keep, "_entry", F.size("_parts").alias("_n"), F.posexplode("_parts").alias("_at", "_part"))
    parts = parts.withColumn("_bits", F.split("_part", ":"))
    entry, part, bits, at = F.col("_entry"), F.col("_part"), F.col("_bits"), F.col("_at")
    named = [_source(entry, bits, at).alias("source"), _named(entry, bits, at).alias("_named")]
    spans = parts.select(*keep, *named, F.explode(_given(part, bits, at, F.col("_n"))).alias("_span"))
    lo, hi = _numbers(F.col("_span"))
    read = spans.select(*keep, "source", "_named", "_span", F.inline(F.array(F.struct(lo.alias("lo"), hi.alias("hi")))))
    return read.where(_good(F.col("_named"), F.col("_span"), F.col("lo"), F.col("hi"))).select(*keep, "source", "lo", "hi")


def txn_rejects(sets: DataFrame, text: str = "txn_set") -> DataFrame:
    """The other columns of sets with a bad span, one row a set; such a set is not known."""
    bad = F.exists(F.array(packed(F.col(text))), faulty)
    return sets.where(bad).select(*[c for c in sets.columns if c != text])


def set_id(text: Column) -> Column:
    """A 128-bit name of a set text; texts that differ in white space or case share it."""
    return text_id(packed(text))


def text_id(packed_text: Column) -> Column:
    return F.md5(packed_text.cast("binary"))


def interned(texts: DataFrame) -> DataFrame:
    """Every distinct set of ``texts`` (set_id, text) parsed once: (set_id, bad, source, lo, hi, block), spans merged.

    A malformed set has one row, with ``bad``; an empty one none. A set was one text, so all its spans fit into a task, and one shuffle by
    ``set_id`` serves the choice of texts, the merging and its windows.
    """
    once = texts.groupBy("set_id").agg(F.first("text").alias("text"))
    parsed = once.select("set_id", set_spans(F.col("text")).alias("all"))
    bad = F.exists("all", lambda s: s["bad"])
    nothing = F.struct(F.lit(None).cast("string").alias("source"), _null(), _null("hi"), F.lit(True).alias("bad"))
    spans = parsed.select("set_id", F.explode(F.when(bad, F.array(nothing)).otherwise(F.col("all"))).alias("s")).select("set_id", "s.*")
    order = Window.partitionBy("set_id", "source").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.when(reach.isNull() | (F.col("lo") > reach + 1), F.col("lo")))
    opened = opened.withColumn("open", F.last("opens", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = opened.groupBy("set_id", "source", "open").agg(F.max("hi").alias("hi"), F.bool_or("bad").alias("bad"))
    block = F.call_function("div", F.col("open"), _long(BLOCK))
    return merged.select("set_id", "bad", "source", F.col("open").alias("lo"), "hi", block.alias("block"))


def _null(name: str = "lo") -> Column:
    return F.lit(None).cast("bigint").alias(name)


def differing_sides(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Spans of both sets of each pair (a, b) of set ids, without the blocks that are equal: (a, b, source, lo, hi, in_a, in_b).

    ``sets`` is an ``interned`` table. A block's digest is two 64-bit hashes of its spans, combined in any order, and their number. Merged spans
    of a set are apart, so spans that both sets hold can be left out of any comparison. Equal histories are settled without a
    sweep, and of long ones only blocks that differ move.
    """
    spans = sets.where(~F.col("bad"))
    hashes = [F.expr("bit_xor(xxhash64(lo, hi))").alias("h1"), F.expr("bit_xor(xxhash64(hi, lo, 'other'))").alias("h2")]
    blocks = spans.groupBy("set_id", "source", "block").agg(*hashes, F.count(F.lit(1)).alias("n"))

    def members(table: DataFrame) -> DataFrame:
        one, none = _long(1), _long(0)
        each = F.array(
            F.struct(F.col("a").alias("set_id"), one.alias("in_a"), none.alias("in_b")),
            F.struct(F.col("b").alias("set_id"), none.alias("in_a"), one.alias("in_b")),
        )
        return table.withColumn("_m", F.explode(each)).select(*table.columns, "_m.*")

    both = members(pairs.select("a", "b")).join(blocks, "set_id")
    side = F.col("in_a") - F.col("in_b")
    unequal = both.groupBy("a", "b", "source", "block").agg(
        F.expr("bit_xor(h1)").alias("h1"), F.expr("bit_xor(h2)").alias("h2"), F.sum(side * F.col("n")).alias("n")
    )
    unequal = unequal.where((F.col("h1") != 0) | (F.col("h2") != 0) | (F.col("n") != 0)).select("a", "b", "source", "block")
    return members(unequal).join(spans.drop("bad"), ["set_id", "source", "block"]).drop("set_id", "block")


def _ends(intervals: DataFrame, keys: Sequence[str], depths: dict[str, Column], known_small: bool) -> DataFrame:
    """(keys, pos, one net change per depth): both ends of every interval, equal positions summed.

    Keys known to be small are brought together at once, so that sum and sweep share a shuffle.
    """
    opens = [c.alias(n) for n, c in depths.items()]
    closes = [(-c).alias(n) for n, c in depths.items()]
    ends = F.array(
        F.struct(F.col("lo").alias("pos"), *opens), F.struct((F.col("hi") + 1).alias("pos"), *closes)
    )
    rows = intervals.select(*keys, F.explode(ends).alias("_e")).select(*keys, "_e.*")
    if known_small:
        rows = rows.repartition(*keys)
    return rows.groupBy(*keys, "pos").agg(*[F.sum(n).alias(n) for n in depths])


def _spans(
    intervals: DataFrame,
    keys: Sequence[str],
    depths: dict[str, Column],
    wanted: Callable[[Callable[[str], Column]], Column],
    rows_per_task: int,
    known_small: bool,
) -> DataFrame:
    """Maximal (keys, lo, hi) on which ``wanted`` holds; ``wanted`` reads depths by name."""

    def sweep(rows: Ordered) -> DataFrame:
        rows = rows.carry(**{f"_d_{n}": total(F.col(n)) for n in depths})
        after = wanted(lambda n: F.col(f"_d_{n}"))
        before = wanted(lambda n: F.col(f"_d_{n}") - F.col(n))
        edges = rows.columns(_before=before, _after=after).where(F.col("_before") != F.col("_after"))
        closed = edges.carry(_open=latest(F.when(F.col("_after"), F.col("pos"))))
        spans = closed.where(F.col("_before")).df
        return spans.select(*keys, F.col("_open").alias("lo"), (F.col("pos") - 1).alias("hi"))

    return over_keys(_ends(intervals, keys, depths, known_small), keys, ["pos"], sweep, rows_per_task, known_small)


def _pairs_small(intervals: DataFrame, rows_per_task: int) -> bool:
    """No pair can have a hot source: it has two owners and two ends for each of their intervals."""
    return none_above(intervals, ["owner", "source"], rows_per_task // 4)


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _region(pos: Column) -> Column:
    """The first position of the region ``pos`` lies in."""
    return pos - F.pmod(pos, _long(REGION))


def _runs(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``intervals`` with those inside one word of 64 positions merged word by word: (keys, lo, hi).

    Such intervals are bits of their word, so however many there are, a word is one row before anything moves. Of other intervals with one
    start the longest stays.
    """
    lo, hi = F.col("lo"), F.col("hi")
    first, last, word = lo.bitwiseAND(_long(63)), hi.bitwiseAND(_long(63)), F.shiftright(lo, 6)
    narrow = F.coalesce((F.shiftright(hi, 6) == word) & (lo <= hi), F.lit(False))
    ones = F.call_function("shiftrightunsigned", _long(-1), (63 - last + first).cast("int"))
    bits = F.when(narrow, F.call_function("shiftleft", ones, first.cast("int")))
    rows = intervals.select(*keys, (~narrow).alias("wide"), F.when(narrow, word).otherwise(lo).alias("start"), F.when(~narrow, hi).alias("hi"), bits.alias("bits"))
    words = rows.groupBy(*keys, "wide", "start").agg(F.max("hi").alias("hi"), F.expr("bit_or(bits)").alias("bits"))

    held, base = F.col("bits"), F.shiftleft(F.col("start"), 6)
    begins = _bits_of(held.bitwiseAND(F.bitwise_not(F.shiftleft(held, 1))), base)
    ends = _bits_of(held.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(held, 1))), base)
    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    runs = F.when(F.col("wide"), F.array(span(F.col("start"), F.col("hi")))).otherwise(F.zip_with(begins, ends, span))
    return words.select(*keys, F.explode(runs).alias("r")).select(*keys, "r.lo", "r.hi")


def coalesce_intervals(
    intervals: DataFrame, keys: Sequence[str] = ("owner", "source"), rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Overlapping and adjacent intervals merged.

    Runs inside a word of positions are merged first. Of intervals with one start the longest counts, which makes the order total. An interval
    opens a new stretch when it starts past everything before it, also in the regions before. A stretch ends where the intervals before
    the next opening ended; for the last opening of a region that is known to the next region that has one.
    """
    keys = list(keys)
    at = [*keys, "region"]
    runs = written(_runs(intervals, keys).withColumn("region", _region(F.col("lo"))))
    regions = written(runs.groupBy(*at).agg(F.max("hi").alias("top")))
    handed = over_keys(regions, keys, ["region"], lambda r: r.carry(reach=highest(F.col("top"), inclusive=False)).df.select(*at, "reach"), rows_per_task)
    handed = handed.where(F.col("reach").isNotNull()).select(*keys, _null(), F.col("reach").alias("hi"), "region")
    longest = runs.unionByName(handed).repartition(*at).groupBy(*at, "lo").agg(F.max("hi").alias("hi"))

    order = Window.partitionBy(*at).orderBy("lo")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    handed_in = F.col("lo").isNull() & F.col("region").isNotNull()
    opens = ~handed_in & (F.col("reach").isNull() | (F.col("lo") > F.col("reach") + 1))
    openings = longest.withColumn("reach", reach).where(opens)
    openings = openings.select(
        *keys,
        F.col("region").alias(_CHUNK),
        "lo",
        F.when(F.col("hi").isNotNull(), F.lead("reach").over(order)).alias("hi"),
        F.when(F.lag(F.lit(1)).over(order).isNull(), F.col("reach")).alias("before"),
        F.lead(F.lit(1)).over(order).isNull().alias("last"),
        F.col("hi").isNull().alias("endless"),
    )
    openings = written(openings)
    inner = openings.where(~F.col("last")).select(*keys, "lo", "hi")

    outer = openings.where(F.col("last") | F.col("before").isNotNull()).withColumnRenamed(_CHUNK, "region")
    own = lambda name: F.when(F.col("last"), F.col(name)).alias(name)
    outer = outer.select(*at, own("lo"), "before", "last", own("endless")).unionByName(regions.select(*at, "top"), allowMissingColumns=True)
    outer = outer.groupBy(*at).agg(*[F.max(c).alias(c) for c in ("lo", "before", "last", "endless", "top")])

    def close(rows: Ordered) -> DataFrame:
        rows = rows.carry(_next=latest(F.col("before"), inclusive=False), _left=highest(F.col("top")))
        hi = F.when(~F.col("endless"), F.coalesce("_next", "_left"))
        return rows.where(F.col("last")).df.select(*keys, "lo", hi.alias("hi"))

    return inner.unionByName(over_keys(outer, keys, ["region"], close, rows_per_task, backward=True))


def _sides(intervals: DataFrame, pairs: DataFrame, pair_key: Sequence[str]) -> DataFrame:
    """Intervals of both members of each pair, marked 1 for the side they come from."""
    both = F.array(
        F.struct(F.col("a").alias("owner"), _long(1).alias("in_a"), _long(0).alias("in_b")),
        F.struct(F.col("b").alias("owner"), _long(0).alias("in_a"), _long(1).alias("in_b")),
    )
    members = pairs.select(*pair_key, F.explode(both).alias("_m")).select(*pair_key, "_m.*")
    return intervals.join(members, "owner").drop("owner")


def _starts(intervals: DataFrame, pairs: DataFrame, pair_key: Sequence[str], rows_per_task: int) -> DataFrame:
    """Intervals of both members of each pair in the order of their starts: (pair key, source, lo, hi, side, a_hi, b_hi, next).

    ``side`` is 1 for a; at one start b comes first. ``a_hi`` and ``b_hi`` are where the last interval of a and of b ends that started so far,
    ``next`` is where the next one starts.
    """
    keys = [*pair_key, "source"]
    at = [*keys, "region"]
    side = lambda name, side, value: F.when(F.col("in_a") == side, F.col(value)).alias(name)
    rows = intervals.select("owner", "source", "lo", "hi", _region(F.col("lo")).alias("region"))
    newest = F.max_by("hi", F.when(F.col("hi").isNotNull(), F.struct("lo", "hi")))
    owned = written(rows.groupBy("owner", "source", "region").agg(F.min("lo").alias("lo"), newest.alias("hi")))
    regions = _sides(owned, pairs, pair_key).select(*at, "lo", side("a_hi", 1, "hi"), side("b_hi", 0, "hi"))
    regions = written(regions.groupBy(*at).agg(F.min("lo").alias("lo"), F.max("a_hi").alias("a_hi"), F.max("b_hi").alias("b_hi")))

    def hand_on(rows: Ordered) -> DataFrame:
        handed = {f"_{c}": latest(F.col(c), inclusive=False) for c in ("a_hi", "b_hi")}
        return rows.carry(**handed).df.select(*at, "lo", *[F.col(f"_{c}").alias(c) for c in ("a_hi", "b_hi")])

    def look_ahead(rows: Ordered) -> DataFrame:
        ahead = rows.carry(next=latest(F.col("lo"), inclusive=False)).df
        return ahead.select(*at, _null(), _null("hi"), F.lit(None).cast("bigint").alias("side"), "a_hi", "b_hi", "next")

    handed = over_keys(over_keys(regions, keys, ["region"], hand_on, rows_per_task), keys, ["region"], look_ahead, rows_per_task, backward=True)
    both = _sides(rows, pairs, pair_key).select(
        *at, "lo", "hi", F.col("in_a").alias("side"), side("a_hi", 1, "hi"), side("b_hi", 0, "hi"), _null("next")
    )
    order = Window.partitionBy(*at).orderBy("lo", "side", "hi")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    known = lambda name: F.last(name, ignorenulls=True).over(so_far)
    following = F.coalesce(F.lead("lo").over(order), known("next"))
    state = both.unionByName(handed).select(*keys, "lo", "hi", "side", known("a_hi").alias("a_hi"), known("b_hi").alias("b_hi"), following.alias("next"))
    return state.where(F.col("side").isNotNull())


def txn_subtract(
    intervals: DataFrame,
    pairs: DataFrame,
    pair_key: Sequence[str] = ("a", "b"),
    rows_per_task: int = ROWS_PER_TASK,
    merged: bool = False,
) -> DataFrame:
    """For each pair(a, b) what a holds and b lacks, as merged intervals.

    Between two starts at most one span of a is not in b: it begins behind b's last interval and ends with a's. Sets are merged first, unless
    ``merged`` says they are, so spans of neighbouring starts are apart. Tables with ends that are NULL are swept by their ends.
    """
    if intervals.where(F.col("lo").isNull() | F.col("hi").isNull()).limit(1).count():
        return side_subtract(_sides(intervals, pairs, pair_key), pair_key, rows_per_task, _pairs_small(intervals, rows_per_task))
    rows = intervals if merged else written(coalesce_intervals(intervals, rows_per_task=rows_per_task))
    spans = _starts(rows, pairs, pair_key, rows_per_task).where(F.col("a_hi").isNotNull()).select(
        *pair_key,
        "source",
        F.greatest(F.col("lo"), F.col("b_hi") + 1).alias("lo"),
        F.least(F.col("a_hi"), F.col("next") - 1).alias("hi"),
    )
    return spans.where(F.col("lo") <= F.col("hi"))


def side_subtract(sides: DataFrame, pair_key: Sequence[str], rows_per_task: int = ROWS_PER_TASK, small: bool = False) -> DataFrame:
    """What side a of each pair holds and b lacks; ``sides`` has the intervals of both, marked by ``in_a`` and ``in_b``."""
    depths = {"in_a": F.col("in_a"), "in_b": F.col("in_b")}
    wanted = lambda depth: (depth("in_a") > 0) & (depth("in_b") == 0)
    return _spans(sides, [*pair_key, "source"], depths, wanted, rows_per_task, small)


OWNERS_PER_BLOCK = 128  # on average; a block's owners are bits of a few 64-bit words


def _numbered_owners(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(owner, block, bit) of every owner in ``pairs``, stored, and the words a block needs. A block has some hundred owners at most."""
    owners = written(pairs.select(F.explode(F.array("a", "b")).alias("owner")).where(F.col("owner").isNotNull()).distinct())
    blocks = -(-owners.count() // OWNERS_PER_BLOCK) or 1
    dealt = owners.withColumn("block", F.pmod(F.xxhash64("owner"), F.lit(blocks)).cast("int"))
    bit = F.row_number().over(Window.partitionBy("block").orderBy("owner")) - 1
    numbered = written(dealt.withColumn("bit", bit))
    return numbered, ((numbered.agg(F.max("bit")).first()[0] or 0) // 64) + 1


def _bits_of(word: Column, offset: Column | int) -> Column:
    """The numbers of the bits set in a word, from ``offset`` on."""
    there = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: F.call_function("getbit", word, p) == 1)
    return F.transform(there, lambda p: p + offset)


def covering_owners(intervals: DataFrame, pairs: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``pairs`` (a, b) of owners of merged ``intervals``, with ``b_in_a`` and ``a_in_b``.

    One sweep per source carries the set of owners whose intervals are open, a bit each: the ends of an owner's merged intervals toggle its bit.
    An owner's covering owners are those open wherever it is, the AND of the sets on its stretches; b is inside a if a is among b's. So no set is
    copied for a pair, and pairs only look two owners up. Owners beyond a block's bits are swept by pairs of blocks that a pair needs.
    """
    owners, words = _numbered_owners(pairs)
    masks = [f"w{k}" for k in range(2 * words)]
    side = lambda s: owners.select(F.col("owner").alias(s), F.col("block").alias(f"block_{s}"), F.col("bit").alias(f"bit_{s}"))
    placed = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    low, high = F.least("block_a", "block_b"), F.greatest("block_a", "block_b")
    placed = written(placed.withColumns({"i": low, "j": high}))

    def spot(block: str, bit: str) -> Column:
        """Where an owner's bit is among the words of blocks i and j."""
        return F.when(F.col(block) == F.col("i"), F.col(bit)).otherwise(F.col(bit) + 64 * words)

    swept = placed.select("i", "j").distinct().select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    held = owners.join(swept, "block").select("owner", "i", "j", spot("block", "bit").alias("spot"))
    ends = intervals.join(held, "owner").select("i", "j", "source", "spot", F.explode(F.array(F.col("lo"), F.col("hi") + 1)).alias("pos"))
    one = F.call_function("shiftleft", _long(1), F.col("spot") % 64)
    bits = [F.bit_xor(F.when(F.floor(F.col("spot") / 64) == k, one).otherwise(_long(0))).alias(w) for k, w in enumerate(masks)]
    at = ["i", "j", "source", "region"]
    changes = written(ends.groupBy(*at[:3], _region(F.col("pos")).alias("region"), "pos").agg(*bits))
    regions = changes.groupBy(*at).agg(*[F.bit_xor(w).alias(w) for w in masks])

    def hand_on(rows: Ordered) -> DataFrame:
        opened = rows.carry(**{f"_{w}": toggled(F.col(w), inclusive=False) for w in masks}).where(F.col(f"_{masks[0]}").isNotNull())
        return opened.df.select(*at, _null("pos"), *[F.col(f"_{w}").alias(w) for w in masks])

    handed = over_keys(regions, at[:3], ["region"], hand_on, rows_per_task)
    so_far = Window.partitionBy(*at).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    swept = changes.unionByName(handed).select("i", "j", *[F.bit_xor(w).over(so_far).alias(w) for w in masks])
    seen = swept.distinct()
    here = [_bits_of(F.col(w), 64 * k) for k, w in enumerate(masks)]
    open_ = seen.select("i", "j", *masks, F.explode(F.flatten(F.array(*here))).alias("spot"))
    above = open_.groupBy("i", "j", "spot").agg(*[F.bit_and(w).alias(w) for w in masks])

    def among(name: str, owner: str, other: str) -> DataFrame:
        """Per pair: is ``other`` open wherever ``owner`` is? An owner without intervals is inside all."""
        asked = placed.select("a", "b", "i", "j", spot(f"block_{owner}", f"bit_{owner}").alias("spot"), spot(f"block_{other}", f"bit_{other}").alias("_other"))
        word = F.element_at(F.array(*masks), (F.floor(F.col("_other") / 64) + 1).cast("int"))
        inside = F.call_function("getbit", word, (F.col("_other") % 64).cast("int")) == 1
        return asked.join(above, ["i", "j", "spot"], "left").select("a", "b", F.coalesce(inside, F.lit(True)).alias(name))

    return among("b_in_a", "b", "a").join(among("a_in_b", "a", "b"), ["a", "b"])


def side_extras(sides: DataFrame, pair_key: Sequence[str], rows_per_task: int = ROWS_PER_TASK, small: bool = False) -> DataFrame:
    """Does each side hold anything the other lacks? ``sides`` has the intervals of both, marked by ``in_a`` and ``in_b``.

    Pairs of two empty sets have no row.
    """
    keys = [*pair_key, "source"]
    depths = {"in_a": F.col("in_a"), "in_b": F.col("in_b")}

    def walk(rows: Ordered) -> DataFrame:
        state = rows.carry(_a=total(F.col("in_a")), _b=total(F.col("in_b"))).df
        return state.select(
            *pair_key,
            ((F.col("_a") > 0) & (F.col("_b") == 0)).alias("a_extra"),
            ((F.col("_b") > 0) & (F.col("_a") == 0)).alias("b_extra"),
        )

    ends = _ends(sides, keys, depths, small)
    spans = over_keys(ends, keys, ["pos"], walk, rows_per_task, small)
    return spans.groupBy(*pair_key).agg(F.bool_or("a_extra").alias("a_extra"), F.bool_or("b_extra").alias("b_extra"))


def extras_relation() -> Column:
    """The relation of a pair joined with its extras."""
    return relation_name(~F.coalesce("b_extra", F.lit(False)), ~F.coalesce("a_extra", F.lit(False)))


def text_relation(a: Column, b: Column) -> Column:
    """The relation of two set texts of one row, as ``txn_relation`` gives it; Unknown where one is NULL or malformed.

    One walk over the sorted ends of both sets: a stretch that only one set has open is an extra of that set. For sets that arrive
    with their row, as in streams; tables of sets are interned and compared by blocks.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def ends(text: Column, in_a: Column, in_b: Column) -> Column:
        point = lambda s, pos, sign: F.struct(
            s["source"].alias("source"), pos.alias("pos"), (in_a * sign).alias("a"), (in_b * sign).alias("b")
        )
        good = F.filter(set_spans(text), lambda s: ~s["bad"])
        return F.flatten(F.transform(good, lambda s: F.array(point(s, s["lo"], one), point(s, s["hi"] + 1, -one))))

    def step(seen: Column, end: Column) -> Column:
        moved = (seen["source"] == end["source"]) & (seen["pos"] < end["pos"])
        return F.struct(
            end["source"].alias("source"),
            end["pos"].alias("pos"),
            (seen["a"] + end["a"]).alias("a"),
            (seen["b"] + end["b"]).alias("b"),
            (seen["a_extra"] | (moved & (seen["a"] > 0) & (seen["b"] == 0))).alias("a_extra"),
            (seen["b_extra"] | (moved & (seen["b"] > 0) & (seen["a"] == 0))).alias("b_extra"),
        )

    no = F.lit(False)
    start = F.struct(F.lit("").alias("source"), none.alias("pos"), none.alias("a"), none.alias("b"), no.alias("a_extra"), no.alias("b_extra"))
    known = a.isNotNull() & b.isNotNull() & ~malformed(a) & ~malformed(b)
    name = lambda s: relation_name(~s["b_extra"], ~s["a_extra"])
    points = F.array_sort(F.concat(ends(a, one, none), ends(b, none, one)))
    return F.when(known, F.aggregate(points, start, step, name)).otherwise("Unknown")


def txn_relation(
    intervals: DataFrame,
    pairs: DataFrame,
    rows_per_task: int = ROWS_PER_TASK,
    merged: bool = False,
) -> DataFrame:
    """How b's set stands to a's: Equal, Behind (b inside a), Ahead (a inside b) or Diverged.

    All sets are swept together, once per source, however many pairs compare them. They are merged first, unless ``merged`` says they
    are. Pairs come from ``pairs``, so empty sets keep their row.
    """
    rows = intervals if merged else coalesce_intervals(intervals, rows_per_task=rows_per_task)
    inside = covering_owners(rows, pairs, rows_per_task)
    found = pairs.join(inside, ["a", "b"], "left")
    return found.withColumn("relation", relation_name(F.col("b_in_a"), F.col("a_in_b")))


def relation_name(b_in_a: Column, a_in_b: Column) -> Column:
    return (
        F.when(b_in_a & a_in_b, "Equal").when(b_in_a, "Behind").when(a_in_b, "Ahead").otherwise("Diverged")
    )


def interval_containment(
    intervals: DataFrame,
    pairs: DataFrame,
    pair_key: Sequence[str] = ("a", "b"),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Each interval of a, and whether one interval of b covers it. Both sides must be coalesced.

    Only the interval of b that starts last at or before a's can cover it.
    """
    starts = _starts(intervals, pairs, pair_key, rows_per_task).where(F.col("side") == 1)
    return starts.select(*pair_key, "source", "lo", "hi", F.coalesce(F.col("b_hi") >= F.col("hi"), F.lit(False)).alias("contained"))
