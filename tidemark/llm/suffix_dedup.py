"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if some string of ``length`` bytes that covers it also starts in a document with a smaller id. Strings are judged on
the input, overlaps count, and nothing matches across documents.

All strings of ``length`` bytes are suffixes cut to that length, one at each position, and far too many to move. Two equal ones
contain the same ``ANCHOR``-byte strings, so both name the same one their anchor: the one of the smallest hash. Steps:

0. Copies. Of equal texts only the smallest document's goes on; the others lose everything.
1. Anchors. Every document names the anchors of its strings, about one position in 16. Their hashes, 36 bits each, are dealt by
   their leading bits; those in two documents at least are marked in a bitmap of 16 MB whatever the input (``marks``). A mark set wrongly costs work, not correctness.
2. Contexts. A marked anchor's context is the bytes of all strings that name it: at most 80. Equal contexts in a
   batch of documents are collapsed at once: all but the smallest document's are removed there. What is left travels by anchor:
   a passage in a third of all documents reaches its task once per batch of documents, not once per document.
3. Suffix sort. In a task, contexts of one anchor are collapsed again, and the strings of what is left are sorted as suffixes, by a
   mergesort that advances all groups at once. Two suffixes are compared by their longest common extension, found by a binary
   search over lengths with prefix polynomial hashes: the logarithm of ``length`` hash comparisons and one byte. Neighbours
   in the order whose common extension is the whole length are equal; they are verified byte by byte, and if a hash
   lied, the bucket is sorted again by its bytes. The smallest document among equal strings keeps, the others lose theirs.
4. Spans are sent to their documents, merged, and cut out.

A task holds one bucket of contexts at a time; the number of buckets grows with the input (``BUCKET_ANCHORS``), so memory does not
depend on the length or the number of documents. Documents of any length are read whole, in overlapping pieces.

Edge cases: a NULL text is kept NULL and counts as empty; shorter texts than ``length`` never lose a byte; rows with a NULL id count
as the largest; rows of equal ids are not smaller than each other, whatever their texts; repeated rows get the same result; an
empty table gives an empty result; other columns are kept, the added ones replace those of their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.batches import returning, small_batches
from tidemark.llm.copies import first_copies
from tidemark.llm.marks import BLOBS, bitmap, marked, packing
from tidemark.llm.rolling import Prefixes, U, mixed, same_bytes

ANCHOR = 20
PIECE = 1 << 16
BATCH_BYTES = 1 << 22  # bytes of contexts collapsed together
BUCKET_ANCHORS = 1 << 19  # anchors, marked or not, that a bucket of contexts of 50-byte strings has on average
SORTED = 1 << 16  # strings sorted together
LAST = np.iinfo(np.int64).max
ADDED = ("kept", "n_bytes", "n_removed", "n_spans")


# -- the strings of a batch of documents ----------------------------------------------------------------------------


def pieces(texts: Iterable[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of several documents together, a document index per byte, and the documents' starts here and offsets in them."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), PIECE):
            part = text[at : at + PIECE + length - 1]
            if held and size + len(part) > PIECE + length:
                yield _together(held)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield _together(held)


def _together(held: list[tuple[int, int, bytes]]):
    sizes = np.array([len(p) for _, _, p in held])
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    return data, np.repeat(np.arange(len(held)), sizes), np.cumsum(sizes) - sizes, np.array([(i, at) for i, at, _ in held])


def runs(data: np.ndarray, part: np.ndarray, length: int, anchor: int) -> tuple[Prefixes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one anchor: first and last string, the anchor's position and hash."""
    prefixes = Prefixes(data)
    bits = U(max(len(data), 2) - 1).item().bit_length()
    low = U((1 << bits) - 1)
    hashes = mixed(prefixes.every(anchor))
    least = (hashes & ~low) | np.arange(len(hashes), dtype=U)
    span, width = 1, length - anchor + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least & low).astype(np.int64)
    whole = part[: len(at)] == part[length - 1 : length - 1 + len(at)]
    at[~whole] = -1
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    real = at[first] >= 0
    first, last = first[real], last[real]
    at = at[first]
    # Anchors are minima, so their own hashes crowd near zero: mixed anew, they spread evenly over marks and buckets.
    return prefixes, first, last, at, mixed(hashes[at] ^ U(0xD1B54A32D192ED03))


# -- marks ----------------------------------------------------------------------------------------------------------


def _named_anchors(length: int, anchor: int, keep=lambda b: b):
    """The anchors of a batch, each once per document."""

    def each(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        b = keep(b)
        for data, part, _, owners in pieces(_texts(b), length):
            _, _, _, at, h = runs(data, part, length, anchor)
            document = owners[part[at], 0]
            order = np.lexsort((h, document))
            h, document = h[order], document[order]
            # A document cut into pieces may name an anchor twice, which only costs work.
            yield h[np.concatenate([[True], (h[1:] != h[:-1]) | (document[1:] != document[:-1])])[: len(h)]]

    return packing(each)


def _texts(b: pa.RecordBatch) -> Iterator[bytes]:
    for text in b.column("text").cast(pa.binary()):
        yield text.as_py()


# -- contexts -------------------------------------------------------------------------------------------------------

CONTEXT = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i8"), ("size", "<i4"), ("anchor", "<i4")])


def _pack(rows: np.ndarray, data: bytes) -> bytes:
    steps = np.diff(rows["doc"], prepend=np.int64(0))  # documents come in runs and often in order
    columns = b"".join([steps.tobytes(), *(rows[c].tobytes() for c in CONTEXT.names[1:])])
    return len(rows).to_bytes(8, "little") + zstandard.ZstdCompressor(level=5).compress(columns + data)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[8:])
    rows, at = np.zeros(n, CONTEXT), 0
    for c in CONTEXT.names:
        rows[c] = np.frombuffer(raw, CONTEXT[c], n, at)
        at += CONTEXT[c].itemsize * n
    rows["doc"] = np.cumsum(rows["doc"])
    return rows, np.frombuffer(raw, np.uint8, offset=at)


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several substrings, one after the other."""
    ends = np.cumsum(size)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def first_of_equal(data: np.ndarray, h: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For substrings with hashes: the smallest document that has each, and the index of one that stands for it.

    Equal hashes and sizes are verified byte by byte; a substring that only collides stands for itself.
    """
    h = mixed(h + size.astype(U))
    order = np.lexsort((doc, h))
    fresh = np.concatenate([[True], h[order][1:] != h[order][:-1]])[: len(order)]
    head = np.zeros(len(order), np.int64)
    head[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    same = (size == size[head]) & _same_sized(data, start, start[head], size)
    head = np.where(same, head, np.arange(len(head)))
    return doc[head], head


def _same_sized(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    same = np.ones(len(a), bool)
    differ = np.flatnonzero(a != b)
    for n in np.unique(size[differ]):
        at = differ[size[differ] == n]
        inside = b[at] + n <= len(data)
        same[at] = False
        same[at[inside]] = same_bytes(data, a[at[inside]], b[at[inside]], int(n))
    return same


def spans_of(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch | None:
    """Merged spans, a row per (document, key)."""
    if not len(doc):
        return None
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], end[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    at = np.flatnonzero(new)
    # Within a document spans touch if the next starts at or before the largest end so far.
    rank = np.cumsum(new) - 1
    reach = np.maximum.accumulate(end + rank * (int(end.max()) + 2)) - rank * (int(end.max()) + 2)
    opens = new | np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(opens)
    merged = np.stack([start[first], reach[np.append(first[1:], len(start)) - 1]], axis=1).astype("<i8")
    cuts = np.append(np.searchsorted(first, at), len(first))
    blobs = [merged[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(doc[at], pa.int64()), pa.array(key[at], pa.int64()), pa.array(blobs, pa.binary())], ["__id", "__key", "__spans"])


SPANS = "__id long, __key long, __spans binary"
SENT = f"bucket long, blob binary, {SPANS}"


def _contexts(length: int, anchor: int, marks, bits: int, keep=lambda b: b, key_of=lambda ids, keys: keys):
    """Contexts of marked anchors by bucket (the leading ``bits`` of the anchor's hash), and spans settled on the way."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in map(keep, batches):
            ids, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("__id", "__key"))
            keys = key_of(ids, keys)
            for data, part, starts, owners in pieces(_texts(b), length):
                prefixes, first, last, at, h = runs(data, part, length, anchor)
                chosen = np.flatnonzero(marked(h, marks))
                first, last, at, h = first[chosen], last[chosen], at[chosen], h[chosen]
                new = np.zeros(len(first), CONTEXT)
                document = owners[part[first], 0]
                new["doc"], new["key"] = ids[document], keys[document]
                new["start"] = first - starts[part[first]] + owners[part[first], 1]
                new["size"], new["anchor"] = last - first + length, at - first
                context = prefixes.hashes(first, first + new["size"])
                held.append((new, gathered(data, first, new["size"].astype(np.int64)), context, (h >> U(64 - bits)).astype(np.int64)))
                size += len(held[-1][1])
                if size >= BATCH_BYTES:
                    yield from collapsed(held)
                    held, size = [], 0
        if held:
            yield from collapsed(held)

    def collapsed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        new, data, context, bucket = (np.concatenate(c) for c in zip(*held))
        sizes = new["size"].astype(np.int64)
        at = np.cumsum(sizes) - sizes
        smallest, _ = first_of_equal(data, context, at, sizes, new["doc"])
        gone = new["doc"] > smallest
        settled = spans_of(new["doc"][gone], new["key"][gone], new["start"][gone], new["start"][gone] + sizes[gone])
        if settled is not None:
            yield _sent(settled.num_rows, pa.array(settled.column("__key").to_numpy() % (1 << bits), pa.int64()), None, settled)
        left = np.flatnonzero(~gone)
        left = left[np.argsort(bucket[left], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[left], prepend=-1, append=-1)) if len(left) else np.zeros(0, np.int64)
        for lo in range(0, max(len(cuts) - 1, 0), 512):
            few = list(zip(cuts[lo : lo + 512], cuts[lo + 1 : lo + 513]))
            blobs = [_pack(new[left[x:y]], gathered(data, at[left[x:y]], sizes[left[x:y]]).tobytes()) for x, y in few]
            yield _sent(len(few), pa.array(bucket[left[[x for x, _ in few]]], pa.int64()), pa.array(blobs, pa.binary()), None)

    return returning(run)


def _sent(n: int, bucket: pa.Array, blob, settled) -> pa.RecordBatch:
    columns = [settled.column(i) for i in range(3)] if settled is not None else [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays([bucket, pa.nulls(n, pa.binary()) if blob is None else blob, *columns], ["bucket", "blob", "__id", "__key", "__spans"])


# -- the suffix sort ------------------------------------------------------------------------------------------------


def common_extension(p: Prefixes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Longest common extension of suffixes at a and b, up to ``length``: a binary search over lengths."""
    found = np.zeros(len(a), np.int64)
    step = 1 << (length.bit_length() - 1)
    while step:
        longer = found + step
        ok = longer <= length
        x, y = a + found, b + found
        h = p.hashes(x, np.where(ok, x + step, x)) == p.hashes(y, np.where(ok, y + step, y))
        found = np.where(ok & h, longer, found)
        step >>= 1
    return found


def compared(p: Prefixes, whole: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """Order of suffixes i and j as -1, 0 or 1. ``whole`` has the hashes of the full length, which settle equality at once."""
    out = np.zeros(len(i), np.int8)
    differ = np.flatnonzero(whole[i] != whole[j])
    if len(differ):
        a, b = pos[i[differ]], pos[j[differ]]
        at = common_extension(p, a, b, length)
        inside = at < length
        x, y = p.data[np.where(inside, a + at, a)].astype(np.int16), p.data[np.where(inside, b + at, b)].astype(np.int16)
        out[differ] = np.where(inside, np.sign(x - y), 0)
    return out


def suffix_sort(p: Prefixes, pos: np.ndarray, segment: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``pos`` in order within each segment (segments are contiguous): a mergesort of all segments at once.

    Runs of 1, 2, 4, ... suffixes are merged in pairs: a suffix's place is its own rank plus its rank in the other run, which a
    binary search by comparisons finds. Also returns the hashes of the full length.
    """
    n = len(pos)
    whole = p.hashes(pos, pos + length)
    order = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])[:n])
    sizes = np.diff(np.append(starts, n))
    base, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    local = np.arange(n) - base
    width = 1
    active = np.flatnonzero(size > width)
    while len(active):
        b, s, r = base[active], size[active], local[active]
        run = r // width
        other = (run ^ 1) * width
        lo, hi = np.minimum(other, s), np.minimum(other + width, s)
        left = run % 2 == 0
        low, high = lo.copy(), hi.copy()
        me = order[active]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            c = compared(p, whole, pos, order[b[open_] + mid], me[open_], length)
            below = np.where(left[open_], c < 0, c <= 0)
            low[open_] = np.where(below, mid + 1, low[open_])
            high[open_] = np.where(below, high[open_], mid)
            open_ = open_[low[open_] < high[open_]]
        target = b + run // 2 * 2 * width + (r - run * width) + (low - lo)
        new = order.copy()
        new[target] = me
        order = new
        width *= 2
        active = active[size[active] > width]
    return order, whole


def smallest_of_equal(p: Prefixes, pos: np.ndarray, segment: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each suffix the smallest document among those of its segment that agree with it for the whole length."""
    order, whole = suffix_sort(p, pos, segment, length)
    a, b = order[:-1], order[1:]
    equal = (segment[a] == segment[b]) & (whole[a] == whole[b])
    if not same_bytes(p.data, pos[a[equal]], pos[b[equal]], length).all():  # a hash lied: sort by the bytes themselves
        window = np.lib.stride_tricks.sliding_window_view(p.data, length)[pos]
        order = np.lexsort((*window.T[::-1], segment))
        a, b = order[:-1], order[1:]
        equal = (segment[a] == segment[b]) & same_bytes(p.data, pos[a], pos[b], length)
    heads = np.flatnonzero(np.concatenate([[True], ~equal])[: len(order)])
    least = np.minimum.reduceat(doc[order], heads) if len(order) else doc
    out = np.zeros(len(order), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return out


def settled_bucket(blobs: list[bytes], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, key, start, end) of what the contexts of a bucket lose."""
    read = []
    for blob in blobs:
        rows, data = _unpack(blob)
        size = rows["size"].astype(np.int64)
        at = np.cumsum(size) - size
        p = Prefixes(data)
        kmer = at + rows["anchor"]
        read.append((rows, data, size, p.hashes(at, at + size), p.hashes(kmer, kmer + anchor)))
    new, data, size, whole, kmer = (np.concatenate(c) for c in zip(*read))
    doc = new["doc"]
    at = np.cumsum(size) - size
    smallest, head = first_of_equal(data, whole, at, size, doc)
    gone = np.flatnonzero(doc > smallest)
    lost = [(gone, np.zeros(len(gone), np.int64), size[gone])]
    heads = np.unique(head)
    heads = heads[np.argsort(kmer[heads], kind="stable")]
    edge = np.flatnonzero(np.concatenate([[True], kmer[heads][1:] != kmer[heads][:-1]]))
    many = np.diff(np.append(edge, len(heads)))
    keep = np.repeat(many > 1, many)
    heads, many = heads[keep], many[many > 1]
    ends = np.cumsum(many)
    strings = np.concatenate([[0], np.cumsum(size[heads] - length + 1)])
    twins = np.flatnonzero(doc == smallest)
    twins = twins[np.argsort(head[twins], kind="stable")]
    lo = 0
    while lo < len(heads):  # whole anchors, about SORTED strings at a time
        enough = int(np.searchsorted(strings, strings[lo] + SORTED))
        hi = int(ends[np.searchsorted(ends, min(max(enough, lo + 1), len(heads)))])
        few = heads[lo:hi]
        p = Prefixes(gathered(data, at[few], size[few]))
        # Strings with their anchor at different places are never equal, so an anchor of very many contexts is sorted place by place.
        places = length - anchor + 1
        step = places if strings[hi] - strings[lo] <= 2 * SORTED else max(1, SORTED // len(few))
        for place in range(0, places, step):
            which, offset = lost_strings(p, size[few], kmer[few], new["anchor"][few].astype(np.int64), doc[few], length, place, place + step)
            # What a context loses, every context equal to it in the same document loses.
            a, b = np.searchsorted(head[twins], few[which]), np.searchsorted(head[twins], few[which], side="right")
            n = b - a
            pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            lost.append((twins[pick], np.repeat(offset, n), np.full(n.sum(), length)))
        lo = hi
    row, offset, width = (np.concatenate(c) for c in zip(*lost))
    start = new["start"][row] + offset
    return doc[row], new["key"][row], start, start + width


def lost_strings(
    p: Prefixes, size: np.ndarray, kmer: np.ndarray, anchor_at: np.ndarray, doc: np.ndarray, length: int, low: int, high: int
) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the strings that a smaller document has too, among contexts lying in ``p.data`` sorted by anchor.

    Only strings whose anchor lies from ``low`` to below ``high`` in them.
    """
    at = np.cumsum(size) - size
    begin = np.maximum(anchor_at - high + 1, 0)
    strings = np.maximum(np.minimum(anchor_at - low, size - length) - begin + 1, 0)
    of = np.repeat(np.arange(len(size)), strings)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings - begin, strings)
    group = np.cumsum(np.concatenate([[0], kmer[1:] != kmer[:-1]]))
    # Equal strings have their anchor at the same place, so they are sorted by (anchor, its place in the string).
    segment = group[of] * length + (anchor_at[of] - offset)
    order = np.argsort(segment, kind="stable")
    seg = segment[order]
    alone = np.ones(len(seg), bool)
    alone[1:] &= seg[1:] != seg[:-1]
    alone[:-1] &= seg[1:] != seg[:-1]
    order = order[~alone]
    of, offset, segment = of[order], offset[order], segment[order]
    least = smallest_of_equal(p, at[of] + offset, segment, doc[of], length)
    hit = least < doc[of]
    return of[hit], offset[hit]


MOST_SPANS = 1 << 17  # spans a task merges at a time


def _settled(length: int, anchor: int):
    names = ["__id", "__key", "__spans"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        lost: list[tuple] = []
        for b in batches:
            done = b.filter(pc.is_null(b.column("blob"))).select(names)
            if done.num_rows:
                yield done
            b = b.filter(pc.is_valid(b.column("blob")))
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
                if bucket != now and held:
                    lost.append(settled_bucket(held, length, anchor))
                    held = []
                    if sum(len(x[0]) for x in lost) >= MOST_SPANS:
                        yield from together(lost)
                        lost = []
                now = bucket
                held.append(blob)
        if held:
            lost.append(settled_bucket(held, length, anchor))
        yield from together(lost)

    def together(lost: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = spans_of(*(np.concatenate(c) for c in zip(*lost))) if lost else None
        if out is not None:
            yield out

    return returning(run)


# -- the operator ---------------------------------------------------------------------------------------------------


def without(text: bytes, spans: np.ndarray, whole_characters: bool) -> tuple[bytes, int, int]:
    """What is left of a text, the number of bytes removed and of maximal removed runs."""
    kept, at, removed, count = [], 0, 0, 0
    for start, end in spans:
        if whole_characters:  # a character goes only with all its bytes
            while start < end and text[start] & 0xC0 == 0x80:
                start += 1
            while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
                end -= 1
        if end > start:
            kept.append(text[at:start])
            at, removed, count = end, removed + end - start, count + 1
    return b"".join([*kept, text[at:]]), removed, count


def merged(blobs: list[bytes]) -> np.ndarray:
    """Spans of one document from several tasks, merged."""
    spans = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def _all_of_it(key_of):
    """Spans of whole texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.stack([np.zeros(b.num_rows, "<i8"), b.column("n").to_numpy().astype("<i8")], axis=1)
            keys = key_of(b.column("__id").to_numpy(), b.column("__key").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(keys), pa.array([e.tobytes() for e in ends], pa.binary())], ["__id", "__key", "__spans"])

    return run


def _ids(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield mixed(b.column("__id").to_numpy().view(U))


def _keyed(rows: DataFrame):
    """``rows`` (__id, __text, others) with ``__key``, and what tells rows of equal ids apart in tasks.

    That is a 64-bit hash of the text where the id is marked as occurring twice, else 0, which takes no room. Should two texts of one id
    share a hash (their 128-bit digests tell), another seed is taken, so that what one row loses never goes to another.
    """
    marks, _, _ = bitmap(rows.select("__id").mapInArrow(packing(_ids), BLOBS))

    @F.pandas_udf("boolean")
    def again(ids: pd.Series) -> pd.Series:
        return pd.Series(marked(mixed(ids.to_numpy().astype(np.int64).view(U)), marks))

    seed, repeated = 0, rows.where(again("__id"))
    while True:
        key = _key(seed)
        digest = F.md5(F.col("__text").cast("binary"))
        texts = repeated.groupBy("__id", key.alias("__key")).agg(F.min(digest).alias("lo"), F.max(digest).alias("hi"))
        if texts.where(F.col("lo") != F.col("hi")).limit(1).count() == 0:
            break
        seed += 1

    def key_of(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return np.where(marked(mixed(ids.astype(np.int64).view(U)), marks), keys, 0).astype(np.int64)

    return rows.withColumn("__key", key), key_of


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce("__text", F.lit("")))


def deduplicated(docs: DataFrame, length: int = 50, anchor: int = ANCHOR, whole_characters: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, any others) with ``kept`` (the bytes left), ``n_bytes``, ``n_removed`` and ``n_spans``.

    ``whole_characters`` keeps a character of which only some bytes would go, so that ``kept`` is valid UTF-8.
    """
    if not 0 < anchor <= length:
        raise ValueError("an anchor must fit into a string")
    small_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("__id")
    keyed, key_of = _keyed(docs.select(row.alias("__row"), ids, F.col("text").alias("__text")))
    keyed_texts = keyed.select("__id", "__key", F.col("__text").alias("text"))
    keyed = keyed.drop("__text")
    long_ = keyed_texts.where(F.octet_length("text") >= length)
    texts, keep, others = first_copies(long_.select("__id", "__key", "text", F.octet_length("text").alias("n")), "__id")
    copies = others.where(F.col("__id") > F.col("first")).select("__id", "__key", "n").mapInArrow(_all_of_it(key_of), SPANS)
    marks, _, n = bitmap(texts.select("text", "text_hash").mapInArrow(_named_anchors(length, anchor, keep), BLOBS))
    bits = min(40, max(6, (n * length // 50 // BUCKET_ANCHORS).bit_length()))
    sent = texts.drop("n").mapInArrow(_contexts(length, anchor, marks, bits, keep, key_of), SENT)
    spans = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settled(length, anchor), SPANS).unionByName(copies)

    @F.pandas_udf("long")
    def final_key(ids: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(key_of(ids.to_numpy(), keys.to_numpy()))

    both = keyed.withColumn("__key", final_key("__id", "__key")).withColumn("__kind", F.lit(1)).unionByName(spans.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    added = [T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ADDED[1:])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, spans_now = None, [], None
        for b in batches:
            ids, keys, kinds = (b.column(c).to_pylist() for c in ("__id", "__key", "__kind"))
            given = b.column("__spans").to_pylist()
            column, rows, out, size = b.column("__row").field("text"), [], [], 0
            for i, here in enumerate(zip(ids, keys)):
                if here != now:
                    now, blobs, spans_now = here, [], None
                if kinds[i] == 0:
                    blobs.append(given[i])
                    continue
                if spans_now is None:
                    spans_now = merged(blobs)
                text = (column[i].as_py() or "").encode()
                kept, removed, count = without(text, spans_now, whole_characters)
                rows.append(i)
                out.append((kept, len(text), removed, count))
                size += len(text)
                if size >= BATCH_BYTES:
                    yield finished(b, rows, out)
                    rows, out, size = [], [], 0
            if rows:
                yield finished(b, rows, out)

    def finished(b: pa.RecordBatch, rows: list[int], out: list[tuple]) -> pa.RecordBatch:
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([b.column("__row").take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(zip(*out), types))], ["__row", *ADDED])

    dealt = both.repartition("__id", "__key").sortWithinPartitions("__id", "__key", "__kind")
    done = dealt.mapInArrow(returning(run), T.StructType([keyed.schema["__row"], *added]))
    kept_names = [c for c in docs.columns if c.lower() not in ADDED]
    return done.select(*[F.col(f"__row.`{c}`") for c in kept_names], *ADDED)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What every document keeps when 50-byte strings of earlier documents go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
