"""Which 64-bit hashes occur twice at least, as a bitmap of fixed size, and how often they occur about.

Tasks pack hashes into blobs by their leading 12 bits (a bucket), the next 24 bits of each, sorted and compressed, about two
bytes a hash. A bucket's blobs meet in one task, which remembers what it has seen in 16 MB, and marks hashes that come again at two
places of the bucket's share of the bitmap; it also counts hashes in 256 slots. Bitmap (2**MARKS bits, 16 MB, less where few are set) and counters
(SLOTS numbers, 4 MB) have their size whatever the input, and are broadcast. A hash that occurs twice is always marked; one
that does not may be, and the more hashes the more often: marks save work, and no result depends on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.batches import give_back, returning

BUCKETS = 4096
MARKS = 27
SLOTS = 1 << 20
BLOBS = "bucket int, blob binary"
FLUSH = 1 << 20  # hashes packed together
U = np.uint64


def packed(h: np.ndarray) -> pa.RecordBatch:
    """Blobs of some hashes: three planes of bytes, the leading one nearly constant in a sorted blob."""
    h = np.sort(h >> U(28))
    cuts = np.searchsorted((h >> U(24)).astype(np.int64), np.arange(BUCKETS + 1))
    planes = h.view(np.uint8).reshape(-1, 8)[:, :3]
    there = np.flatnonzero(np.diff(cuts))
    press = zstandard.ZstdCompressor(level=1).compress
    blobs = [press(planes[cuts[k] : cuts[k + 1]].T.tobytes()) for k in there]
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def packing(hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]]):
    """A task that packs the arrays ``hashes`` gives for a batch, FLUSH at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            for h in hashes(b):
                held.append(h)
                n += len(h)
                if n >= FLUSH:
                    yield packed(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield packed(np.concatenate(held))

    return returning(run)


def _spots(place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of the 24 bits after a bucket's 12 in its share of 2**width bits; halving a share halves the places."""
    low = U((1 << 24) - 1)
    return (place >> U(24 - width)).astype(np.int64), (((place * U(0x9E3779B1)) & low) >> U(24 - width)).astype(np.int64)


def _twice(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << 24, bool)
    bits = np.zeros(1 << (MARKS - 12), bool)
    slots = np.zeros(SLOTS // BUCKETS, np.int64)
    touched: list[np.ndarray] = []
    now, n = None, 0
    read = zstandard.ZstdDecompressor().decompress
    press = zstandard.ZstdCompressor(level=1).compress

    def done() -> Iterator[pa.RecordBatch]:
        if now is not None:
            row = [now], [press(np.packbits(bits, bitorder="little").tobytes())], [press(np.minimum(slots, 0xFFFFFFFF).astype("<u4").tobytes())], [n]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["bucket", "blob", "slots", "n"])

    for b in batches:
        for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
            if bucket != now:
                yield from done()
                if n > len(seen) // 8:
                    seen[:] = False
                else:
                    for t in touched:
                        seen[t] = False
                touched, now, n = [], bucket, 0
                bits[:] = False
                slots[:] = 0
            planes = np.frombuffer(read(blob), np.uint8).reshape(3, -1)
            wide = np.zeros((planes.shape[1], 8), np.uint8)
            wide[:, :3] = planes.T
            place = wide.view(U).ravel()  # ascending, as packed
            for again in (place[1:][place[1:] == place[:-1]], place[seen[place]]):
                for spot in _spots(again, MARKS - 12):
                    bits[spot] = True
            seen[place] = True
            slots += np.bincount((place >> U(16)).astype(np.int64), minlength=len(slots))
            n += len(place)
            if n <= len(seen) // 8:
                touched.append(place)
    yield from done()


def _gathered(shares: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Bits and counters of all buckets, and the number of hashes.

    The shares come compressed and as Arrow batches, which the driver's JVM passes on one task after the other: collected as rows
    they would lie there several times at once, and a heap that has grown for that stays large.
    """
    bits, slots = np.zeros((BUCKETS, (1 << (MARKS - 3)) // BUCKETS), np.uint8), np.zeros((BUCKETS, 4 * SLOTS // BUCKETS), np.uint8)
    read, n = zstandard.ZstdDecompressor().decompress, 0
    for b in shares.toArrow().to_batches():  # at most BUCKETS rows of a fixed size, 20 MB before they are compressed
        for bucket, blob, counts, some in zip(*b.columns):
            bits[bucket.as_py()] = np.frombuffer(read(blob.as_py()), np.uint8)
            slots[bucket.as_py()] = np.frombuffer(read(counts.as_py()), np.uint8)
            n += some.as_py()
    return bits.ravel(), slots.ravel(), n


def bitmap(blobs: DataFrame):
    """A broadcast of the marks of all hashes in ``blobs``, their counters (``slots``), and their number."""
    shares = blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(returning(_twice), f"{BLOBS}, slots binary, n long")
    bits, slots, n = _gathered(shares)
    small = folded(bits)
    del bits
    give_back()
    sent = blobs.sparkSession.sparkContext.broadcast(small)
    del small
    give_back()
    return sent, slots.tobytes(), n


#: For a byte: the four bits that say whether each pair of its bits has any set.
_HALVES = np.array([sum(1 << i for i in range(4) if byte >> 2 * i & 3) for byte in range(256)], np.uint8)


def folded(packed_bits: np.ndarray) -> bytes:
    """The bitmap halved while one bit in 64 at most is set: neighbours share a place from then on."""
    while len(packed_bits) > BUCKETS and sum(int(np.bitwise_count(part).sum(dtype=np.int64)) for part in np.split(packed_bits, 16)) * 64 <= 8 * len(packed_bits):
        half = _HALVES[packed_bits]
        packed_bits = half[::2] | half[1::2] << 4
    return packed_bits.tobytes()


def members(hashes: DataFrame):
    """A broadcast of the marks of every hash in the only column of ``hashes``."""

    def each(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.repeat(b.column(0).to_numpy().view(U), 2)

    return bitmap(hashes.mapInArrow(packing(each), BLOBS))[0]


def marked(h: np.ndarray, marks) -> np.ndarray:
    """Whether each hash is marked."""
    bits = np.frombuffer(marks.value, np.uint8)
    width = (len(bits) * 8 // BUCKETS).bit_length() - 1
    share = (h >> U(52)).astype(np.int64) << width
    found = np.ones(len(h), bool)
    for spot in _spots((h >> U(28)) & U(0xFFFFFF), width):
        at = share + spot
        found &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def often(h: np.ndarray, slots) -> np.ndarray:
    """About how often each hash occurs; never less than it does."""
    return np.frombuffer(slots.value, "<u4")[(h >> U(44)).astype(np.int64)]
