"""Sets of word shingles as arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tidemark.llm.rolling import U, mixed

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PIECE = 1 << 18
_GAP = b" "


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            back = max(text.rfind(c, at, end) for c in b" \t\n\v\f\r")
            if back <= at:  # one word longer than a piece
                ends = [x for x in (text.find(c, end) for c in b" \t\n\v\f\r") if x >= 0]
                back = min(ends, default=len(text))
            end = back
        yield text[at:end]
        at = end


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word: the sum of a random number for each byte and its place in the word.

    Unlike a polynomial modulo 2**64, for which any two words built like Thue-Morse sequences collide, sums of mixed numbers have no
    pairs of texts that collide by their form.
    """
    size = end - start
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    place = at - np.repeat(start, size)
    salted = mixed((place.astype(U) << U(8)) | data[at])
    sums = np.concatenate([np.zeros(1, U), np.cumsum(salted, dtype=U)])
    ends = np.cumsum(size)
    return mixed(sums[ends] - sums[ends - size] + size.astype(U))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text.

    A-Z become lower case; words are runs of bytes other than 0x20 and 0x09-0x0D, which splits UTF-8 as it splits characters.
    """
    counts = np.zeros(len(texts), np.int64)
    out, held, owner, size = [], [], [], 0

    def flush() -> None:
        data = np.frombuffer(_GAP.join([*held, b""]), np.uint8)
        inside = np.concatenate([[False], ~SPACES[data], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        begins = np.cumsum([0] + [len(h) + 1 for h in held[:-1]])
        of = np.array(owner)[np.searchsorted(begins, start, side="right") - 1] if len(start) else np.zeros(0, np.int64)
        np.add.at(counts, of, 1)
        out.append(_words(data, start, end))

    for i, text in enumerate(texts):
        for part in _cut((text or "").encode().lower()):  # bytes.lower touches A-Z alone
            held.append(part)
            owner.append(i)
            size += len(part) + 1
            if size >= PIECE:
                flush()
                held, owner, size = [], [], 0
    if held:
        flush()
    return (np.concatenate(out) if out else np.zeros(0, U)), counts


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, one text after the other, and their numbers.

    A shingle is ``words`` neighbouring words; a text with fewer has its whole sequence as its only one; one without words has none.
    """
    h, n = word_hashes(texts)
    first = np.cumsum(n) - n
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
    length = np.minimum(n, words)[of]
    value = length.astype(U)  # sequences of different lengths never meet
    for k in range(words):
        more = k < length
        step = value * U(0x9E3779B97F4A7C15) + h[np.where(more, at + k, 0)] if len(h) else value
        value = np.where(more, step, value)
    value = mixed(value)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[fresh], np.bincount(of[fresh], minlength=len(texts))


def sliced(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a megabyte together."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
