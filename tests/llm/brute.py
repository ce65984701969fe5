"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LAST = (1 << 63) - 1


def shingles(text: str | None, words: int) -> frozenset:
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if 0 < len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def components(rows: list[tuple], words: int, percent: int) -> list[tuple]:
    """(id, size of the set, smallest id of the component) per row."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict[frozenset, int] = {}
    for i, s in enumerate(sets):
        if s and first.setdefault(s, i) != i:
            parent[root(i)] = root(first[s])
    where = defaultdict(list)
    for s, i in first.items():
        for k in s:
            where[k].append(i)
    for s, i in first.items():
        for j, common in Counter(j for k in s for j in where[k] if j < i).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), LAST), LAST if d is None else d)
    named = [(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    return [(d, n, None if c == LAST else c) for d, n, c in named]


def removed(rows: list[tuple], length: int) -> list[bytearray]:
    """A flag per byte of each text: covered by a string that starts in a row with a smaller id."""
    first: dict[bytes, int] = {}
    texts = [((LAST if d is None else d), (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out.append(gone)
    return out


def deduplicated(rows: list[tuple], length: int) -> list[tuple]:
    out = []
    for (d, t), gone in zip(rows, removed(rows, length)):
        kept = bytes(x for x, g in zip((t or "").encode(), gone) if not g)
        out.append((d, len(gone), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def whole_characters(text: str, gone: bytearray) -> str:
    """What is left if a character goes only with all its bytes."""
    out, at = [], 0
    for ch in text:
        n = len(ch.encode())
        if not all(gone[at : at + n]):
            out.append(ch)
        at += n
    return "".join(out)


def ordered(rows) -> list:
    return sorted(map(tuple, rows), key=repr)
