"""A bounded table of texts a worker has encoded."""

from __future__ import annotations

from collections.abc import Callable

KEPT, LONGEST_KEPT = 1 << 17, 64


class Known(dict):
    """Ids of chunks or words, as bytes. One that is not there is encoded; short ones are kept until two turn-overs pass without them."""

    def __init__(self, encode: Callable[[str], bytes], kept: int = KEPT):
        super().__init__()
        self.encode, self.kept, self.older = encode, kept, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.encode(text)
        if len(text) <= LONGEST_KEPT:
            if len(self) >= self.kept:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found
