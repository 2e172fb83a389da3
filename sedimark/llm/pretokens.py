r"""Splitting text as ``PATTERN`` of the byte-level vocabularies does.

A text is cut into chunks, each an optional run of white space and the run of other
characters after it. No match of the pattern spans two chunks, and how a chunk splits
doesn't depend on its neighbours: only ``\s+(?!\S)`` looks ahead, and it never looks past
the chunk. So whatever is computed from a chunk can be cached by the chunk.
"""

from __future__ import annotations

import re

import regex

#: The characters with the Unicode property White_Space.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Longer chunks are not kept in caches.
CACHED_CHARS = 48


def splitter(pattern: str) -> regex.Pattern:
    """Compile a split pattern with white space as Unicode defines it."""
    spelled = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    return regex.compile(spelled)


class ChunkCache(dict):
    """Chunk to result, filled on demand.

    At ``most`` entries a new generation begins; the one before serves until the next, so
    that frequent chunks stay and at most twice ``most`` entries are held.
    """

    def __init__(self, work, most: int):
        super().__init__()
        self.work, self.most, self.older = work, most, {}

    def __missing__(self, chunk: str):
        out = self.older.get(chunk)
        if out is None:
            out = self.work(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[chunk] = out
        return out
