"""Exact byte-pair merges of single words, by the ranks of a public vocabulary."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import regex

#: How a text is split before the merges (fixed value of the byte-level vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that are split at once, and words kept with their ids.
PORTION, KEPT = 1 << 20, 1 << 18
# White space as Unicode defines it; the separators U+001C to U+001F are not among it.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(PATTERN.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))
_SAFE = regex.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")


def split(text: str) -> Iterator[list[str]]:
    """The words of a text, in portions. A single space between other characters always begins a word, so a long text is cut there."""
    lo = 0
    while lo < len(text):
        hi = lo + PORTION
        if hi < len(text):
            cut = _SAFE.search(text, hi)
            hi = cut.start() if cut else len(text)
        yield _SPLIT.findall(text if lo == 0 and hi >= len(text) else text[lo:hi])
        lo = hi


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


class Merger:
    """Merges the bytes of a word, always the pair of least rank (of equal ones the first), until none is left."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.ids = lru_cache(KEPT)(self._ids)

    def __call__(self, word: bytes) -> tuple[int, ...]:
        return self.ids(word) if len(word) <= 64 else self._ids(word)

    def _ids(self, word: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return (whole,)
        n = len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        end = list(range(1, n + 1))
        while heap:
            rank, i, j = heapq.heappop(heap)
            if part[i] is None or j >= n or part[j] is None or after[i] != j or ranks.get(part[i] + part[j]) != rank:
                continue
            part[i] += part[j]
            part[j] = None
            end[i] = end[j]
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = ranks.get(part[i] + part[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, k))
            p = before[i]
            if p >= 0:
                r = ranks.get(part[p] + part[i])
                if r is not None:
                    heapq.heappush(heap, (r, p, i))
        return tuple(ranks[p] for p in part if p is not None)
