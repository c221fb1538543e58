"""A minimal acyclic transducer from words to token ids.

Words with a common prefix share states from the front, words with a common suffix from the back. Each edge carries the number of
words that come before those behind it, so the sum along a path is the word's number, and this finds its ids in a
table. The arrays lie in one file that all workers of a machine map into memory.
"""

from __future__ import annotations

import io

import numpy as np

_PARTS = ("key", "to", "add", "final", "first", "ids")


class Lexicon:
    """``key`` holds state * 256 + byte of every edge, ascending; ``to`` and ``add`` its target and count; ``final`` marks end states."""

    def __init__(self, key, to, add, final, first, ids):
        self.key, self.to, self.add, self.final, self.first, self.ids = key, to, add, final, first, ids

    @staticmethod
    def build(words: list[bytes], ids: list[list[int]]) -> "Lexicon":
        """From distinct words in ascending order, with the ids of each."""
        register: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # open states: final, edges [byte, target]
        done: list[tuple] = []

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                state = (final, tuple(edges))
                number = register.get(state)
                if number is None:
                    number = register[state] = len(done)
                    done.append(state)
                path[-1][1][-1] = (path[-1][1][-1][0], number)

        before = b""
        for word in words:
            same = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            close(same)
            for byte in word[same:]:
                path[-1][1].append((byte, -1))
                path.append([False, []])
            path[-1][0] = True
            before = word
        close(0)
        done.append((path[0][0], tuple(path[0][1])))
        reach = []
        key, to, add = [], [], []
        for number, (final, edges) in enumerate(done):  # targets come before their sources
            n = int(final)
            for byte, target in edges:
                key.append(number * 256 + byte)
                to.append(target)
                add.append(n)
                n += reach[target]
            reach.append(n)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return Lexicon(np.asarray(key, np.int64), np.asarray(to, np.int32), np.asarray(add, np.int32), np.asarray([f for f, _ in done], bool), np.append(0, np.cumsum(size)).astype(np.int64), np.fromiter((i for own in ids for i in own), np.int32, int(size.sum())))

    def number(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1 where it isn't listed; all words walk the automaton together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        found = np.full(len(words), -1, np.int64)
        on = np.arange(len(words)) if len(self.final) else np.zeros(0, np.int64)
        state, count, depth = np.full(len(on), len(self.final) - 1, np.int64), np.zeros(len(on), np.int64), 0
        while len(on):
            end = size[on] == depth
            if end.any():
                own = end & self.final[state]
                found[on[own]] = count[own]
                on, state, count = on[~end], state[~end], count[~end]
            if not len(on) or not len(self.key):
                break
            key = state * 256 + data[first[on] + depth]
            edge = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            go = self.key[edge] == key
            on, edge = on[go], edge[go]
            state, count = self.to[edge].astype(np.int64), count[go] + self.add[edge]
            depth += 1
        return found

    def to_bytes(self) -> bytes:
        """A header of lengths and the arrays, each at a multiple of 64 bytes."""
        parts = [np.ascontiguousarray(getattr(self, p)) for p in _PARTS]
        out = io.BytesIO()
        out.write(np.array([p.size for p in parts], np.int64).tobytes().ljust(64, b"\0"))
        for p in parts:
            out.write(p.tobytes().ljust(-(-p.nbytes // 64) * 64, b"\0"))
        return out.getvalue()

    @staticmethod
    def mapped(path: str) -> "Lexicon":
        """The lexicon in a file, mapped into memory."""
        whole = np.memmap(path, np.uint8, "r")
        sizes = whole[: 8 * len(_PARTS)].view(np.int64)
        at, parts = 64, []
        for n, kind in zip(sizes.tolist(), (np.int64, np.int32, np.int32, bool, np.int64, np.int32)):
            length = n * np.dtype(kind).itemsize
            parts.append(whole[at : at + length].view(kind))
            at += -(-length // 64) * 64
        return Lexicon(*parts)
