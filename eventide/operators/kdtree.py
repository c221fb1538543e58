"""A k-d tree in flat numpy arrays; all queries walk it together, level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points in a bucket of the tree, at most, unless more of them coincide.
BUCKET = 12
#: (query, node) or (query, point) pairs that are held at once.
AT_ONCE = 1 << 20


class KdTree:
    """Balanced tree over ``points`` (n, k): every node halves its points along its widest side."""

    def __init__(self, points: np.ndarray, bucket: int = BUCKET):
        n = len(points)
        order = np.arange(n)
        starts, ends = [np.array([0])], [np.array([n])]
        depth = max(0, int(np.ceil(np.log2(max(1, n / bucket)))))
        for _ in range(depth):
            s, e = starts[-1], ends[-1]
            low, high = self._boxes(points[order], s, e)
            axis = np.argmax(high - low, axis=1)
            node = np.repeat(np.arange(len(s)), e - s)
            value = points[order, axis[node]]
            order = order[np.lexsort((value, node))]
            mid = (s + e) // 2
            starts.append(np.stack([s, mid], 1).ravel())
            ends.append(np.stack([mid, e], 1).ravel())
        self.points, self.order, self.starts, self.ends = points[order], order, starts, ends
        self.boxes = [self._boxes(self.points, s, e) for s, e in zip(starts, ends)]

    @staticmethod
    def _boxes(points: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full((len(s), points.shape[1]), np.inf), np.full((len(s), points.shape[1]), -np.inf)
        full = e > s
        if full.any():
            low[full] = np.minimum.reduceat(points, s[full], axis=0)
            high[full] = np.maximum.reduceat(points, s[full], axis=0)
        return low, high

    def within(self, queries: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of (query, point) indices with a distance of at most the query's radius.

        At most about ``AT_ONCE`` pairs are held, however many points coincide.
        """
        step = AT_ONCE >> 4
        todo = [(np.arange(i, min(i + step, len(queries))), np.zeros(min(step, len(queries) - i), int), 0) for i in range(0, len(queries), step)][::-1]
        while todo:
            query, node, level = todo.pop()
            low, high = self.boxes[level]
            gap = np.maximum(np.maximum(low[node] - queries[query], queries[query] - high[node]), 0)
            near = np.einsum("ij,ij->i", gap, gap) <= radius[query] ** 2
            query, node = query[near], node[near]
            if not len(query):
                continue
            if level + 1 < len(self.starts):
                query, node = np.repeat(query, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()
                parts = -(-len(query) // AT_ONCE)
                todo += [(q, m, level + 1) for q, m in zip(np.array_split(query, parts), np.array_split(node, parts))]
                continue
            count = self.ends[level][node] - self.starts[level][node]
            for cut in np.split(np.arange(len(query)), np.flatnonzero(np.diff(np.cumsum(count) // AT_ONCE)) + 1):
                own = count[cut]
                q = np.repeat(query[cut], own)
                p = np.repeat(self.starts[level][node[cut]] - np.cumsum(own) + own, own) + np.arange(own.sum())
                gap = self.points[p] - queries[q]
                near = np.einsum("ij,ij->i", gap, gap) <= radius[q] ** 2
                if near.any():
                    yield q[near], self.order[p[near]]
