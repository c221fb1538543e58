"""Top N items of every group, by a loser-tree merge of sorted runs.

1. Every input partition is sorted by (bucket, group, score down, item) and becomes a run. While it is
   cut into segments by bucket, each group keeps its first N different items of every batch: more of them can't
   be among the N of all, so a group of any size shrinks before it moves.
2. The segments of a bucket meet in one task. A loser tree merges their runs; after N items of a group
   every run seeks, by its table of group starts, to the next group.

The number of buckets follows from the size of the input, so that a bucket stays small at any scale.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime

#: Bytes of input that a bucket stands for; tasks that merge buckets, and rows of an output batch, at most.
BUCKET_BYTES, MOST_TASKS, OUT_ROWS = 2 << 20, 10_000, 50_000


class LoserTree:
    """Merges ``k`` sorted runs: each inner node holds the loser of its match, the root's winner is next.

    ``heads`` are the runs' current keys, None where a run is at its end.
    """

    def __init__(self, heads: list):
        self.heads, self.k = heads, len(heads)
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._enter(leaf)

    def _enter(self, leaf: int) -> None:
        """First entry: wait at the first free node, else play on with the winner."""
        node, winner = (leaf + self.k) >> 1, leaf
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node >>= 1
        self.winner = winner

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y)

    def replay(self, run: int) -> int:
        """The run with the least head, after the head of ``run`` (the last winner) changed."""
        node, winner, heads, losers = (run + self.k) >> 1, run, self.heads, self.losers
        while node > 0:
            other = losers[node]
            x, y = heads[other], heads[winner]
            if x is not None and (y is None or x < y):
                losers[node], winner = winner, other
            node >>= 1
        self.winner = winner
        return winner


def merge_runs(runs: list[tuple[list, list, list, list[int]]], n: int) -> Iterator[tuple]:
    """The first ``n`` different items of each group, as keys (group, -score, item), of runs sorted by them.

    A run is its three key columns and, for each of its rows, the row where the next group begins.
    """
    runs = [r for r in runs if r[0]]
    if not runs:
        return
    at = [0] * len(runs)
    tree = LoserTree([(r[0][0], r[1][0], r[2][0]) for r in runs])
    heads, replay, run = tree.heads, tree.replay, tree.winner
    group, taken = None, set()
    while heads[run] is not None:
        key = heads[run]
        groups, scores, items, nexts = runs[run]
        if key[0] != group:
            group, taken = key[0], set()
        if len(taken) < n and key[2] not in taken:
            taken.add(key[2])
            yield key
        at[run] = k = nexts[at[run]] if len(taken) >= n else at[run] + 1
        heads[run] = (groups[k], scores[k], items[k]) if k < len(groups) else None
        run = replay(run)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Rows where a new combination of the columns begins."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """``(group, item, score, rank)``: the ``n`` items of highest score of every group, rank from 1.

    An item counts once in a group, with its highest score; equal scores are ordered by the UTF-8 bytes of the item.
    Rows with a null group, a null or blank item (nothing but white space) or a score that is null or not finite don't
    count; a group of such rows only is not in the result, an empty input gives an empty result. Other columns are
    ignored. ``group`` must be an integer column.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    spark = rows.sparkSession
    runtime.prepare(spark)
    size = runtime.plan_bytes(rows)
    buckets = max(runtime.shuffle_partitions(spark), 1 if size is None else -(-size // BUCKET_BYTES))
    g, i, s = F.col(group), F.col(item).cast("string"), F.col(score).cast("double")
    blank = F.length(F.translate(i, " \t\r\n", "")) == 0
    fit = g.isNotNull() & i.isNotNull() & ~blank & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    clean = rows.filter(fit).select(g.cast("bigint").alias("g"), i.alias("i"), (s + 0.0).alias("s"))
    run = clean.withColumn("b", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int")).sortWithinPartitions("b", "g", F.desc("s"), "i")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of this partition's run; a bucket's keep their order by ``part``."""
        name, part = uuid.uuid4().hex, 0
        for batch in it:
            if not batch.num_rows:
                continue
            grp = batch.column("g").to_numpy()
            code = pc.dictionary_encode(batch.column("i")).indices.to_numpy()
            own = np.cumsum(np.diff(grp, prepend=grp[0]) != 0)
            kept = np.sort(np.unique(own * (code.max() + 1) + code, return_index=True)[1])  # an item's first row has its highest score
            place = np.arange(len(kept)) - np.searchsorted(own[kept], own[kept])
            batch = batch.take(pa.array(kept[place < n]))
            b = batch.column("b").to_numpy()
            ends = np.append(_starts(b)[1:], len(b)).astype(np.int32)
            offsets = pa.array(np.append(np.int32(0), ends))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("g", "s", "i")]
            yield pa.RecordBatch.from_arrays([pa.array(b[ends - 1]), pa.array([name] * len(ends)), pa.array(np.full(len(ends), part, np.int32)), *lists], names=["b", "run", "part", "g", "s", "i"])
            part += 1

    kind = "b int, run string, part int, g array<bigint>, s array<double>, i array<string>"
    runs = run.mapInArrow(cut, kind).repartition(min(buckets, MOST_TASKS), "b").sortWithinPartitions("b", "run", "part")

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            merging = []
            for parts in held.values():
                grp, sc = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                words = [w for p in parts for w in p[2]]
                ends = np.append(_starts(grp)[1:], len(grp))
                nexts = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) if len(grp) else ends
                merging.append((grp.tolist(), (-sc).tolist(), words, nexts.tolist()))
            rank, last, rows_ = 0, None, []
            for grp, neg, word in merge_runs(merging, n):
                rank = rank + 1 if grp == last else 1
                last = grp
                rows_.append((grp, word, -neg, rank))
                if len(rows_) >= OUT_ROWS:
                    yield _rows(rows_)
                    rows_ = []
            if rows_:
                yield _rows(rows_)

        for batch in it:
            for b, name, g_, s_, i_ in zip(batch.column("b").to_pylist(), batch.column("run").to_pylist(), batch.column("g"), batch.column("s"), batch.column("i")):
                if b != bucket:
                    yield from out()
                    bucket, held = b, {}
                held.setdefault(name, []).append((g_.values.to_numpy(), s_.values.to_numpy(), i_.values.cast(pa.binary()).to_pylist()))
        yield from out()

    def _rows(rows_: list[tuple]) -> pa.RecordBatch:
        g_, w, s_, r = zip(*rows_)
        return pa.RecordBatch.from_arrays([pa.array(g_, pa.int64()), pa.array(w, pa.binary()).cast(pa.string()), pa.array(s_, pa.float64()), pa.array(r, pa.int32())], names=["g", "i", "s", "r"])

    merged = runs.mapInArrow(merge, "g bigint, i string, s double, r int")
    return merged.select(F.col("g").cast(dict(rows.dtypes)[group]).alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").alias("rank"))
