"""Minimum spanning forests by Boruvka rounds, distributed over the cluster.

All edges are ordered by (distance, a, b), so the forest is unique and no round can close a circle. Each task first reduces its own edges to
their forest: an edge that isn't in the forest of a part can't be in that of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime

#: Edges that a task gathers before it reduces them; edges of a contracted graph that one task finishes.
GATHER, FINISH = 1_000_000, 50_000
_EDGE = "ca bigint, cb bigint, distance double, a bigint, b bigint"


def forest(ca: np.ndarray, cb: np.ndarray, distance: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges kept, nodes, root of each node) of the minimum spanning forest of nodes ``ca``-``cb``."""
    nodes, ends = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    order = np.lexsort((b, a, distance))
    u, v = ends[: len(ca)][order], ends[len(ca) :][order]
    label = np.arange(len(nodes))
    kept = np.zeros(len(order), bool)
    live = np.flatnonzero(u != v)
    while len(live):
        x, y = label[u[live]], label[v[live]]
        differ = x != y
        live, x, y = live[differ], x[differ], y[differ]
        if not len(live):
            break
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, x, live)
        np.minimum.at(best, y, live)
        own = np.flatnonzero(best < len(order))
        edge = best[own]
        kept[edge] = True
        p, q = label[u[edge]], label[v[edge]]
        to = np.arange(len(nodes))
        to[own] = np.where(p == own, q, p)
        mutual = (to[to] == np.arange(len(nodes))) & (np.arange(len(nodes)) < to)
        to[mutual] = np.flatnonzero(mutual)
        while True:
            further = to[to]
            if np.array_equal(further, to):
                break
            to = further
        label = to[label]
    return order[kept], nodes, nodes[label]


def _reduce(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in it:
        held.append(batch)
        n += len(batch)
        if n >= GATHER:
            held = [_forest_of(held)]
            n = len(held[0]) if len(held[0]) < GATHER // 2 else 0
    if held:
        yield _forest_of(held)


def _forest_of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches)
    keep, _, _ = forest(*(t.column(k).to_numpy() for k in ("ca", "cb", "distance", "a", "b")))
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in t.take(pa.array(keep)).columns], names=t.column_names)


def _finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of the forest (kind 0) and each node's root (kind 1)."""
    held = [b for b in it if len(b)]
    if not held:
        return
    t = pa.Table.from_batches(held)
    keep, nodes, roots = forest(*(t.column(k).to_numpy() for k in ("ca", "cb", "distance", "a", "b")))
    names = ["kind", "x", "y", "distance"]
    e = t.take(pa.array(keep))
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(keep), np.int8)), e.column("a").combine_chunks(), e.column("b").combine_chunks(), e.column("distance").combine_chunks()], names=names)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(nodes), np.int8)), pa.array(nodes), pa.array(roots), pa.array(np.zeros(len(nodes)))], names=names)


def reduced(edges: DataFrame) -> DataFrame:
    """``edges`` without those that the other edges of their task make superfluous."""
    return edges.mapInArrow(_reduce, _EDGE)


def spanning_forest(edges: DataFrame, finish: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The forest's edges ``(a, b, distance)`` and ``(id, root)`` of every id that has an edge.

    ``edges`` are (a BIGINT, b BIGINT, distance DOUBLE), none null; equal edges count once, loops not at all. A contracted graph of at most
    ``finish`` edges (``FINISH``) is finished by one task; above that, rounds run on the whole cluster until it is smaller.
    """
    finish = FINISH if finish is None else finish
    runtime.prepare(edges.sparkSession)
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("ca"), F.greatest("a", "b").alias("cb"), "distance", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = runtime.cut(reduced(edges))
    label = None
    forests = []
    while live.count() > finish:
        ends = live.select(F.col("ca").alias("c"), F.struct("distance", "a", "b", F.col("cb").alias("to")).alias("e")).unionAll(live.select(F.col("cb").alias("c"), F.struct("distance", "a", "b", F.col("ca").alias("to")).alias("e")))
        best = runtime.cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"))
        forests.append(best.select("a", "b", "distance").distinct())
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        root = best.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"))
        root = runtime.cut(root)
        while True:  # halves the way to the root each time
            up = root.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            further = runtime.cut(root.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            root = further.select("c", "p")
            if not further.filter("moved").limit(1).count():
                break
        label = root.select(F.col("c").alias("id"), F.col("p").alias("root")) if label is None else label.join(root.select(F.col("c").alias("root"), "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        label = runtime.cut(label)
        side = lambda c: root.select(F.col("c").alias(c), F.col("p").alias(f"p{c}"))
        moved = live.join(side("ca"), "ca").join(side("cb"), "cb").filter("pca <> pcb").select(F.col("pca").alias("ca"), F.col("pcb").alias("cb"), "distance", "a", "b")
        live = runtime.cut(reduced(moved.repartition("ca")))
    last = runtime.cut(live.coalesce(1).mapInArrow(_finish, "kind tinyint, x bigint, y bigint, distance double"))
    done = last.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"), "distance")
    for f in forests:
        done = done.unionByName(f)
    ends = last.filter("kind = 1").select(F.col("x").alias("c"), F.col("y").alias("p"))
    if label is None:
        return done, ends.select(F.col("c").alias("id"), F.col("p").alias("root"))
    label = label.join(ends.select(F.col("c").alias("root"), "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
    return done, label
