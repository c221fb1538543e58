"""The regions that contain each point, by a plane sweep over polygon edges within k-d cells of the map.

An edge goes down the tree of cells with the cells that it meets. Of edges wholly below a cell only their ends matter: where a ring's path under the
cell goes on, the ends of its edges meet and cancel, so a long outline leaves a cell with its own edges and with the few places where the number of
edges below changes between even and odd. Each cell then sweeps its own edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .neighbours import CELL_BITS, CELL_POINTS, SAMPLE_LEAST, _batches, _Cuts, _cuts_of, _finite

#: (point, edge) pairs that are looked at together; metres by which an edge must be off a cell to be left out, far above any rounding.
_AT_ONCE, MARGIN = 1 << 21, 1e-3


def _odd(at: np.ndarray) -> np.ndarray:
    """The places that are there an odd number of times, in order."""
    value, n = np.unique(at, return_counts=True)
    return value[n % 2 == 1]


def pieces(cuts: _Cuts, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cell, edges, turns) of one ring for each cell that it meets or covers in part; ``x1`` < ``x2`` for every edge.

    ``edges`` are numbers of edges that meet the cell, ``turns`` the x from which on the number of edges below the cell is odd, then even, and so on.
    """
    least, most = np.minimum(y1, y2) - MARGIN, np.maximum(y1, y2) + MARGIN
    todo = [(0, -np.inf, np.inf, np.arange(len(x1)), np.zeros(0))]
    while todo:
        node, west, east, edges, turns = todo.pop()
        if not len(edges) and not len(turns):
            continue
        if cuts.child[node] < 0:
            yield int(-1 - cuts.child[node]), edges, turns
            continue
        at, left = cuts.at[node], int(cuts.child[node])
        if cuts.axis[node] == 0:
            before = turns <= at
            todo.append((left, west, at, edges[x1[edges] < at], turns[turns < at]))
            todo.append((left + 1, at, east, edges[x2[edges] > at], np.append(np.full(int(before.sum()) % 2, at), turns[~before])))
        else:
            under = edges[most[edges] < at]
            ends = np.concatenate([turns, np.maximum(x1[under], west), x2[under]])
            todo.append((left, west, east, edges[least[edges] < at], turns))
            todo.append((left + 1, west, east, edges[most[edges] >= at], _odd(ends[ends < east])))


def sweep(px: np.ndarray, py: np.ndarray, region: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, region) for every point inside a region whose edges are given, by even-odd rule.

    A line sweeps from left to right; between two edge ends the set of edges under it stays the same, and a
    point is inside if it has an odd number of the region's edges at or below it.
    """
    up = x1 != x2
    region, x1, y1, x2, y2 = region[up], x1[up], y1[up], x2[up], y2[up]
    swap = x1 > x2
    x1, x2, y1, y2 = np.where(swap, x2, x1), np.where(swap, x1, x2), np.where(swap, y2, y1), np.where(swap, y1, y2)
    order = np.argsort(px, kind="stable")
    stops = np.unique(np.concatenate([x1, x2]))
    slab = np.searchsorted(stops, px[order], "right") - 1
    enter, leave = np.argsort(x1, kind="stable"), np.argsort(x2, kind="stable")
    enter_at, leave_at = x1[enter], x2[leave]
    live: set[int] = set()
    e = f = 0
    points, regions = [], []
    begins = np.flatnonzero(np.diff(slab, prepend=-2))
    for begin, end in zip(begins, np.append(begins[1:], len(slab))):
        if not 0 <= slab[begin] < len(stops) - 1:
            continue
        at = stops[slab[begin]]
        to = np.searchsorted(enter_at, at, "right")
        live.update(enter[e:to].tolist())
        e = max(e, to)
        to = np.searchsorted(leave_at, at, "right")
        live.difference_update(leave[f:to].tolist())
        f = max(f, to)
        if not live:
            continue
        edge = np.fromiter(live, int)
        edge = edge[np.argsort(region[edge], kind="stable")]
        own, first = np.unique(region[edge], return_index=True)
        for cut in np.array_split(order[begin:end], -(-(end - begin) * len(edge) // _AT_ONCE)):
            x, y = px[cut][:, None], py[cut][:, None]
            below = y1[edge] + (x - x1[edge]) * ((y2[edge] - y1[edge]) / (x2[edge] - x1[edge])) <= y
            p, r = np.nonzero(np.add.reduceat(below, first, axis=1, dtype=np.int64) % 2)
            points.append(cut[p])
            regions.append(own[r])
    none = np.zeros(0, np.int64)
    return (np.concatenate(points), np.concatenate(regions)) if points else (none, none)


def points_in_regions(points: DataFrame, id_col: str, x: str, y: str, regions: DataFrame, region_col: str, xs: str, ys: str, *, cell_points: int = CELL_POINTS) -> DataFrame:
    """``(id, region)`` for every point and each region that contains it.

    ``regions`` has a row for each ring: the region's integer id and the parallel coordinate arrays ``xs``, ``ys`` in
    Web Mercator metres; a ring closes itself, several rings of a region count together by the even-odd rule, so a
    ring in another is a hole. A point on a left or lower edge is inside, on a right or upper edge outside. Points
    with a null id or an unusable place, and rings that are null, shorter than three corners, of unequal lengths or
    with a corner that is null or not finite, take no part. Equal rows count once. Other columns are ignored.
    """
    spark = points.sparkSession
    runtime.prepare(spark)
    rows = points.select(F.col(id_col).cast("bigint").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.filter(F.col("id").isNotNull())
    fraction = runtime.sample_fraction(points, SAMPLE_LEAST, 64)
    cuts = _cuts_of(rows, fraction, cell_points, _plane)
    kind = "task bigint, id bigint, kind tinyint, xs array<double>, ys array<double>"
    names = ["task", "id", "kind", "xs", "ys"]

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            i, px, py = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fit = np.isfinite(px) & np.isfinite(py)
            i, px, py = i[fit], px[fit], py[fit]
            point, cell, _ = cuts.cells(_plane(px, py), np.full(len(px), -1.0))
            i, px, py = i[point], px[point], py[point]
            task = (cell.astype(np.int64) << CELL_BITS) + i % cuts.block[cell]
            one = pa.array(np.arange(len(i) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(i), pa.array(np.zeros(len(i), np.int8)), pa.ListArray.from_arrays(one, pa.array(px)), pa.ListArray.from_arrays(one, pa.array(py))], names=names)

    def deal_rings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(len(b)):
                rid = b.column("id")[k].as_py()
                cx, cy = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("xs", "ys"))
                nx, ny = np.roll(cx, -1), np.roll(cy, -1)
                up, swap = cx != nx, cx > nx
                x1, y1, x2, y2 = (np.where(swap, q, p)[up] for p, q in ((cx, nx), (cy, ny), (nx, cx), (ny, cy)))
                out = []
                for cell, edges, turns in pieces(cuts, x1, y1, x2, y2):
                    own = [(1, np.stack([x1[edges], x2[edges]], 1).ravel(), np.stack([y1[edges], y2[edges]], 1).ravel())] if len(edges) else []
                    own += [(2, turns, np.zeros(0))] if len(turns) else []
                    out += [((cell << CELL_BITS) + block, rid, *v) for block in range(cuts.block[cell]) for v in own]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int8(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=names)

    def inside(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches(it, "task"):
            what = t.column("kind").to_numpy()
            dots, lines, turns = (t.filter(pa.array(what == k)).combine_chunks() for k in range(3))
            if not dots.num_rows or dots.num_rows == t.num_rows:
                continue
            px, py = (dots.column(c).combine_chunks().flatten().to_numpy() for c in ("xs", "ys"))
            known = np.unique(np.concatenate([lines.column("id").to_numpy(), turns.column("id").to_numpy()]))
            odd = np.zeros(0, np.int64)  # point x number of regions + region
            if lines.num_rows:
                n = pc.list_value_length(lines.column("xs")).to_numpy() // 2
                ex, ey = (lines.column(c).combine_chunks().flatten().to_numpy().reshape(-1, 2) for c in ("xs", "ys"))
                p, r = sweep(px, py, np.repeat(lines.column("id").to_numpy(), n), ex[:, 0], ey[:, 0], ex[:, 1], ey[:, 1])
                odd = p * len(known) + np.searchsorted(known, r)
            for rid, at in zip(turns.column("id").to_pylist(), turns.column("xs")):
                p = np.flatnonzero(np.searchsorted(at.values.to_numpy(), px, "right") % 2)
                odd = np.setxor1d(odd, p * len(known) + np.searchsorted(known, rid), assume_unique=True)
            if len(odd):
                yield pa.RecordBatch.from_arrays([pa.array(dots.column("id").to_numpy()[odd // len(known)]), pa.array(known[odd % len(known)])], names=["id", "region"])

    corners = lambda c: (F.size(F.col(c)) >= 3) & F.forall(F.col(c), _finite)
    rings = regions.select(F.col(region_col).cast("bigint").alias("id"), F.col(xs).cast("array<double>").alias("xs"), F.col(ys).cast("array<double>").alias("ys"))
    rings = rings.filter(F.col("id").isNotNull() & F.col("xs").isNotNull() & F.col("ys").isNotNull() & (F.size("xs") == F.size("ys"))).filter(corners("xs") & corners("ys")).distinct()
    both = rows.distinct().mapInArrow(deal, kind).unionByName(rings.mapInArrow(deal_rings, kind))
    found = both.repartition("task").sortWithinPartitions("task").mapInArrow(inside, "id bigint, region bigint").distinct()
    return found.select(F.col("id").cast(dict(points.dtypes)[id_col]).alias(id_col), F.col("region").cast(dict(regions.dtypes)[region_col]).alias(region_col))


def _plane(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([x, y], 1)
