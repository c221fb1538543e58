"""Points near other points, and points in regions, on the sphere or in the Web Mercator plane.

Places become unit vectors in three dimensions. A k-d tree over a sample of them cuts space into
cells of about equal load; every point goes to its home cell and, as a halo copy, to each cell that its
own search ball touches. Within a cell a local k-d tree finds the candidates by chord radius, and the
distance asked for decides. A pair is given only in the home cell of its smaller id, so no pair comes twice
and no pass for distinct pairs is needed.

The sample only places the cuts; all points take part. A cell that can't be cut (many points at one
place) is dealt as a square of blocks, so that no task holds more than a bounded share of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import runtime
from .kdtree import KdTree

#: Radius of the sphere of Web Mercator (fixed value), metres.
EARTH_R = 6378137.0
#: Half the side of the Web Mercator square (fixed value), metres.
MERCATOR_MAX = 20037508.35
#: Points aimed at in a cell, and samples that stand for a cell.
CELL_POINTS, CELL_SAMPLES = 20_000, 24
#: Bounds of the sample that places the cuts.
SAMPLE_LEAST, SAMPLE_MOST = 20_000, 1_000_000
#: Bits of a task's number for the block within its cell.
CELL_BITS = 40
_NUMBER = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
_POINT = rf"(?i)^\s*(?:SRID\s*=\s*(\d+)\s*;)?\s*POINT\s*(?:Z|M|ZM)?\s*\(\s*{_NUMBER}\s+{_NUMBER}(?:\s+{_NUMBER})*\s*\)\s*$"


def mercator_x(lon: Column) -> Column:
    return F.lit(EARTH_R) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    """NULL at and beyond the poles, where the projection has no value."""
    return F.when(F.abs(lat) < 90, F.lit(EARTH_R) * F.log(F.tan(F.lit(np.pi / 4) + F.radians(lat) / 2)))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def place(x: Column, y: Column, geom: Column) -> Column:
    """STRUCT(x, y) in Web Mercator metres, or NULL where there is no usable place.

    (x, y) counts if both are finite and within the Web Mercator square; otherwise the point written in ``geom``
    (WKT or EWKT, any case, Z and M ignored; no SRID or 3857: metres, 4326: degrees, longitude first).
    Empty, damaged and other geometries and other SRIDs give no place.
    """
    inside = _finite(x) & _finite(y) & (F.abs(x) <= MERCATOR_MAX) & (F.abs(y) <= MERCATOR_MAX)
    srid = F.regexp_extract(geom, _POINT, 1)
    a, b = (F.regexp_extract(geom, _POINT, i).try_cast("double") for i in (2, 3))
    degrees = srid == "4326"
    gx, gy = F.when(degrees, mercator_x(a)).otherwise(a), F.when(degrees, mercator_y(b)).otherwise(b)
    known = srid.isin("", "3857", "4326") & _finite(gx) & _finite(gy)
    return F.when(inside, F.struct(x.alias("x"), y.alias("y"))).when(known, F.struct(gx.alias("x"), gy.alias("y")))


def _vectors(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unit vectors of Web Mercator places."""
    lon, c = x / EARTH_R, 1 / np.cosh(y / EARTH_R)
    return np.stack([c * np.cos(lon), c * np.sin(lon), np.tanh(y / EARTH_R)], 1)


def _chord_of_plane(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Chord that no place within ``r`` metres in the plane exceeds: the map shrinks by cosh(y / R) at least at the side towards the equator."""
    arc = r / EARTH_R / np.cosh(np.maximum(np.abs(y) - r, 0) / EARTH_R)
    return np.minimum(arc * (1 + 1e-9) + 1e-12, 2.0)


def _chord_of_sphere(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    return 2 * np.sin(np.minimum(r / EARTH_R, np.pi) / 2) * (1 + 1e-9) + 1e-12


class _Cuts:
    """The k-d splits: flat arrays, small enough to travel with the tasks (a node per ``CELL_SAMPLES`` samples)."""

    def __init__(self, sample: np.ndarray, cell_samples: int, weight: float, cell_points: int):
        self.axis, self.at, self.child, self.block = [], [], [], []
        self.depth = 0
        cells = 0
        todo = [(self._node(), np.arange(len(sample)), 0)]
        while todo:
            node, own, depth = todo.pop()
            self.depth = max(self.depth, depth)
            v = sample[own]
            spread = v.max(0) - v.min(0) if len(own) else np.zeros(v.shape[1])
            if len(own) > cell_samples and spread.max() > 0:
                k = int(np.argmax(spread))
                s = np.sort(v[:, k])
                at = s[len(s) // 2]
                if at == s[0]:
                    at = s[np.searchsorted(s, at, "right")]
                left, right = self._node(), self._node()
                self.axis[node], self.at[node], self.child[node] = k, at, left
                todo += [(left, own[v[:, k] < at], depth + 1), (right, own[v[:, k] >= at], depth + 1)]
            else:
                self.child[node] = -1 - cells
                cells += 1
                self.block.append(max(1, int(np.ceil(len(own) * weight / (4 * cell_points)))))
        self.axis, self.at, self.child, self.block = map(np.asarray, (self.axis, self.at, self.child, self.block))

    def _node(self) -> int:
        for a, x in ((self.axis, 0), (self.at, 0.0), (self.child, 0)):
            a.append(x)
        return len(self.axis) - 1

    def cells(self, v: np.ndarray, chord: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, cell, home): the home cell of each point and the others that its ball touches."""
        point, node, home = np.arange(len(v)), np.zeros(len(v), int), np.ones(len(v), bool)
        done = []
        while len(point):
            end = self.child[node] < 0
            if end.any():
                done.append((point[end], -1 - self.child[node[end]], home[end]))
                point, node, home = point[~end], node[~end], home[~end]
                continue
            value, at, left = v[point, self.axis[node]], self.at[node], self.child[node]
            own = np.where(value < at, left, left + 1)
            other = np.flatnonzero(np.where(value < at, value + chord[point] >= at, value - chord[point] <= at))
            side = np.where(value < at, left + 1, left)[other]
            point, node, home = np.concatenate([point, point[other]]), np.concatenate([own, side]), np.concatenate([home, np.zeros(len(other), bool)])
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (point, node, home)


def _cuts_of(rows: DataFrame, fraction: float, cell_points: int, space=_vectors) -> _Cuts:
    drawn = rows.select("x", "y").sample(fraction, seed=7).toPandas()
    x, y = drawn["x"].to_numpy(float), drawn["y"].to_numpy(float)
    fit = np.isfinite(x) & np.isfinite(y)
    return _Cuts(space(x[fit], y[fit]), max(1, int(cell_points * fraction)), 1 / fraction, cell_points)


def _batches(it: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each run of equal ``key``, of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        ends = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))
        start = 0
        for end in ends:
            if held and held[0].column(key)[0].as_py() != k[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield pa.Table.from_batches(held)


def near_pairs(points: DataFrame, id_col: str, x: str, y: str, radius: str, *, metric: str = "plane", cell_points: int = CELL_POINTS) -> DataFrame:
    """All pairs ``(id_a, id_b)``, ``id_a < id_b``, of points no further apart than the radius of both.

    ``x``, ``y`` are Web Mercator metres; ``metric`` is "plane" (straight line in the plane) or "sphere" (great
    circle, metres). Rows with a null id, a place that is null or not finite, or a radius that isn't finite and above 0
    are in no pair. An id counts once: of several different rows of one id the least (x, y, radius) counts. Other
    columns of the input are ignored, an empty input gives an empty result; ties with the limit are
    included. Ids must be integers.
    """
    spark = points.sparkSession
    runtime.prepare(spark)
    if metric not in ("plane", "sphere"):
        raise ValueError("metric is 'plane' or 'sphere'")
    chord_of = _chord_of_plane if metric == "plane" else _chord_of_sphere
    cx, cy, cr = (F.col(c).cast("double") for c in (x, y, radius))
    kind = dict(points.dtypes)[id_col]
    rows = points.select(F.col(id_col).cast("bigint").alias("id"), cx.alias("x"), cy.alias("y"), cr.alias("r"))
    # places are judged after the projection that makes them: pushed below it, a filter would repeat the parsing
    rows = rows.filter(F.col("id").isNotNull() & _finite(F.col("r")) & (F.col("r") > 0))

    fraction = runtime.sample_fraction(points, SAMPLE_LEAST, 64)
    if fraction < 1:  # more samples where one stands for more than a fitting part of a cell
        fraction = min(1.0, fraction * min(SAMPLE_MOST / SAMPLE_LEAST, max(1.0, CELL_SAMPLES / fraction / cell_points)))
    cuts = _cuts_of(rows, fraction, cell_points)

    usable = _finite(F.col("x")) & _finite(F.col("y"))
    once = rows.groupBy("id").agg(F.min(F.when(usable, F.struct("x", "y", "r"))).alias("p")).filter("p IS NOT NULL").select("id", "p.x", "p.y", "p.r")

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            i, px, py, pr = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            point, cell, home = cuts.cells(_vectors(px, py), chord_of(py, pr))
            side = cuts.block[cell]
            task, ask, give = cell.astype(np.int64) << CELL_BITS, home, np.ones(len(cell), bool)
            many = side > 1
            if many.any():  # a square of blocks: asked in one row of them, given in one column
                s = side[many]
                own = ((i[point[many]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % s
                k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                p, base, at, was, s = (np.repeat(z, s) for z in (point[many], task[many], own, home[many], s))
                rest = ~(was & (k == at))
                task = np.concatenate([task[~many], (base + at * s + k)[was], (base + k * s + at)[rest]])
                ask = np.concatenate([home[~many], np.ones(was.sum(), bool), np.zeros(rest.sum(), bool)])
                give = np.concatenate([give[~many], (k == at)[was], np.ones(rest.sum(), bool)])
                point = np.concatenate([point[~many], p[was], p[rest]])
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in (task, ask, give, i[point], px[point], py[point], pr[point])], names=["task", "ask", "give", "id", "x", "y", "r"])

    dealt = once.mapInArrow(deal, "task bigint, ask boolean, give boolean, id bigint, x double, y double, r double")

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _batches(it, "task"):
            _, ask, give, i, px, py, pr = (c.to_numpy() for c in t.columns)
            v = _vectors(px, py)
            a, g = np.flatnonzero(ask), np.flatnonzero(give)
            tree = KdTree(v[g])
            for q, p in tree.within(v[a], chord_of(py[a], pr[a])):
                q, p = a[q], g[p]
                keep = i[q] < i[p]
                q, p = q[keep], p[keep]
                least = np.minimum(pr[q], pr[p])
                if metric == "plane":
                    keep = (px[q] - px[p]) ** 2 + (py[q] - py[p]) ** 2 <= least**2
                else:
                    keep = 2 * EARTH_R * np.arcsin(np.minimum(1, np.linalg.norm(v[q] - v[p], axis=1) / 2)) <= least
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(i[q[keep]]), pa.array(i[p[keep]])], names=["id_a", "id_b"])

    pairs = dealt.repartition("task").sortWithinPartitions("task").mapInArrow(join, "id_a bigint, id_b bigint")
    return pairs.select(F.col("id_a").cast(kind).alias("id_a"), F.col("id_b").cast(kind).alias("id_b"))
