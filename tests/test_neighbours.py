import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import neighbours as N
from eventide.operators.kdtree import KdTree
from eventide.operators.regions import points_in_regions, sweep


def brute(points):
    return sorted((a[0], b[0]) for a in points for b in points if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= min(a[3], b[3]) ** 2)


def cloud(n, seed=3):
    r = random.Random(seed)
    towns = [(r.uniform(-2e7, 2e7), r.uniform(-1.9e7, 1.9e7)) for _ in range(6)] + [(20037500.0, 0.0), (-20037500.0, 0.0), (0.0, 20037000.0)]
    return [(i, t[0] + r.gauss(0, 90), t[1] + r.gauss(0, 90), float(r.choice([20, 50, 250]))) for i in range(n) for t in [r.choice(towns)]]


@pytest.mark.parametrize("cell_points", [20, 20_000])
def test_pairs_are_brute_force(spark, rows, cell_points):
    p = cloud(900)
    df = spark.createDataFrame(p + p[:50], "id int, a double, b double, r double").withColumn("x", F.lit("clash"))
    assert rows(N.near_pairs(df, "id", "a", "b", "r", cell_points=cell_points)) == sorted(brute(p), key=repr)


def test_many_points_at_one_place(spark, rows):
    p = [(i, 5.0, 5.0, 10.0) for i in range(300)] + [(1000 + i, 1e6 + i, 0.0, 1.5) for i in range(50)]
    df = spark.createDataFrame(p, "id long, x double, y double, r double")
    assert rows(N.near_pairs(df, "id", "x", "y", "r", cell_points=10)) == sorted(brute(p), key=repr)


def test_unusable_rows(spark, rows):
    nan, inf = float("nan"), float("inf")
    p = [(1, 0.0, 0.0, 5.0), (2, 3.0, 4.0, 5.0), (3, nan, 0.0, 5.0), (4, None, 0.0, 5.0), (5, 0.0, 0.0, 0.0), (6, 0.0, 0.0, nan), (7, 0.0, 0.0, inf), (8, 0.0, 0.0, None), (None, 0.0, 0.0, 5.0), (9, 0.0, 0.0, -1.0), (2, 900.0, 4.0, 5.0)]
    df = spark.createDataFrame(p, "id int, x double, y double, r double")
    assert rows(N.near_pairs(df, "id", "x", "y", "r")) == [(1, 2)]
    assert N.near_pairs(df.limit(0), "id", "x", "y", "r").count() == 0
    with pytest.raises(ValueError):
        N.near_pairs(df, "id", "x", "y", "r", metric="cube")


def test_sphere(spark, rows):
    lat, lon = 60.0, 10.0
    metres = [0.0, 400.0, 899.9]
    p = [(i, 6378137 * math.radians(lon), 6378137 * math.log(math.tan(math.pi / 4 + (math.radians(lat) + m / 6378137) / 2)), 500.0) for i, m in enumerate(metres)]
    df = spark.createDataFrame(p, "id int, x double, y double, r double")
    assert rows(N.near_pairs(df, "id", "x", "y", "r", metric="sphere")) == [(0, 1), (1, 2)]
    assert rows(N.near_pairs(df, "id", "x", "y", "r", metric="plane")) == []


@pytest.mark.parametrize(
    "geom, want",
    [
        ("POINT(1 2)", (1.0, 2.0)),
        ("SRID=3857;POINT(-1.5 2e3)", (-1.5, 2000.0)),
        ("srid=3857;point( -1  2 )", (-1.0, 2.0)),
        ("POINT Z (1 2 3)", (1.0, 2.0)),
        ("POINT EMPTY", None),
        ("SRID=3857;POINT EMPTY", None),
        ("", None),
        ("n/a", None),
        (None, None),
        ("SRID=2154;POINT(1 2)", None),
        ("SRID=4326;POINT(10 91)", None),
        ("LINESTRING(1 2, 3 4)", None),
    ],
)
def test_place(spark, geom, want):
    df = spark.createDataFrame([(float("nan"), 1.0, geom)], "x double, y double, g string")
    got = df.select(N.place(F.col("x"), F.col("y"), F.col("g"))).first()[0]
    assert (got and tuple(got)) == want


def test_place_prefers_coordinates(spark):
    df = spark.createDataFrame([(1.0, 2.0, "POINT(5 5)"), (1e30, 2.0, "SRID=4326;POINT(180 0)")], "x double, y double, g string")
    a, b = (tuple(r[0]) for r in df.select(N.place(F.col("x"), F.col("y"), F.col("g"))).collect())
    assert a == (1.0, 2.0) and b == (pytest.approx(20037508.342789), pytest.approx(0.0, abs=1e-6))


def test_tree():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 700):
        p = np.concatenate([r.normal(size=(n, 3)), np.zeros((n // 3, 3))])
        radius = r.uniform(0, 0.7, len(p))
        got = sorted((int(a), int(b)) for q, k in KdTree(p).within(p, radius) for a, b in zip(q, k))
        assert got == [(a, b) for a in range(len(p)) for b in range(len(p)) if np.linalg.norm(p[a] - p[b]) <= radius[a]]


def inside(x, y, rings):
    n = 0
    for xs, ys in rings:
        for k in range(len(xs)):
            x1, y1, x2, y2 = xs[k - 1], ys[k - 1], xs[k], ys[k]
            if min(x1, x2) <= x < max(x1, x2) and y1 + (x - x1) * (y2 - y1) / (x2 - x1) <= y:
                n += 1
    return n % 2 == 1


@pytest.mark.parametrize("cell_points", [100_000, 40, 1])
def test_regions(spark, rows, cell_points):
    r = random.Random(5)
    rings = [(1, [0.0, 1e6, 1e6, 0.0], [0.0, 0.0, 1e6, 1e6]), (1, [2e5, 4e5, 4e5, 2e5], [2e5, 2e5, 4e5, 4e5]), (2, [-1e7, 1e7, 0.0], [-1e7, -1e7, 1.5e7]), (3, [5e5, 9e5, 7e5, 9e5, 5e5], [1e5, 1e5, 5e5, 9e5, 9e5])]
    bad = [(4, [0.0, 1.0], [0.0, 1.0]), (5, None, None), (6, [0.0, None, 1.0], [0.0, 1.0, 1.0]), (None, [0.0, 1.0, 1.0], [0.0, 0.0, 1.0])]
    p = [(i, r.uniform(-2e6, 2e6), r.uniform(-2e6, 2e6)) for i in range(800)] + [(900, 0.0, 0.0), (901, 1e6, 5e5), (902, None, 1.0), (903, float("nan"), 1.0)]
    regions = spark.createDataFrame(rings + bad + rings[:1], "region int, xs array<double>, ys array<double>")
    got = rows(points_in_regions(spark.createDataFrame(p, "id int, x double, y double"), "id", "x", "y", regions, "region", "xs", "ys", cell_points=cell_points))
    want = [(i, k) for i, x, y in p if x == x and x is not None for k in (1, 2, 3) if inside(x, y, [(a, b) for q, a, b in rings if q == k])]
    assert got == sorted(want, key=repr) and (900, 1) in got and (901, 1) not in got
    none = np.zeros(0)
    assert len(sweep(none, none, none.astype(int), none, none, none, none)[0]) == 0


def test_a_long_outline_over_many_cells(spark, rows):
    import math

    n = 100_000
    turn = [2 * math.pi * k / n for k in range(n)]
    ring = [(1e6 + 2e4 * math.cos(40 * t)) for t in turn]
    xs, ys = [d * math.cos(t) for d, t in zip(ring, turn)], [d * math.sin(t) for d, t in zip(ring, turn)]
    r = random.Random(6)
    p = [(i, r.uniform(-1.1e6, 1.1e6), r.uniform(-1.1e6, 1.1e6)) for i in range(2000)]
    regions = spark.createDataFrame([(1, xs, ys)], "region int, xs array<double>, ys array<double>")
    got = points_in_regions(spark.createDataFrame(p, "id int, x double, y double"), "id", "x", "y", regions, "region", "xs", "ys", cell_points=50)
    inner = {i for i, x, y in p if math.hypot(x, y) < 1e6 + 2e4 * math.cos(40 * math.atan2(y, x)) - 1}
    outer = {i for i, x, y in p if math.hypot(x, y) > 1e6 + 2e4 * math.cos(40 * math.atan2(y, x)) + 1}
    found = {x["id"] for x in got.collect()}
    assert inner <= found and not outer & found and len(inner) + len(outer) >= 1990


def test_edges_go_to_the_cells_that_they_meet():
    from eventide.operators.neighbours import _Cuts
    from eventide.operators.regions import pieces

    r = np.random.default_rng(2)
    cuts = _Cuts(r.uniform(0, 1, (4096, 2)), 16, 1.0, 16)
    turn = np.linspace(0, 2 * np.pi, 5001)
    x, y = 0.5 + 0.4 * np.cos(turn), 0.5 + 0.4 * np.sin(turn)
    swap = x[:-1] > x[1:]
    ends = [np.where(swap, b, a) for a, b in ((x[:-1], x[1:]), (y[:-1], y[1:]), (x[1:], x[:-1]), (y[1:], y[:-1]))]
    got = list(pieces(cuts, *ends))
    assert sum(len(e) for _, e, _ in got) < 2.5 * 5000 and max(len(t) for _, _, t in got) <= 4
