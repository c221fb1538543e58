"""Queries on located posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbours import near_pairs, place
from ..operators.regions import points_in_regions
from ..sources import load

#: Six outlines in Web Mercator metres for the region query (an example input; any table of rings will do).
OUTLINES = [
    (1, [-2.0e7, -1.0e7, -1.0e7, -2.0e7], [0.0, 0.0, 1.2e7, 1.2e7]),
    (2, [-1.0e7, 0.0, -5.0e6], [-1.2e7, -1.2e7, 1.2e7]),
    (3, [0.0, 1.0e7, 1.0e7, 5.0e6, 0.0], [0.0, 0.0, 1.0e7, 5.0e6, 1.0e7]),
    (3, [2.0e6, 4.0e6, 4.0e6, 2.0e6], [1.0e6, 1.0e6, 3.0e6, 3.0e6]),
    (4, [1.0e7, 2.0e7, 2.0e7, 1.0e7], [-1.6e7, -1.6e7, 1.6e7, 1.6e7]),
    (5, [-1.6e7, 1.6e7, 0.0], [-1.6e7, -1.6e7, 1.6e7]),
]


def located(spark: SparkSession, sf: str) -> DataFrame:
    posts = load(spark, sf, "spatial_partition_eval_results")
    return posts.select("id", place(F.col("x"), F.col("y"), F.col("geom")).alias("p"), "cell_length").select("id", "p.x", "p.y", "cell_length")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_pairs(located(spark, sf), "id", "x", "y", "cell_length")


def p1_regions(spark: SparkSession, sf: str) -> DataFrame:
    outlines = spark.createDataFrame(OUTLINES, "region int, xs array<double>, ys array<double>")
    return points_in_regions(located(spark, sf), "id", "x", "y", outlines, "region", "xs", "ys")


QUERIES = {"p1_found": p1_found, "p1_regions": p1_regions}
_PLACES = """
WITH once AS (SELECT DISTINCT id, x, y, geom, cell_length AS r FROM spatial_partition_eval_results WHERE isfinite(cell_length) AND cell_length > 0),
m AS (SELECT *, isfinite(x) AND isfinite(y) AND abs(x) <= 20037508.35 AND abs(y) <= 20037508.35 AS inside,
        regexp_extract(lower(geom), '^\\s*(?:srid\\s*=\\s*(\\d+)\\s*;)?\\s*point\\s*z?\\s*\\(\\s*([-+.0-9e]+)\\s+([-+.0-9e]+)', ['srid', 'a', 'b']) AS g FROM once),
d AS (SELECT id, x, y, r, inside, g.srid AS srid, try_cast(g.a AS DOUBLE) AS a, try_cast(g.b AS DOUBLE) AS b FROM m),
p AS (SELECT id, r,
        CASE WHEN inside THEN x WHEN srid = '4326' THEN 6378137 * radians(a) ELSE a END AS x,
        CASE WHEN inside THEN y WHEN srid = '4326' THEN 6378137 * ln(tan(pi() / 4 + radians(b) / 2)) ELSE b END AS y FROM d),
l AS (SELECT * FROM p WHERE isfinite(x) AND isfinite(y))
"""
_EDGES = ", ".join(f"({r}, {x1!r}, {y1!r}, {x2!r}, {y2!r})" for r, xs, ys in OUTLINES for x1, y1, x2, y2 in zip(xs, ys, xs[1:] + xs[:1], ys[1:] + ys[:1]))
#: Pairs are looked for in a grid of the greatest cell length; a point is inside where the edges at or below it are odd.
ORACLES: dict[str, str] = {
    "p1_found": _PLACES
    + """,
c AS (SELECT *, floor(x / g)::BIGINT AS cx, floor(y / g)::BIGINT AS cy FROM l, (SELECT max(r) AS g FROM l)),
n AS (SELECT id, x, y, r, cx + dx AS cx, cy + dy AS cy FROM c, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy))
SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM c a JOIN n b USING (cx, cy)
WHERE a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= least(a.r, b.r) ** 2
""",
    "p1_regions": _PLACES.replace("WHERE isfinite(cell_length) AND cell_length > 0", "")
    + f""",
e(region, x1, y1, x2, y2) AS (VALUES {_EDGES}),
h AS (SELECT DISTINCT id, region, x, y, x1, y1, x2, y2 FROM l JOIN e ON least(x1, x2) <= x AND x < greatest(x1, x2) AND y1 + (x - x1) * (y2 - y1) / (x2 - x1) <= y)
SELECT DISTINCT id, region FROM (SELECT id, region FROM h GROUP BY id, region, x, y HAVING count(*) % 2 = 1)
""",
}
