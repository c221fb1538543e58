from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from eventide.functions import register
from eventide.operators import grid as G

M, H = (lambda n: timedelta(minutes=n)), (lambda n: timedelta(hours=n))


def at(s):
    return datetime.fromisoformat(s)


@pytest.mark.parametrize(
    "ts, length, shift, start, end",
    [
        ("2025-01-01 00:00", M(15), None, "2025-01-01 00:00", "2025-01-01 00:15"),
        ("2025-01-01 00:00", M(15), M(10), "2024-12-31 23:55", "2025-01-01 00:10"),
        ("2025-01-01 00:00", M(15), M(-10), "2024-12-31 23:50", "2025-01-01 00:05"),
        ("2025-01-01 01:10", M(30), None, "2025-01-01 01:00", "2025-01-01 01:30"),
        ("2025-01-01 23:59:59", M(15), None, "2025-01-01 23:45", "2025-01-02 00:00"),
        ("2025-01-01 23:30", H(12), None, "2025-01-01 12:00", "2025-01-02 00:00"),
        ("1969-12-31 23:59", M(30), None, "1969-12-31 23:30", "1970-01-01 00:00"),
    ],
)
def test_period(spark, ts, length, shift, start, end):
    df = spark.createDataFrame([(at(ts),)], "ts timestamp_ntz")
    assert tuple(df.select(G.time_partition(F.col("ts"), length, shift)).first()[0]) == (at(start), at(end))
    register(spark)
    df.createOrReplaceTempView("one")
    i = lambda d: f"INTERVAL '{int(d.total_seconds())}' SECOND"
    sql = f"SELECT time_partition(ts, {i(length)}{', ' + i(shift) if shift is not None else ''}) FROM one"
    assert tuple(spark.sql(sql).first()[0]) == (at(start), at(end))


def test_null_time(spark):
    assert tuple(spark.createDataFrame([(None,)], "ts timestamp_ntz").select(G.time_partition(F.col("ts"), M(15))).first()[0]) == (None, None)


@pytest.mark.parametrize("length, shift", [(None, None), (M(0), None), (timedelta(seconds=20), None), (H(25), None), (H(7), None), (M(90), None), (M(15), M(15)), (M(15), M(20)), (M(15), M(-15)), (M(15), M(-20))])
def test_bad_periods(spark, length, shift):
    with pytest.raises(ValueError):
        G.time_partition(F.lit(None).cast("timestamp_ntz"), length, shift)


def test_good_lengths():
    G.check_period(M(120), None)
    G.check_period(M(15), M(-10))


@pytest.mark.parametrize("args, said", [("NULL", "needs a length"), ("INTERVAL '90' MINUTE", "hours does not divide"), ("INTERVAL '7' MINUTE", "minutes does not divide"), ("INTERVAL '20' SECOND", "from one minute"), ("INTERVAL '15' MINUTE, INTERVAL '-15' MINUTE", "shorter than the period")])
def test_bad_period_in_sql(spark, args, said):
    register(spark)
    with pytest.raises(PySparkException, match=said):
        spark.sql(f"SELECT time_partition(TIMESTAMP_NTZ '2025-01-01 00:00:00', {args})").collect()


@pytest.mark.parametrize(
    "x, y, cell, shift, want",
    [
        (1500.0, -200.0, 1000, (0, 0), (1, -1)),
        (4812345.25, 2210987.75, 1000, (0, 0), (4812, 2210)),
        (4812345.25, 2210987.75, 1000, (500, 500), (4811, 2210)),
        (4812345.25, 2210987.75, 1000, (-500, -500), (4812, 2211)),
        (-3141592.65, -1618033.99, 100000, (0, 0), (-32, -17)),
        (6712345.67, 3345678.91, 500000, (0, 0), (13, 6)),
        (4812345.25, 2210987.75, 1500.5, (None, None), (3207, 1473)),
        (4812345.25, 2210987.75, 1e12, (0, 0), (0, 0)),
        (None, 5.0, 10, (0, 0), (None, 0)),
    ],
)
def test_cell(spark, x, y, cell, shift, want):
    df = spark.createDataFrame([(x, y)], "x double, y double")
    assert tuple(df.select(G.spatial_partition(F.col("x"), F.col("y"), cell, *shift)).first()[0]) == want
    register(spark)
    df.createOrReplaceTempView("one")
    s = ", ".join("NULL" if v is None else f"{v}D" for v in shift)
    assert tuple(spark.sql(f"SELECT spatial_partition(x, y, {float(cell)!r}D, {s}) FROM one").first()[0]) == want


@pytest.mark.parametrize("cell", [0, -1000, None, float("nan"), float("inf")])
def test_bad_cells(spark, cell):
    df = spark.createDataFrame([(1.0, 2.0, cell if cell is None else float(cell))], "x double, y double, c double")
    with pytest.raises(ValueError):
        G.spatial_partition(F.col("x"), F.col("y"), cell)
    with pytest.raises(PySparkException):
        df.select(G.spatial_partition(F.col("x"), F.col("y"), F.col("c"))).collect()
    assert df.select(G.spatial_partition(F.col("x"), F.col("y"), F.col("c"), on_invalid="null")).first()[0] is None


def test_bad_coordinates(spark):
    for x, cell in ((float("nan"), 10.0), (float("inf"), 10.0), (4433432.3, 1e-6)):
        df = spark.createDataFrame([(x, 0.0)], "x double, y double")
        with pytest.raises(PySparkException):
            df.select(G.spatial_partition(F.col("x"), F.col("y"), cell)).collect()
        assert tuple(df.select(G.spatial_partition(F.col("x"), F.col("y"), cell, on_invalid="null")).first()[0]) == (None, 0)


def test_squares(spark, rows):
    df = spark.createDataFrame([(1, 500.0, 500.0), (2, 1000.0, 500.0), (3, 1000.0, 2000.0), (4, None, 1.0), (5, float("nan"), 1.0)], "id int, x double, y double")
    got = G.grid_join(df, "x", "y", 1000.0)
    assert rows(got.groupBy("id").count()) == [(1, 1), (2, 2), (3, 4)]


def test_mercator(spark):
    df = spark.createDataFrame([(0.0, 0.0), (180.0, 45.0), (10.0, 90.0)], "lon double, lat double")
    a, b, c = (r[0] for r in df.select(G.to_web_mercator(F.col("lon"), F.col("lat"))).collect())
    assert tuple(a) == (0.0, pytest.approx(0.0, abs=1e-8)) and tuple(b) == (pytest.approx(20037508.342789244), pytest.approx(5621521.486192066)) and c["y"] is None


def test_no_python_and_pushed_filters(spark, tmp_path):
    spark.range(10).selectExpr("id", "double(id) x", "double(id) y", "timestamp_ntz '2025-01-01 00:00:00' ts", "string(id) unused").write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p").filter("x > 3")
    out = df.groupBy(G.time_partition(F.col("ts"), M(15)).alias("p"), G.spatial_partition(F.col("x"), F.col("y"), 2.0).alias("c")).count()
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "GreaterThan(x,3.0)" in plan and "unused" not in plan.split("ReadSchema")[1]


def test_cell_rows(spark, rows):
    nan = float("nan")
    df = spark.createDataFrame([(1, 15.0, -5.0, 10.0), (2, 1.0, 1.0, 0.0), (3, 1.0, 1.0, nan), (4, nan, 1.0, 5.0), (5, None, 1.0, 5.0), (6, 1.0, 1.0, None)], "id int, x double, y double, c double")
    assert rows(G.cell_rows(df, "x", "y", "c").select("id", "cell_x", "cell_y")) == [(1, 1, -1)]
    register(spark)
    df.createOrReplaceTempView("some")
    assert rows(spark.sql("SELECT id, t.cell_x, t.cell_y FROM some, LATERAL spatial_partition_rows(x, y, c) AS t")) == [(1, 1, -1)]
