"""Time periods and grid cells."""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import EARTH_R, mercator_x, mercator_y

#: Lengths of a period in minutes (fixed values); each divides a day.
PERIODS = (1, 2, 3, 4, 5, 6, 10, 12, 15, 20, 30, 60, 120, 180, 240, 360, 480, 720, 1440)
_INT = 2**31


def check_period(length: timedelta | None, shift: timedelta | None) -> None:
    """Raises ValueError for a length or shift that periods can't have."""
    if length is None:
        raise ValueError("a period needs a length")
    if not timedelta(minutes=1) <= length <= timedelta(hours=24):
        raise ValueError("a period lasts from one minute to one day")
    if length < timedelta(hours=1) and length not in [timedelta(minutes=m) for m in PERIODS]:
        raise ValueError(f"this number of minutes does not divide an hour; allowed are {[m for m in PERIODS if m <= 60]}")
    if length not in [timedelta(minutes=m) for m in PERIODS]:
        raise ValueError(f"this number of hours does not divide a day; allowed are {[m // 60 for m in PERIODS if m >= 60]}")
    if shift is not None and abs(shift) >= length:
        raise ValueError("the shift must be shorter than the period")


def time_partition(ts: Column, length: timedelta, shift: timedelta | None = None) -> Column:
    """STRUCT(start_timestamp, end_timestamp): the period [start, end) of the day's grid, moved by ``shift``, that holds ``ts`` (TIMESTAMP_NTZ).

    A null timestamp gives a struct of nulls. All lengths divide a day, so the grid from midnight is the grid from any midnight.
    """
    check_period(length, shift)
    micro = length // timedelta(microseconds=1)
    moved = (shift or timedelta()) // timedelta(microseconds=1)
    zero = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    at = F.timestamp_diff("MICROSECOND", zero, ts) - F.lit(moved)
    start = at - F.pmod(at, F.lit(micro)) + F.lit(moved)
    return F.struct(F.timestamp_add("MICROSECOND", start, zero).alias("start_timestamp"), F.timestamp_add("MICROSECOND", start + F.lit(micro), zero).alias("end_timestamp"))


def period_text(period: Column) -> Column:
    """"start - end" of a period, for display."""
    return F.concat_ws(" - ", F.date_format(period["start_timestamp"], "yyyy-MM-dd HH:mm:ss"), F.date_format(period["end_timestamp"], "yyyy-MM-dd HH:mm:ss"))


def check_cell(cell_length: float | None) -> None:
    if cell_length is None or not (0 < cell_length < math.inf):
        raise ValueError(f"cell length must be finite and above 0, not {'<NULL>' if cell_length is None else cell_length}")


def spatial_partition(x: Column, y: Column, cell_length: float | Column | None, s_x: float | None = 0.0, s_y: float | None = 0.0, on_invalid: str = "raise") -> Column:
    """STRUCT(x INT, y INT): the square cell of a place; the grid starts at (0, 0) moved by (s_x, s_y), an edge belongs to the upper cell.

    A null coordinate gives a null component. A cell length that is null, not finite or not above 0, a coordinate that is NaN or infinite, and an index
    beyond INT raise; with ``on_invalid`` "null" they give a null struct or component instead. ``cell_length`` may be a column.
    """
    if on_invalid not in ("raise", "null"):
        raise ValueError("on_invalid is 'raise' or 'null'")
    strict = on_invalid == "raise"
    if not isinstance(cell_length, Column):
        if strict:
            check_cell(cell_length)
        cell = F.lit(cell_length).cast("double")
    else:
        cell = cell_length.cast("double")
    fit = cell.isNotNull() & (cell > 0) & (cell < float("inf"))  # NaN is above infinity

    def index(v: Column, shift: float | None) -> Column:
        v = v.cast("double")
        at = F.floor((v - F.lit(float(shift or 0.0))) / cell)
        bad = F.isnan(v) | (F.abs(v) == float("inf"))
        wide = (at >= _INT) | (at < -_INT)
        wrong = F.raise_error(F.lit("coordinate or cell index out of range")).cast("int") if strict else F.lit(None).cast("int")
        return F.when(v.isNull(), F.lit(None).cast("int")).when(bad | wide, wrong).otherwise(at.cast("int"))

    cell_id = F.struct(index(x, s_x).alias("x"), index(y, s_y).alias("y"))
    if not strict:
        return F.when(fit, cell_id)
    if not isinstance(cell_length, Column):
        return cell_id
    return F.when(fit, cell_id).otherwise(F.raise_error(F.concat(F.lit("cell length must be finite and above 0, not "), F.coalesce(cell.cast("string"), F.lit("<NULL>")))).cast("struct<x:int,y:int>"))


def cell_rows(df: DataFrame, x: str, y: str, cell_length: str) -> DataFrame:
    """``df`` with ``cell_x``, ``cell_y`` by each row's own cell length; rows whose length or coordinates are unusable are left out."""
    cell = spatial_partition(F.col(x), F.col(y), F.col(cell_length), on_invalid="null")
    return df.withColumn("__cell", cell).withColumns({"cell_x": F.col("__cell.x"), "cell_y": F.col("__cell.y")}).drop("__cell").filter("cell_x IS NOT NULL AND cell_y IS NOT NULL")


def to_web_mercator(lon: Column, lat: Column) -> Column:
    """STRUCT(x, y) in Web Mercator metres of degrees; spherical formulas, NULL at and beyond the poles."""
    return F.struct(mercator_x(lon).alias("x"), mercator_y(lat).alias("y"))


def grid_join(points: DataFrame, x: str, y: str, cell_length: float) -> DataFrame:
    """The points with each square (``cell_x``, ``cell_y``) that touches them: inside 1, on an edge 2, on a corner 4.

    The squares that a point can touch are its own and, on an edge, the one below; they are derived from the point, so nothing is
    joined. Points with an unusable coordinate have no square.
    """
    check_cell(cell_length)

    def touched(v: Column) -> Column:
        at = F.floor(v / F.lit(float(cell_length)))
        return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.when(at * F.lit(float(cell_length)) == v, F.array(at - 1, at)).otherwise(F.array(at)))

    return points.withColumn("cell_x", F.explode(touched(F.col(x)))).withColumn("cell_y", F.explode(touched(F.col(y))))


__all__ = ["EARTH_R", "check_cell", "check_period", "grid_join", "period_text", "spatial_partition", "time_partition", "to_web_mercator"]
