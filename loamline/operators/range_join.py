"""Joins of points with the intervals that hold them.

An interval [first, past) belongs to the level of its length, the next power of two, and lies in at most two cells of that
level; a point lies in one cell of each level. Equal cells are joined and the ends compared. Short and long intervals thus
cost alike, a point is repeated once per level that occurs (there are at most 63), and no interval meets points far from it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _level(first: str, past: str):
    return F.greatest(F.lit(0), F.ceil(F.log2((F.col(past) - F.col(first)).cast("double")))).cast("int")


def range_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, first: str = "first", past: str = "past") -> DataFrame:
    """Rows of ``points`` with every interval of equal ``keys`` that holds their whole number ``point`` (an inner join).

    Empty intervals and nulls match nothing. Only the keys may be named alike in both tables.
    """
    filled = intervals.where(F.col(past) > F.col(first)).withColumn("_level", _level(first, past))
    levels = sorted(r["_level"] for r in filled.select("_level").distinct().collect())  # at most 63 numbers
    cell = lambda c: F.expr(f"floor({c} / shiftleft(1L, _level))").cast("long")
    cells = filled.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(f"`{first}`"), cell(f"(`{past}` - 1)")))))
    each = F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")
    asked = points.withColumn("_level", F.explode(each)).withColumn("_cell", cell(f"`{point}`"))
    met = asked.join(cells, [*keys, "_level", "_cell"])
    return met.where((F.col(point) >= F.col(first)) & (F.col(point) < F.col(past))).drop("_level", "_cell")
