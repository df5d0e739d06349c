"""Points inside intervals as a join on equal cells.

An interval of whole numbers is cut into the fewest cells of a dyadic grid that tile it: at most two a level, where a cell
of level k is 2^k wide. A point lies in one cell of every level, and in exactly one cell of every interval that holds it. So
cells meet in a hash join, whose work follows the number of points, intervals and pairs found, however many intervals
share a key, overlap or nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.operators.questions import unused

_MAX_LEVEL = 62


def _cells(low: Column, high: Column) -> Column:
    """The cells (level, cell) that tile ``low`` to ``high``, both included; none if the interval is empty."""
    beyond = high + 1
    levels = F.sequence(F.lit(0), F.when(beyond > low, F.floor(F.log2((beyond - low).cast("double"))).cast("int") + 1).otherwise(0))

    def at(level: Column) -> Column:
        scale = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        first = F.call_function("div", low + F.pmod(-low, scale), scale)
        last = F.call_function("div", beyond - F.pmod(beyond, scale), scale)
        left = F.when((first < last) & (F.pmod(first, F.lit(2)) == 1), F.array(first))
        right = F.when((first < last) & (F.pmod(last, F.lit(2)) == 1), F.array(last - 1))
        none = F.array().cast("array<bigint>")
        cells = F.concat(F.coalesce(left, none), F.coalesce(right, none))
        return F.transform(cells, lambda c: F.struct(level.cast("int").alias("level"), c.alias("cell")))

    return F.flatten(F.transform(levels, at))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, low: str, high: str) -> DataFrame:
    """Every point with every interval of its keys that holds it: the columns of both, the keys once.

    ``low`` and ``high`` are included. Columns of the two tables other than the keys must have different names.
    """
    level = unused([*points.columns, *intervals.columns], "_level")
    cell = unused([*points.columns, *intervals.columns], "_cell")
    tiled = intervals.select("*", F.explode(_cells(F.col(low).cast("long"), F.col(high).cast("long"))).alias(cell))
    tiled = tiled.select(*intervals.columns, F.col(f"{cell}.level").alias(level), F.col(f"{cell}.cell").alias(cell))
    return _placed(points, point, intervals, low, high, level, cell).join(tiled, [*keys, level, cell]).drop(level, cell)


def points_outside_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, low: str, high: str) -> DataFrame:
    """(keys, point): the points that no interval of their keys holds, once each."""
    level, cell = unused([*points.columns], "_level"), unused([*points.columns], "_cell")
    wanted = points.select(*keys, point).distinct()
    tiled = intervals.select(*keys, F.inline(_cells(F.col(low).cast("long"), F.col(high).cast("long"))).alias(level, cell)).distinct()
    held = _placed(wanted, point, intervals, low, high, level, cell).join(tiled, [*keys, level, cell], "left_semi").select(
        *keys, point).distinct()
    return wanted.join(held, [*keys, point], "left_anti")


def _placed(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str, level: str, cell: str) -> DataFrame:
    """Points once for every level that an interval can use."""
    widest = intervals.agg(F.max(F.col(high).cast("long") - F.col(low).cast("long") + 1)).first()[0] or 1
    top = min(_MAX_LEVEL, max(0, int(widest).bit_length()))
    scale = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(level))
    value = F.col(point).cast("long")
    return points.select("*", F.explode(F.sequence(F.lit(0), F.lit(top))).alias(level)).withColumn(
        cell, F.call_function("div", value - F.pmod(value, scale), scale))
