"""Grids of points over images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _frame(images: DataFrame) -> DataFrame:
    """One row per image (id, h, w, rows, cols) and grid place."""
    at = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    return images.withColumn("row", at("rows")).withColumn("col", at("cols"))


def tile_grid(images: DataFrame, tile: float) -> DataFrame:
    """(id, rows, cols): tiles of side ``tile`` that cover each image (id, h, w)."""
    return images.select("id", F.ceil(F.col("h") / tile).cast("int").alias("rows"), F.ceil(F.col("w") / tile).cast("int").alias("cols"))


def edge_grid(images: DataFrame, cell: float) -> DataFrame:
    """Points from edge to edge of each image (id, h, w): one more than cells fit, floored places."""
    dims = images.select("id", "h", "w", (F.ceil(F.col("h") / cell) + 1).cast("int").alias("rows"), (F.ceil(F.col("w") / cell) + 1).cast("int").alias("cols"))
    place = lambda k, n, s: F.floor(F.col(k) * (F.col(s) - 1) / (F.col(n) - 1)).cast("bigint")
    return _frame(dims).select("id", "row", "col", place("row", "rows", "h").alias("y"), place("col", "cols", "w").alias("x"))


def centred_grid(images: DataFrame, spacing: float) -> DataFrame:
    """Centres of cells of side ``spacing`` that cover each image, moved half their overhang inwards; halves round to even."""
    dims = images.select("id", "h", "w", F.ceil(F.col("h") / spacing).cast("int").alias("rows"), F.ceil(F.col("w") / spacing).cast("int").alias("cols"))
    place = lambda k, n, s: F.bround(F.col(k) * spacing + spacing / 2 - (F.col(n) * spacing - F.col(s)) / 2).cast("bigint")
    return _frame(dims).select("id", "row", "col", place("row", "rows", "h").alias("y"), place("col", "cols", "w").alias("x"))


def roi_range(start: int, count: int, most: int, least: int = 0) -> tuple[int, int] | None:
    """Range of ``count`` moved inside [least, most); None if it can't be."""
    if count > most - least:
        return None
    begin = min(max(start, least), most - count)
    return begin, begin + count


def constrained_range(start: int, count: int, most: int, least: int = 0) -> tuple[int, int]:
    """Range cut to [least, most)."""
    return max(start, least), max(max(start, least), min(start + count, most))


def largest_dimension_scale(h: int, w: int, limit: int) -> float:
    return limit / max(h, w)


def next_power(v: float) -> float:
    return 2.0 ** math.ceil(math.log2(v))


def range_columns(start: Column, count: Column, most: Column, least: Column) -> tuple[Column, Column, Column, Column]:
    """``roi_range`` and ``constrained_range`` as columns: begin and end of the moved range (null if it can't be), then of the cut one."""
    begin = F.when(count <= most - least, F.least(F.greatest(start, least), most - count))
    low = F.greatest(start, least)
    return begin, begin + count, low, F.greatest(low, F.least(start + count, most))
