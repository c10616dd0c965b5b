"""Joins and set operations on rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import SIDES, Rect


def _cells(rects: DataFrame, size: float, key: str) -> DataFrame:
    """Each rectangle once per grid cell of side ``size`` that its interior meets."""
    rows = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.greatest(F.ceil(F.col(hi) / size) - 1, F.floor(F.col(lo) / size)))
    return rects.withColumn("cell_y", F.explode(rows("min_y", "max_y"))).withColumn("cell_x", F.explode(rows("min_x", "max_x")))


def overlapping_pairs(rects: DataFrame, size: float, key: str = "id") -> DataFrame:
    """Unordered pairs (a, b), a < b, of rectangles (key, min_y, min_x, max_y, max_x) whose interiors meet; with both bounds.

    Rectangles meet in the grid cells that they share, so the theta join becomes an equi-join on cells; a pair counts only
    in the cell of the lower corner of its common part, so none comes twice and nothing is shuffled to remove copies.
    ``size`` should be near the usual size of a rectangle. Both sides are shuffled: Spark doesn't count what the explosion
    into cells adds, and would take many rows of a small file for a side to broadcast, which the driver holds as a whole.
    Skewed cells are split by AQE. Rectangles with null or negative bounds overlap nothing.
    """
    good = rects.filter(Rect.of().valid()).select(key, *SIDES)
    gridded = _cells(good, size, key)
    a, b = gridded.alias("a"), gridded.alias("b")
    ra, rb = Rect.of(alias="a"), Rect.of(alias="b")
    common = ra.clip(rb)
    here = (F.floor(common.min_y / size) == F.col("a.cell_y")) & (F.floor(common.min_x / size) == F.col("a.cell_x"))
    on = (F.col("a.cell_y") == F.col("b.cell_y")) & (F.col("a.cell_x") == F.col("b.cell_x")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    return a.join(b.hint("merge"), on & ra.intersects(rb) & here).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), *ra.columns("a_"), *rb.columns("b_"))


def overlaps(rects: DataFrame, size: float, least: float = 0.0, key: str = "id") -> DataFrame:
    """Overlap descriptors of the pairs that share more than ``least`` of a's area: shares, common rectangle, centre offset b - a."""
    ra, rb = Rect.of("a_"), Rect.of("b_")
    pairs = overlapping_pairs(rects, size, key)
    return pairs.select("a", "b", ra.overlap(rb).alias("overlap"), ra.overlap_normalized(rb).alias("overlap_norm"), *ra.clip(rb).columns(), (rb.center_y - ra.center_y).alias("dy"), (rb.center_x - ra.center_x).alias("dx")).filter(F.col("overlap") > least)


def neighbours(pairs: DataFrame) -> DataFrame:
    """Per rectangle the number of rectangles it overlaps and their sorted list, from pairs (a, b)."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other")))
    return both.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("other")).alias("others"))


def isolated(rects: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """Rectangles in no pair."""
    touched = pairs.select(F.explode(F.array("a", "b")).alias(key))
    return rects.select(key).join(touched, key, "left_anti")


def pair_delta(old: DataFrame, new: DataFrame, epsilon: float = 1.0) -> DataFrame:
    """State of each pair (a, b, dy, dx) between two layouts: new, removed, changed (offset moved by epsilon or more) or unchanged."""
    o = old.select("a", "b", F.col("dy").alias("old_dy"), F.col("dx").alias("old_dx"))
    moved = F.hypot(F.col("dy") - F.col("old_dy"), F.col("dx") - F.col("old_dx")) >= epsilon
    state = F.when(F.col("old_dy").isNull(), "new").when(F.col("dy").isNull(), "removed").when(moved, "changed").otherwise("unchanged")
    return new.select("a", "b", "dy", "dx").join(o, ["a", "b"], "full_outer").select("a", "b", state.alias("state"))


def region_clip(rects: DataFrame, region: Rect, key: str = "id") -> DataFrame:
    """Rectangles whose whole bounds meet a region, cut to it."""
    r = Rect.of().safe_round()
    return rects.filter(r.intersects(region)).select(key, *r.clip(region).columns())


def bounds(rects: DataFrame) -> DataFrame:
    """Bounding box of all rectangles, one row."""
    return rects.agg(F.min("min_y").alias("min_y"), F.min("min_x").alias("min_x"), F.max("max_y").alias("max_y"), F.max("max_x").alias("max_x"))


def to_zero_origin(rects: DataFrame, key: str = "id") -> DataFrame:
    """Rectangles shifted so that their bounding box begins at (0, 0). The box, a single row, is broadcast."""
    box = F.broadcast(rects.agg(F.min("min_y").alias("oy"), F.min("min_x").alias("ox")))
    return rects.crossJoin(box).select(key, *Rect.of().translate(-F.col("oy"), -F.col("ox")).columns())
