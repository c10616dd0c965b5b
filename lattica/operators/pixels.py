"""Image operators on pixels in long form (image_id, y, x, v): everything here is Catalyst expressions and hash aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def image_stats(px: DataFrame, by: str = "image_id") -> DataFrame:
    """Median, mean, population standard deviation and extrema of each image. Null pixels don't count."""
    v = F.col("v")
    return px.groupBy(by).agg(F.percentile("v", 0.5).alias("median"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def merged_stats(px: DataFrame, by: str = "image_id") -> DataFrame:
    """The same but the median, by merging moments of images, as for a tile set."""
    part = px.groupBy(by).agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    n = F.sum("n")
    mean = F.sum("s") / n
    return part.agg(n.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.sum("q") / n - mean * mean, F.lit(0.0))).alias("std"), F.min("lo").alias("min"), F.max("hi").alias("max"))


def normalised(px: DataFrame, by: str = "image_id") -> DataFrame:
    """Pixels of each image stretched to 0 .. 1; a constant image becomes 0. The extrema are joined, not windowed: no image is gathered."""
    ext = px.groupBy(by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return px.join(ext, by).withColumn("v", F.coalesce((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0))).drop("lo", "hi")


def histogram(px: DataFrame, bins: int, lo: float, hi: float, by: str = "image_id") -> DataFrame:
    """Counts per image and bin of equal width over [lo, hi]; hi itself belongs to the last bin, values outside to none."""
    b = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return px.filter(F.col("v").between(lo, hi)).groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"))


def merged_histogram(per_image: DataFrame) -> DataFrame:
    """Histogram of all images, with the pixels below each bin. The window runs over bins only, already aggregated."""
    total = per_image.groupBy("bin").agg(F.sum("n").alias("n"))
    return total.withColumn("below", F.coalesce(F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def intensity_at(hist: DataFrame, percent: float, bins: int, lo: float, hi: float, by: str = "image_id") -> DataFrame:
    """Left edge of the first bin below which lie more than ``percent`` of an image's pixels; the upper end if there is none."""
    w = Window.partitionBy(by)
    run = hist.withColumn("below", F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(w))
    # Empty bins have no row: the edge is that of the first bin behind the one that fills the share.
    reached = run.filter(F.col("below") + F.col("n") > F.col("total") * percent).groupBy(by).agg(F.min("bin").alias("b"))
    step = (hi - lo) / bins
    return reached.select(by, (F.lit(lo) + F.least(F.col("b") + 1, F.lit(bins)) * step).alias("cutoff"))


def prune_score(px: DataFrame, block: int, height: int, width: int, overlap: float, by: str = "image_id") -> DataFrame:
    """Sum of the population standard deviations of an image's blocks near its border: how much there is to register by."""
    top, left = int(min(overlap, 0.5) * height), int(min(overlap, 0.5) * width)
    y0, x0 = F.col("by") * block, F.col("bx") * block
    border = (y0 < top) | (y0 >= height - top) | (x0 < left) | (x0 >= width - left)
    blocks = px.withColumn("by", F.floor(F.col("y") / block)).withColumn("bx", F.floor(F.col("x") / block)).filter(border)
    return blocks.groupBy(by, "by", "bx").agg(F.stddev_pop("v").alias("sd")).groupBy(by).agg(F.sum("sd").alias("score"))


def level_gamma(px: DataFrame, lo: float, hi: float, gamma: float, invert: bool = False) -> DataFrame:
    """Levels and gamma: (v - lo) / (hi - lo) to the power 1 / gamma, cut to 0 .. 1, inverted on demand."""
    u = F.greatest(F.least((F.col("v") - lo) / (hi - lo), F.lit(1.0)), F.lit(0.0))
    out = F.pow(u, F.lit(1.0 / gamma))
    return px.withColumn("v", 1 - out if invert else out)


def flipped(px: DataFrame, height: int, width: int, flip: bool = True, flop: bool = False) -> DataFrame:
    """Upside down (flip) and mirrored (flop)."""
    if flip:
        px = px.withColumn("y", height - 1 - F.col("y"))
    return px.withColumn("x", width - 1 - F.col("x")) if flop else px


def shade_image(px: DataFrame, bright: bool = True) -> DataFrame:
    """Per pixel the largest value over all tiles (bright field), or the least less the least of all (dark field)."""
    if bright:
        return px.groupBy("y", "x").agg(F.max("v").alias("v"))
    low = px.groupBy("y", "x").agg(F.min("v").alias("v"))
    return low.crossJoin(F.broadcast(low.agg(F.min("v").alias("least")))).select("y", "x", (F.col("v") - F.col("least")).alias("v"))


def shade_corrected(px: DataFrame, shade: DataFrame, bright: bool = True, by: str = "image_id") -> DataFrame:
    """Pixels corrected by a shade image: divided by its share of its maximum and cut to 0 .. 1 (bright), or less it (dark)."""
    s = shade.select("y", "x", F.col("v").alias("s"))
    if not bright:
        return px.join(s, ["y", "x"]).select(by, "y", "x", (F.col("v") - F.col("s")).alias("v"))
    top = F.broadcast(s.agg(F.max("s").alias("top")))
    most = px.groupBy(by).agg(F.max("v").alias("most"))
    u = F.col("v") / F.nullif(F.col("most"), F.lit(0.0)) / F.nullif(F.col("s") / F.col("top"), F.lit(0.0))
    return px.join(most, by).join(s, ["y", "x"]).crossJoin(top).select(by, "y", "x", F.greatest(F.least(F.coalesce(u, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("v"))


def cell_coverage(mask: DataFrame, cell: int, least: float, by: str = "image_id") -> DataFrame:
    """Grid cells of which more than ``least`` is true in a mask (valid boolean), with the share."""
    area = float(cell * cell)
    c = mask.groupBy(by, F.floor(F.col("y") / cell).cast("int").alias("cy"), F.floor(F.col("x") / cell).cast("int").alias("cx")).agg((F.count_if("valid") / area).alias("coverage"))
    return c.filter(F.col("coverage") > least)


def in_bounds(y: Column, x: Column, height: Column, width: Column) -> Column:
    """Half open: 0 <= p < shape."""
    return (y >= 0) & (y < height) & (x >= 0) & (x < width)


def crop(px: DataFrame, y0: int, x0: int, height: int, width: int, fill: float, by: str = "image_id") -> DataFrame:
    """Window of every image; what lies outside an image is ``fill``. The window's places are generated, once per image."""
    if height < 0 or width < 0:
        raise ValueError("negative size")
    inside = px.filter(F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1)).select(by, (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "v")
    frame = px.select(by).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return frame.join(inside, [by, "y", "x"], "left").select(by, "y", "x", F.coalesce("v", F.lit(fill)).alias("v"))


def to_tiles(px: DataFrame, th: int, tw: int, by: str = "image_id") -> DataFrame:
    """Pixels with the row and column of their tile and their place in it."""
    return px.select(by, F.floor(F.col("y") / th).cast("int").alias("row"), F.floor(F.col("x") / tw).cast("int").alias("col"), (F.col("y") % th).alias("y"), (F.col("x") % tw).alias("x"), "v")


def halved(px: DataFrame, by: str = "image_id") -> DataFrame:
    """Next pyramid level: means of 2 x 2 pixels, missing ones 0."""
    return px.groupBy(by, F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg((F.sum("v") / 4).alias("v"))


def composite(placed: DataFrame) -> DataFrame:
    """Depth-buffer composite of placed pixels (key, y, x, v, dist): per place the value of the pixel nearest to its own image's centre.

    ``min_by`` is partial and final, so the result depends on no order and no place's pixels meet before they are reduced;
    of equal distances the least key wins. Negative values become 0.
    """
    best = placed.groupBy("y", "x").agg(F.min_by(F.struct("v", "dist", "key"), F.struct("dist", "key")).alias("b"))
    return best.select("y", "x", F.greatest("b.v", F.lit(0.0)).alias("v"), F.col("b.dist").alias("dist"), F.col("b.key").alias("key"))


def quality_scores(px: DataFrame, by: str = "image_id") -> DataFrame:
    """Mean absolute difference of consecutive images where neither is at an extremum, both normalised; 1 where nothing is left."""
    n = normalised(px, by).select(by, "y", "x", "v")
    a, b = n.alias("a"), n.withColumn(by, F.col(by) - 1).alias("b")
    ok = (F.col("a.v") > 0) & (F.col("a.v") < 1) & (F.col("b.v") > 0) & (F.col("b.v") < 1)
    j = a.join(b, [by, "y", "x"])
    return j.groupBy(by).agg(F.coalesce(F.avg(F.when(ok, F.abs(F.col("a.v") - F.col("b.v")))), F.lit(1.0)).alias("score"))


def axis_distance(i: Column, n: int) -> Column:
    """Distance of pixel ``i`` of ``n`` from the centre: steps of one about a middle pixel, else from a half on, spread over both halves."""
    if n % 2:
        return F.abs(i - (n - 1) // 2).cast("double")
    half = n // 2
    k = F.when(i >= half, i - half).otherwise(half - 1 - i)
    return F.lit(0.5) + k * (half / (half - 1.0) if half > 1 else 0.0)


def distance_to_centre(y: Column, x: Column, h: int, w: int) -> Column:
    return F.sqrt(F.pow(axis_distance(y, h), 2.0) + F.pow(axis_distance(x, w), 2.0))


def linear_distance(y: Column, x: Column, h: int, w: int) -> Column:
    """The simpler distance, -n/2 .. n/2 over each axis."""
    dy, dx = -h / 2 + y * (h / (h - 1)), -w / 2 + x * (w / (w - 1))
    return F.sqrt(dy * dy + dx * dx)


def combined(px: DataFrame, fold: Callable[[Column], Column]) -> DataFrame:
    """Images of one size folded into one by an aggregate of the caller's, such as ``F.max``: per place over all images."""
    return px.groupBy("y", "x").agg(fold(F.col("v")).alias("v"))
