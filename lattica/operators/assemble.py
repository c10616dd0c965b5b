"""Warping images through transforms and assembling mosaics, as joins on pixel places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import similarity, similarity_inverse
from lattica.operators.pixels import composite, distance_to_centre

PARAMS = ["angle", "scale", "c_y", "c_x", "dy", "dx"]


def target_boxes(images: DataFrame, params: DataFrame) -> DataFrame:
    """Whole bounds of where each image (image_id, h, w) lies under its transform (tf_id = image_id), with the transform."""
    p = images.join(params.withColumnRenamed("tf_id", "image_id"), "image_id")
    ys, xs = [], []
    for cy, cx in ((0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)):
        y, x = similarity(cy * (F.col("h") - 1), cx * (F.col("w") - 1), *[F.col(c) for c in PARAMS])
        ys.append(y)
        xs.append(x)
    low, high = lambda v: F.floor(F.round(F.least(*v), 6)), lambda v: F.ceil(F.round(F.greatest(*v), 6))
    return p.select("image_id", "h", "w", *PARAMS, low(ys).alias("min_y"), low(xs).alias("min_x"), high(ys).alias("max_y"), high(xs).alias("max_x"))


def warped(px: DataFrame, images: DataFrame, params: DataFrame, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(key, y, x, v, sy, sx): each image gathered into target space, nearest pixel, only inside the image.

    Every place of an image's target box asks for one source pixel, so the work is the area of the boxes; a ``region``
    (min_y, min_x, max_y, max_x, exclusive) cuts the boxes before anything is generated. The rest is an equi-join on
    (image, y, x), which no hot image skews: its pixels are distinct keys.
    """
    b = target_boxes(images, params)
    if region:
        b = b.select(*[c for c in b.columns if c[:4] not in ("min_", "max_")], F.greatest("min_y", F.lit(region[0])).alias("min_y"), F.greatest("min_x", F.lit(region[1])).alias("min_x"), F.least("max_y", F.lit(region[2] - 1)).alias("max_y"), F.least("max_x", F.lit(region[3] - 1)).alias("max_x")).filter("min_y <= max_y and min_x <= max_x")
    places = b.withColumn("y", F.explode(F.sequence("min_y", "max_y"))).withColumn("x", F.explode(F.sequence("min_x", "max_x")))
    sy, sx = similarity_inverse(F.col("y"), F.col("x"), *[F.col(c) for c in PARAMS])
    near = lambda v: F.floor(F.round(v, 3) + 0.5).cast("int")
    asked = places.select("image_id", "h", "w", "y", "x", near(sy).alias("sy"), near(sx).alias("sx")).filter("sy >= 0 and sx >= 0 and sy < h and sx < w")
    source = px.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    return asked.join(source, ["image_id", "sy", "sx"]).select(F.col("image_id").alias("key"), "h", "w", "y", "x", "v", "sy", "sx")


def assembled(px: DataFrame, images: DataFrame, params: DataFrame, h: int, w: int, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(y, x, v, dist, key) of the mosaic of images of one size: all images warped, the one nearest to its own centre on top."""
    p = warped(px, images, params, region)
    return composite(p.select("key", "y", "x", "v", F.round(distance_to_centre(F.col("sy"), F.col("sx"), h, w), 9).alias("dist")))
