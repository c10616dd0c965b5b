"""Quantities recorded in different units: conversion by what the record states, and unit changes found in its history."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.units import UNIT_NM, downsample_factor, name_downsample, numbers_in, remark_unit, says_full_resolution, unit_in
from lattica.operators.parsing import with_transforms
from lattica.sources.tables import load

#: Place of the first X by transform type, fixed values: list, index.
FIRST_X = {
    "LegendrePolynomialTransform_double_2_2_1": ("fp", 0),
    "Rigid2DTransform_double_2_2": ("vp", 1),
    "CenteredSimilarity2DTransform_double_2_2": ("vp", 4),
    "GridTransform_double_2_2": ("vp", 0),
    "MeshTransform_double_2_2": ("vp", 2),
}


def first_x() -> F.Column:
    found = F.lit(None).cast("double")
    for kind, (where, index) in FIRST_X.items():
        found = F.when(F.col("transform_type") == kind, F.get(where, F.lit(index))).otherwise(found)
    return found


def with_quantities(stos: DataFrame) -> DataFrame:
    """Raw quantities of slice-to-slice records: ds, dims (all numbers), x (first X), and the scales of dims and x.

    A scale is nanometres per unit, 0 for pixels; null where no unit is stated.
    """
    kept = stos.select("stos_id", "stos_name", "stos_dir", "downsample", "mapped_image_dim", "pixel_nm", "coord_unit", "remark", "recorded_at", "transform_str")
    parsed = with_transforms(kept, "transform_str")
    coord = F.coalesce(unit_in(F.col("coord_unit")), remark_unit(F.col("remark")))
    return parsed.select(
        "stos_id", "stos_dir", "recorded_at", "pixel_nm",
        F.coalesce(downsample_factor(F.col("downsample")), name_downsample(F.col("stos_name"))).alias("ds"),
        F.filter(numbers_in(F.col("mapped_image_dim")), lambda x: x.isNotNull()).alias("dims"),
        unit_in(F.col("mapped_image_dim")).alias("dim_scale"), says_full_resolution(F.col("mapped_image_dim")).alias("dim_full"),
        first_x().alias("x"), coord.alias("x_scale"), (says_full_resolution(F.col("coord_unit")) | (unit_in(F.col("coord_unit")).isNull() & says_full_resolution(F.col("remark")))).alias("x_full"),
    )


def in_pixels(value: F.Column, scale: F.Column, full: F.Column, ds: F.Column, pixel_nm: F.Column) -> F.Column:
    """A value in full-resolution pixels; null where it needs a downsample or pixel size that is lacking."""
    return F.when(scale > 0, F.when(pixel_nm > 0, F.try_divide(value * scale, pixel_nm))).when(full, value).otherwise(value * ds)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record and readable quantity, in full-resolution pixels (the downsample as a factor).

    The units are those that the record itself states: a record without a stated unit is in pixels at its downsample.
    """
    q = with_quantities(load(spark, sf_dir, "stos_files"))
    c, n = F.col, F.size("dims")
    px = lambda v, of: in_pixels(v, c(f"{of}_scale"), c(f"{of}_full"), c("ds"), c("pixel_nm"))
    rows = F.array(
        F.struct(F.lit("downsample").alias("field_name"), c("ds").cast("double").alias("value")),
        F.struct(F.lit("mapped_width").alias("field_name"), F.when(n >= 2, px(F.get("dims", n - 2), "dim")).alias("value")),
        F.struct(F.lit("mapped_height").alias("field_name"), F.when(n >= 2, px(F.get("dims", n - 1), "dim")).alias("value")),
        F.struct(F.lit("transform_x").alias("field_name"), px(c("x"), "x").alias("value")),
    )
    long = q.select("stos_id", F.explode(rows).alias("r")).filter("r.value is not null and not isnan(r.value) and abs(r.value) < 9e18")
    return long.select("stos_id", "r.field_name", F.round("r.value").cast("bigint").alias("value_px")).dropDuplicates(["stos_id", "field_name"])
