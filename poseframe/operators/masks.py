"""Masks as rows of pixels (frame, obj, x, y, p): unions and boxes are aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mask_union(pixels: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """Rows (by, x, y, on): whether any mask of the group has the pixel with a score above `least`; a null score counts as 0."""
    return pixels.groupBy(*by, "x", "y").agg(F.bool_or(F.coalesce(F.col("p"), F.lit(0.0)) > least).alias("on"))


def mask_boxes(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, x1, y1, x2, y2): the box around the pixels that are on; none for a mask without any."""
    return pixels.where("on").groupBy(*by).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
