"""Tumour instances and distances to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.painting import visible_sums
from ocellus.operators.spatial import nearest


def instances(tumors: DataFrame, step: int, min_px: int = 100) -> DataFrame:
    """(slide_id, tumor_id, tumor_key, area) after painting: size test first, then by falling score the first painter keeps a pixel.

    Hidden tumours get no number; areas are visible raster pixels.
    """
    large = tumors.filter((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= min_px)
    first = lambda c: F.ceil(F.col(c) / step).cast("long").alias(c)  # noqa: E731  the first raster pixel at or behind a place
    seen = visible_sums(large.select("slide_id", "tumor_key", "score", *[first(c) for c in ("x1", "y1", "x2", "y2")]), "tumor_key", named=("score",))
    areas = seen.select("slide_id", "tumor_key", "score", F.col("n").alias("area"), (F.col("sx") / F.col("n")).alias("cx"), (F.col("sy") / F.col("n")).alias("cy"))
    rank = F.row_number().over(Window.partitionBy("slide_id").orderBy(F.col("score").desc(), "tumor_key")).cast("long")
    return areas.withColumn("tumor_id", rank)


def enough_tumour(tumors: DataFrame, min_total_px: int) -> DataFrame:
    """The tumours of slides on which they have ``min_total_px`` pixels or more in all."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    enough = tumors.groupBy("slide_id").agg(F.sum(area).alias("_px")).filter(F.col("_px") >= min_total_px).select("slide_id")
    return tumors.join(enough, "slide_id", "left_semi")


def distances(boxes: DataFrame, tumors: DataFrame, extent: int, min_total_px: int = 50, key: str = "det_id") -> DataFrame:
    """Boxes with gap2 and tumor_key of the nearest tumour; null where the slide's tumours have fewer than ``min_total_px`` pixels in all."""
    near = nearest(boxes, enough_tumour(tumors, min_total_px), key, "tumor_key", extent)
    return boxes.join(near.drop("slide_id"), key, "left")
