"""The whole analysis of a cohort as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.config import DEFAULTS, EngineConfig
from ocellus.functions import scalars as S
from ocellus.operators import cells as C
from ocellus.operators.spatial import with_nearest
from ocellus.operators.tumors import enough_tumour


def analyze(slides: DataFrame, detections: DataFrame, tumors: DataFrame, config: EngineConfig = DEFAULTS, extent: int = 2000) -> dict[str, DataFrame]:
    """cells, with distances and bins, and a summary row for every slide, those without cells included.

    All slides are one job: they share its plan, and a slide without detections or
    tumours gives empty or null results instead of failing.
    """
    config.validated()
    found = C.cells_summed(detections, slides, config.min_area_um2, config.max_area_um2)
    near = with_nearest(found, enough_tumour(tumors, config.min_total_tumor_px), ["slide_id", "root"], "tumor_key", extent)
    d = F.sqrt(F.col("gap2")) * F.col("mpp")
    cells = near.join(slides.select("slide_id", "width", "height", "mpp"), "slide_id").select(
        "slide_id", "cell_id", "root", "area_px", S.px_to_um2(F.col("area_px"), F.col("mpp")).alias("area_um2"), "cx", "cy",
        S.grid_id(F.col("cx"), F.col("cy"), F.col("width"), F.col("height"), F.col("mpp"), config.grid_cell_um).alias("grid"), "mpp",
        F.coalesce("tumor_key", F.lit(1)).alias("closest_tumor"), d.alias("distance_um"), S.distance_bin(d, config.close_um, config.medium_um).alias("distance_bin"),
    )
    sizes = found.join(slides.select("slide_id", "mpp"), "slide_id").select("slide_id", "area_px", S.px_to_um2(F.col("area_px"), F.col("mpp")).alias("area_um2"))
    summary = slides.select("slide_id", "image_name").join(
        sizes.groupBy("slide_id").agg(F.count("*").alias("cells"), F.sum("area_px").alias("px"), F.avg("area_um2").alias("mean_um2"), F.stddev_pop("area_um2").alias("std_um2")), "slide_id", "left"
    ).fillna(0, ["cells", "px"])
    return {"cells": cells, "summary": summary}
