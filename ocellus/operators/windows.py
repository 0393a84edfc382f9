"""Window generators and their guidance by tissue and regions of interest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocellus.operators.grouped import by_group
from ocellus.operators.spatial import box_join


def positions(length: Column, size: Column, stride: Column) -> Column:
    """0, stride, 2 stride ... up to length - size, and length - size itself so that the end is covered; none if the image is smaller."""
    last = length - size
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.array_union(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)), stride), F.array(last)))


def sliding_windows(slides: DataFrame, size: Column, stride: Column) -> DataFrame:
    """(slide_id, x, y, size) of windows over whole slides."""
    return slides.select("slide_id", "width", "height", size.cast("long").alias("size"), stride.cast("long").alias("stride")).select(
        "slide_id", "size", F.explode(positions(F.col("width"), F.col("size"), F.col("stride"))).alias("x"), "height", "stride"
    ).select("slide_id", "x", F.explode(positions(F.col("height"), F.col("size"), F.col("stride"))).alias("y"), "size")


def window_params(mpp: Column) -> tuple[Column, Column]:
    """Window size and stride that suit the resolution."""
    return F.when(mpp >= 0.4, 1100).otherwise(2000), F.when(mpp >= 0.4, 900).otherwise(1700)


def as_boxes(windows: DataFrame) -> DataFrame:
    return windows.select("slide_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("size")).alias("x2"), (F.col("y") + F.col("size")).alias("y2"))


def guided_windows(slides: DataFrame, regions: DataFrame, size: int, stride: int) -> DataFrame:
    """Windows over each tissue region grown by half a window and clamped to the slide, each window once."""
    half = size // 2
    grown = regions.join(slides.select("slide_id", "width", "height"), "slide_id").select(
        "slide_id", "width", "height",
        F.greatest(F.lit(0), F.col("x1") - half).alias("gx"), F.greatest(F.lit(0), F.col("y1") - half).alias("gy"),
        F.least(F.col("width"), F.col("x2") + half).alias("hx"), F.least(F.col("height"), F.col("y2") + half).alias("hy"),
    )
    s, d = F.lit(size).cast("long"), F.lit(stride).cast("long")
    along = lambda lo, hi: F.transform(positions(F.col(hi) - F.col(lo), s, d), lambda v: v + F.col(lo))
    out = grown.withColumn("x", F.explode(along("gx", "hx"))).withColumn("y", F.explode(along("gy", "hy")))
    inside = (F.col("x") + size <= F.col("width")) & (F.col("y") + size <= F.col("height"))
    return out.filter(inside).select("slide_id", "x", "y").distinct()


def on_regions(windows: DataFrame, regions: DataFrame, how: str = "left_semi") -> DataFrame:
    """Window boxes that overlap a region (left_semi) or none (left_anti)."""
    return box_join(windows, regions.select("slide_id", "x1", "y1", "x2", "y2"), cell=1024, how=how)


def or_all(kept: DataFrame, windows: DataFrame) -> DataFrame:
    """``kept``, or for slides of which nothing was kept all ``windows``."""
    none = windows.join(kept.select("slide_id").distinct(), "slide_id", "left_anti")
    return kept.unionByName(none.select(*kept.columns))


def prioritised(windows: DataFrame, coverage: str, threshold: float, seq: Column) -> DataFrame:
    """rank per slide: windows of enough coverage first and by falling coverage, the others after them in their order."""
    from pyspark.sql import Window

    high = F.col(coverage) >= threshold
    order = [F.when(high, 0).otherwise(1), F.when(high, -F.col(coverage)).otherwise(0.0), seq]
    return windows.withColumn("rank", F.row_number().over(Window.partitionBy("slide_id").orderBy(*order)).cast("long"))


def roi_coverage(windows: DataFrame, mask: DataFrame, scale: Column, thumb: int) -> DataFrame:
    """Window boxes with ``inside``, ``total`` pixels of a thumbnail mask (slide_id, px, py, v) by four look-ups in its prefix sums.

    Pixels that the mask lacks count as 0, so only set ones need to be in it. A slide's
    thumbnail of ``thumb`` pixels a side is summed in memory: rows travel per window and set pixel.
    """
    from ocellus.functions.scalars import thumb as coordinate

    box = ["x1", "y1", "x2", "y2"]
    at = windows.select("slide_id", *box, *[coordinate(F.col(c), scale, F.lit(thumb).cast("long")).cast("long").alias(f"t{c}") for c in box], F.lit(None).cast("long").alias("v"))
    here = mask.filter("v <> 0").select("slide_id", *[F.lit(0).cast("long").alias(c) for c in box], F.col("px").cast("long").alias("tx1"), F.col("py").cast("long").alias("ty1"), F.lit(0).cast("long").alias("tx2"), F.lit(0).cast("long").alias("ty2"), F.col("v").cast("long").alias("v"))
    here = here.filter((F.col("tx1") >= 0) & (F.col("tx1") < thumb) & (F.col("ty1") >= 0) & (F.col("ty1") < thumb))

    def look(part: pd.DataFrame) -> pd.DataFrame:
        slide, window = part["slide_id"].to_numpy(np.int64), part["v"].isna().to_numpy()
        x1, y1, x2, y2 = (part[f"t{c}"].to_numpy(np.int64) for c in box)
        inside = np.zeros(len(part), np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], slide[1:] != slide[:-1], [True])))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            w, m = lo + np.flatnonzero(window[lo:hi]), lo + np.flatnonzero(~window[lo:hi])
            if len(w) and len(m):
                sums = np.zeros((thumb + 1, thumb + 1), np.int64)
                np.add.at(sums, (y1[m] + 1, x1[m] + 1), part["v"].to_numpy()[m].astype(np.int64))
                sums = sums.cumsum(axis=0).cumsum(axis=1)
                inside[w] = sums[y2[w], x2[w]] - sums[y1[w], x2[w]] - sums[y2[w], x1[w]] + sums[y1[w], x1[w]]
        out = pd.DataFrame({"slide_id": slide, **{c: part[c].to_numpy(np.int64) for c in box}, "inside": inside, "total": (x2 - x1) * (y2 - y1)})
        return out[window]

    return by_group(at.unionByName(here), ["slide_id"], look, ", ".join(f"{c} long" for c in ["slide_id", *box, "inside", "total"]))
