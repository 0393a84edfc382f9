"""From detections to cells: merging, area filter, consecutive numbers, shapes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions.scalars import um2_to_px
from ocellus.operators.components import components_by_slide
from ocellus.operators.grouped import by_group, close_pairs, flat_lists, group_numbers, least_reachable, within
from ocellus.operators.painting import visible_objects
from ocellus.operators.spatial import merge_edges, priority_paint
from ocellus.sources.scratch import written


def area_filter(df: DataFrame, slides: DataFrame, min_um2: float = 250.0, max_um2: float = 25000.0) -> DataFrame:
    """Rows whose area_px lies in the slide's limits, both inclusive. The slide table is joined by its key."""
    limits = slides.select("slide_id", um2_to_px(min_um2, F.col("mpp")).alias("_lo"), um2_to_px(max_um2, F.col("mpp")).alias("_hi"))
    return df.join(limits, "slide_id").filter(F.col("area_px").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def roots(dets: DataFrame, num: int = 2, den: int = 10) -> DataFrame:
    """Detections with ``root``, the smallest det_id of their component of merge edges."""
    comp = components_by_slide(merge_edges(dets, num, den)).select(F.col("node").alias("det_id"), F.col("component").alias("root"))
    return dets.join(comp, "det_id", "left").withColumn("root", F.coalesce("root", "det_id"))


def merged(rooted: DataFrame) -> DataFrame:
    """Cells in summed mode: areas add up, centroids weigh by area, boxes unite."""
    cx2, cy2 = F.col("x1") + F.col("x2") - 1, F.col("y1") + F.col("y2") - 1  # twice the pixel centre, so that sums stay integer
    return rooted.groupBy("slide_id", "root").agg(
        F.sum("area_px").alias("area_px"), F.count("*").alias("members"),
        (F.sum(cx2 * F.col("area_px")) / (2.0 * F.sum("area_px"))).alias("cx"), (F.sum(cy2 * F.col("area_px")) / (2.0 * F.sum("area_px"))).alias("cy"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )


def merge_boxes(dets: DataFrame, num: int = 2, den: int = 10, crowded: int = 1_000_000) -> DataFrame:
    """``merged(roots(dets))`` in one pass over each slide's boxes; slides of more than ``crowded`` boxes go by grid cells and edges."""
    box = ["x1", "y1", "x2", "y2"]
    slim = written(dets.select("slide_id", "det_id", "area_px", *box))  # counted, then read again
    many = slim.filter("slide_id IS NOT NULL").groupBy("slide_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > crowded).select("slide_id")
    many = None if many.isEmpty() else written(many)
    missing = " OR ".join(f"{c} IS NULL" for c in slim.columns)  # such a box overlaps none
    whole = slim.filter(f"NOT ({missing})")

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["slide_id", "det_id"], kind="stable", ignore_index=True)
        slide, det, area, x1, y1, x2, y2 = (part[c].to_numpy(np.int64) for c in ("slide_id", "det_id", "area_px", *box))
        i, j = close_pairs(group_numbers(part, ["slide_id"]), x1, y1, x2, y2, num, den, area)
        same = np.flatnonzero((slide[1:] == slide[:-1]) & (det[1:] == det[:-1]))  # rows of one number are one cell
        label = least_reachable(len(part), np.concatenate((i, same)), np.concatenate((j, same + 1)))
        at, cell = np.unique(label, return_inverse=True)

        def total(v):
            out = np.zeros(len(at), np.int64)
            np.add.at(out, cell, v)
            return out

        def end(f, v):
            out = v[at].copy()
            f.at(out, cell, v)
            return out

        px = total(area)
        middle = lambda a, b: total((a + b - 1) * area) / (2.0 * px)
        ends = [end(np.minimum, x1), end(np.minimum, y1), end(np.maximum, x2), end(np.maximum, y2)]
        return pd.DataFrame({"slide_id": slide[at], "root": det[at], "area_px": px, "members": total(np.ones(len(part), np.int64)), "cx": middle(x1, x2), "cy": middle(y1, y2), **dict(zip(box, ends))})

    few = whole if many is None else whole.join(many, "slide_id", "left_anti")
    schema = "slide_id long, root long, area_px long, members long, cx double, cy double, x1 long, y1 long, x2 long, y2 long"
    out = by_group(few, ["slide_id"], merge, schema).unionByName(merged(slim.filter(missing).withColumn("root", F.col("det_id"))))
    return out if many is None else out.unionByName(merged(roots(whole.join(many, "slide_id", "left_semi"), num, den)))


def numbered(cells: DataFrame, order: str = "root") -> DataFrame:
    """cell_id 1..n per slide by ascending ``order``."""
    return cells.withColumn("cell_id", F.row_number().over(Window.partitionBy("slide_id").orderBy(order)).cast("long"))


def cells_summed(dets: DataFrame, slides: DataFrame, min_um2: float = 250.0, max_um2: float = 25000.0) -> DataFrame:
    """The whole way: area filter, merge, area filter, numbers."""
    kept = area_filter(dets, slides, min_um2, max_um2)
    return numbered(area_filter(merge_boxes(kept), slides, min_um2, max_um2))


def box_rows(boxes: DataFrame) -> DataFrame:
    """Runs (row, c0, c1) of filled boxes."""
    return boxes.withColumn("row", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1))).withColumn("c0", F.col("x1")).withColumn("c1", F.col("x2"))


def region_properties(runs: DataFrame, by: list[str]) -> DataFrame:
    """Exact properties from disjoint runs: area, centroid, half-open box."""
    n = F.col("c1") - F.col("c0")
    return runs.groupBy(*by).agg(
        F.sum(n).alias("area_px"), (F.sum(F.col("row") * n) / F.sum(n)).alias("cy"), (F.sum((F.col("c0") + F.col("c1") - 1) * n) / (2.0 * F.sum(n))).alias("cx"),
        F.min("c0").alias("x1"), F.min("row").alias("y1"), F.max("c1").alias("x2"), (F.max("row") + 1).alias("y2"),
    )


def visible_runs(runs: DataFrame, on: str, priority: list) -> DataFrame:
    """Disjoint runs after painting in order of ``priority`` (first wins).

    Rows are cut at all run ends; each elementary stretch keeps its best run.
    """
    ends = runs.select(on, "row", F.explode(F.array("c0", "c1")).alias("cut")).distinct()
    nxt = ends.withColumn("stop", F.lead("cut").over(Window.partitionBy(on, "row").orderBy("cut"))).filter("stop is not null")
    inside = runs.join(nxt, [on, "row"]).filter((F.col("cut") >= F.col("c0")) & (F.col("cut") < F.col("c1")))
    best = priority_paint(inside, [on, "row", "cut"], priority)
    return best.withColumn("c0", F.col("cut")).withColumn("c1", F.col("stop")).drop("cut", "stop")


def moments(runs: DataFrame, by: list[str]) -> DataFrame:
    """Extent, equivalent diameter and eccentricity from the moments of disjoint runs."""
    n = (F.col("c1") - F.col("c0")).cast("double")
    mid = (F.col("c0") + F.col("c1") - 1) / 2.0
    sums = runs.groupBy(*by).agg(
        F.sum(n).alias("a"), F.sum(n * mid).alias("sx"), F.sum(n * F.col("row")).alias("sy"),
        F.sum(n * mid * mid + n * (n * n - 1) / 12).alias("sxx"), F.sum(n * F.col("row") * F.col("row")).alias("syy"), F.sum(n * mid * F.col("row")).alias("sxy"),
        ((F.max("c1") - F.min("c0")) * (F.max("row") + 1 - F.min("row"))).alias("box"),
    )
    return shape_of(sums, by)


def shape_of(sums: DataFrame, by: list[str]) -> DataFrame:
    """Extent, equivalent diameter and eccentricity from sums over pixels (a, sx, sy, sxx, syy, sxy) and the area of the box."""
    # a pixel is a unit square: its own variance is 1/12
    u20 = F.col("sxx") / F.col("a") - F.pow(F.col("sx") / F.col("a"), F.lit(2.0)) + 1 / 12
    u02 = F.col("syy") / F.col("a") - F.pow(F.col("sy") / F.col("a"), F.lit(2.0)) + 1 / 12
    u11 = F.col("sxy") / F.col("a") - F.col("sx") * F.col("sy") / (F.col("a") * F.col("a"))
    spread = F.sqrt(4 * u11 * u11 + (u20 - u02) * (u20 - u02))
    big, small = (u20 + u02 + spread) / 2, (u20 + u02 - spread) / 2
    return sums.select(
        *by, F.col("a").cast("long").alias("area_px"), (F.col("a") / F.col("box")).alias("extent"), F.sqrt(4 * F.col("a") / math.pi).alias("eq_diameter"),
        F.sqrt(F.greatest(F.lit(0.0), 1 - small / big)).alias("eccentricity"),
    )


def painted_properties(sums: DataFrame, by: list[str]) -> DataFrame:
    """``region_properties`` from ``painting.visible_sums``."""
    n = F.col("n")
    return sums.select(*by, n.alias("area_px"), (F.col("sy") / n).alias("cy"), (2 * F.col("sx") / (2.0 * n)).alias("cx"), "x1", "y1", "x2", "y2")


def painted_moments(sums: DataFrame, by: list[str]) -> DataFrame:
    """``moments`` from ``painting.visible_sums``."""
    d = lambda c: F.col(c).cast("double").alias({"n": "a"}.get(c, c))
    return shape_of(sums.select(*by, *[d(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")], ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("box")), by)


def hull_areas(n: np.ndarray, lo: np.ndarray, hi: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Areas of the convex hulls of many objects' pixel squares: of each, n rows y in order with the first and the last end of their pixels.

    Both sides are lines of corners by height. Corners on or inside the line between their neighbours are dropped, everywhere at once, until none is.
    """

    def side(x: np.ndarray) -> np.ndarray:
        """Twice the area between the axis and the hull's side towards large x."""
        of = np.repeat(np.arange(len(n)), 2 * n)
        px, py = np.repeat(x, 2), np.repeat(y, 2)
        py[1::2] += 1
        same = np.flatnonzero((of[1:] == of[:-1]) & (py[1:] == py[:-1]))  # two corners of one height: the outer one counts
        px[same] = px[same + 1] = np.maximum(px[same], px[same + 1])
        alone = np.ones(len(px), bool)
        alone[same + 1] = False
        of, px, py = of[alone], px[alone], py[alone]
        total, live = np.zeros(len(n), np.int64), np.ones(len(n), bool)
        while len(of):
            inner = np.concatenate(([False], (of[2:] == of[:-2]), [False]))
            at = np.flatnonzero(inner)
            turn = (px[at] - px[at - 1]) * (py[at + 1] - py[at - 1]) - (px[at + 1] - px[at - 1]) * (py[at] - py[at - 1])
            drop = at[turn <= 0]
            live[:] = False
            live[of[drop]] = True
            done = np.flatnonzero((of[1:] == of[:-1]) & ~live[of[1:]])
            np.add.at(total, of[done], (px[done] + px[done + 1]) * (py[done + 1] - py[done]))
            keep = live[of]
            keep[drop] = False
            of, px, py = of[keep], px[keep], py[keep]
        return total

    return (side(hi) + side(-lo)) / 2


def batch_outlines(counts: np.ndarray, y: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(solidity, perimeter) of many objects of disjoint runs, at least one each."""
    of = np.repeat(np.arange(len(counts)), counts)
    if ((of[1:] == of[:-1]) & ((y[1:] < y[:-1]) | (y[1:] == y[:-1]) & (c0[1:] < c0[:-1]))).any():
        order = np.lexsort((c0, y, of))
        y, c0, c1 = y[order], c0[order], c1[order]
    left = np.minimum.reduceat(c0, np.cumsum(counts) - counts)
    c0, c1 = c0 - left[of], c1 - left[of]
    total = lambda v, at=of: np.bincount(at, weights=v, minlength=len(counts)).astype(np.int64)
    area = total(c1 - c0)
    again = (of[1:] == of[:-1]) & (y[1:] == y[:-1])
    joined = total(c0[1:][again] == c1[:-1][again], of[1:][again])
    begin = np.flatnonzero(np.concatenate(([True], ~again)))  # lines: an object's runs of one row
    line = np.cumsum(np.concatenate(([True], ~again))) - 1
    runs = np.diff(np.append(begin, len(y)))
    below = np.flatnonzero((of[begin][1:] == of[begin][:-1]) & (y[begin][1:] == y[begin][:-1] + 1))
    shared = np.zeros(len(counts), np.int64)
    after = np.zeros(len(begin), bool)
    after[below] = True
    runs_after = np.append(runs[1:], 0)
    pairs = np.where(after[line], runs_after[line], 0)
    reach = np.cumsum(pairs)
    lo = 0
    while lo < len(y):  # runs above meet all runs of the row below, about a million pairs at a time
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + 1_000_000, "right")))
        i = np.repeat(np.arange(lo, hi), pairs[lo:hi])
        j = begin[line[i] + 1] + within(pairs[lo:hi]) if len(i) else i
        over = np.minimum(c1[i], c1[j]) - np.maximum(c0[i], c0[j])
        np.add.at(shared, of[i], np.maximum(over, 0))
        lo = hi
    rows = np.bincount(of[begin], minlength=len(counts))
    hull = hull_areas(rows, c0[begin], c1[np.append(begin[1:], len(y)) - 1], y[begin])
    return area / hull, (2 * area + 2 * counts - 2 * joined - 2 * shared).astype(float)


def outline(runs: DataFrame, on: str = "slide_id", key: str = "det_id") -> DataFrame:
    """Solidity (area over hull of pixel squares) and perimeter (unit edges towards the outside) of cells from disjoint runs."""
    return outline_of(runs.groupBy(on, key).agg(F.collect_list(F.struct("row", "c0", "c1")).alias("r")).select(on, key, F.col("r.row").alias("row"), F.col("r.c0").alias("c0"), F.col("r.c1").alias("c1")), on, key)


def shapes(on: str, key: str) -> tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]:
    """``outline_of`` batches of objects, and its schema."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            solidity, perimeter = batch_outlines(*flat_lists(b, ("row", "c0", "c1"))) if b.num_rows else (np.empty(0), np.empty(0))
            yield pa.RecordBatch.from_arrays([b.column(on), b.column(key), pa.array(solidity), pa.array(perimeter)], names=[on, key, "solidity", "perimeter"])

    return measure, f"{on} long, {key} long, solidity double, perimeter double"


def outline_of(objects: DataFrame, on: str = "slide_id", key: str = "det_id") -> DataFrame:
    """``outline`` of cells whose runs are lists (row, c0, c1), a batch of cells at a time."""
    return objects.select(on, key, "row", "c0", "c1").filter(F.size("row") > 0).mapInArrow(*shapes(on, key))


def painted_outlines(boxes: DataFrame, key: str = "det_id") -> DataFrame:
    """``outline_of`` of ``painting.visible_objects``, measured where they are painted."""
    then, schema = shapes("slide_id", key)
    return visible_objects(boxes, key, then=then, schema=schema)
