"""Polygons as pixel spans, outlines and GeoJSON features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.functions.scalars import ring_area
from ocellus.operators.spatial import box_join


def polygon_spans(rings: DataFrame, key: str) -> DataFrame:
    """(key, row, c0, c1): pixels whose centre lies in the ring by the even-odd rule.

    Edges meet the centre lines of pixel rows; crossings in order pair up to spans.
    A key's edges travel as lists and meet their rows in numpy, so only rings are shuffled.
    """
    n = F.size("ring")
    edges = F.filter(F.transform("ring", lambda a, i: F.struct(a.alias("a"), F.get("ring", (i + 1) % n).alias("b"))), lambda e: e["a"]["y"] != e["b"]["y"])
    tasks = int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given is kept, though the rings are small beside their rows
    lists = rings.select(key, edges.alias("e")).repartition(tasks, key).groupBy(key).agg(F.flatten(F.collect_list("e")).alias("e")).filter(F.size("e") > 0)
    side = lambda v, c: F.transform("e", lambda e: e[v][c].cast("double")).alias(f"{v}{c}")
    lists = lists.select(key, side("a", "x"), side("a", "y"), side("b", "x"), side("b", "y"))

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.iloc[at : at + 1000]
                ax, ay, bx, by = (np.concatenate(b[c].to_list()) for c in ("ax", "ay", "bx", "by"))
                first, stop = (np.ceil(f(ay, by) - 0.5).astype(np.int64) for f in (np.minimum, np.maximum))  # rows whose centre line the edge crosses, its lower end excluded
                e = np.repeat(np.arange(len(ax)), stop - first)
                row = first[e] + np.arange(len(e)) - np.repeat(np.cumsum(stop - first) - (stop - first), stop - first)
                x = ax[e] + (row + 0.5 - ay[e]) * (bx[e] - ax[e]) / (by[e] - ay[e])
                ring = np.repeat(np.arange(len(b)), [len(v) for v in b["ax"]])[e]
                order = np.lexsort((x, row, ring))
                ring, row, x = ring[order], row[order], x[order]
                begin = np.flatnonzero(np.concatenate(([True], (ring[1:] != ring[:-1]) | (row[1:] != row[:-1])))) if len(x) else np.empty(0, np.int64)
                count = np.diff(np.append(begin, len(x)))
                place = np.arange(len(x)) - np.repeat(begin, count)
                i = np.flatnonzero((place % 2 == 0) & (place + 1 < np.repeat(count, count)))
                c0, c1 = np.ceil(x[i] - 0.5).astype(np.int64), np.ceil(x[i + 1] - 0.5).astype(np.int64)
                some = c0 < c1
                i = i[some]
                yield pd.DataFrame({key: b[key].to_numpy()[ring[i]], "row": row[i], "c0": c0[some], "c1": c1[some]})

    return lists.mapInPandas(cross, f"{key} {dict(rings.dtypes)[key]}, row long, c0 long, c1 long")


def self_touching(rings: DataFrame, key: str, near: float = 1e-9) -> DataFrame:
    """(key) of rings(key, ring) with a repeated vertex, or with two edges that are not neighbours and share a point.

    Edges meet by the grid cells of their boxes, so a ring of n edges costs their
    cells and not n squared. Two edges that are not parallel are solved for the
    place where their lines cross, as a share of either edge; of two on one line
    the second's ends are measured along the first.
    """
    repeated = rings.filter(F.size(F.array_distinct("ring")) < F.size("ring")).select(key)
    here, there = F.col("a"), F.get("ring", (F.col("i") + 1) % F.size("ring"))
    edges = rings.select(key, F.size("ring").alias("n"), "ring", F.posexplode("ring").alias("i", "a")).select(
        key, "n", "i", F.col("a.x").alias("px"), F.col("a.y").alias("py"), (there["x"] - here["x"]).alias("dx"), (there["y"] - here["y"]).alias("dy")
    )
    low = lambda p, d: F.floor(F.least(F.col(p), F.col(p) + F.col(d)) - near)
    high = lambda p, d: F.floor(F.greatest(F.col(p), F.col(p) + F.col(d)) + near) + 1
    boxed = edges.withColumns({"x1": low("px", "dx"), "x2": high("px", "dx"), "y1": low("py", "dy"), "y2": high("py", "dy")})
    pairs = box_join(boxed, boxed, on=key).filter("r.i > l.i + 1 and not (l.i = 0 and r.i = l.n - 1)")
    c = lambda n: F.col(n)
    wx, wy = c("r.px") - c("l.px"), c("r.py") - c("l.py")
    turn = c("l.dx") * c("r.dy") - c("l.dy") * c("r.dx")
    offset = wx * c("l.dy") - wy * c("l.dx")
    along = lambda x, y: (x * c("l.dx") + y * c("l.dy")) / (c("l.dx") * c("l.dx") + c("l.dy") * c("l.dy"))
    first, last = along(wx, wy), along(wx + c("r.dx"), wy + c("r.dy"))
    share = lambda v: v.between(-near, 1 + near)
    crossing = share((wx * c("r.dy") - wy * c("r.dx")) / turn) & share(offset / turn)
    on_line = (F.abs(offset) <= near) & (F.least(first, last) <= 1 + near) & (F.greatest(first, last) >= -near)
    meet = F.when(F.abs(turn) > near, crossing).otherwise(on_line)
    return repeated.union(pairs.filter(meet).select(F.col(f"l.{key}"))).distinct()


def valid_rings(rings: DataFrame, key: str, least_area: float = 1e-6) -> DataFrame:
    """The rings that are finite, have three vertices or more and an area, and do not touch themselves."""
    finite = F.forall("ring", lambda v: ~F.isnan(v["x"]) & ~F.isnan(v["y"]) & (F.abs(v["x"]) < float("inf")) & (F.abs(v["y"]) < float("inf")))
    sound = rings.filter(finite & (F.size(F.array_distinct("ring")) >= 3) & (ring_area(F.col("ring")) > least_area))
    return sound.join(self_touching(sound, key), key, "left_anti")


def feature_json(cells: DataFrame, ident: str = "det_id", name: str = "Cell", color: tuple[int, int, int] = (255, 0, 0)) -> DataFrame:
    """(ident, feature): a GeoJSON feature per box-shaped cell, with a closed ring and flat properties."""
    p = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    ring = F.array(p("x1", "y1"), p("x2", "y1"), p("x2", "y2"), p("x1", "y2"), p("x1", "y1"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.concat(F.lit(f"{name} "), F.col(ident)).alias("name"), F.lit("annotation").alias("objectType"),
            F.struct(F.lit(name).alias("name"), F.array(*[F.lit(c) for c in color]).alias("colorRGB")).alias("classification"),
            F.col("area_px").alias("area_pixels"), ((F.col("x1") + F.col("x2")) / 2).alias("centroid_x"), ((F.col("y1") + F.col("y2")) / 2).alias("centroid_y"), F.col(ident).alias("cell_id"),
        ).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return cells.select(ident, F.to_json(feature).alias("feature"))


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: points of a line farther than ``tolerance`` from the chord stay."""
    keep = np.zeros(len(points), dtype=bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        i, j = stack.pop()
        if j <= i + 1:
            continue
        chord = points[j] - points[i]
        away = points[i + 1 : j] - points[i]
        length = np.hypot(*chord)
        gap = np.abs(chord[0] * away[:, 1] - chord[1] * away[:, 0]) / length if length else np.hypot(away[:, 0], away[:, 1])
        k = int(np.argmax(gap))
        if gap[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def outer_contour(mask: np.ndarray) -> np.ndarray:
    """Corner points of the outer border of a mask's first object, in order, along pixel edges."""
    rows, cols = np.nonzero(mask)
    if not len(rows):
        return np.zeros((0, 2))
    padded = np.pad(mask.astype(bool), 1)
    y, x = rows[0] + 1, cols[np.flatnonzero(rows == rows[0])[0]] + 1
    start, at, heading = (x, y), (x, y), (1, 0)
    out = [at]
    while True:
        at = (at[0] + heading[0], at[1] + heading[1])
        px = lambda cx, cy: bool(padded[cy, cx])
        # the two pixels ahead of the corner, seen along the heading
        if heading == (1, 0):
            l, r = px(at[0], at[1] - 1), px(at[0], at[1])
        elif heading == (0, 1):
            l, r = px(at[0], at[1]), px(at[0] - 1, at[1])
        elif heading == (-1, 0):
            l, r = px(at[0] - 1, at[1]), px(at[0] - 1, at[1] - 1)
        else:
            l, r = px(at[0] - 1, at[1] - 1), px(at[0], at[1] - 1)
        turned = heading
        if l:
            turned = (heading[1], -heading[0])
        elif not r:
            turned = (-heading[1], heading[0])
        if at == start:
            break
        if turned != heading:
            out.append(at)
        heading = turned
    return np.array(out, dtype=float) - 1
