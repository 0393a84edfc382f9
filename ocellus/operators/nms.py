"""Greedy non-maximum suppression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ocellus.operators.grouped import by_group, close_pairs, group_numbers


def greedy(x1, y1, x2, y2, score, ident, num: int, den: int) -> np.ndarray:
    """Whether each box stays: boxes in order of score (then identifier), unless one that stays overlaps by IoU > num / den."""
    order = np.lexsort((ident, -score))
    x1, y1, x2, y2 = (np.asarray(v)[order].astype(np.int64) for v in (x1, y1, x2, y2))
    area = (x2 - x1) * (y2 - y1)
    alive = np.ones(len(order), dtype=bool)
    for i in range(len(order)):
        if not alive[i]:
            continue
        w = np.minimum(x2[i], x2[i + 1 :]) - np.maximum(x1[i], x1[i + 1 :])
        h = np.minimum(y2[i], y2[i + 1 :]) - np.maximum(y1[i], y1[i + 1 :])
        inter = np.maximum(w, 0) * np.maximum(h, 0)
        alive[i + 1 :] &= inter * den <= (area[i] + area[i + 1 :] - inter) * num
    out = np.empty(len(order), dtype=bool)
    out[order] = alive
    return out


def stays(n: int, better: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """Which of n boxes stay by greedy suppression, from the pairs in conflict.

    A box that no undecided better one contests stays and removes those it contests;
    rounds end when no pair is open, so boxes without conflicts cost nothing.
    """
    alive = np.ones(n, dtype=bool)
    while len(better):
        contested = np.zeros(n, dtype=bool)
        contested[worse] = True
        wins = ~contested[better]
        alive[worse[wins]] = False
        open_ = ~wins & alive[better] & alive[worse]
        better, worse = better[open_], worse[open_]
    return alive


def nms(dets: DataFrame, group: list[str], ident: str = "det_id", num: int = 3, den: int = 10) -> DataFrame:
    """The detections that stay in their group (a window: its size bounds the group). Only the needed columns go through Python, many groups a call."""
    slim = dets.select(*group, ident, "score", "x1", "y1", "x2", "y2")

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        x1, y1, x2, y2 = (part[c].to_numpy(np.int64) for c in ("x1", "y1", "x2", "y2"))
        i, j = close_pairs(group_numbers(part, group), x1, y1, x2, y2, num, den)
        rank = np.empty(len(part), np.int64)
        rank[np.lexsort((part[ident].to_numpy(), -part["score"].to_numpy()))] = np.arange(len(part))
        first = rank[i] < rank[j]
        return part[stays(len(part), np.where(first, i, j), np.where(first, j, i))]

    return by_group(slim, group, keep, slim.schema)


def nms_fold(dets: DataFrame, group: list[str], ident: str = "det_id", num: int = 3, den: int = 10) -> DataFrame:
    """The same with expressions alone: a fold over each group's sorted boxes. For small groups and for checks.

    Only boxes in conflict with another one of their group are folded; the others stay in any case.
    """
    slim = dets.select(*group, ident, "score", "x1", "y1", "x2", "y2").filter(" AND ".join(f"{g} IS NOT NULL" for g in group))
    box = F.struct((-F.col("score")).alias("s"), F.col(ident).alias("i"), "x1", "y1", "x2", "y2")
    kind = T.ArrayType(T.StructType([T.StructField("s", T.DoubleType()), T.StructField("i", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("x1", "y1", "x2", "y2")]]))

    def inter(a, b):
        side = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
        return side("x1", "x2") * side("y1", "y2")

    def area(a):
        return (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])

    def step(kept, d):
        clash = F.exists(kept, lambda k: inter(k, d) * den > (area(k) + area(d) - inter(k, d)) * num)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(d)))


    def mark(part: pd.DataFrame) -> pd.DataFrame:
        i, j = close_pairs(group_numbers(part, group), *(part[c].to_numpy(np.int64) for c in ("x1", "y1", "x2", "y2")), num, den)
        met = np.zeros(len(part), dtype=bool)
        met[i] = met[j] = True
        return part.assign(met=met)

    marked = by_group(slim, group, mark, ", ".join(f"{n} {t}" for n, t in slim.dtypes) + ", met boolean")
    folded = marked.filter("met").groupBy(*group).agg(F.array_sort(F.collect_list(box)).alias("b"))
    kept = folded.select(*group, F.explode(F.aggregate(F.col("b").cast(kind), F.array().cast(kind), step)).alias("k"))
    return marked.filter("NOT met").select(*group, ident).unionByName(kept.select(*group, F.col("k.i").alias(ident)))
