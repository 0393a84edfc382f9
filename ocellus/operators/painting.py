"""What stays visible of boxes painted over one another, without a row per pixel or run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.operators.grouped import box_pairs, by_group, flat_lists, group_numbers, list_column, within

BOX = ["x1", "y1", "x2", "y2"]
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy", "x1", "y1", "x2", "y2"]


def whole_sums(x1, y1, x2, y2) -> np.ndarray:
    """SUMS of boxes of which nothing is hidden: pixels, sums of x, y, xx, yy and xy over them, and the box."""
    one = lambda a, b: (b * (b - 1) - a * (a - 1)) // 2
    two = lambda a, b: ((b - 1) * b * (2 * b - 1) - (a - 1) * a * (2 * a - 1)) // 6
    w, h = x2 - x1, y2 - y1
    return np.stack([w * h, h * one(x1, x2), w * one(y1, y2), h * two(x1, x2), w * two(y1, y2), one(x1, x2) * one(y1, y2), x1, y1, x2, y2], axis=1)


def hidden_masks(x1, y1, x2, y2, over: np.ndarray, under: np.ndarray, room: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(boxes, visible) of the boxes ``under`` others: a block of masks at a time, those of like size together."""
    who = np.unique(under)
    who = who[np.argsort((x2 - x1)[who] * (y2 - y1)[who], kind="stable")]
    place = np.full(len(x1), -1)
    place[who] = np.arange(len(who))
    order = np.argsort(place[under], kind="stable")
    over, under = over[order], under[order]
    spot = place[under]
    lo = 0
    while lo < len(who):
        size = lambda hi: int((x2 - x1)[who[lo:hi]].max() + 1) * int((y2 - y1)[who[lo:hi]].max() + 1) * (hi - lo)  # noqa: E731, B023
        hi = min(len(who), lo + 4096)
        while hi - lo > 1 and size(hi) > room:
            hi = lo + (hi - lo) // 2
        b = who[lo:hi]
        h, w = (y2 - y1)[b], (x2 - x1)[b]
        diff = np.zeros((hi - lo, int(h.max()) + 1, int(w.max()) + 1), np.int32)
        p = slice(*np.searchsorted(spot, (lo, hi)))
        o, u, k = over[p], under[p], spot[p] - lo
        left, top = np.maximum(x1[o], x1[u]) - x1[u], np.maximum(y1[o], y1[u]) - y1[u]
        right, low = np.minimum(x2[o], x2[u]) - x1[u], np.minimum(y2[o], y2[u]) - y1[u]
        for r, c, sign in ((top, left, 1), (low, right, 1), (top, right, -1), (low, left, -1)):
            np.add.at(diff, (k, r, c), sign)
        free = diff.cumsum(axis=1).cumsum(axis=2)[:, :-1, :-1] == 0
        yield b, free & (np.arange(free.shape[1]) < h[:, None])[:, :, None] & (np.arange(free.shape[2]) < w[:, None])[:, None, :]
        lo = hi


def mask_sums(visible: np.ndarray, left: np.ndarray, top: np.ndarray) -> np.ndarray:
    """SUMS of masks (k, rows, columns) whose first pixels stand at left, top; n is 0 where nothing is visible."""
    _, rows, cols = visible.shape
    y, x = top[:, None] + np.arange(rows), left[:, None] + np.arange(cols)
    by_row, by_col = visible.sum(axis=2, dtype=np.int64), visible.sum(axis=1, dtype=np.int64)
    x_of_row = (visible.reshape(-1, cols).astype(np.float64) @ np.arange(cols, dtype=np.float64)).astype(np.int64).reshape(by_row.shape) + left[:, None] * by_row
    any_row, any_col = by_row > 0, by_col > 0
    return np.stack([
        by_row.sum(1), (by_col * x).sum(1), (by_row * y).sum(1), (by_col * x * x).sum(1), (by_row * y * y).sum(1), (x_of_row * y).sum(1),
        left + any_col.argmax(1), top + any_row.argmax(1), left + cols - any_col[:, ::-1].argmax(1), top + rows - any_row[:, ::-1].argmax(1),
    ], axis=1)


def raster_sums(x1, y1, x2, y2, rank) -> np.ndarray:
    """SUMS of one tile's boxes from its painted raster, for tiles with more boxes than pairs of them could be kept."""
    left, top = int(x1.min()), int(y1.min())
    raster = np.full((int(y2.max()) - top, int(x2.max()) - left), -1, np.int64)
    for k in np.argsort(-rank):
        raster[y1[k] - top : y2[k] - top, x1[k] - left : x2[k] - left] = k
    y, x = np.nonzero(raster >= 0)
    k = raster[y, x]
    y, x = y + top, x + left
    out = np.zeros((len(x1), len(SUMS)), np.int64)
    for c, v in enumerate((np.ones(len(k), np.int64), x, y, x * x, y * y, x * y)):
        np.add.at(out[:, c], k, v)
    out[:, 6:8] = np.iinfo(np.int64).max
    for c, f, v in ((6, np.minimum, x), (7, np.minimum, y), (8, np.maximum, x + 1), (9, np.maximum, y + 1)):
        f.at(out[:, c], k, v)
    return out


def tiled(boxes: DataFrame, tile: int) -> DataFrame:
    """Boxes cut at the tiles (tx, ty) of their slide; rows with a missing value or without area have none."""
    known = boxes.filter(" AND ".join(f"{c} IS NOT NULL" for c in ["slide_id", *BOX]) + " AND x1 < x2 AND y1 < y2")
    across = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor((F.col(hi) - 1) / tile)))
    cut = known.withColumn("tx", across("x1", "x2")).withColumn("ty", across("y1", "y2"))
    least = lambda c, t: F.greatest(F.col(c), F.col(t) * tile).alias(c)
    most = lambda c, t: F.least(F.col(c), (F.col(t) + 1) * tile).alias(c)
    return cut.select(*[c for c in boxes.columns if c not in BOX], "tx", "ty", least("x1", "tx"), least("y1", "ty"), most("x2", "tx"), most("y2", "ty"))


def ranks(part: pd.DataFrame, key: str) -> np.ndarray:
    """0 for the box that is painted last, by falling score and then by key."""
    rank = np.empty(len(part), np.int64)
    rank[np.lexsort((part[key].to_numpy(), -part["score"].to_numpy(np.float64)))] = np.arange(len(part))
    return rank


def visible_sums(boxes: DataFrame, key: str, tile: int = 1024, crowded: int = 20_000, named: tuple[str, ...] = ()) -> DataFrame:
    """(slide_id, key, SUMS) of the visible pixels of boxes (slide_id, key, score, box); of two the higher score, then the smaller key, is on top.

    Hidden boxes drop out; ``named`` columns (double) of the boxes stay. All sums are whole numbers, so tiles add up exactly.
    """

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        x1, y1, x2, y2 = (part[c].to_numpy(np.int64) for c in BOX)
        rank, group = ranks(part, key), group_numbers(part, ["slide_id", "tx", "ty"])
        out = whole_sums(x1, y1, x2, y2)
        many = np.bincount(group)[group] > crowded
        few = np.flatnonzero(~many)
        pairs = [(few[i], few[j]) for i, j in box_pairs(group[few], x1[few], y1[few], x2[few], y2[few])]
        if pairs:
            i, j = (np.concatenate(p) for p in zip(*pairs))
            first = rank[i] < rank[j]
            for b, visible in hidden_masks(x1, y1, x2, y2, np.where(first, i, j), np.where(first, j, i)):
                out[b] = mask_sums(visible, x1[b], y1[b])
        for g in np.unique(group[many]):
            at = np.flatnonzero(group == g)
            out[at] = raster_sums(x1[at], y1[at], x2[at], y2[at], rank[at])
        got = pd.DataFrame(out, columns=SUMS)
        got.insert(0, key, part[key].to_numpy(np.int64))
        got.insert(0, "slide_id", part["slide_id"].to_numpy(np.int64))
        for c in named:
            got[c] = part[c]
        return got[got["n"] > 0]

    slim = tiled(boxes.select("slide_id", key, "score", *BOX).filter(F.col(key).isNotNull()), tile)
    got = by_group(slim, ["slide_id", "tx", "ty"], sums, ", ".join(f"{c} long" for c in ["slide_id", key, *SUMS]) + "".join(f", {c} double" for c in named))
    ends = {"x1": F.min, "y1": F.min, "x2": F.max, "y2": F.max}
    return got.groupBy("slide_id", key, *named).agg(*[ends.get(c, F.sum)(c).alias(c) for c in SUMS])


def hidden_runs(x1, y1, x2, y2, over: np.ndarray, under: np.ndarray, room: int = 1_000_000) -> Iterator[tuple[np.ndarray, ...]]:
    """(boxes, number of runs of each, row, c0, c1) of the boxes ``under`` others, about ``room`` of their rows and the hidden stretches at a time.

    A row's hidden stretches in order of their begin leave a run wherever one begins behind the ends of all before it.
    """
    order = np.argsort(under, kind="stable")
    over, under = over[order], under[order]
    who, first = np.unique(under, return_index=True)
    first = np.append(first, len(under))
    top, low = np.maximum(y1[over], y1[under]), np.minimum(y2[over], y2[under])
    load = np.cumsum(np.add.reduceat(low - top, first[:-1]) + 2 * (y2 - y1)[who]) if len(who) else np.empty(0, np.int64)
    lo = 0
    while lo < len(who):
        hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + room, "right")))
        b, p = who[lo:hi], slice(first[lo], first[hi])
        h = (y2 - y1)[b]
        line0 = np.cumsum(h) - h  # lines count the rows of the block's boxes
        o, u, t, n = over[p], under[p], top[p], (low - top)[p]
        spot = np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1]))
        lines = np.arange(int(h.sum()))
        at = np.repeat(np.arange(hi - lo), h)
        left, right, width = np.maximum(x1[o], x1[u]) - x1[u], np.minimum(x2[o], x2[u]) - x1[u], (x2 - x1)[b]
        line = np.concatenate((lines, np.repeat(line0[spot] + t - y1[u], n) + within(n), lines))
        begin = np.concatenate((np.zeros(len(lines), np.int64), np.repeat(left, n), width[at]))
        stop = np.concatenate((np.zeros(len(lines), np.int64), np.repeat(right, n), width[at]))
        wide = int(width.max()) + 1
        key = line * wide + begin
        order = np.argsort(key, kind="stable")
        key, reach = key[order], np.maximum.accumulate((line * wide + stop)[order])  # later lines are larger, so a reach ends with its line
        free = np.flatnonzero((key[1:] > reach[:-1]) & (key[1:] // wide == key[:-1] // wide))
        found, c0 = np.divmod(reach[free], wide)
        c1, k = key[free + 1] - found * wide, at[found]
        yield b, np.bincount(k, minlength=hi - lo), found - line0[k] + y1[b][k], c0 + x1[b][k], c1 + x1[b][k]
        lo = hi


def visible_objects(boxes: DataFrame, key: str, tile: int = 1024, carried: tuple[str, ...] = (), then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str = "") -> DataFrame:
    """(slide_id, key, row, c0, c1): each box's visible runs as lists in order of rows, painted as by ``visible_sums``; hidden boxes drop out.

    ``key`` stands once in a slide. Only boxes cut by a tile are brought together again, and only they are painted for that.
    ``carried`` columns (long, without nulls) of the boxes stay. ``then`` turns batches of whole objects into ``schema``; it runs where
    they are painted, so that runs do not leave Python before.
    """
    known = boxes.select("slide_id", key, "score", *BOX, *carried).filter(F.col(key).isNotNull())
    cut = (F.floor(F.col("x1") / tile) != F.floor((F.col("x2") - 1) / tile)) | (F.floor(F.col("y1") / tile) != F.floor((F.col("y2") - 1) / tile))
    slim = tiled(known.withColumn("cut", cut), tile)
    lists = ("row", "c0", "c1")

    def painted(wanted: bool) -> DataFrame:
        def paint(part: pd.DataFrame) -> pa.RecordBatch:
            x1, y1, x2, y2 = (part[c].to_numpy(np.int64) for c in BOX)
            rank, group, open_ = ranks(part, key), group_numbers(part, ["slide_id", "tx", "ty"]), part["cut"].to_numpy(bool) == wanted
            over, under = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, j in box_pairs(group, x1, y1, x2, y2):
                first = rank[i] < rank[j]
                o, u = np.where(first, i, j), np.where(first, j, i)
                over.append(o[open_[u]])
                under.append(u[open_[u]])
            over, under = np.concatenate(over), np.concatenate(under)
            whole = open_.copy()
            whole[under] = False
            at = np.flatnonzero(whole)
            h = (y2 - y1)[at]
            who, runs = [at], [(h, np.repeat(y1[at], h) + within(h), np.repeat(x1[at], h), np.repeat(x2[at], h))]
            for b, *found in hidden_runs(x1, y1, x2, y2, over, under):
                who.append(b)
                runs.append(found)
            who, (counts, *values) = np.concatenate(who), (np.concatenate(r) for r in zip(*runs))
            some = counts > 0
            names = [part[c].to_numpy(np.int64)[who[some]] for c in ("slide_id", key, *carried)]
            return pa.RecordBatch.from_arrays([*map(pa.array, names), *(list_column(v, counts[some]) for v in values)], names=["slide_id", key, *carried, *lists])

        objects = ", ".join(f"{c} long" for c in ("slide_id", key, *carried)) + "".join(f", {c} array<long>" for c in lists)
        last, of = (None, objects) if wanted or then is None else (then, schema)
        return by_group(slim, ["slide_id", "tx", "ty"], paint, of, packed=True, then=last)

    parts = painted(True).groupBy("slide_id", key, *carried).agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip(*lists)))).alias("r"))
    parts = parts.select("slide_id", key, *carried, *[F.col(f"r.{c}").alias(c) for c in lists])
    return painted(False).unionByName(parts if then is None else parts.mapInArrow(then, schema))


def runs_of(objects: DataFrame) -> DataFrame:
    """A row per run (row, c0, c1) of packed objects."""
    return objects.select(*[c for c in objects.columns if c not in ("row", "c0", "c1")], F.explode(F.arrays_zip("row", "c0", "c1")).alias("r")).select("*", "r.row", "r.c0", "r.c1").drop("r")


def row_pixels(objects: DataFrame, key: str = "det_id") -> DataFrame:
    """(slide_id, row, key, px): pixels in each row of packed objects, whose runs are summed where the object is."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, row, c0, c1 = flat_lists(b, ("row", "c0", "c1"))
            which = np.repeat(np.arange(len(counts)), counts)
            if ((which[1:] == which[:-1]) & (row[1:] < row[:-1])).any():
                order = np.lexsort((row, which))
                which, row, c0, c1 = which[order], row[order], c0[order], c1[order]
            begin = np.flatnonzero(np.concatenate(([len(row) > 0], (which[1:] != which[:-1]) | (row[1:] != row[:-1]))))
            px = np.add.reduceat(c1 - c0, begin) if len(begin) else np.empty(0, np.int64)
            of = lambda c: pa.array(b.column(c).to_numpy(zero_copy_only=False)[which[begin]])  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([of("slide_id"), pa.array(row[begin]), of(key), pa.array(px)], names=["slide_id", "row", key, "px"])

    return objects.select("slide_id", key, "row", "c0", "c1").mapInArrow(add, f"slide_id long, row long, {key} long, px long")
