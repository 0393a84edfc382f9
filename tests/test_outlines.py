"""Traced outlines against plain flood fills, and the parts and features made of them."""

import json

import numpy as np
import pytest

from ocellus.operators import outlines as O

SIDES, ALL = ((1, 0), (0, 1), (-1, 0), (0, -1)), O.AROUND


def flood(free, seeds, steps):
    """Pixels of ``free`` that steps reach from ``seeds``."""
    seen, todo = set(), [s for s in seeds if free[s[1], s[0]]]
    while todo:
        x, y = todo.pop()
        if (x, y) in seen:
            continue
        seen.add((x, y))
        todo += [(x + i, y + j) for i, j in steps if 0 <= x + i < free.shape[1] and 0 <= y + j < free.shape[0] and free[y + j, x + i]]
    return seen


@pytest.mark.parametrize("seed", range(60))
def test_borders_are_the_pixels_beside_the_outside(seed):
    rng = np.random.default_rng(seed)
    mask = np.pad(rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.choice([0.2, 0.5, 0.8]), 1)
    outside = flood(~mask, [(0, 0)], SIDES)
    want, done = set(), set()
    for y, x in zip(*np.nonzero(mask)):
        if (x, y) not in done:
            whole = flood(mask, [(x, y)], ALL)
            done |= whole
            edge = frozenset(p for p in whole if any((p[0] + i, p[1] + j) in outside for i, j in SIDES))
            want |= {edge} if edge else set()
    got = O.borders(mask)
    assert {frozenset(map(tuple, b.tolist())) for b in got} == want and len(got) == len(want)
    for b in got:  # neighbours in order are neighbours in the mask
        assert len(b) == 1 or (np.abs(np.roll(b, -1, axis=0) - b).max(axis=1) == 1).all()


def test_simplified_rings_stay_near():
    rng = np.random.default_rng(3)
    angle = np.linspace(0, 2 * np.pi, 900, endpoint=False)
    ring = np.stack((200 + 90 * np.cos(angle), 200 + 60 * np.sin(angle)), 1) + rng.normal(0, 0.2, (900, 2))
    slim = O.ring_simplified(ring)
    assert len(slim) < 80 and abs(O.area_of(slim) / O.area_of(ring) - 1) < 0.05
    ends = np.roll(slim, -1, axis=0)
    for p in ring:  # every point lies within the tolerance of some edge
        along = np.clip(((p - slim) * (ends - slim)).sum(1) / ((ends - slim) ** 2).sum(1), 0, 1)[:, None]
        assert np.hypot(*(slim + along * (ends - slim) - p).T).min() <= O.LOOSEST + 1e-9


def test_smoothing_keeps_boxes_and_drops_specks():
    box = np.zeros((12, 12), bool)
    box[3:9, 2:10] = True
    assert (O.smoothed(box) == box).all()
    line = np.zeros((9, 9), bool)
    line[4, 4] = True
    assert O.smoothed(line).sum() == 1 and (O.smoothed(line[:5]) == line[:5]).all()


def runs_of(spark, objects):
    rows = [(1, k, y, x0, x1) for k, boxes in objects.items() for x0, y0, x1, y1 in boxes for y in range(y0, y1)]
    return spark.createDataFrame(rows, "slide_id long, det_id long, row long, c0 long, c1 long")


def test_parts_reasons_and_features(spark):
    objects = {1: [(10, 10, 30, 20), (40, 10, 50, 20)], 2: [(60, 60, 61, 61)], 3: [(0, 0, 9, 9)], 4: [(80, 10, 82, 60)]}
    sizes = spark.createDataFrame([(1, 100, 100)], "slide_id long, width long, height long")
    parts = O.outline_parts(runs_of(spark, objects), sizes)
    why = {(r.det_id, r.part): r.reason for r in parts.collect()}
    assert why[1, 0] is None and why[1, 1] is None and why[2, 0] == "fewer than 3 unique vertices" and why[3, 0] is None
    cells = spark.createDataFrame([(1, 1, 300, 25.0, 14.5), (1, 2, 1, 60.0, 60.0), (1, 3, 1000, 4.0, 4.0)], "slide_id long, det_id long, area_px long, cx double, cy double")
    out = {(r.det_id, r.part_index): r for r in O.outline_features(cells, parts).collect()}
    assert set(out) == {(1, 1), (1, 2), (3, 1)} and out[3, 1].mismatch and not out[1, 1].mismatch
    first = json.loads(out[1, 1].feature)
    assert first["properties"]["name"] == "Cell 1 part 1" and first["properties"]["part_count"] == 2
    ring = first["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and {tuple(p) for p in ring} == {(10, 10), (29, 10), (29, 19), (10, 19)} and out[1, 1].exported_area == 19 * 9 + 9 * 9
    only = json.loads(out[3, 1].feature)["properties"]
    assert only["name"] == "Cell 3" and "part_index" not in only and {tuple(p) for p in json.loads(out[3, 1].feature)["geometry"]["coordinates"][0]} == {(0, 0), (8, 0), (8, 8), (0, 8)}


def test_no_objects_no_parts(spark):
    empty = runs_of(spark, {})
    assert O.outline_parts(empty).count() == 0 and O.outline_parts(empty, spark.createDataFrame([], "slide_id long, width long, height long")).count() == 0


def test_touching_ring_is_refused(spark):
    # two blocks that meet at a corner are one object whose border passes that corner twice
    parts = O.outline_parts(runs_of(spark, {7: [(10, 10, 30, 30), (30, 30, 50, 50)]})).collect()
    assert [p.reason for p in parts] == ["self-intersecting or self-touching contour"]
