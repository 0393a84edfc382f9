"""Steps whose rows and results must not outgrow the input."""

import numpy as np
from pyspark.sql import functions as F

from ocellus.operators import spatial as X
from ocellus.operators import windows as W
from ocellus.plans import basics, cells, geometry, guidance, records, statistics, tables, tumours  # noqa: F401
from ocellus.plans.registry import QUERIES
from ocellus.sources.adapters import Tables

BOX = "slide_id long, x1 long, y1 long, x2 long, y2 long"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_roi_windows_broadcasts_no_raster(spark, sf):
    """the dense thumbnail of every slide was broadcast, and so met in the driver."""
    w = spark.createDataFrame([(1, 0, 0, 100, 100), (1, 50, 0, 150, 100), (2, 0, 0, 100, 100), (None, 0, 0, 100, 100)], BOX)
    mask = spark.createDataFrame([(1, 0, 0, 1), (1, 3, 1, 1), (1, 4, 4, 0), (1, 39, 39, 1)], "slide_id long, px long, py long, v int")
    got = {(r.slide_id, r.x1): (r.inside, r.total) for r in W.roi_coverage(w, mask, F.lit(0.04), 40).collect()}
    assert got == {(1, 0): (2, 16), (1, 50): (1, 16), (2, 0): (0, 16)}
    assert "Join LeftOuter" not in plan(QUERIES["roi_windows"](spark, sf))


def test_coverage_moves_no_pixel_rows(spark):
    """a row per window and raster pixel was joined."""
    rng = np.random.default_rng(3)
    box = lambda n, size: [(int(s), int(x), int(y), int(x) + int(a), int(y) + int(b)) for s, x, y, a, b in zip(rng.integers(1, 4, n), rng.integers(0, 300, n), rng.integers(0, 300, n), rng.integers(1, size, n), rng.integers(1, size, n))]
    windows, regions = box(40, 150) + [(9, 0, 0, 100, 100)], box(25, 80)
    want = set()
    for s, x1, y1, x2, y2 in windows:
        pixels = [(x, y) for x in range(-(-x1 // 7) * 7, x2, 7) for y in range(-(-y1 // 7) * 7, y2, 7)]
        if pixels:
            want.add((s, x1, y1, x2, y2, sum(any(s == t and a <= x < c and b <= y < d for t, a, b, c, d in regions) for x, y in pixels), len(pixels)))
    df = X.coverage(spark.createDataFrame(windows, BOX), spark.createDataFrame(regions, BOX), 7)
    assert {tuple(r) for r in df.collect()} == want
    assert "Generate" not in plan(df)


def test_nearest_moves_a_box_once(spark, sf):
    """a row per box and grid cell was shuffled, in every round anew."""
    t = Tables(spark, sf)
    tumors = t.tumors.unionByName(t.tumors.withColumns({"tumor_key": F.col("tumor_key") + 5000, "x1": F.col("x1") + 9, "x2": F.col("x2") + 9}))
    packed = X.nearest(t.detections, tumors, "det_id", "tumor_key", 2000)
    assert "Generate" not in plan(packed)
    want = sorted(tuple(r) for r in packed.collect())
    for limit in (0, 40):  # every slide by rings, some by rings
        assert sorted(tuple(r) for r in X.nearest(t.detections, tumors, "det_id", "tumor_key", 2000, packed=limit).select(packed.columns).collect()) == want
        if limit:
            near = X.with_nearest(t.detections, tumors, ["slide_id", "det_id"], "tumor_key", 2000, packed=limit).select(packed.columns)
            assert sorted(tuple(r) for r in near.filter("gap2 IS NOT NULL").collect()) == want
            assert near.count() == t.detections.count()


def test_suppression_by_conflicts(spark):
    """every box met every better one of its window."""
    from ocellus.operators.nms import greedy, nms, nms_fold

    rng = np.random.default_rng(5)
    n = 3000
    x, y, w, h = rng.integers(0, 400, n), rng.integers(0, 400, n), rng.integers(5, 60, n), rng.integers(5, 60, n)
    rows = list(zip(rng.integers(0, 9, n).tolist(), range(n), (rng.integers(0, 6, n) / 5).tolist(), x.tolist(), y.tolist(), (x + w).tolist(), (y + h).tolist()))
    want = set()
    for g in range(9):
        part = [np.array(c) for c in zip(*[r for r in rows if r[0] == g])]
        want |= set(part[1][greedy(part[3], part[4], part[5], part[6], part[2], part[1], 3, 10)].tolist())
    df = spark.createDataFrame(rows, "g long, det_id long, score double, x1 long, y1 long, x2 long, y2 long")
    assert {r.det_id for r in nms(df, ["g"]).collect()} == want
    assert {r.det_id for r in nms_fold(df, ["g"]).collect()} == want
    assert "FlatMapGroups" not in plan(nms(df, ["g"]))


def test_cells_in_one_pass_over_a_slide(spark, sf):
    """Detections were shuffled once per grid cell, side and join."""
    from ocellus.operators import cells as C

    t = Tables(spark, sf)
    more = t.detections.limit(2).withColumns({"x1": F.lit(None).cast("long"), "det_id": -F.col("det_id")})
    dets = t.detections.unionByName(t.detections.withColumns({"det_id": F.col("det_id") + 10**6, "x1": F.col("x1") + 11, "x2": F.col("x2") + 11})).unionByName(more)
    want = sorted(map(repr, C.merged(C.roots(dets)).collect()))
    for crowded in (10**6, 900, 0):  # in one pass, some slides by edges, all of them
        assert sorted(map(repr, C.merge_boxes(dets, crowded=crowded).collect())) == want
    assert "Join" not in plan(C.merge_boxes(dets))


def test_painting_moves_no_runs(spark, sf):
    """rows of pixels were cut, joined and sorted."""
    from ocellus.operators import cells as C
    from ocellus.operators.painting import visible_sums

    dets = Tables(spark, sf).detections.filter("slide_id < 4")
    runs = C.visible_runs(C.box_rows(dets.select("slide_id", "det_id", "score", "x1", "y1", "x2", "y2")), "slide_id", [F.col("score").desc(), F.col("det_id")])
    want = sorted(map(repr, C.region_properties(runs, ["slide_id", "det_id"]).collect()))
    shapes = sorted(map(repr, C.moments(runs, ["slide_id", "det_id"]).collect()))
    for tile, crowded in ((1024, 20000), (64, 20000), (512, 0)):  # whole, cut into tiles, by rasters
        sums = visible_sums(dets, "det_id", tile, crowded)
        assert "Join" not in plan(sums.drop("_")).split("MapInPandas")[0]
        assert sorted(map(repr, C.painted_properties(sums, ["slide_id", "det_id"]).collect())) == want
        assert sorted(map(repr, C.painted_moments(sums, ["slide_id", "det_id"]).collect())) == shapes


def test_sizes_in_the_units_of_a_query(spark):
    """the query's SQL stops at GB, the operator at TB; decimals of halves were rounded from shortened text."""
    from ocellus.functions import scalars as S

    values = [0, 1023, 1024, 1280, 1536 + 256, 3 * 1024**4, -5 * 1024**4, 1024**3 + 53687091]
    df = spark.createDataFrame([(v,) for v in values], "n long")
    got = [tuple(r) for r in df.select(S.bytes_text(F.col("n")), S.bytes_text(F.col("n"), ("B", "KB", "MB", "GB"))).collect()]
    assert [g[0] for g in got] == ["0.0 B", "1023.0 B", "1.0 KB", "1.2 KB", "1.8 KB", "3.0 TB", "-5.0 TB", "1.0 GB"]
    assert got[5][1] == "3072.0 GB" and got[6][1] == "-5120.0 GB"


def test_rows_are_made_after_the_shuffle(spark, sf):
    """runs and crossings were shuffled, a row each."""
    assert "Window" not in plan(QUERIES["polygon_spans"](spark, sf))
    assert "Join" not in plan(QUERIES["mask_out_invalid"](spark, sf)).split("Generate explode(sequence(y1")[0]


def test_one_file_a_slide(spark, sf, tmp_path):
    """Every task wrote a file for every slide."""
    from ocellus.sources.readers import write_cells

    df = spark.range(0, 4000, 1, 8).selectExpr("id % 10 AS slide_id", "id AS cell_id")
    write_cells(df, str(tmp_path / "cells"))
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "cells").glob("slide_id=*"))
    assert spark.read.parquet(str(tmp_path / "cells")).count() == 4000


def test_outlines_check_their_rings_where_they_are_traced():
    """every ring's edges were exploded, shuffled and joined."""
    from ocellus.operators.outlines import crosses_itself

    square, bow = [(0, 0), (9, 0), (9, 9), (0, 9)], [(0, 0), (9, 9), (9, 0), (0, 9)]
    twice, spike = [(0, 0), (5, 5), (9, 0), (5, 5), (0, 9)], [(0, 0), (9, 0), (9, 9), (4, 0), (0, 9)]
    assert [crosses_itself(np.array(r, float)) for r in (square, bow, twice, spike)] == [False, True, True, True]


def test_quantiles_are_those_of_the_sql(spark):
    """F16: quantiles differed in their last bit, and boxes on the border of a bin went to its other side."""
    import duckdb

    from ocellus.functions import scalars as S

    rng = np.random.default_rng(7)
    rows = [(g, float(v) / 16) for g in range(60) for v in rng.integers(400, 4200, int(rng.integers(1, 400)))] + [(60, 5.0)] * 9 + [(61, None)]
    df = spark.createDataFrame(rows, "g long, v double")
    values = df.groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("v"))
    got = {tuple(r) for r in values.select("g", *[S.quantile_cont(F.col("v"), p).alias(f"q{i}") for i, p in enumerate((0.01, 0.5, 0.95, 0.99))]).collect()}
    frame = df.toPandas()  # noqa: F841  read by name
    assert got == set(duckdb.sql("SELECT g, quantile_cont(v, 0.01), quantile_cont(v, 0.5), quantile_cont(v, 0.95), quantile_cont(v, 0.99) FROM frame GROUP BY g").fetchall())


def test_bins_without_width(spark, sf):
    """F16: a slide of one box has bins of no width, which divided by zero; its SQL counts the box in the last ones."""
    from types import SimpleNamespace

    import duckdb

    from ocellus.plans.registry import ORACLES

    t = Tables(spark, sf)
    boxes = [(1, 0, 0, 30, 30, 900), (2, 7, 5, 30, 30, 575), (2, 7, 5, 30, 30, 575), (3, 3, 4, 30, 30, 700), (3, 6, 8, 30, 30, 800)]
    d = spark.createDataFrame([(i, *b, 0.5) for i, b in enumerate(boxes)], "det_id long, slide_id long, x1 long, y1 long, x2 long, y2 long, area_px long, score double")
    got = {tuple(r) for r in statistics.cohort_dist_size_hist(SimpleNamespace(detections=d, slides=t.slides)).collect()}
    slides, frame = t.slides.toPandas(), d.toPandas()  # noqa: F841  read by name
    sql = ORACLES["cohort_dist_size_hist"]
    want = set(duckdb.sql("WITH detections AS (SELECT * FROM frame), " + sql[sql.index("d AS (SELECT d.*") :]).fetchall())
    assert got == want and {w[0] for w in want} == {1, 2}


def test_detections_are_ranked_after_the_shuffle(spark, sf):
    """every input split of line items was sorted whole before its rows were dealt, and spilled."""
    t = Tables(spark, sf)
    lines = t.detections._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(l_orderkey" in line]
    ranked = [i for i, line in enumerate(lines) if "Sort [" in line or "WindowGroupLimit" in line]
    assert len(dealt) == 1 and ranked and max(ranked) < dealt[0]
    assert "l_tax" not in "".join(lines) and t.detections.count() == t.lineitem.select("l_orderkey", "l_linenumber").distinct().count()


def test_dealt_partitions_follow_the_input(spark, sf, monkeypatch):
    """with few shuffle partitions a partition grew with the input, and its sort spilled."""
    import re

    from ocellus.sources import adapters

    parts = lambda t: int(re.search(r"Exchange hashpartitioning\(l_orderkey#\d+L, l_linenumber#\d+, (\d+)\)", t.detections._jdf.queryExecution().executedPlan().toString())[1])
    t = Tables(spark, sf)
    few, want = int(spark.conf.get("spark.sql.shuffle.partitions")), sorted(map(repr, t.detections.collect()))
    assert parts(t) == few
    monkeypatch.setattr(adapters, "DEALT_BYTES", 10_000, raising=False)
    assert parts(t) == -(-t.lineitem._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() // 10_000) > few
    assert sorted(map(repr, t.detections.collect())) == want


def test_full_mask_moves_no_runs(spark, sf):
    """r03 F1: a row per run was shuffled, sorted, written to a folder per slide and shuffled again."""
    from ocellus.operators import cells as C
    from ocellus.operators.painting import row_pixels, runs_of, visible_objects

    dets = Tables(spark, sf).detections.filter("slide_id < 4")
    runs = C.visible_runs(C.box_rows(dets.select("slide_id", "det_id", "score", "x1", "y1", "x2", "y2")), "slide_id", [F.col("score").desc(), F.col("det_id")])
    want = sorted(map(tuple, runs.groupBy("slide_id", "row", "det_id").agg(F.sum(F.col("c1") - F.col("c0"))).collect()))
    for tile in (1024, 64):  # hardly any boxes cut, most of them
        objects = visible_objects(dets, "det_id", tile)
        assert sorted(map(tuple, row_pixels(objects).collect())) == want
        assert objects.count() == objects.select("slide_id", "det_id").distinct().count()
        assert runs_of(objects).agg(F.sum(F.col("c1") - F.col("c0"))).first()[0] == sum(w[3] for w in want)
    mask = plan(QUERIES["full_mask"](spark, sf))
    assert "Aggregate" not in mask and "Generate" not in mask and "Repartition" not in mask


def test_outlines_of_a_batch_are_those_of_each_object():
    """r03 F2: objects were smoothed, traced, simplified and checked one at a time."""
    from ocellus.operators import outlines as O

    rng = np.random.default_rng(11)
    runs, want = [], []
    for k in range(240):
        m = np.zeros((120, 120), bool)
        y, x = rng.choice([0, 1, 2, 5, 60, 90], 2)  # also at the image's ends
        h, w = rng.integers(1, 55, 2)
        m[y : y + h, x : x + w] = True
        for _ in range(k % 4):
            b, a = y + rng.integers(0, h), x + rng.integers(0, w)
            m[b : b + rng.integers(1, 25), a : a + rng.integers(1, 25)] = False
        if k % 4 == 3:
            m &= rng.random(m.shape) < 0.7
        if k % 40 == 0:  # a ring with an island, and one of a long border
            m[:] = False
            m[10:110:2, 10:100] = m[10:110, 10] = True
            m[20:60, 20:60], m[25:55, 25:55], m[30:40, 30:40] = True, False, True
        if m.any():
            step = np.diff(np.pad(m.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            runs.append((*np.nonzero(step == 1), np.nonzero(step == -1)[1]))
    for i, (r, a, z) in enumerate(runs):
        for area, ring in O.parts_of(r, a, z, 120, 120):
            corners = len(set(map(tuple, ring.tolist())))
            fault = 1 if corners < 3 else 2 if O.area_of(ring) <= 1e-6 else 3 if O.crosses_itself(ring) else 0
            want.append((i, area, ring.tolist(), fault, O.area_of(ring)))
    ends = np.full(len(runs), 120)
    obj, area, n, x, y, fault, ring_area = O.many_parts(np.array([len(r[0]) for r in runs]), *(np.concatenate(v) for v in zip(*runs)), ends, ends)
    rings = [p.tolist() for p in np.split(np.stack((x, y), 1), np.cumsum(n)[:-1])]
    assert list(zip(obj.tolist(), area.tolist(), rings, fault.tolist(), ring_area.tolist())) == want
    assert set(fault.tolist()) >= {0, 1, 3} and max(n) > 100


def test_outlines_are_painted_and_numbered_in_one_pass(spark, sf):
    """r03 F2: detections were painted three times, traced parts written, and both joined."""
    painted = plan(QUERIES["outline_painted"](spark, sf))
    assert painted.count("Join") == painted.count("Join LeftOuter") == 2  # the slide's size, for boxes that tiles cut and for others
    assert painted.count("MapInArrow") == 3 and "MapInPandas" not in painted and "windowspecdefinition(slide_id" not in painted


def test_shapes_of_a_batch_are_those_of_each_cell():
    """r03 F3: a cell's hull and perimeter were measured one cell at a time."""
    from ocellus.operators import cells as C

    def hull(points):
        def half(seq):
            out = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        pts = sorted(points)
        v = half(pts) + half(pts[::-1])
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(v, v[1:] + v[:1]))) / 2

    rng = np.random.default_rng(2)
    runs, want = [], []
    for k in range(150):
        m = np.ones(rng.integers(1, 30, 2), bool)
        for _ in range(k % 4):
            y, x = rng.integers(0, m.shape[0]), rng.integers(0, m.shape[1])
            m[y : y + rng.integers(1, 12), x : x + rng.integers(1, 12)] = False
        if k % 4 == 3:
            m &= rng.random(m.shape) < 0.6
        if not m.any():
            continue
        step = np.diff(np.pad(m.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        r, a, z = *np.nonzero(step == 1), np.nonzero(step == -1)[1]
        cut = np.flatnonzero(z - a > 2)  # runs that touch, in any order
        r, a, z = np.append(r, r[cut]), np.append(a, a[cut] + 1), np.append(np.where(z - a > 2, a + 1, z), z[cut])
        mixed = rng.permutation(len(r))
        runs.append((r[mixed] + 7, a[mixed] - 3 + k, z[mixed] - 3 + k))
        ys, xs = np.nonzero(m)
        edges = sum(np.abs(np.diff(np.pad(m.astype(int), 1), axis=i)).sum() for i in (0, 1))
        want.append((m.sum() / hull({(int(x) + i, int(y) + j) for x, y in zip(xs, ys) for i in (0, 1) for j in (0, 1)}), float(edges)))
    got = C.batch_outlines(np.array([len(r[0]) for r in runs]), *(np.concatenate(v) for v in zip(*runs)))
    assert list(zip(*(g.tolist() for g in got))) == want
