"""Known answers, invariants and differential checks."""

import json
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ocellus.config import EngineConfig
from ocellus.functions import scalars as S
from ocellus.operators import cells as C
from ocellus.operators import geometry as G
from ocellus.operators import spatial as X
from ocellus.operators.components import components, components_by_slide, union_find
from ocellus.operators.nms import greedy
from ocellus.operators.tumors import distances, instances
from ocellus.operators.windows import sliding_windows
from ocellus.plans import batch, guidance
from ocellus.plans import cells as QUERY_CELLS
from ocellus.sources import readers as R
from ocellus.sources.adapters import Tables


def test_tumours_are_numbered_by_score(spark):
    t = spark.createDataFrame([(1, 10, 1, 1, 3, 3, 0.2), (1, 11, 3, 3, 5, 5, 0.9)], "slide_id long, tumor_key long, x1 long, y1 long, x2 long, y2 long, score double")
    got = {r.tumor_key: (r.tumor_id, r.area, r.cx, r.cy) for r in instances(t, 1, 1).collect()}
    assert got == {11: (1, 4, 3.5, 3.5), 10: (2, 4, 1.5, 1.5)}


def test_hidden_tumour_gets_no_number(spark):
    t = spark.createDataFrame([(1, 10, 0, 0, 4, 4, 0.9), (1, 11, 1, 1, 3, 3, 0.2)], "slide_id long, tumor_key long, x1 long, y1 long, x2 long, y2 long, score double")
    assert [r.tumor_key for r in instances(t, 1, 1).collect()] == [10]


def test_nearest_and_gate(spark):
    box = "slide_id long, det_id long, x1 long, y1 long, x2 long, y2 long"
    d = spark.createDataFrame([(1, 1, 0, 0, 160, 160), (1, 2, 160, 160, 320, 320), (2, 3, 0, 0, 5, 5)], box)
    t = spark.createDataFrame([(1, 1, 0, 0, 160, 160), (1, 2, 300, 300, 320, 320), (2, 9, 0, 0, 1, 1)], box.replace("det_id", "tumor_key"))
    got = {r.det_id: (r.gap2, r.tumor_key) for r in distances(d, t, 512, 50).collect()}
    assert got[1] == (0, 1) and got[2][0] == 0 and got[3] == (None, None)


def test_nearest_equals_brute_force(spark, sf):
    t = Tables(spark, sf)
    got = {r.det_id: (r.gap2, r.tumor_key) for r in X.nearest(t.detections, t.tumors, "det_id", "tumor_key", 2000, first=32).collect()}
    far = {r.det_id: (r.gap2, r.tumor_key) for r in X.nearest(t.detections, t.tumors, "det_id", "tumor_key", 2000, first=2000).collect()}
    assert got == far


def test_nms_leaves_no_overlap():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 200, 300), rng.integers(0, 200, 300)
    w, h, s, i = rng.integers(10, 60, 300), rng.integers(10, 60, 300), rng.integers(0, 5, 300) / 5, np.arange(300)
    keep = np.flatnonzero(greedy(x, y, x + w, y + h, s, i, 3, 10))
    for a in keep:
        for b in keep:
            if a < b:
                n = max(0, min(x[a] + w[a], x[b] + w[b]) - max(x[a], x[b])) * max(0, min(y[a] + h[a], y[b] + h[b]) - max(y[a], y[b]))
                assert n * 10 <= (w[a] * h[a] + w[b] * h[b] - n) * 3
    again = greedy(x[keep], y[keep], (x + w)[keep], (y + h)[keep], s[keep], i[keep], 3, 10)
    assert again.all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_union_find_gives_smallest_member(edges):
    got = union_find([a for a, _ in edges], [b for _, b in edges])
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)


def test_components_agree_and_long_chain(spark):
    e = spark.createDataFrame([(1, i, i + 1) for i in range(60)] + [(2, 1000, 1005)], "slide_id long, a long, b long")
    one = {r.node: r.component for r in components(e).collect()}
    two = {r.node: r.component for r in components_by_slide(e).collect()}
    assert one == two and set(one.values()) == {0, 1000}


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_cells_do_not_depend_on_partitions(spark, sf, parts):
    t = Tables(spark, sf)
    d = t.detections.repartition(parts)
    got = C.cells_summed(d, t.slides)
    assert got.agg(F.sum("area_px"), F.count("*"), F.sum(F.col("cell_id") * F.col("root"))).first() == C.cells_summed(t.detections, t.slides).agg(F.sum("area_px"), F.count("*"), F.sum(F.col("cell_id") * F.col("root"))).first()


def test_merge_preserves_area_and_ids_are_dense(spark, sf):
    t = Tables(spark, sf)
    m = C.merged(C.roots(t.detections))
    assert m.agg(F.sum("area_px")).first()[0] == t.detections.agg(F.sum("area_px")).first()[0]
    n = C.numbered(m).groupBy("slide_id").agg(F.max("cell_id").alias("m"), F.count("*").alias("n"))
    assert n.filter("m <> n").count() == 0


def test_windows_cover_the_slide(spark):
    s = spark.createDataFrame([(1, 2000, 2000), (2, 500, 3000)], "slide_id long, width long, height long")
    w = sliding_windows(s, F.lit(700), F.lit(600)).collect()
    assert sorted({r.x for r in w}) == [0, 600, 1200, 1300] and {r.slide_id for r in w} == {1}


@pytest.mark.parametrize("case, want", [
    (("0.25", "0.35", "µm", "µm"), 0.30), (("0.20", "0.40", None, None), 0.30), (("250", "500", "nm", "nm"), 0.375),
    (("0", "0.4", "um", "um"), None), (("-0.4", "0.4", "um", "um"), None), (("1", "1", "furlong", "um"), None),
])
def test_pixel_size_from_xml(spark, case, want):
    x, y, u, v = case
    tag = f'PhysicalSizeX="{x}" PhysicalSizeY="{y}"' + (f' PhysicalSizeXUnit="{u}" PhysicalSizeYUnit="{v}"' if u else "")
    xml = f'<ome:OME xmlns:ome="x"><ome:Pixels SizeX="3"/><ome:Pixels {tag}></ome:Pixels></ome:OME>'
    got = spark.createDataFrame([(xml,)], "x string").select(R.ome_mpp(F.col("x")).alias("m")).first().m
    assert got == want if want is None else abs(got - want) < 1e-12


def test_pixel_size_precedence(spark):
    df = spark.createDataFrame([("0.3", "0.4"), (None, "0.375"), ("nan", "inf")], "a string, b string")
    assert [r.m for r in df.select(S.mpp_of(F.col("a"), F.col("b")).alias("m")).collect()] == [0.3, 0.375, 0.5]


def test_saved_settings_overlay():
    now = EngineConfig(extended_properties=True, output_dir=None, resume_batch="r.json")
    got = now.with_saved({"extended_properties": False, "output_dir": "old", "resume_batch": "x", "confidence": 0.5, "unknown": 1})
    assert got.extended_properties and got.output_dir == "old" and got.resume_batch == "r.json" and got.confidence == 0.5
    with pytest.raises(ValueError):
        EngineConfig(min_area_um2=5, max_area_um2=1).validated()


def test_outline_and_moments_of_a_rectangle(spark):
    runs = C.box_rows(spark.createDataFrame([(1, 7, 1, 1, 5, 4)], "slide_id long, det_id long, x1 long, y1 long, x2 long, y2 long"))
    m = C.moments(runs, ["slide_id", "det_id"]).first()
    o = C.outline(runs).first()
    assert (m.area_px, m.extent, o.solidity, o.perimeter) == (12, 1.0, 1.0, 14.0)
    assert abs(m.eq_diameter - (48 / np.pi) ** 0.5) < 1e-9 and abs(m.eccentricity - (1 - 9 / 16) ** 0.5) < 1e-9


def test_outline_with_a_gap(spark):
    rows = [(1, 7, 0, 0, 5), (1, 7, 1, 0, 2), (1, 7, 1, 3, 5), (1, 7, 2, 0, 5)]
    o = C.outline(spark.createDataFrame(rows, "slide_id long, det_id long, row long, c0 long, c1 long")).first()
    assert o.perimeter == 20.0 and abs(o.solidity - 14 / 15) < 1e-9


def test_contour_and_simplification():
    mask = np.zeros((6, 6), int)
    mask[1:4, 1:5] = 1
    ring = G.outer_contour(mask)
    x, y = ring[:, 0], ring[:, 1]
    assert abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2 == 12
    line = np.array([[0, 0], [1, 0.1], [2, -0.1], [3, 5], [4, 6]], float)
    assert G.simplified(line, 0.5).tolist() == [[0, 0], [2, -0.1], [3, 5], [4, 6]]


def test_geojson_gate_and_form(spark, tmp_path):
    f = G.feature_json(spark.createDataFrame([(5, 0, 0, 2, 3, 6)], "det_id long, x1 long, y1 long, x2 long, y2 long, area_px long"))
    one = json.loads(f.first().feature)
    assert one["geometry"]["coordinates"][0][0] == one["geometry"]["coordinates"][0][-1] and one["properties"]["area_pixels"] == 6
    assert not R.write_geojson(f, str(tmp_path / "a"), True, False) and not (tmp_path / "a").exists()
    assert R.write_geojson(f, str(tmp_path / "a"), True, True) and (tmp_path / "a").exists()


def test_image_listing(spark, tmp_path):
    known = ["svs", "ndpi", "tiff", "tif", "vms", "vmu", "scn", "mrxs", "svslide", "bif", "czi", "png", "jpg", "jpeg"]
    for n in (*(f"a.{x}" for x in known), "b.SVS", "c.txt", "d.bmp", "svs"):
        (tmp_path / n).write_bytes(b"xx")
    assert [r.path.rsplit("/", 1)[-1] for r in R.list_images(spark, str(tmp_path)).collect()] == sorted([*(f"a.{x}" for x in known), "b.SVS"])


def test_rings_that_touch_themselves(spark):
    from ocellus.operators.geometry import self_touching, valid_rings

    square, nan = [(0, 0), (4, 0), (4, 4), (0, 4)], float("nan")
    rings = {
        1: (square, False), 2: ([(0, 0), (4, 4), (4, 0), (0, 4)], True), 3: ([(0, 0), (4, 0), (4, 4), (4, 0), (0, 4)], True),
        4: ([(0, 0), (6, 0), (6, 3), (3, 0), (0, 3)], True), 5: ([(0, 0), (6, 0), (6, 3), (5, 3), (2, 0), (1, 0), (0, 2)], True),
        6: ([(0, 0), (1000, 0), (1000, 900), (500, 1), (0, 900)], False), 7: ([(0, 0), (1, 0), (2, 0)], False), 8: ([(0, 0), (nan, 0), (2, 2)], False),
        9: ([(-700, -300), (-10, -300), (-10, 500), (-300, -290), (-700, 500)], False), 10: ([(0, 0), (1, 1)], False),
    }
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r]) for k, (r, _) in rings.items()], "id long, ring array<struct<x:double,y:double>>")
    sound = df.filter("id <> 8")
    assert {r.id for r in self_touching(sound, "id").collect()} == {k for k, (_, touches) in rings.items() if touches}
    assert sorted(r.id for r in valid_rings(df, "id").collect()) == [1, 6, 9]


def test_progress_lines_of_all_formats(spark):
    from ocellus.functions.scalars import progress_of

    lines = ["\x1b[1;32mprocessing image  3 / 17: a b.svs\x1b[0m", "Found 12 images to process", "Successfully processed: 4/5 images", "Processing 7 remaining images out of 9 total",
             "GPU_PROBE_STAGE: CUDA_init", "x GPU_RUNTIME_STAGE: done_2", "nothing of this"]
    got = [tuple(r.p) for r in spark.createDataFrame([(x,) for x in lines], "line string").select(progress_of(F.col("line")).alias("p")).collect()]
    none = (None,) * 7
    assert got == [(3, 17, "a b.svs", *none[3:]), (*none[:3], 12, None, None, None), (*none[:4], 4, None, None), (*none[:5], 7, None), (*none[:6], "CUDA_init"), (*none[:6], "done_2"), none]


def test_batch_states_skip_corrupt(spark, tmp_path):
    d = tmp_path / "run" / "batch_summary"
    d.mkdir(parents=True)
    (d / "a_state.json").write_text(json.dumps({"batch_id": "b1", "total_images": 3, "image_results": [{"image_name": "x", "processing_status": "failed"}]}))
    (d / "b_state.json").write_text("{ not json")
    got = R.read_batch_states(spark, str(tmp_path)).collect()
    assert [r.batch_id for r in got] == ["b1"] and got[0].image_results[0].processing_status == "failed"


def test_predict_isolates_failures(spark):
    w = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "slide_id long, window_id long").coalesce(1)

    def model(b):
        if (b.window_id == 1).any():
            raise ValueError("cannot allocate")
        return b.assign(score=0.5)[["window_id", "score"]]

    got = {r.window_id: r.error for r in R.predict(w, model, "window_id long, score double").collect()}
    assert got[0] is None and got[2] is None and "allocate" in got[1]


def test_column_aliases(spark):
    df = spark.createDataFrame([(1, 2)], ["Total Cells", "other"])
    assert R.resolve_columns(df, {"cells": ["cells", "Total Cells"], "absent": ["nope"]}).columns == ["cells"]


def test_pixel_filters(spark):
    from ocellus.operators import pixels as P

    step = np.zeros((5, 6), np.uint8)
    step[:, 3:] = 200
    assert P.sobel(step, "clip")[2, 2] == 255 and P.sobel(step)[2, 2] == 800 % 256 and P.sobel(step)[2, 0] == 0
    assert (P.invert(step)[:, 0] == 255).all() and (P.gaussian(np.full((5, 5), 9, np.uint8)) == 9).all() and P.laplacian(step)[2, 2] == 200
    spot = np.zeros((5, 5), np.uint8)
    spot[2, 2] = 255
    assert P.median(spot).max() == 0
    rows = [(1, 0, 0, 5, 6, bytearray(step.tobytes())), (1, 4, 0, 5, 6, bytearray(P.invert(step).tobytes())), (1, 9, 9, 5, 6, bytearray(30))]
    w = spark.createDataFrame(rows, "slide_id long, x long, y long, h int, w int, pixels binary")
    assert P.apply_filters(w, ["invert"]).count() == 2
    seen = {(r.y, r.x): r.value for r in P.stitch(w.filter("x < 9")).collect()}
    assert seen[0, 3] == 200 and seen[0, 4] == 255 and seen[0, 9] == 55


def test_command_line_settings():
    from ocellus.__main__ import config_of, parser

    a = parser().parse_args(["--slides", "a", "--detections", "b", "--tumors", "c", "--output", "d", "--min_area_um2", "10", "--retry_failed"])
    assert config_of(a).min_area_um2 == 10 and config_of(a).retry_failed


def test_retries_function_is_registered(spark, tmp_path):
    from ocellus.streaming import logs as L

    spark.createDataFrame([(1, 1, "processing"), (2, 2, "completed")], "seq long, image_id long, status string").write.parquet(str(tmp_path / "log"))
    out = L.retries(L.file_stream(spark, str(tmp_path / "log"), "seq long, image_id long, status string"))
    assert out.isStreaming and out.columns == ["image_id", "status"]


def test_all_labels_are_united(spark):
    d = spark.createDataFrame([(1, 1), (60, 2)], "slide_id long, det_id long")
    w = spark.createDataFrame([(1, 1, 0), (60, 2, 500), (70, 3, 500)], "slide_id long, det_id long, win_x long")
    assert sorted(r.det_id for r in QUERY_CELLS.union_distinct_labels(SimpleNamespace(detections=d, window_detections=w)).collect()) == [1, 2, 3]


def test_whole_tissue_guides_and_slides_without_fall_back(spark):
    slides = spark.createDataFrame([(1, 2000, 2000), (2, 2000, 2000)], "slide_id long, width long, height long")
    tissue = spark.createDataFrame([(1, 7, 0, 0, 50, 50)], "slide_id long, tissue_id long, x1 long, y1 long, x2 long, y2 long")
    got = [(r.slide_id, r.x1, r.y1) for r in guidance.windows_or_all(SimpleNamespace(slides=slides, tissue=tissue)).collect()]
    assert [g for g in got if g[0] == 1] == [(1, 0, 0)] and sum(g[0] == 2 for g in got) == 25


def test_all_completed_images_are_excluded(spark):
    log = spark.createDataFrame([(1, "completed", ""), (2, "completed", ""), (3, "pending", ""), (4, "failed", "x")], "image_id long, status string, error_message string")
    assert sorted(r.image_id for r in batch.exclusion_sets(SimpleNamespace(batch_log=log)).collect()) == [1, 2, 4]
