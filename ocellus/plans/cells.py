"""From detections to cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ocellus.operators import cells as C
from ocellus.operators.components import components, components_by_slide
from ocellus.operators.nms import nms, nms_fold
from ocellus.operators.painting import visible_sums
from ocellus.operators.spatial import box_join, dilate, erode, merge_edges, overlap_pairs, raster_cells, run_adjacency
from ocellus.plans.registry import query

_INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
PAIRS = f"""p AS (SELECT a.slide_id, a.det_id AS a, b.det_id AS b, {_INTER} AS inter, a.area_px + b.area_px - {_INTER} AS uni
    FROM dets a JOIN dets b ON a.slide_id = b.slide_id AND a.det_id < b.det_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)"""
# components by the least reachable id: labels spread along edges until nothing is new
COMPONENTS = """e AS (SELECT a, b FROM p WHERE inter * 10 > uni * 2 UNION SELECT b, a FROM p WHERE inter * 10 > uni * 2),
    reach AS (SELECT a AS node, a AS label FROM e UNION SELECT e.b, reach.label FROM reach JOIN e ON e.a = reach.node WHERE reach.label < e.b),
    comp AS (SELECT node, min(label) AS component FROM reach GROUP BY node)"""
ROOTED = "r AS (SELECT d.*, coalesce(component, det_id) AS root FROM dets d LEFT JOIN comp ON comp.node = d.det_id)"
MERGED = """m AS (SELECT slide_id, root, CAST(sum(area_px) AS BIGINT) AS area_px, count(*) AS members, sum((x1 + x2 - 1) * area_px) / (2.0 * sum(area_px)) AS cx,
    sum((y1 + y2 - 1) * area_px) / (2.0 * sum(area_px)) AS cy, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM r GROUP BY slide_id, root)"""
_LIMITS = "BETWEEN CAST(floor(250.0 / (s.mpp * s.mpp)) AS BIGINT) AND CAST(floor(25000.0 / (s.mpp * s.mpp)) AS BIGINT)"
FILTERED = f"dets AS (SELECT d.* FROM {{detections}} d JOIN {{slides}} s USING (slide_id) WHERE d.area_px {_LIMITS})"
ALL = "dets AS (SELECT * FROM {detections})"
CELLS = f"WITH RECURSIVE {FILTERED}, {PAIRS}, {COMPONENTS}, {ROOTED}, {MERGED}, cells AS (SELECT m.*, row_number() OVER (PARTITION BY m.slide_id ORDER BY root) AS cell_id FROM m JOIN {{slides}} s USING (slide_id) WHERE m.area_px {_LIMITS})"


@query("overlap_pairs", f"WITH {ALL}, {PAIRS} SELECT * FROM p")
def q_overlap_pairs(t):
    return overlap_pairs(t.detections)


@query("merge_edges", f"WITH {ALL}, {PAIRS} SELECT slide_id, a, b FROM p WHERE inter * 10 > uni * 2")
def q_merge_edges(t):
    return merge_edges(t.detections)


@query("iou_values", f"WITH {ALL}, {PAIRS} SELECT a, b, CAST(inter AS DOUBLE) / uni AS iou FROM p")
def q_iou(t):
    return overlap_pairs(t.detections).select("a", "b", (F.col("inter") / F.col("uni")).alias("iou"))


def _nms_oracle(source: str, group: str) -> str:
    inter = "greatest(0, least(k.x2, d.x2) - greatest(k.x1, d.x1)) * greatest(0, least(k.y2, d.y2) - greatest(k.y1, d.y1))"
    area = "(k.x2 - k.x1) * (k.y2 - k.y1) + (d.x2 - d.x1) * (d.y2 - d.y1)"
    return f"""
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, det_id) AS rn FROM {{{source}}}),
      s AS (SELECT {group}, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(det_id BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[]) AS kept FROM o WHERE rn = 1
            UNION ALL
            SELECT {', '.join('s.' + g.strip() for g in group.split(','))}, s.rn + 1,
                   CASE WHEN len(list_filter(s.kept, lambda k: ({inter}) * 10 > ({area} - ({inter})) * 3)) = 0
                        THEN list_append(s.kept, {{'det_id': d.det_id, 'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2}}) ELSE s.kept END
            FROM s JOIN o d ON d.rn = s.rn + 1 AND {' AND '.join(f'd.{g.strip()} = s.{g.strip()}' for g in group.split(','))}),
      f AS (SELECT {group}, arg_max(kept, rn) AS kept FROM s GROUP BY {group}),
      u AS (SELECT {group}, unnest(kept) AS k FROM f)
    SELECT {group}, k.det_id AS det_id FROM u"""


@query("nms_keep", _nms_oracle("detections", "slide_id"))
def nms_keep(t):
    return nms(t.detections, ["slide_id"]).select("slide_id", "det_id")


@query("nms_per_window", _nms_oracle("window_detections", "slide_id, win_x, win_y"))
def nms_per_window(t):
    return nms(t.window_detections, ["slide_id", "win_x", "win_y"]).select("slide_id", "win_x", "win_y", "det_id")


@query("nms_fold_per_window", _nms_oracle("window_detections", "slide_id, win_x, win_y"))
def nms_fold_per_window(t):
    return nms_fold(t.window_detections, ["slide_id", "win_x", "win_y"])


@query("components", f"WITH RECURSIVE {ALL}, {PAIRS}, {COMPONENTS} SELECT node, component FROM comp")
def q_components(t):
    return components_by_slide(merge_edges(t.detections)).select("node", "component")


@query("components_loop", f"WITH RECURSIVE {ALL}, {PAIRS}, {COMPONENTS} SELECT node, component FROM comp")
def q_components_loop(t):
    """The same by label rounds, which need no slide in one task."""
    return components(merge_edges(t.detections))


@query("merge_props_summed", f"WITH RECURSIVE {ALL}, {PAIRS}, {COMPONENTS}, {ROOTED}, {MERGED} SELECT * FROM m")
def merge_props_summed(t):
    return C.merge_boxes(t.detections)


@query("cells_summed", f"{CELLS} SELECT * FROM cells")
def cells_summed(t):
    return C.cells_summed(t.detections, t.slides)


@query("relabel_consecutive", f"{CELLS} SELECT slide_id, root, cell_id FROM cells")
def relabel_consecutive(t):
    return C.cells_summed(t.detections, t.slides).select("slide_id", "root", "cell_id")


@query("slide_cell_summary", f"""{CELLS}
    SELECT s.slide_id, s.image_name, count(*) AS total_cells, avg(area_px * mpp * mpp) AS mean_um2, median(area_px * mpp * mpp) AS median_um2, stddev_pop(area_px * mpp * mpp) AS std_um2,
           min(area_px * mpp * mpp) AS min_um2, max(area_px * mpp * mpp) AS max_um2, sum(area_px * mpp * mpp) AS total_um2
    FROM cells JOIN {{slides}} s USING (slide_id) GROUP BY s.slide_id, s.image_name""")
def slide_cell_summary(t):
    """From raw detections to one summary row per slide: filter, overlap join, components, merge, filter, statistics."""
    um2 = F.col("area_px") * F.col("mpp") * F.col("mpp")
    return C.cells_summed(t.detections, t.slides).join(t.slides, "slide_id").groupBy("slide_id", "image_name").agg(
        F.count("*").alias("total_cells"), F.avg(um2).alias("mean_um2"), F.median(um2).alias("median_um2"), F.stddev_pop(um2).alias("std_um2"),
        F.min(um2).alias("min_um2"), F.max(um2).alias("max_um2"), F.sum(um2).alias("total_um2"))


# Pixel-exact properties: each detection's visible stretches after painting, later detections on top (score ascending, id descending)
_EXACT = """WITH dets AS (SELECT * FROM {detections}), rows AS (SELECT det_id, slide_id, score, x1, x2, unnest(range(y1, y2)) AS y FROM dets),
    cuts AS (SELECT slide_id, y, x1 AS c FROM rows UNION SELECT slide_id, y, x2 FROM rows),
    seg AS (SELECT slide_id, y, c AS a, lead(c) OVER (PARTITION BY slide_id, y ORDER BY c) AS b FROM cuts),
    own AS (SELECT s.slide_id, s.y, s.a, s.b, arg_min(r.det_id, (-r.score, r.det_id)) AS det_id FROM seg s JOIN rows r ON r.slide_id = s.slide_id AND r.y = s.y AND s.a >= r.x1 AND s.a < r.x2 WHERE s.b IS NOT NULL GROUP BY ALL)"""


@query("cells_exact", _EXACT + """ SELECT slide_id, det_id, CAST(sum(b - a) AS BIGINT) AS area_px, sum(y * (b - a)) / sum(b - a) AS cy, sum((a + b - 1) * (b - a)) / (2.0 * sum(b - a)) AS cx,
    min(a) AS x1, min(y) AS y1, max(b) AS x2, max(y) + 1 AS y2 FROM own GROUP BY slide_id, det_id""")
def cells_exact(t):
    """Exact mode: distinct pixels; a detection painted over entirely has none and drops out."""
    return C.painted_properties(visible_sums(t.detections, "det_id"), ["slide_id", "det_id"])


@query("extent_eqdiam_ecc", _EXACT + """, k AS (SELECT slide_id, det_id, CAST(sum(b - a) AS DOUBLE) AS n, sum((b - a) * (a + b - 1) / 2.0) AS sx, CAST(sum((b - a) * y) AS DOUBLE) AS sy,
      sum((b - a) * ((a + b - 1) / 2.0) * ((a + b - 1) / 2.0) + CAST(b - a AS DOUBLE) * ((b - a) * (b - a) - 1) / 12) AS sxx, CAST(sum((b - a) * y * y) AS DOUBLE) AS syy, sum((b - a) * ((a + b - 1) / 2.0) * y) AS sxy,
      (max(b) - min(a)) * (max(y) + 1 - min(y)) AS box FROM own GROUP BY ALL),
    u AS (SELECT *, sxx / n - (sx / n) * (sx / n) + 1 / 12 AS u20, syy / n - (sy / n) * (sy / n) + 1 / 12 AS u02, sxy / n - sx * sy / (n * n) AS u11 FROM k),
    v AS (SELECT *, sqrt(4 * u11 * u11 + (u20 - u02) * (u20 - u02)) AS d FROM u)
    SELECT slide_id, det_id, CAST(n AS BIGINT) AS area_px, n / box AS extent, round(sqrt(4 * n / pi()), 6) AS eq_diameter, round(sqrt(greatest(0.0, 1 - (u20 + u02 - d) / (u20 + u02 + d))), 5) AS eccentricity FROM v""")
def extent_eqdiam_ecc(t):
    out = C.painted_moments(visible_sums(t.detections, "det_id"), ["slide_id", "det_id"])
    return out.withColumn("eq_diameter", F.round("eq_diameter", 6)).withColumn("eccentricity", F.round("eccentricity", 5))


@query("outline_shapes")
def outline_shapes(t):
    """Solidity and perimeter, which SQL cannot express."""
    return C.painted_outlines(t.detections)


@query("mask_out_invalid", """
    WITH rows AS (SELECT slide_id, det_id, unnest(range(y1, y2)) AS row, x1 AS c0, x2 AS c1 FROM {detections})
    SELECT r.slide_id, r.row, CAST(sum(c1 - c0) AS BIGINT) AS px FROM rows r WHERE det_id IN (SELECT det_id FROM {detections} WHERE score > 0.95) GROUP BY ALL""")
def mask_out_invalid(t):
    """Boxes whose label is not valid are removed by a semi-join on the label before they become runs; a slide's runs are summed where its boxes are."""
    valid = t.detections.filter("score > 0.95").select("det_id")
    kept = t.detections.select("slide_id", "det_id", "x1", "y1", "x2", "y2").join(valid, "det_id", "left_semi").drop("det_id").repartition("slide_id")
    return C.box_rows(kept).groupBy("slide_id", "row").agg(F.sum(F.col("c1") - F.col("c0")).alias("px"))


@query("map_labels", f"WITH RECURSIVE {ALL}, {PAIRS}, {COMPONENTS}, {ROOTED} SELECT det_id, dense_rank() OVER (PARTITION BY slide_id ORDER BY root) AS label FROM r")
def map_labels(t):
    """Old label to root to consecutive label in one chain of key joins."""
    rooted = C.roots(t.detections)
    names = rooted.select("slide_id", "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy("slide_id").orderBy("root")).cast("long"))
    return rooted.join(names, ["slide_id", "root"]).select("det_id", "label")


@query("distinct_labels", "SELECT slide_id, count(DISTINCT det_id) AS labels FROM {window_detections} GROUP BY slide_id")
def distinct_labels(t):
    return t.window_detections.groupBy("slide_id").agg(F.countDistinct("det_id").alias("labels"))


@query("union_distinct_labels", "SELECT det_id FROM {detections} UNION SELECT det_id FROM {window_detections}")
def union_distinct_labels(t):
    return t.detections.select("det_id").union(t.window_detections.select("det_id")).distinct()


_MASKS = """a AS (SELECT DISTINCT slide_id, p.v AS px, q.v AS py FROM {tissue} t, (SELECT unnest(range(0, 40)) AS v) p, (SELECT unnest(range(0, 40)) AS v) q WHERE p.v * 50 >= x1 AND p.v * 50 < x2 AND q.v * 50 >= y1 AND q.v * 50 < y2),
    b AS (SELECT DISTINCT slide_id, p.v AS px, q.v AS py FROM {tumors} t, (SELECT unnest(range(0, 40)) AS v) p, (SELECT unnest(range(0, 40)) AS v) q WHERE p.v * 50 >= x1 AND p.v * 50 < x2 AND q.v * 50 >= y1 AND q.v * 50 < y2)"""


def _mask(df):
    return raster_cells(df, 50).select("slide_id", "px", "py").distinct()


@query("mask_union", f"WITH {_MASKS} SELECT * FROM a UNION SELECT * FROM b")
def mask_union(t):
    return _mask(t.tissue).union(_mask(t.tumors)).distinct()


@query("mask_intersect", f"WITH {_MASKS} SELECT * FROM a INTERSECT SELECT * FROM b")
def mask_intersect(t):
    return _mask(t.tissue).intersect(_mask(t.tumors))


@query("mask_except", f"WITH {_MASKS} SELECT * FROM a EXCEPT SELECT * FROM b")
def mask_except(t):
    return _mask(t.tissue).subtract(_mask(t.tumors))


@query("mask_arithmetic", f"""WITH {_MASKS}, f AS (SELECT coalesce(a.slide_id, b.slide_id) AS slide_id, coalesce(a.px, b.px) AS px, coalesce(a.py, b.py) AS py, CASE WHEN a.px IS NULL THEN 0 ELSE 1 END AS u, CASE WHEN b.px IS NULL THEN 0 ELSE 1 END AS v
      FROM a FULL JOIN b ON a.slide_id = b.slide_id AND a.px = b.px AND a.py = b.py) SELECT slide_id, px, py, u + v AS added, greatest(u - v, 0) AS taken, u * v AS product FROM f""")
def mask_arithmetic(t):
    a, b = _mask(t.tissue).withColumn("u", F.lit(1)), _mask(t.tumors).withColumn("v", F.lit(1))
    f = a.join(b, ["slide_id", "px", "py"], "full").fillna(0, ["u", "v"])
    return f.select("slide_id", "px", "py", (F.col("u") + F.col("v")).alias("added"), F.greatest(F.col("u") - F.col("v"), F.lit(0)).alias("taken"), (F.col("u") * F.col("v")).alias("product"))


@query("jaccard_by_slide", f"""WITH {_MASKS}, na AS (SELECT slide_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT slide_id, count(*) AS n FROM b GROUP BY 1), i AS (SELECT slide_id, count(*) AS n FROM a JOIN b USING (slide_id, px, py) GROUP BY 1)
    SELECT na.slide_id, coalesce(i.n, 0) / CAST(na.n AS DOUBLE) AS overlap, coalesce(i.n, 0) / CAST(na.n + coalesce(nb.n, 0) - coalesce(i.n, 0) AS DOUBLE) AS jaccard FROM na LEFT JOIN nb USING (slide_id) LEFT JOIN i USING (slide_id)""")
def jaccard_by_slide(t):
    a, b = _mask(t.tissue).withColumn("u", F.lit(1)), _mask(t.tumors).withColumn("v", F.lit(1))
    g = a.join(b, ["slide_id", "px", "py"], "full").groupBy("slide_id").agg(F.count("u").alias("na"), F.count("v").alias("nb"), F.count_if(F.col("u").isNotNull() & F.col("v").isNotNull()).alias("n"))
    return g.filter("na > 0").select("slide_id", (F.col("n") / F.col("na")).alias("overlap"), (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))


@query("mask_stats", """
    SELECT slide_id, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS lo, max(score) AS hi, count(*) FILTER (score <> 0) AS nonzero, count(DISTINCT score) AS distinct_values, count(*) AS size FROM {detections} GROUP BY slide_id""")
def mask_stats(t):
    s = F.col("score")
    return t.detections.groupBy("slide_id").agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("lo"), F.max(s).alias("hi"), F.count_if(s != 0).alias("nonzero"), F.countDistinct(s).alias("distinct_values"), F.count("*").alias("size"))


_PIX = "px AS (SELECT DISTINCT slide_id, p.v AS px, q.v AS py FROM {tissue} t, (SELECT unnest(range(0, 40)) AS v) p, (SELECT unnest(range(0, 40)) AS v) q WHERE p.v * 50 >= x1 AND p.v * 50 < x2 AND q.v * 50 >= y1 AND q.v * 50 < y2)"
_SQUARE = "(SELECT unnest([-1, 0, 1]) AS d) i, (SELECT unnest([-1, 0, 1]) AS d) j"


@query("morph_dilate", f"WITH {_PIX} SELECT DISTINCT slide_id, px + i.d AS px, py + j.d AS py FROM px, {_SQUARE}")
def morph_dilate(t):
    return dilate(_mask(t.tissue), "slide_id")


@query("morph_erode", f"WITH {_PIX} SELECT slide_id, px + i.d AS px, py + j.d AS py FROM px, {_SQUARE} GROUP BY ALL HAVING count(*) = 9")
def morph_erode(t):
    return erode(_mask(t.tissue), "slide_id")


@query("morph_open", f"WITH {_PIX}, e AS (SELECT slide_id, px + i.d AS px, py + j.d AS py FROM px, {_SQUARE} GROUP BY ALL HAVING count(*) = 9) SELECT DISTINCT slide_id, px + i.d AS px, py + j.d AS py FROM e, {_SQUARE}")
def morph_open(t):
    return dilate(erode(_mask(t.tissue), "slide_id"), "slide_id")


@query("morph_close", f"WITH {_PIX}, e AS (SELECT DISTINCT slide_id, px + i.d AS px, py + j.d AS py FROM px, {_SQUARE}) SELECT slide_id, px + i.d AS px, py + j.d AS py FROM e, {_SQUARE} GROUP BY ALL HAVING count(*) = 9")
def morph_close(t):
    return erode(dilate(_mask(t.tissue), "slide_id"), "slide_id")


@query("binary_components", f"""WITH RECURSIVE {_PIX}, n AS (SELECT slide_id, px, py, slide_id * 10000 + py * 100 + px AS id FROM px),
    e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.slide_id = b.slide_id AND abs(a.px - b.px) + abs(a.py - b.py) = 1),
    reach AS (SELECT id AS node, id AS label FROM n UNION SELECT e.b, label FROM reach JOIN e ON e.a = reach.node WHERE label < e.b),
    c AS (SELECT node, min(label) AS component FROM reach GROUP BY node)
    SELECT node // 10000 AS slide_id, component, count(*) AS size FROM c GROUP BY ALL""")
def binary_components(t):
    """Components of a mask (4-connectivity): runs of pixels in a row, joined to touching runs of the next row."""
    m = _mask(t.tissue)
    island = m.withColumn("island", F.col("px") - F.row_number().over(Window.partitionBy("slide_id", "py").orderBy("px")))
    runs = island.groupBy("slide_id", F.col("py").alias("row"), "island").agg(F.min("px").alias("c0"), (F.max("px") + 1).alias("c1")).withColumn("run_id", F.col("slide_id") * 10000 + F.col("row") * 100 + F.col("c0"))
    runs = runs.select("slide_id", "row", "c0", "c1", "run_id")
    comp = components_by_slide(run_adjacency(runs, "slide_id")).select(F.col("node").alias("run_id"), "component")
    return runs.join(comp, "run_id", "left").groupBy("slide_id", F.coalesce("component", "run_id").alias("component")).agg(F.sum(F.col("c1") - F.col("c0")).alias("size"))


@query("downsampled_mask", "SELECT DISTINCT slide_id, p.v AS px, q.v AS py FROM {tissue} t, (SELECT unnest(range(0, 12)) AS v) p, (SELECT unnest(range(0, 12)) AS v) q WHERE p.v * 2000 // 12 >= x1 AND p.v * 2000 // 12 < x2 AND q.v * 2000 // 12 >= y1 AND q.v * 2000 // 12 < y2")
def downsampled_mask(t):
    """Nearest-neighbour reduction to 1/160: the sampled source pixel of each target pixel decides."""
    n = 2000 // 160
    across = lambda lo, hi: F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda v: (F.floor(v * 2000 / n) >= F.col(lo)) & (F.floor(v * 2000 / n) < F.col(hi))))
    return t.tissue.withColumn("px", across("x1", "x2")).withColumn("py", across("y1", "y2")).select("slide_id", "px", "py").distinct()


@query("upsampled_mask", """
    WITH m AS (SELECT DISTINCT slide_id, p.v AS px, q.v AS py FROM {tissue} t, (SELECT unnest(range(0, 12)) AS v) p, (SELECT unnest(range(0, 12)) AS v) q WHERE p.v * 2000 // 12 >= x1 AND p.v * 2000 // 12 < x2 AND q.v * 2000 // 12 >= y1 AND q.v * 2000 // 12 < y2)
    SELECT slide_id, CAST(ceil(px * 2000 / 12.0) AS BIGINT) AS x1, CAST(ceil((px + 1) * 2000 / 12.0) AS BIGINT) AS x2, CAST(ceil(py * 2000 / 12.0) AS BIGINT) AS y1, CAST(ceil((py + 1) * 2000 / 12.0) AS BIGINT) AS y2 FROM m""")
def upsampled_mask(t):
    """Nearest-neighbour enlargement to full size: a mask pixel becomes the box of the pixels that take their value from it."""
    n = 2000 // 160
    edge = lambda c, more: F.ceil((F.col(c) + more) * 2000 / n).cast("long")
    return downsampled_mask(t).select("slide_id", edge("px", 0).alias("x1"), edge("px", 1).alias("x2"), edge("py", 0).alias("y1"), edge("py", 1).alias("y2"))


@query("background_dropped", """
    SELECT slide_id, count(DISTINCT label) AS labels FROM (SELECT slide_id, CASE WHEN score > 0.95 THEN det_id + 1 ELSE 0 END AS label FROM {detections}) q WHERE label <> 0 GROUP BY slide_id""")
def background_dropped(t):
    """Labels of which the invalid ones have become background, 0, without it."""
    label = F.when(F.col("score") > 0.95, F.col("det_id") + 1).otherwise(0)
    return t.detections.select("slide_id", label.alias("label")).filter("label <> 0").groupBy("slide_id").agg(F.countDistinct("label").alias("labels"))


@query("group_boundaries", "SELECT slide_id, CAST(count(*) FILTER (prev IS NULL OR prev <> score) AS BIGINT) AS groups FROM (SELECT slide_id, score, lag(score) OVER (PARTITION BY slide_id ORDER BY score, det_id) AS prev FROM {detections}) q GROUP BY slide_id")
def group_boundaries(t):
    prev = F.lag("score").over(Window.partitionBy("slide_id").orderBy("score", "det_id"))
    return t.detections.withColumn("prev", prev).groupBy("slide_id").agg(F.count_if(F.col("prev").isNull() | (F.col("prev") != F.col("score"))).alias("groups"))


@query("sampled_windows", "SELECT slide_id, det_id FROM (SELECT slide_id, det_id, row_number() OVER (PARTITION BY slide_id ORDER BY det_id) - 1 AS i FROM {detections}) q WHERE i % 100 = 0")
def sampled_windows(t):
    """Every hundredth event, the first included: the sampling that progress reports use."""
    i = F.row_number().over(Window.partitionBy("slide_id").orderBy("det_id")) - 1
    return t.detections.withColumn("i", i).filter("i % 100 = 0").select("slide_id", "det_id")


@query("semi_overlap", "SELECT d.det_id FROM {detections} d WHERE EXISTS (SELECT 1 FROM {tissue} t WHERE t.slide_id = d.slide_id AND d.x1 < t.x2 AND t.x1 < d.x2 AND d.y1 < t.y2 AND t.y1 < d.y2)")
def semi_overlap(t):
    return box_join(t.detections, t.tissue, how="left_semi").select("det_id")
