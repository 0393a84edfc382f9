"""Windows, tissue guidance and regions of interest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocellus.operators import windows as W
from ocellus.operators.spatial import coverage, raster_cells
from ocellus.plans.registry import query

_POS = """SELECT DISTINCT unnest(CASE WHEN 2000 - {0} < 0 THEN [] ELSE list_append(range(0, 2000 - {0} + 1, {1}), 2000 - {0}) END) AS v"""
_WIN = "(SELECT s.slide_id, a.v AS x1, b.v AS y1, a.v + 500 AS x2, b.v + 500 AS y2 FROM {slides} s, (" + _POS.format(500, 400) + ") a, (" + _POS.format(500, 400) + ") b)"


def _windows(t):
    return W.as_boxes(W.sliding_windows(t.slides, F.lit(500), F.lit(400)))


@query("window_params_by_mpp", "SELECT slide_id, CASE WHEN mpp >= 0.4 THEN 1100 ELSE 2000 END AS size, CASE WHEN mpp >= 0.4 THEN 900 ELSE 1700 END AS stride FROM {slides}")
def window_params_by_mpp(t):
    size, stride = W.window_params(F.col("mpp"))
    return t.slides.select("slide_id", size.alias("size"), stride.alias("stride"))


@query("sliding_windows", """
    SELECT slide_id, a.v AS x, b.v AS y, CAST(700 AS BIGINT) AS size FROM {slides}, (""" + _POS.format(700, 600) + ") a, (" + _POS.format(700, 600) + ") b")
def sliding_windows(t):
    return W.sliding_windows(t.slides, F.lit(700), F.lit(600))


@query("sliding_windows_by_mpp", """
    SELECT slide_id, a.v AS x, b.v AS y, CAST(CASE WHEN mpp >= 0.4 THEN 1100 ELSE 2000 END AS BIGINT) AS size FROM {slides}
    JOIN (SELECT 0 AS k, unnest([0, 900]) AS v UNION ALL SELECT 1, 0) a ON a.k = CASE WHEN mpp >= 0.4 THEN 0 ELSE 1 END
    JOIN (SELECT 0 AS k, unnest([0, 900]) AS v UNION ALL SELECT 1, 0) b ON b.k = a.k""")
def sliding_windows_by_mpp(t):
    out = W.sliding_windows(t.slides, *W.window_params(F.col("mpp")))
    return out.select("slide_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "size")


@query("windows_small_image", "SELECT slide_id, width AS x, width AS y, width AS size FROM {slides} WHERE false")
def windows_small_image(t):
    """An image smaller than the window has no window."""
    return W.sliding_windows(t.slides, F.lit(2100), F.lit(900))


@query("tissue_guided_windows", """
    WITH g AS (SELECT greatest(0, x1 - 250) AS gx, greatest(0, y1 - 250) AS gy, least(2000, x2 + 250) AS hx, least(2000, y2 + 250) AS hy, slide_id FROM {tissue} JOIN {slides} USING (slide_id)),
         xs AS (SELECT *, unnest(CASE WHEN hx - gx < 500 THEN [] ELSE list_append(range(gx, hx - 500 + 1, 400), hx - 500) END) AS x FROM g),
         xy AS (SELECT *, unnest(CASE WHEN hy - gy < 500 THEN [] ELSE list_append(range(gy, hy - 500 + 1, 400), hy - 500) END) AS y FROM xs)
    SELECT DISTINCT slide_id, x, y FROM xy WHERE x + 500 <= 2000 AND y + 500 <= 2000""")
def tissue_guided_windows(t):
    return W.guided_windows(t.slides, t.tissue, 500, 400)


@query("windows_on_tissue", "SELECT w.* FROM " + _WIN + " w WHERE EXISTS (SELECT 1 FROM {tissue} t WHERE t.slide_id = w.slide_id AND w.x1 < t.x2 AND t.x1 < w.x2 AND w.y1 < t.y2 AND t.y1 < w.y2)")
def windows_on_tissue(t):
    return W.on_regions(_windows(t), t.tissue)


@query("windows_off_tissue", "SELECT w.* FROM " + _WIN + " w WHERE NOT EXISTS (SELECT 1 FROM {tissue} t WHERE t.slide_id = w.slide_id AND w.x1 < t.x2 AND t.x1 < w.x2 AND w.y1 < t.y2 AND t.y1 < w.y2)")
def windows_off_tissue(t):
    return W.on_regions(_windows(t), t.tissue, "left_anti")


@query("occupied_windows", "SELECT w.* FROM " + _WIN + " w WHERE EXISTS (SELECT 1 FROM {detections} t WHERE t.slide_id = w.slide_id AND w.x1 < t.x2 AND t.x1 < w.x2 AND w.y1 < t.y2 AND t.y1 < w.y2)")
def occupied_windows(t):
    """Windows without any instance are skipped."""
    return W.on_regions(_windows(t), t.detections)


@query("windows_or_all", """
    WITH k AS (SELECT w.* FROM """ + _WIN + """ w WHERE EXISTS (SELECT 1 FROM {tissue} t WHERE t.slide_id = w.slide_id AND w.x1 < t.x2 AND t.x1 < w.x2 AND w.y1 < t.y2 AND t.y1 < w.y2))
    SELECT * FROM k UNION ALL SELECT w.* FROM """ + _WIN + """ w WHERE w.slide_id NOT IN (SELECT slide_id FROM k)""")
def windows_or_all(t):
    """A slide of which guidance keeps nothing falls back to all its windows."""
    every = _windows(t)
    return W.or_all(W.on_regions(every, t.tissue), every)


_COV = """
    WITH m AS (SELECT DISTINCT t.slide_id, a.v AS px, b.v AS py FROM {tissue} t, (SELECT unnest(range(0, 40)) AS v) a, (SELECT unnest(range(0, 40)) AS v) b
               WHERE a.v * 50 >= t.x1 AND a.v * 50 < t.x2 AND b.v * 50 >= t.y1 AND b.v * 50 < t.y2),
         c AS (SELECT w.*, (SELECT count(*) FROM m WHERE m.slide_id = w.slide_id AND px * 50 >= w.x1 AND px * 50 < w.x2 AND py * 50 >= w.y1 AND py * 50 < w.y2) AS inside, CAST(100 AS BIGINT) AS total FROM """ + _WIN + " w)"


@query("window_coverage", _COV + " SELECT * FROM c")
def window_coverage(t):
    return coverage(_windows(t), t.tissue, 50)


@query("window_priority", _COV + """
    SELECT slide_id, x1, y1, row_number() OVER (PARTITION BY slide_id ORDER BY CASE WHEN inside >= 0.4 * total THEN 0 ELSE 1 END, CASE WHEN inside >= 0.4 * total THEN -inside ELSE 0 END, y1, x1) AS rank FROM c""")
def window_priority(t):
    cov = coverage(_windows(t), t.tissue, 50).withColumn("share", F.col("inside") / F.col("total"))
    return W.prioritised(cov, "share", 0.4, F.struct("y1", "x1")).select("slide_id", "x1", "y1", "rank")


@query("guidance_stats", """
    WITH k AS (SELECT w.* FROM """ + _WIN + """ w WHERE EXISTS (SELECT 1 FROM {tissue} t WHERE t.slide_id = w.slide_id AND w.x1 < t.x2 AND t.x1 < w.x2 AND w.y1 < t.y2 AND t.y1 < w.y2))
    SELECT s.slide_id, CAST(25 AS BIGINT) AS possible, coalesce(n, 0) AS guided, CASE WHEN coalesce(n, 0) > 0 THEN 25.0 / n ELSE 1.0 END AS speedup
    FROM {slides} s LEFT JOIN (SELECT slide_id, count(*) AS n FROM k GROUP BY 1) q USING (slide_id)""")
def guidance_stats(t):
    every = _windows(t)
    possible = every.groupBy("slide_id").agg(F.count("*").alias("possible"))
    guided = W.on_regions(every, t.tissue).groupBy("slide_id").agg(F.count("*").alias("guided"))
    return possible.join(guided, "slide_id", "left").select("slide_id", "possible", F.coalesce("guided", F.lit(0)).cast("long").alias("guided")).withColumn(
        "speedup", F.when(F.col("guided") > 0, F.col("possible").cast("double") / F.col("guided")).otherwise(1.0))


@query("adaptive_windows", """
    WITH m AS (SELECT DISTINCT t.slide_id, a.v AS px, b.v AS py FROM {tissue} t, (SELECT unnest(range(0, 40)) AS v) a, (SELECT unnest(range(0, 40)) AS v) b
               WHERE a.v * 50 >= t.x1 AND a.v * 50 < t.x2 AND b.v * 50 >= t.y1 AND b.v * 50 < t.y2)
    SELECT slide_id, x, y, CASE WHEN n > 80 THEN 750 WHEN n < 20 THEN 350 ELSE 500 END AS size
    FROM (SELECT s.slide_id, a.v AS x, b.v AS y, (SELECT count(*) FROM m WHERE m.slide_id = s.slide_id AND px * 50 >= a.v AND px * 50 < a.v + 500 AND py * 50 >= b.v AND py * 50 < b.v + 500) AS n
          FROM {slides} s, (SELECT unnest(range(0, 1500, 500)) AS v) a, (SELECT unnest(range(0, 1500, 500)) AS v) b) q""")
def adaptive_windows(t):
    """Window size by the density of tissue in a probe box; the upper bound of positions is exclusive."""
    grid = t.slides.select("slide_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1499).cast("long"), F.lit(500).cast("long"))).alias("x")).select(
        "slide_id", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1499).cast("long"), F.lit(500).cast("long"))).alias("y"))
    boxes = grid.select("slide_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 500).alias("x2"), (F.col("y") + 500).alias("y2"))
    share = F.col("inside") / F.col("total")
    return coverage(boxes, t.tissue, 50).select("slide_id", F.col("x1").alias("x"), F.col("y1").alias("y"), F.when(share > 0.8, 750).when(share < 0.2, 350).otherwise(500).alias("size"))


_ROI = "(SELECT slide_id, x1, y1, x2, y2 FROM {tumors})"


def _roi(t):
    return t.tumors.select("slide_id", "x1", "y1", "x2", "y2")


@query("roi_windows", """
    WITH m AS (SELECT DISTINCT t.slide_id, a.v AS px, b.v AS py FROM {tumors} t, (SELECT unnest(range(0, 40)) AS v) a, (SELECT unnest(range(0, 40)) AS v) b
               WHERE a.v * 50 >= t.x1 AND a.v * 50 < t.x2 AND b.v * 50 >= t.y1 AND b.v * 50 < t.y2)
    SELECT * FROM (SELECT w.slide_id, w.x1, w.y1, (SELECT count(*) FROM m WHERE m.slide_id = w.slide_id AND px >= round_even(w.x1 * 0.02, 0) AND px < round_even(w.x2 * 0.02, 0)
                           AND py >= round_even(w.y1 * 0.02, 0) AND py < round_even(w.y2 * 0.02, 0)) AS inside FROM """ + _WIN + """ w) q WHERE inside >= 0.2 * 100""")
def roi_windows(t):
    """Windows of which a fifth or more lies in the region, by prefix sums over a thumbnail mask."""
    mask = raster_cells(_roi(t), 50).select("slide_id", "px", "py").distinct().withColumn("v", F.lit(1))
    got = W.roi_coverage(_windows(t), mask, F.lit(0.02), 40)
    return got.filter(F.col("inside") >= 0.2 * F.col("total")).select("slide_id", "x1", "y1", "inside")


@query("roi_tissue_intersection", "SELECT w.* FROM " + _WIN + """ w WHERE EXISTS (SELECT 1 FROM {tissue} t WHERE t.slide_id = w.slide_id AND w.x1 < t.x2 AND t.x1 < w.x2 AND w.y1 < t.y2 AND t.y1 < w.y2)
    AND EXISTS (SELECT 1 FROM {tumors} t WHERE t.slide_id = w.slide_id AND w.x1 < t.x2 AND t.x1 < w.x2 AND w.y1 < t.y2 AND t.y1 < w.y2)""")
def roi_tissue_intersection(t):
    every = _windows(t)
    return W.on_regions(every, t.tissue).intersect(W.on_regions(every, t.tumors))


@query("roi_detections", """
    WITH k AS (SELECT DISTINCT d.det_id, d.slide_id FROM {detections} d JOIN {tumors} t ON t.slide_id = d.slide_id
               WHERE (d.x1 + d.x2) // 2 >= t.x1 AND (d.x1 + d.x2) // 2 < t.x2 AND (d.y1 + d.y2) // 2 >= t.y1 AND (d.y1 + d.y2) // 2 < t.y2)
    SELECT slide_id, det_id, row_number() OVER (PARTITION BY slide_id ORDER BY det_id) AS new_id FROM k""")
def roi_detections(t):
    """Detections whose centroid lies in a region, numbered anew."""
    from pyspark.sql import Window

    from ocellus.operators.spatial import box_join

    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    points = t.detections.select("slide_id", "det_id", mid("x1", "x2").alias("x1"), mid("y1", "y2").alias("y1")).withColumns({"x2": F.col("x1") + 1, "y2": F.col("y1") + 1})
    hit = box_join(points, _roi(t), how="left_semi")
    return hit.select("slide_id", "det_id", F.row_number().over(Window.partitionBy("slide_id").orderBy("det_id")).cast("long").alias("new_id"))


@query("grid_cells", """
    SELECT slide_id, r.r * cols + c.c AS cell, c.c * g AS x, r.r * g AS y
    FROM (SELECT slide_id, CAST(greatest(1, floor(100 / mpp)) AS BIGINT) AS g, CAST(ceil(width / floor(100 / mpp)) AS BIGINT) AS cols, CAST(ceil(height / floor(100 / mpp)) AS BIGINT) AS rws FROM {slides}) s,
         (SELECT unnest(range(0, 20)) AS r) r, (SELECT unnest(range(0, 20)) AS c) c WHERE r.r < rws AND c.c < cols""")
def grid_cells(t):
    g = F.greatest(F.lit(1), F.floor(100 / F.col("mpp"))).cast("long")
    s = t.slides.select("slide_id", g.alias("g"), F.ceil(F.col("width") / g).alias("cols"), F.ceil(F.col("height") / g).alias("rows"))
    return s.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).select(
        "slide_id", (F.col("r") * F.col("cols") + F.col("c")).alias("cell"), (F.col("c") * F.col("g")).alias("x"), (F.col("r") * F.col("g")).alias("y"))


@query("prefix_sums", """
    WITH m AS (SELECT DISTINCT t.slide_id, a.v AS px, b.v AS py FROM {tissue} t, (SELECT unnest(range(0, 20)) AS v) a, (SELECT unnest(range(0, 20)) AS v) b
               WHERE a.v * 100 >= t.x1 AND a.v * 100 < t.x2 AND b.v * 100 >= t.y1 AND b.v * 100 < t.y2)
    SELECT s.slide_id, a.v AS px, b.v AS py, (SELECT count(*) FROM m WHERE m.slide_id = s.slide_id AND m.px <= a.v AND m.py <= b.v) AS total
    FROM {slides} s, (SELECT unnest(range(0, 20)) AS v) a, (SELECT unnest(range(0, 20)) AS v) b""")
def prefix_sums(t):
    from ocellus.operators.spatial import prefix_sum_2d

    line = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))
    dense = t.slides.select("slide_id", line.alias("px")).select("slide_id", "px", line.alias("py"))
    mask = raster_cells(t.tissue, 100).select("slide_id", "px", "py").distinct().withColumn("v", F.lit(1))
    return prefix_sum_2d(dense.join(mask, ["slide_id", "px", "py"], "left").withColumn("v", F.coalesce("v", F.lit(0))), "slide_id", "v").select("slide_id", "px", "py", "total")
