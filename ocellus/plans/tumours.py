"""Tumour instances, distances, zones and the cell table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocellus.functions import scalars as S
from ocellus.operators import cells as C
from ocellus.operators.spatial import nearest, with_nearest
from ocellus.operators.tumors import distances, instances
from ocellus.plans.cells import CELLS
from ocellus.plans.registry import query

_GAP = "greatest(0, t.x1 - d.x2, d.x1 - t.x2)"
_GAPY = "greatest(0, t.y1 - d.y2, d.y1 - t.y2)"
_NEAR = f"n AS (SELECT d.slide_id, d.det_id, min(({_GAP}) * ({_GAP}) + ({_GAPY}) * ({_GAPY})) AS gap2, arg_min(t.tumor_key, (({_GAP}) * ({_GAP}) + ({_GAPY}) * ({_GAPY}), t.tumor_key)) AS tumor_key FROM {{detections}} d JOIN {{tumors}} t USING (slide_id) GROUP BY d.slide_id, d.det_id)"


@query("tumor_min_area", "SELECT tumor_key, (x2 - x1) * (y2 - y1) AS area_px FROM {tumors} WHERE (x2 - x1) * (y2 - y1) >= 4000")
def tumor_min_area(t):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return t.tumors.select("tumor_key", area.alias("area_px")).filter("area_px >= 4000")


_PAINT = """px AS (SELECT slide_id, tumor_key, score, a.v AS px, b.v AS py FROM {tumors} t, (SELECT unnest(range(0, 200)) AS v) a, (SELECT unnest(range(0, 200)) AS v) b WHERE a.v * 10 >= x1 AND a.v * 10 < x2 AND b.v * 10 >= y1 AND b.v * 10 < y2),
    own AS (SELECT slide_id, px, py, arg_min(tumor_key, (-score, tumor_key)) AS tumor_key FROM px GROUP BY ALL)"""


@query("tumor_priority_paint", f"""WITH {_PAINT} SELECT o.slide_id, o.tumor_key, count(*) AS area, avg(px) AS cx, avg(py) AS cy, row_number() OVER (PARTITION BY o.slide_id ORDER BY t.score DESC, o.tumor_key) AS tumor_id
    FROM own o JOIN {{tumors}} t USING (tumor_key) GROUP BY o.slide_id, o.tumor_key, t.score""")
def tumor_priority_paint(t):
    return instances(t.tumors, 10).select("slide_id", "tumor_key", "area", "cx", "cy", "tumor_id")


@query("tumor_table", f"""WITH {_PAINT} SELECT o.slide_id, row_number() OVER (PARTITION BY o.slide_id ORDER BY t.score DESC, o.tumor_key) AS tumor_id, count(*) * 100 AS area_pixels, count(*) * 100 * s.mpp * s.mpp AS area_um2, avg(px) * 10 AS centroid_x, avg(py) * 10 AS centroid_y
    FROM own o JOIN {{tumors}} t USING (tumor_key) JOIN {{slides}} s ON s.slide_id = o.slide_id GROUP BY o.slide_id, o.tumor_key, t.score, s.mpp""")
def tumor_table(t):
    return instances(t.tumors, 10).join(t.slides, "slide_id").select("slide_id", "tumor_id", (F.col("area") * 100).alias("area_pixels"), (F.col("area") * 100 * F.col("mpp") * F.col("mpp")).alias("area_um2"), (F.col("cx") * 10).alias("centroid_x"), (F.col("cy") * 10).alias("centroid_y"))


@query("nearest_tumor", f"WITH {_NEAR} SELECT * FROM n")
def nearest_tumor(t):
    return nearest(t.detections, t.tumors, "det_id", "tumor_key", 2000)


@query("nearest_tumor_gate50", f"""WITH {_NEAR}, ok AS (SELECT slide_id FROM {{tumors}} GROUP BY slide_id HAVING sum((x2 - x1) * (y2 - y1)) >= 80000)
    SELECT d.det_id, n.gap2, n.tumor_key FROM {{detections}} d LEFT JOIN (SELECT n.* FROM n JOIN ok USING (slide_id)) n USING (det_id)""")
def nearest_tumor_gate50(t):
    """All distances of a slide are absent when its tumours are too small in total."""
    return distances(t.detections, t.tumors, 2000, 80000).select("det_id", "gap2", "tumor_key")


@query("nearest_tumor_raster", """
    WITH c AS (SELECT DISTINCT det_id, d.slide_id, a.v AS px, b.v AS py FROM {detections} d, (SELECT unnest(range(0, 13)) AS v) a, (SELECT unnest(range(0, 13)) AS v) b WHERE a.v * 160 >= x1 AND a.v * 160 < x2 AND b.v * 160 >= y1 AND b.v * 160 < y2),
         u AS (SELECT DISTINCT tumor_key, t.slide_id, a.v AS px, b.v AS py FROM {tumors} t, (SELECT unnest(range(0, 13)) AS v) a, (SELECT unnest(range(0, 13)) AS v) b WHERE a.v * 160 >= x1 AND a.v * 160 < x2 AND b.v * 160 >= y1 AND b.v * 160 < y2)
    SELECT det_id, min((c.px - u.px) * (c.px - u.px) + (c.py - u.py) * (c.py - u.py)) AS d2,
           arg_min(tumor_key, ((c.px - u.px) * (c.px - u.px) + (c.py - u.py) * (c.py - u.py), u.py, u.px, tumor_key)) AS tumor_key FROM c JOIN u USING (slide_id) GROUP BY det_id""")
def nearest_tumor_raster(t):
    """Distances on the 1/160 raster: cells that vanish in the reduction have none; ties go by row, column and key."""
    from ocellus.operators.spatial import raster_cells

    c = raster_cells(t.detections, 160).select("slide_id", "det_id", "px", "py")
    u = raster_cells(t.tumors, 160).select("slide_id", "tumor_key", F.col("px").alias("ux"), F.col("py").alias("uy"))
    d2 = (F.col("px") - F.col("ux")) * (F.col("px") - F.col("ux")) + (F.col("py") - F.col("uy")) * (F.col("py") - F.col("uy"))
    best = c.join(u, "slide_id").groupBy("det_id").agg(F.min(F.struct(d2.alias("d2"), "uy", "ux", "tumor_key")).alias("b"))
    return best.select("det_id", "b.d2", "b.tumor_key")


@query("cell_table", f"""{CELLS}, g AS (SELECT c.slide_id, c.cell_id, min(({_GAP.replace('d.', 'c.')}) * ({_GAP.replace('d.', 'c.')}) + ({_GAPY.replace('d.', 'c.')}) * ({_GAPY.replace('d.', 'c.')})) AS gap2,
      arg_min(t.tumor_key, (({_GAP.replace('d.', 'c.')}) * ({_GAP.replace('d.', 'c.')}) + ({_GAPY.replace('d.', 'c.')}) * ({_GAPY.replace('d.', 'c.')}), t.tumor_key)) AS tumor_key FROM cells c JOIN {{tumors}} t USING (slide_id) GROUP BY ALL)
    SELECT c.slide_id, c.cell_id, c.area_px, c.area_px * s.mpp * s.mpp AS area_um2, c.cx, c.cy,
           CAST(least(greatest(floor(c.cy / gg), 0), ceil(s.height / gg) - 1) * ceil(s.width / gg) + least(greatest(floor(c.cx / gg), 0), ceil(s.width / gg) - 1) AS BIGINT) AS grid,
           coalesce(g.tumor_key, 1) AS closest_tumor, sqrt(gap2) * s.mpp AS distance_um, CASE WHEN gap2 IS NULL THEN NULL WHEN sqrt(gap2) * s.mpp <= 100 THEN 'Close' WHEN sqrt(gap2) * s.mpp <= 500 THEN 'Medium' ELSE 'Far' END AS distance_bin
    FROM cells c JOIN (SELECT *, greatest(1.0, floor(1100.0 / mpp)) AS gg FROM {{slides}}) s USING (slide_id) LEFT JOIN g ON g.slide_id = c.slide_id AND g.cell_id = c.cell_id""")
def cell_table(t):
    """The per-cell table: area, centroid, grid, nearest tumour, distance and its bin."""
    cells = C.cells_summed(t.detections, t.slides)
    d = F.sqrt(F.col("gap2")) * F.col("mpp")
    full = with_nearest(cells, t.tumors, ["slide_id", "root"], "tumor_key", 2000).join(t.slides.drop("image_name"), "slide_id")
    return full.select(
        "slide_id", "cell_id", "area_px", S.px_to_um2(F.col("area_px"), F.col("mpp")).alias("area_um2"), "cx", "cy",
        S.grid_id(F.col("cx"), F.col("cy"), F.col("width"), F.col("height"), F.col("mpp")).alias("grid"),
        F.coalesce("tumor_key", F.lit(1)).alias("closest_tumor"), d.alias("distance_um"), S.distance_bin(d).alias("distance_bin"))


@query("zone_counts", f"""WITH {_NEAR}, z AS (SELECT n.slide_id, sqrt(gap2) AS d, greatest(1, CAST(round_even(50.0 / mpp * 0.3, 0) AS BIGINT)) AS near, greatest(CAST(round_even(150.0 / mpp * 0.3, 0) AS BIGINT), greatest(1, CAST(round_even(50.0 / mpp * 0.3, 0) AS BIGINT)) + 1) AS far FROM n JOIN {{slides}} s USING (slide_id))
    SELECT slide_id, count(*) FILTER (d > 0 AND d <= near) AS near_n, count(*) FILTER (d > near AND d <= far) AS intermediate_n, count(*) FILTER (d > far) AS distal_n FROM z GROUP BY slide_id""")
def zone_counts(t):
    near, far = S.zone_thresholds(F.col("mpp"), 0.3, 50.0, 150.0)
    z = nearest(t.detections, t.tumors, "det_id", "tumor_key", 2000).join(t.slides, "slide_id").withColumn("zone", S.zone(F.sqrt("gap2"), near, far))
    n = lambda k: F.count_if(F.col("zone") == k).alias(f"{k}_n")
    return z.groupBy("slide_id").agg(n("near"), n("intermediate"), n("distal"))


@query("distance_color_cap", f"""WITH {_NEAR}, v AS (SELECT slide_id, sqrt(gap2) AS d FROM n WHERE gap2 > 0)
    SELECT slide_id, CASE WHEN max(d) - min(d) < 10 THEN max(d) + 50 ELSE greatest(least(quantile_cont(d, 0.95), 2000.0), 100.0) END AS cap FROM v GROUP BY slide_id""")
def distance_color_cap(t):
    """Upper end of the distance colour scale."""
    v = nearest(t.detections, t.tumors, "det_id", "tumor_key", 2000).filter("gap2 > 0").withColumn("d", F.sqrt("gap2"))
    d = v.groupBy("slide_id").agg(F.sort_array(F.collect_list("d")).alias("d"), F.min("d").alias("lo"), F.max("d").alias("hi")).select("slide_id", "lo", "hi", S.quantile_cont(F.col("d"), 0.95).alias("q"))
    return d.select("slide_id", F.when(F.col("hi") - F.col("lo") < 10, F.col("hi") + 50).otherwise(F.greatest(F.least("q", F.lit(2000.0)), F.lit(100.0))).alias("cap"))


@query("distance_stats", f"""WITH {_NEAR} SELECT s.slide_id, coalesce(round(avg(sqrt(gap2) * mpp), 6), 0) AS mean_um, coalesce(min(sqrt(gap2) * mpp), 0) AS min_um, coalesce(max(sqrt(gap2) * mpp), 0) AS max_um FROM {{slides}} s LEFT JOIN n USING (slide_id) GROUP BY s.slide_id""")
def distance_stats(t):
    near = nearest(t.detections, t.tumors, "det_id", "tumor_key", 2000)
    d = F.sqrt("gap2") * F.col("mpp")
    z = F.lit(0.0)
    return t.slides.join(near, "slide_id", "left").groupBy("slide_id").agg(F.coalesce(F.round(F.avg(d), 6), z).alias("mean_um"), F.coalesce(F.min(d), z).alias("min_um"), F.coalesce(F.max(d), z).alias("max_um"))


@query("min_distance_per_label", f"WITH {_NEAR} SELECT tumor_key, min(gap2) AS gap2, count(*) AS n FROM n GROUP BY tumor_key")
def min_distance_per_label(t):
    return nearest(t.detections, t.tumors, "det_id", "tumor_key", 2000).groupBy("tumor_key").agg(F.min("gap2").alias("gap2"), F.count("*").alias("n"))
