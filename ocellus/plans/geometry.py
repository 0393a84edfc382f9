"""Rings, polygon spans and GeoJSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ocellus.functions import scalars as S
from ocellus.operators.geometry import feature_json, polygon_spans, self_touching, valid_rings
from ocellus.operators.outlines import object_parts, outline_features, painted_parts
from ocellus.plans.registry import query

# A quadrilateral per tissue box; every fifth has two corners exchanged and so crosses itself
_RING = """r AS (SELECT tissue_id, slide_id, x1, y1, x2, y2, tissue_id % 5 = 0 AS bow, CAST(tissue_id % 40 AS BIGINT) AS k FROM {tissue})"""


def _rings(t):
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    k = F.col("tissue_id") % 40
    a, b, c, d = p(F.col("x1") + k, F.col("y1")), p(F.col("x2"), F.col("y1") + k), p(F.col("x2") - k, F.col("y2")), p(F.col("x1"), F.col("y2"))
    return t.tissue.withColumn("ring", F.when(F.col("tissue_id") % 5 == 0, F.array(a, c, b, d)).otherwise(F.array(a, b, c, d)))


@query("ring_area", f"""WITH {_RING}, v AS (SELECT tissue_id, CASE WHEN bow THEN [x1 + k, x2 - k, x2, x1] ELSE [x1 + k, x2, x2 - k, x1] END AS xs, CASE WHEN bow THEN [y1, y2, y1 + k, y2] ELSE [y1, y1 + k, y2, y2] END AS ys FROM r)
    SELECT tissue_id, abs(xs[1] * ys[2] - xs[2] * ys[1] + xs[2] * ys[3] - xs[3] * ys[2] + xs[3] * ys[4] - xs[4] * ys[3] + xs[4] * ys[1] - xs[1] * ys[4]) / 2.0 AS area FROM v""")
def ring_area(t):
    return _rings(t).select("tissue_id", S.ring_area(F.col("ring")).alias("area"))


@query("ring_self_touch", f"WITH {_RING} SELECT tissue_id, bow AS touches FROM r")
def ring_self_touch(t):
    rings = _rings(t).select("tissue_id", "ring")
    found = self_touching(rings, "tissue_id").withColumn("touches", F.lit(True))
    return rings.join(found, "tissue_id", "left").select("tissue_id", F.coalesce("touches", F.lit(False)).alias("touches"))


@query("ring_valid", f"WITH {_RING} SELECT tissue_id FROM r WHERE NOT bow")
def ring_valid(t):
    return valid_rings(_rings(t).select("tissue_id", "ring"), "tissue_id").select("tissue_id")


@query("ring_edges", f"""WITH {_RING}, v AS (SELECT tissue_id, CASE WHEN bow THEN [x1 + k, x2 - k, x2, x1] ELSE [x1 + k, x2, x2 - k, x1] END AS xs FROM r), e AS (SELECT tissue_id, i.i, xs FROM v, (SELECT unnest([0, 1, 2, 3]) AS i) i)
    SELECT tissue_id, i, CAST(xs[i + 1] AS DOUBLE) AS from_x, CAST(xs[(i + 1) % 4 + 1] AS DOUBLE) AS to_x FROM e""")
def ring_edges(t):
    e = _rings(t).select("tissue_id", "ring", F.posexplode("ring").alias("i", "v"))
    return e.select("tissue_id", "i", F.col("v.x").alias("from_x"), F.get("ring", (F.col("i") + 1) % F.size("ring"))["x"].alias("to_x"))


@query("polygon_spans", f"""WITH {_RING}, v AS (SELECT tissue_id, [x1 + k, x2, x2 - k, x1] AS xs, [y1, y1 + k, y2, y2] AS ys FROM r WHERE NOT bow),
    e AS (SELECT tissue_id, CAST(xs[i.i + 1] AS DOUBLE) AS ax, CAST(ys[i.i + 1] AS DOUBLE) AS ay, CAST(xs[(i.i + 1) % 4 + 1] AS DOUBLE) AS bx, CAST(ys[(i.i + 1) % 4 + 1] AS DOUBLE) AS bee FROM v, (SELECT unnest([0, 1, 2, 3]) AS i) i),
    c AS (SELECT tissue_id, row, ax + (row + 0.5 - ay) * (bx - ax) / (bee - ay) AS x FROM (SELECT *, unnest(range(CAST(ceil(least(ay, bee) - 0.5) AS BIGINT), CAST(ceil(greatest(ay, bee) - 0.5) AS BIGINT))) AS row FROM e WHERE ay <> bee) q),
    n AS (SELECT *, lead(x) OVER w AS nx, row_number() OVER w AS rn FROM c WINDOW w AS (PARTITION BY tissue_id, row ORDER BY x))
    SELECT tissue_id, row, CAST(ceil(x - 0.5) AS BIGINT) AS c0, CAST(ceil(nx - 0.5) AS BIGINT) AS c1 FROM n WHERE rn % 2 = 1 AND ceil(x - 0.5) < ceil(nx - 0.5)""")
def q_polygon_spans(t):
    return polygon_spans(_rings(t).filter("tissue_id % 5 <> 0"), "tissue_id")


@query("geojson_properties", "SELECT det_id, 'Cell ' || det_id AS name, 'annotation' AS object_type, area_px AS area_pixels, (x1 + x2) / 2.0 AS centroid_x, CAST(5 AS BIGINT) AS ring_points FROM {detections}")
def geojson_properties(t):
    f = feature_json(t.detections)
    schema = "type string, properties struct<name:string, objectType:string, area_pixels:long, centroid_x:double>, geometry struct<type:string, coordinates:array<array<array<double>>>>"
    p = f.select("det_id", F.from_json("feature", schema).alias("f"))
    return p.select("det_id", "f.properties.name", F.col("f.properties.objectType").alias("object_type"), F.col("f.properties.area_pixels"), F.col("f.properties.centroid_x"), F.size(F.col("f.geometry.coordinates")[0]).cast("long").alias("ring_points"))


@query("part_numbers", "SELECT det_id, win_x, win_y, row_number() OVER (PARTITION BY det_id ORDER BY (x2 - x1) * (y2 - y1) DESC, win_y, win_x) AS part_index, count(*) OVER (PARTITION BY det_id) AS part_count FROM {window_detections}")
def part_numbers(t):
    """Parts of an object by falling area, with their number and count."""
    from pyspark.sql import Window

    w = Window.partitionBy("det_id")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return t.window_detections.select("det_id", "win_x", "win_y", F.row_number().over(w.orderBy(area.desc(), "win_y", "win_x")).cast("long").alias("part_index"), F.count("*").over(w).alias("part_count"))


@query("area_mismatch", "SELECT det_id, (x2 - x1 - 12) * (y2 - y1 - 12) < 0.5 * area_px AS mismatch FROM {detections}")
def area_mismatch(t):
    """Flag where an exported outline lost half of the area."""
    return t.detections.select("det_id", ((F.col("x2") - F.col("x1") - 12) * (F.col("y2") - F.col("y1") - 12) < 0.5 * F.col("area_px")).alias("mismatch"))


@query("roi_from_json", f"WITH {_RING} SELECT tissue_id, CAST(1 AS BIGINT) AS polygons, CAST(4 AS BIGINT) AS points FROM r")
def roi_from_json(t):
    """Polygons written to and read from their JSON form."""
    text = F.to_json(F.struct(F.array(F.transform("ring", lambda v: F.array(v["x"], v["y"]))).alias("polygons_full_res")))
    back = F.from_json(text, "polygons_full_res array<array<array<double>>>")
    return _rings(t).select("tissue_id", back.alias("p")).select("tissue_id", F.size("p.polygons_full_res").cast("long").alias("polygons"), F.size(F.col("p.polygons_full_res")[0]).cast("long").alias("points"))


@query("outline_boxes", """SELECT slide_id, det_id, CAST(1 AS BIGINT) AS part_count, CAST(5 AS BIGINT) AS ring_points, CAST((x2 - x1 - 1) * (y2 - y1 - 1) AS DOUBLE) AS exported_area,
    CAST(x1 AS DOUBLE) AS min_x, CAST(x2 - 1 AS DOUBLE) AS max_x, CAST(y1 AS DOUBLE) AS min_y, CAST(y2 - 1 AS DOUBLE) AS max_y, false AS mismatch FROM {detections}""")
def outline_boxes(t):
    """Outlines traced from the pixels of every detection, read back from their features: a box is traced through its corner pixels' centres."""
    cells = t.detections.select("slide_id", "det_id", "area_px", ((F.col("x1") + F.col("x2") - 1) / 2).alias("cx"), ((F.col("y1") + F.col("y2") - 1) / 2).alias("cy"))
    row = F.sequence(F.col("y1"), F.col("y2") - 1)
    objects = t.detections.select("slide_id", "det_id", row.alias("row"), F.transform(row, lambda v: F.col("x1")).alias("c0"), F.transform(row, lambda v: F.col("x2")).alias("c1"))
    f = outline_features(cells, object_parts(objects, t.slides))
    ring = F.from_json("feature", "geometry struct<coordinates:array<array<array<double>>>>")["geometry"]["coordinates"][0]
    f = f.withColumn("r", ring)
    xs, ys = F.transform("r", lambda p: p[0]), F.transform("r", lambda p: p[1])
    return f.select("slide_id", "det_id", "part_count", F.size("r").cast("long").alias("ring_points"), "exported_area", F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"), F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y"), "mismatch")


@query("outline_painted")
def outline_painted(t):
    """Outlines of the painted mask of every slide, of which SQL cannot express the tracing."""
    return outline_features(None, painted_parts(t.detections, t.slides)).select("slide_id", "det_id", "part_index", "part_count", "exported_area", "mismatch")
