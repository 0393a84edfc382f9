"""Round trips through files, and the programmatic entry."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ocellus.operators.analysis import analyze
from ocellus.plans.cells import CELLS
from ocellus.plans.registry import query
from ocellus.sources import readers as R
from ocellus.sources.scratch import _root


@query("cells_round_trip", f"{CELLS} SELECT slide_id, cell_id, area_px FROM cells")
def cells_round_trip(t):
    """Cell tables written by slide and read back with pruning by the partition column."""
    out = analyze(t.slides, t.detections, t.tumors)["cells"]
    path = f"{_root(t.spark)}/ocellus-cells-{uuid.uuid4().hex}"
    R.write_cells(out.select("slide_id", "cell_id", "area_px"), path)
    return t.spark.read.schema("cell_id long, area_px long, slide_id long").parquet(path).select("slide_id", "cell_id", "area_px")


@query("analysis_summary", f"{CELLS} SELECT s.slide_id, count(c.cell_id) AS cells, coalesce(CAST(sum(c.area_px) AS BIGINT), 0) AS px FROM {{slides}} s LEFT JOIN cells c USING (slide_id) GROUP BY s.slide_id")
def analysis_summary(t):
    return analyze(t.slides, t.detections, t.tumors)["summary"].select("slide_id", "cells", "px")


@query("csv_scan", "SELECT slide_id, count(*) AS n, median(area_px) AS med FROM {detections} GROUP BY slide_id")
def csv_scan(t):
    """Statistics from per-slide CSV files, one a slide, read with a fixed schema."""
    path = f"{_root(t.spark)}/ocellus-csv-{uuid.uuid4().hex}"
    t.detections.select("slide_id", "det_id", "area_px").repartition("slide_id").write.option("header", True).partitionBy("slide_id").csv(path)
    back = t.spark.read.schema("det_id long, area_px long, slide_id long").option("header", True).csv(path)
    return back.groupBy("slide_id").agg(F.count("*").alias("n"), F.median("area_px").alias("med"))


@query("table_choice", "SELECT slide_id, CASE WHEN slide_id % 3 = 0 THEN 'first' WHEN slide_id % 2 = 0 THEN 'second' ELSE 'third' END AS name FROM {slides}")
def table_choice(t):
    """Of several candidate files the first that exists."""
    names = F.array(F.when(F.col("slide_id") % 3 == 0, "first"), F.when(F.col("slide_id") % 2 == 0, "second"), F.lit("third"))
    return t.slides.select("slide_id", F.get(F.array_compact(names), F.lit(0)).alias("name"))
