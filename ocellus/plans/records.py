"""Round trips of what a run leaves beside its results, and the batch driver."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ocellus.operators.painting import row_pixels, visible_objects
from ocellus.operators.runs import results, run_batch
from ocellus.plans.cells import CELLS, _EXACT
from ocellus.plans.registry import query
from ocellus.sources import records as R
from ocellus.sources.scratch import _root


def _folder(t, kind: str) -> str:
    return f"{_root(t.spark)}/ocellus-{kind}-{uuid.uuid4().hex}"


@query("batch_states", f"""{CELLS}, n AS (SELECT slide_id, count(*) AS cells FROM cells GROUP BY slide_id)
    SELECT s.slide_id AS image_id, 'completed' AS status, '' AS error_message, coalesce(n.cells, 0) AS cells FROM {{slides}} s LEFT JOIN n USING (slide_id)""")
def batch_states(t):
    """All slides through the batch driver: their last logged state and number of cells."""
    return run_batch(t.slides, t.detections, t.tumors, _folder(t, "batch")).select("image_id", "status", "error_message", "cells")


@query("batch_results", f"{CELLS} SELECT slide_id, cell_id, area_px FROM cells")
def batch_results(t):
    """The cells of completed slides as the batch driver left them, after a second run that finds nothing to do."""
    folder = _folder(t, "batch")
    run_batch(t.slides, t.detections, t.tumors, folder)
    run_batch(t.slides, t.detections, t.tumors, folder)
    return results(t.spark, folder).select("slide_id", "cell_id", "area_px")


@query("progress_log", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, 'event ' || event_id || ' ' || event_type AS message FROM {events}")
def progress_log(t):
    """Every event appended to a progress log in two writes, and read back."""
    path = _folder(t, "progress")
    said = t.events.select("ts", F.concat_ws(" ", F.lit("event"), "event_id", "event_type").alias("message"), (F.col("event_id") % 2).alias("half"))
    for half in (0, 1):
        R.append_progress(said.filter(F.col("half") == half), path, F.col("ts"))
    return R.read_progress(t.spark, path).select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "message")


_FONTS = """f AS (SELECT p_partkey, replace(p_name, ' ', '-') AS name, CASE WHEN p_size % 7 = 0 THEN 'Type 3' WHEN p_size % 2 = 0 THEN 'CID TrueType' ELSE 'Type 1C' END AS font_type, p_type AS encoding,
    p_size % 5 <> 0 AS embedded, p_size % 3 = 0 AS subset, p_size % 4 = 0 AS unicode_map, CAST(p_partkey AS VARCHAR) AS object_id, CAST(p_size AS VARCHAR) AS generation FROM {part})"""


def _listings(t):
    """A listing with title, rule and one font for every part."""
    yes = lambda c: F.when(c, "yes").otherwise("no")
    size = F.col("p_size")
    kind = F.when(size % 7 == 0, "Type 3").when(size % 2 == 0, "CID TrueType").otherwise("Type 1C")
    row = F.concat_ws("  ", F.replace("p_name", F.lit(" "), F.lit("-")), kind, "p_type", yes(size % 5 != 0), yes(size % 3 == 0), yes(size % 4 == 0), F.col("p_partkey").cast("string"), size.cast("string"))
    return t.part.select("p_partkey", F.concat_ws("\n", F.lit("name type encoding emb sub uni object ID"), F.lit("---- ---- -------- --- --- --- ---------"), row, F.lit("")).alias("report"))


@query("pdf_fonts", f"WITH {_FONTS} SELECT * FROM f")
def pdf_fonts(t):
    return R.font_rows(_listings(t), ["p_partkey"])


@query("pdf_font_problems", f"""WITH {_FONTS} SELECT p_partkey, 'type 3' AS problem, name || ' (' || font_type || ')' AS fonts FROM f WHERE font_type = 'Type 3'
    UNION ALL SELECT p_partkey, 'not embedded', name || ' (' || font_type || ')' FROM f WHERE NOT embedded""")
def pdf_font_problems(t):
    return R.font_problems(_listings(t), ["p_partkey"])


@query("full_mask", _EXACT + " SELECT slide_id, y AS row, det_id, CAST(sum(b - a) AS BIGINT) AS px FROM own GROUP BY ALL")
def full_mask(t):
    """The painted mask of every slide written as packed objects and read back; runs that touch may be one or several."""
    path = _folder(t, "mask")
    R.write_mask(visible_objects(t.detections, "det_id"), path)
    return row_pixels(R.read_mask(t.spark, path))
