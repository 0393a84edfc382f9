"""Batch state, reports, curation, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ocellus.functions import scalars as S
from ocellus.operators import batch as B
from ocellus.plans.registry import query

_RANK = "CASE status WHEN 'completed' THEN 4 WHEN 'failed' THEN 3 WHEN 'processing' THEN 2 WHEN 'pending' THEN 1 ELSE 0 END"
_BEST = f"b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_RANK} DESC, seq) AS rn FROM {{batch_log}}) q WHERE rn = 1)"


@query("status_dedupe", f"WITH {_BEST} SELECT image_id, seq, status, seconds FROM b")
def status_dedupe(t):
    return B.best_status(t.batch_log).select("image_id", "seq", "status", "seconds")


@query("pending_safe", """
    WITH done AS (SELECT DISTINCT image_id FROM {batch_log} WHERE status IN ('failed', 'completed') OR trim(error_message) <> '')
    SELECT image_id, seq, 'pending' AS status FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY seq) AS rn FROM {batch_log} WHERE status IN ('pending', 'processing') AND image_id NOT IN (SELECT image_id FROM done)) q WHERE rn = 1""")
def pending_safe(t):
    return B.pending(t.batch_log).select("image_id", "seq", "status")


@query("pending_retry", """
    SELECT image_id, seq, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY seq) AS rn FROM {batch_log} WHERE status IN ('pending', 'processing', 'failed')) q WHERE rn = 1""")
def pending_retry(t):
    return B.pending(t.batch_log, retry_failed=True).select("image_id", "seq", "status")


@query("batch_totals", f"""WITH {_BEST} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, CAST(sum(seconds) AS BIGINT) AS seconds,
    coalesce(100.0 * count(*) FILTER (status = 'completed') / nullif(count(*), 0), 0.0) AS success_pct FROM b""")
def batch_totals(t):
    n = lambda s: F.count_if(F.col("status") == s)
    return B.best_status(t.batch_log).agg(F.count("*").alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), F.sum("seconds").alias("seconds"), F.coalesce(F.try_divide(100.0 * n("completed"), F.count("*")), F.lit(0.0)).alias("success_pct"))


@query("status_hist", "SELECT status, count(*) AS n FROM {batch_log} GROUP BY status")
def status_hist(t):
    return t.batch_log.groupBy("status").agg(F.count("*").alias("n"))


@query("summary_csv", f"""WITH {_BEST}, m AS (SELECT slide_id AS image_id, count(*) AS cells, median(area_px) AS med FROM {{detections}} GROUP BY 1)
    SELECT b.image_id AS "Image", b.status AS "Status", CASE WHEN coalesce(cells, 0) > 0 THEN CAST(cells AS VARCHAR) ELSE '' END AS "Total Cells", CASE WHEN coalesce(med, 0) > 0 THEN printf('%.2f', med) ELSE '' END AS "Median Size",
           CASE WHEN seconds > 0 THEN printf('%.2f', CAST(seconds AS DOUBLE)) ELSE '' END AS "Processing Time (s)", error_message AS "Error Message" FROM b LEFT JOIN m USING (image_id)""")
def summary_csv(t):
    """The batch summary table: numbers as text, blank unless positive."""
    m = t.detections.groupBy(F.col("slide_id").alias("image_id")).agg(F.count("*").alias("cells"), F.median("area_px").alias("med"))
    b = B.best_status(t.batch_log).join(m, "image_id", "left")
    return b.select(
        F.col("image_id").alias("Image"), F.col("status").alias("Status"), F.when(F.coalesce("cells", F.lit(0)) > 0, F.col("cells").cast("string")).otherwise("").alias("Total Cells"),
        F.coalesce(S.blank_unless_positive(F.col("med")), F.lit("")).alias("Median Size"), S.blank_unless_positive(F.col("seconds").cast("double")).alias("Processing Time (s)"), F.col("error_message").alias("Error Message"))


@query("legacy_summary", f"""WITH {_BEST} SELECT status, count(*) AS images, printf('%02d:%02d:%02d', CAST(sum(seconds) AS BIGINT) // 3600, CAST(sum(seconds) AS BIGINT) % 3600 // 60, CAST(sum(seconds) AS BIGINT) % 60) AS total_time FROM b GROUP BY status""")
def legacy_summary(t):
    return B.best_status(t.batch_log).groupBy("status").agg(F.count("*").alias("images"), S.hhmmss(F.sum("seconds")).alias("total_time"))


@query("resumable_progress", """SELECT image_id % 50 AS batch_id, count(*) AS total, count(*) FILTER (status IN ('completed', 'failed')) AS processed, round(100.0 * count(*) FILTER (status IN ('completed', 'failed')) / count(*), 1) AS pct FROM {batch_log} GROUP BY 1 HAVING count(*) FILTER (status IN ('completed', 'failed')) < count(*)""")
def resumable_progress(t):
    done = F.count_if(F.col("status").isin("completed", "failed"))
    return t.batch_log.groupBy((F.col("image_id") % 50).alias("batch_id")).agg(F.count("*").alias("total"), done.alias("processed"), F.round(100.0 * done / F.count("*"), 1).alias("pct")).filter("processed < total")


@query("batch_sizes", "SELECT b.image_id, coalesce(m.med, 0.0) AS median_size, coalesce(m.avg, 0.0) AS average_size FROM (SELECT DISTINCT image_id FROM {batch_log}) b LEFT JOIN (SELECT slide_id AS image_id, median(area_px) AS med, avg(area_px) AS avg FROM {detections} GROUP BY 1) m USING (image_id)")
def batch_sizes(t):
    """Median and mean size per image, zero where an image has no table."""
    m = t.detections.groupBy(F.col("slide_id").alias("image_id")).agg(F.median("area_px").alias("med"), F.avg("area_px").alias("avg"))
    return t.batch_log.select("image_id").distinct().join(m, "image_id", "left").select("image_id", F.coalesce("med", F.lit(0.0)).alias("median_size"), F.coalesce("avg", F.lit(0.0)).alias("average_size"))


@query("stats_repair", "SELECT seq, CASE WHEN seconds % 5 = 0 THEN coalesce(m.avg, 0.0) ELSE CAST(seconds AS DOUBLE) END AS average_size FROM {batch_log} b LEFT JOIN (SELECT slide_id AS image_id, avg(area_px) AS avg FROM {detections} GROUP BY 1) m USING (image_id)")
def stats_repair(t):
    """Missing (zero) statistics filled from the cell tables, others left alone."""
    m = t.detections.groupBy(F.col("slide_id").alias("image_id")).agg(F.avg("area_px").alias("avg"))
    return t.batch_log.join(m, "image_id", "left").select("seq", F.when(F.col("seconds") % 5 == 0, F.coalesce("avg", F.lit(0.0))).otherwise(F.col("seconds").cast("double")).alias("average_size"))


@query("duplicate_paths", "SELECT image_id, count(*) AS n FROM {batch_log} GROUP BY image_id HAVING count(*) > 1")
def duplicate_paths(t):
    return t.batch_log.groupBy("image_id").agg(F.count("*").alias("n")).filter("n > 1")


@query("first_occurrence", "SELECT image_id, seq, status FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY seq) AS rn FROM {batch_log}) q WHERE rn = 1")
def first_occurrence(t):
    return t.batch_log.groupBy("image_id").agg(F.min_by(F.struct("seq", "status"), "seq").alias("r")).select("image_id", "r.seq", "r.status")


@query("exclusion_sets", "SELECT image_id FROM {batch_log} WHERE status = 'failed' UNION SELECT image_id FROM {batch_log} WHERE error_message <> '' UNION SELECT image_id FROM {batch_log} WHERE status = 'completed'")
def exclusion_sets(t):
    log = t.batch_log
    pick = lambda c: log.filter(c).select("image_id")
    return pick("status = 'failed'").union(pick("error_message <> ''")).union(pick("status = 'completed'")).distinct()


@query("sort_by_resolution", "SELECT slide_id, row_number() OVER (ORDER BY CASE WHEN slide_id % 9 = 0 THEN NULL ELSE width * (1 + slide_id % 13) * height END DESC NULLS LAST, slide_id) AS rank FROM {slides}")
def sort_by_resolution(t):
    """Slides by pixel area, unknown ones last. The slide list is the smallest table: one row per image file."""
    area = F.when(F.col("slide_id") % 9 == 0, None).otherwise(F.col("width") * (1 + F.col("slide_id") % 13) * F.col("height"))
    w = Window.orderBy(F.col("area").desc_nulls_last(), "slide_id")
    return t.slides.select("slide_id", area.alias("area")).select("slide_id", F.row_number().over(w).cast("long").alias("rank"))


@query("oom_by_image", "SELECT image_file, pid, count(*) AS n, round(avg(memory_pct), 6) AS mean_pct FROM {oom_log} GROUP BY image_file, pid")
def oom_by_image(t):
    return t.oom_log.groupBy("image_file", "pid").agg(F.count("*").alias("n"), F.round(F.avg("memory_pct"), 6).alias("mean_pct"))


@query("oom_top10", "SELECT pid, count(*) AS n FROM {oom_log} GROUP BY pid ORDER BY n DESC, pid LIMIT 10")
def oom_top10(t):
    """The report's ten most frequent processes."""
    return t.oom_log.groupBy("pid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pid").limit(10)


@query("first_places", "SELECT event_id, pid FROM {oom_log} ORDER BY event_id LIMIT 10")
def first_places(t):
    """The report's first ten events."""
    return t.oom_log.orderBy("event_id").limit(10).select("event_id", "pid")


@query("skipped_preview", "SELECT det_id FROM {detections} WHERE area_px < 900 ORDER BY det_id LIMIT 20")
def skipped_preview(t):
    """The first twenty skipped identifiers."""
    return t.detections.filter("area_px < 900").orderBy("det_id").limit(20).select("det_id")


_CUR = "c AS (SELECT o_orderkey AS row_id, coalesce(TRY_CAST(CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE), 0) AS cells FROM orders)"


def _curation(t):
    raw = F.when(F.col("o_orderkey") % 11 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("row_id"), F.coalesce(raw.try_cast("double"), F.lit(0.0)).alias("cells")).filter("cells >= 100")


@query("curation_filter", f"WITH {_CUR} SELECT * FROM c WHERE cells >= 100")
def curation_filter(t):
    return _curation(t)


_DEC = "d AS (SELECT event_id AS seq, event_id % 15000 AS row_id, CASE WHEN event_type IN ('view', 'click') THEN 'approved' WHEN event_type = 'error' THEN 'undone' ELSE 'rejected' END AS decision, event_type AS reason FROM events), l AS (SELECT row_id, arg_max(decision, seq) AS decision, arg_max(reason, seq) AS reason, max(seq) AS seq FROM d GROUP BY row_id)"


def _decisions(t):
    """Latest decision per row; an undone decision counts as none."""
    kind = F.when(F.col("event_type").isin("view", "click"), "approved").when(F.col("event_type") == "error", "undone").otherwise("rejected")
    log = t.events.select(F.col("event_id").alias("seq"), (F.col("event_id") % 15000).alias("row_id"), kind.alias("decision"), F.col("event_type").alias("reason"))
    return log.groupBy("row_id").agg(F.max_by("decision", "seq").alias("decision"), F.max_by("reason", "seq").alias("reason"), F.max("seq").alias("seq"))


@query("approved", f"WITH {_CUR}, {_DEC} SELECT c.row_id, cells, l.seq FROM c JOIN l USING (row_id) WHERE cells >= 100 AND decision = 'approved'")
def approved(t):
    return _curation(t).join(_decisions(t).filter("decision = 'approved'"), "row_id").select("row_id", "cells", "seq")


@query("rejected", f"WITH {_CUR}, {_DEC} SELECT c.row_id, cells, reason FROM c JOIN l USING (row_id) WHERE cells >= 100 AND decision = 'rejected'")
def rejected(t):
    return _curation(t).join(_decisions(t).filter("decision = 'rejected'"), "row_id").select("row_id", "cells", "reason")


@query("folder_match", r"""
    WITH f AS (SELECT 'results_' || image_name || CASE WHEN slide_id % 3 = 0 THEN '_extra' ELSE '' END || '_20240102_030405' AS folder, slide_id AS seq FROM {slides}),
         n AS (SELECT folder, seq, regexp_extract(folder, '^results_(.+)_[0-9]+_[0-9]+$', 1) AS name FROM f),
         m AS (SELECT s.slide_id, n.folder, CASE WHEN n.name = s.image_name THEN 0 ELSE 1 END AS prio, n.seq FROM {slides} s JOIN n ON n.name = s.image_name OR starts_with(n.name, s.image_name || '_'))
    SELECT slide_id, arg_min(folder, (prio, seq)) AS folder FROM m GROUP BY slide_id""")
def folder_match(t):
    """Result folder of each image: exact name first, else a name that begins with it; both are key joins on name parts."""
    folder = F.concat(F.lit("results_"), "image_name", F.when(F.col("slide_id") % 3 == 0, "_extra").otherwise(""), F.lit("_20240102_030405"))
    f = t.slides.select(folder.alias("folder"), F.col("slide_id").alias("seq")).withColumn("name", S.run_name(F.col("folder")))
    # every prefix of a folder's name that ends before an underscore is a key
    parts = F.split("name", "_")
    keys = f.withColumn("n", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("key", F.array_join(F.slice(parts, 1, F.col("n")), "_"))
    hit = t.slides.select("slide_id", F.col("image_name").alias("key")).join(keys.select("folder", "seq", "name", "key"), "key").withColumn("prio", F.when(F.col("key") == F.col("name"), 0).otherwise(1))
    return hit.groupBy("slide_id").agg(F.min_by("folder", F.struct("prio", "seq")).alias("folder"))


@query("running_throughput", "SELECT seq, count(*) OVER (PARTITION BY image_id ORDER BY seq) AS done, CAST(sum(seconds) OVER (PARTITION BY image_id ORDER BY seq) AS BIGINT) AS elapsed FROM {batch_log}")
def running_throughput(t):
    w = Window.partitionBy("image_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return t.batch_log.select("seq", F.count("*").over(w).alias("done"), F.sum("seconds").over(w).alias("elapsed"))


@query("lookup_result", "SELECT b.seq, s.image_name FROM {batch_log} b JOIN {slides} s ON s.slide_id = b.image_id")
def lookup_result(t):
    return t.batch_log.join(t.slides, F.col("image_id") == F.col("slide_id")).select("seq", "image_name")
