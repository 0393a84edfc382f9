"""Statistics of slides and cohorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ocellus.functions import scalars as S
from ocellus.plans.registry import query

_UM2 = "d AS (SELECT d.*, s.image_name, s.mpp, d.area_px * s.mpp * s.mpp AS um2, sqrt(d.x1 * d.x1 + d.y1 * d.y1) * s.mpp AS dist FROM {detections} d JOIN {slides} s USING (slide_id))"


def _quantiles(d, **wanted):
    """A row per slide with quantiles named by ``wanted``: (column, p)."""
    columns = sorted({c for c, _ in wanted.values()})
    values = d.groupBy("slide_id").agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in columns])
    return values.select("slide_id", *[S.quantile_cont(F.col(c), p).alias(name) for name, (c, p) in wanted.items()])


def _um2(t):
    q = t.detections.join(t.slides.select("slide_id", "image_name", "mpp"), "slide_id")
    return q.withColumn("um2", F.col("area_px") * F.col("mpp") * F.col("mpp")).withColumn("dist", F.sqrt(F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1")) * F.col("mpp"))


@query("area_stats", f"WITH {_UM2} SELECT slide_id, avg(um2) AS mean, sum(um2) AS total FROM d GROUP BY slide_id")
def area_stats(t):
    return _um2(t).groupBy("slide_id").agg(F.avg("um2").alias("mean"), F.sum("um2").alias("total"))


@query("slide_summary", f"WITH {_UM2} SELECT image_name, count(*) AS total_cells, round(avg(um2), 6) AS mean, median(um2) AS median, round(stddev_pop(um2), 6) AS std, min(um2) AS lo, max(um2) AS hi, sum(um2) AS total FROM d GROUP BY image_name")
def slide_summary(t):
    """Per slide, with the population standard deviation."""
    return _um2(t).groupBy("image_name").agg(F.count("*").alias("total_cells"), F.round(F.avg("um2"), 6).alias("mean"), F.median("um2").alias("median"), F.round(F.stddev_pop("um2"), 6).alias("std"), F.min("um2").alias("lo"), F.max("um2").alias("hi"), F.sum("um2").alias("total"))


@query("cohort_stats", f"WITH {_UM2} SELECT image_name, count(*) AS n, round(median(um2), 1) AS median, round(avg(um2), 1) AS mean, round(stddev_samp(um2), 1) AS std FROM d GROUP BY image_name")
def cohort_stats(t):
    """Per slide of a cohort, with the sample standard deviation, to one decimal."""
    return _um2(t).groupBy("image_name").agg(F.count("*").alias("n"), F.round(F.median("um2"), 1).alias("median"), F.round(F.avg("um2"), 1).alias("mean"), F.round(F.stddev_samp("um2"), 1).alias("std"))


def histogram(df, by: list[str], value: str, bins: int):
    """Counts of equal-width bins between a group's least and largest value; the last bin includes its right end."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = df.join(ends, by) if by else df.join(F.broadcast(ends))  # without groups there is one row of ends
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)))
    return at.withColumn("bin", index.cast("long")).groupBy(*by, "bin").agg(F.count("*").alias("n"))


@query("cohort_hist50", f"""WITH {_UM2}, e AS (SELECT min(um2) AS lo, max(um2) AS hi FROM d) SELECT CAST(least(floor((um2 - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS n FROM d, e GROUP BY 1""")
def cohort_hist50(t):
    return histogram(_um2(t), [], "um2", 50)


@query("channel_histogram", f"""WITH {_UM2}, e AS (SELECT slide_id, min(um2) AS lo, max(um2) AS hi FROM d GROUP BY 1) SELECT slide_id, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((um2 - lo) / ((hi - lo) / 256)), 255) END AS BIGINT) AS bin, count(*) AS n FROM d JOIN e USING (slide_id) GROUP BY ALL""")
def channel_histogram(t):
    """256 bins over each group's own range."""
    return histogram(_um2(t), ["slide_id"], "um2", 256)


@query("drop_outliers", f"""WITH {_UM2}, q AS (SELECT slide_id, quantile_cont(dist, 0.99) AS q99 FROM d GROUP BY 1) SELECT d.det_id, d.dist FROM d JOIN q USING (slide_id) WHERE d.dist <= q99 AND d.dist IS NOT NULL""")
def drop_outliers(t):
    d = _um2(t).dropna(subset=["dist", "um2"])
    q = _quantiles(d, q99=("dist", 0.99))
    return d.join(q, "slide_id").filter(F.col("dist") <= F.col("q99")).select("det_id", "dist")


@query("cohort_dist_size_hist", f"""WITH {_UM2}, q AS (SELECT slide_id, quantile_cont(dist, 0.99) AS dq, quantile_cont(um2, 0.01) AS lo, quantile_cont(um2, 0.99) AS hi FROM d GROUP BY 1)
    SELECT slide_id, CAST(least(floor(dist / (dq / 8)), 7) AS BIGINT) AS dist_bin, CAST(least(floor((um2 - lo) / ((hi - lo) / 39)), 38) AS BIGINT) AS size_bin, count(*) AS n FROM d JOIN q USING (slide_id) WHERE dist <= dq AND um2 BETWEEN lo AND hi GROUP BY ALL""")
def cohort_dist_size_hist(t):
    """Two-dimensional counts: eight distance bins up to the 99th percentile, 39 size bins between the 1st and 99th."""
    d = _um2(t)
    q = _quantiles(d, dq=("dist", 0.99), lo=("um2", 0.01), hi=("um2", 0.99))
    at = d.join(q, "slide_id").filter((F.col("dist") <= F.col("dq")) & F.col("um2").between(F.col("lo"), F.col("hi")))
    # bins of no width hold what lies in the last one
    bin_ = lambda v, width, last: F.least(F.floor(F.try_divide(v, width)), F.lit(last))
    return at.groupBy("slide_id", bin_(F.col("dist"), F.col("dq") / 8, 7).alias("dist_bin"), bin_(F.col("um2") - F.col("lo"), (F.col("hi") - F.col("lo")) / 39, 38).alias("size_bin")).agg(F.count("*").alias("n"))


@query("bin_edges", f"""WITH {_UM2}, q AS (SELECT slide_id, quantile_cont(dist, 0.99) AS dq FROM d GROUP BY 1) SELECT slide_id, i.i, i.i * dq / 8 AS edge FROM q, (SELECT unnest(range(0, 9)) AS i) i""")
def bin_edges(t):
    q = _quantiles(_um2(t), dq=("dist", 0.99))
    return q.select("slide_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: i * F.col("dq") / 8)).alias("i", "edge"))


@query("minmax_area_color", f"WITH {_UM2} SELECT det_id, CASE WHEN max(um2) OVER w = min(um2) OVER w THEN 0.0 ELSE (um2 - min(um2) OVER w) / (max(um2) OVER w - min(um2) OVER w) END AS shade FROM d WINDOW w AS (PARTITION BY slide_id)")
def minmax_area_color(t):
    w = Window.partitionBy("slide_id")
    lo, hi = F.min("um2").over(w), F.max("um2").over(w)
    return _um2(t).select("det_id", F.when(hi == lo, 0.0).otherwise((F.col("um2") - lo) / (hi - lo)).alias("shade"))


@query("heat_values", "SELECT det_id, CAST(floor(CAST(area_px AS DOUBLE) / max(area_px) OVER (PARTITION BY slide_id) * 255) AS BIGINT) AS heat FROM {detections}")
def heat_values(t):
    top = F.max("area_px").over(Window.partitionBy("slide_id"))
    return t.detections.select("det_id", F.floor(F.col("area_px").cast("double") / top * 255).alias("heat"))


_EMB = "e AS (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


def _elementwise(name: str, sql: str, f) -> None:
    @query(f"elementwise_{name}", f"WITH {_EMB} SELECT label, CAST(pos AS INTEGER) AS pos, round({sql}, 5) AS v FROM e GROUP BY ALL")
    def run(t):
        e = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
        return e.groupBy("label", "pos").agg(F.round(f(F.col("x")), 5).alias("v"))


_elementwise("sum", "sum(CAST(v AS DOUBLE))", F.sum)
_elementwise("mean", "avg(CAST(v AS DOUBLE))", F.avg)
_elementwise("max", "max(CAST(v AS DOUBLE))", F.max)
_elementwise("min", "min(CAST(v AS DOUBLE))", F.min)


@query("elementwise_logic", f"WITH {_EMB} SELECT label, CAST(pos AS INTEGER) AS pos, bool_or(v > 0) AS some, bool_and(v > 0) AS every FROM e GROUP BY ALL")
def elementwise_logic(t):
    e = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.bool_or(F.col("x") > 0).alias("some"), F.bool_and(F.col("x") > 0).alias("every"))


@query("cohort_rollup", f"""WITH {_UM2} SELECT image_name, CASE WHEN dist <= 100 THEN 'Close' WHEN dist <= 500 THEN 'Medium' ELSE 'Far' END AS bin, count(*) AS n, sum(area_px)::BIGINT AS px FROM d GROUP BY ROLLUP (image_name, bin)""")
def cohort_rollup(t):
    """Subtotals by slide and distance bin."""
    from ocellus.functions.scalars import distance_bin

    return _um2(t).withColumn("bin", distance_bin(F.col("dist"))).rollup("image_name", "bin").agg(F.count("*").alias("n"), F.sum("area_px").alias("px"))


@query("throughput_ratios", "SELECT image_id, count(*) AS images, CAST(sum(seconds) AS BIGINT) AS seconds, coalesce(count(*) / nullif(CAST(sum(seconds) AS DOUBLE), 0), 0.0) AS rate FROM {batch_log} GROUP BY image_id")
def throughput_ratios(t):
    return t.batch_log.groupBy("image_id").agg(F.count("*").alias("images"), F.sum("seconds").alias("seconds")).withColumn("rate", F.coalesce(F.try_divide("images", F.col("seconds").cast("double")), F.lit(0.0)))


@query("peak_tracking", "SELECT user_id, max(value) AS peak, arg_max(event_id, (value, -event_id)) AS peak_event FROM events WHERE value IS NOT NULL GROUP BY user_id")
def peak_tracking(t):
    return t.events.filter("value IS NOT NULL").groupBy("user_id").agg(F.max("value").alias("peak"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("peak_event"))


@query("hit_rate", "SELECT event_type, count(*) AS reads, count(*) FILTER (value > 50) AS hits, count(*) FILTER (value > 50) / CAST(count(*) AS DOUBLE) AS rate FROM events GROUP BY event_type")
def hit_rate(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("reads"), F.count_if(F.col("value") > 50).alias("hits")).withColumn("rate", F.col("hits") / F.col("reads"))


@query("valid_distances", "WITH q AS (SELECT slide_id, det_id, CASE WHEN x1 % 7 = 0 THEN -1.0 ELSE CAST(x1 AS DOUBLE) END AS d FROM {detections}) SELECT slide_id, coalesce(avg(d) FILTER (d >= 0), 0.0) AS mean, max(d) >= 0 AS some FROM q GROUP BY slide_id")
def valid_distances(t):
    """Only distances of zero or more count; the flag tells whether a slide has any."""
    q = t.detections.withColumn("d", F.when(F.col("x1") % 7 == 0, -1.0).otherwise(F.col("x1").cast("double")))
    return q.groupBy("slide_id").agg(F.coalesce(F.avg(F.when(F.col("d") >= 0, F.col("d"))), F.lit(0.0)).alias("mean"), (F.max("d") >= 0).alias("some"))


@query("even_sample5", "WITH q AS (SELECT slide_id, det_id, row_number() OVER (PARTITION BY slide_id ORDER BY det_id) - 1 AS i, count(*) OVER (PARTITION BY slide_id) AS n FROM {detections}) SELECT slide_id, det_id FROM q WHERE i IN (SELECT DISTINCT unnest([0, (n - 1) // 4, 2 * (n - 1) // 4, 3 * (n - 1) // 4, n - 1]))")
def even_sample5(t):
    """Five evenly spaced rows of each slide."""
    w = Window.partitionBy("slide_id")
    q = t.detections.withColumn("i", F.row_number().over(w.orderBy("det_id")) - 1).withColumn("n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.floor(k * (F.col("n") - 1) / 4))
    return q.filter(F.array_contains(picks, F.col("i").cast("long"))).select("slide_id", "det_id")


@query("union_frames", "SELECT slide_id, image_name, NULL AS tumor_key, mpp FROM {slides} UNION ALL SELECT slide_id, NULL, tumor_key, NULL FROM {tumors}")
def union_frames(t):
    """Tables with different columns stacked by name, missing values null."""
    return t.slides.select("slide_id", "image_name", "mpp").unionByName(t.tumors.select("slide_id", "tumor_key"), allowMissingColumns=True)


@query("percentile_sketch")
def percentile_sketch(t):
    """Approximate percentiles, for cohorts too large for exact ones."""
    return _um2(t).groupBy("image_name").agg(F.percentile_approx("um2", [0.01, 0.5, 0.99], 10000).alias("p"))
