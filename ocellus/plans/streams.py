"""Streaming queries run to completion over a directory of files; the oracle is the same question asked of the table."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ocellus.plans.registry import query
from ocellus.streaming import logs as L

#: Files written together may be read in any order; nothing is late until the closing mark.
_PATIENT = "60 days"


def _events(t):
    """The event log (times in the session's zone) as a stream of four files in order of time, and a closing mark far ahead that lets all windows end."""
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    path = L.in_slices(e, F.col("ts"))
    end = e.select(F.lit(-1).cast("long").alias("event_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value")).limit(1)
    end.coalesce(1).write.mode("append").parquet(path)
    return L.file_stream(t.spark, path, e.schema, 1)


def _naive(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("stop", F.col("stop").cast("timestamp_ntz")).withColumn("mean", F.round("mean", 6))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS stop, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_tumbling(t):
    return _naive(L.drain(L.tumbling(_events(t), delay=_PATIENT))).filter("event_type <> 'end'")


@query("stream_sliding", """SELECT s.start, s.start + INTERVAL '2 days' AS stop, event_type, count(*) AS n, round(avg(value), 6) AS mean
    FROM events, LATERAL (SELECT unnest([time_bucket(INTERVAL '1 day', ts), time_bucket(INTERVAL '1 day', ts) - INTERVAL '1 day']) AS start) s GROUP BY ALL""")
def stream_sliding(t):
    return _naive(L.drain(L.tumbling(_events(t), "2 days", _PATIENT, "1 day"))).filter("event_type <> 'end'")


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL '6 hours' AS stop, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(t):
    out = L.drain(L.sessions(_events(t), "6 hours", _PATIENT)).filter("user_id >= 0")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("stop", F.col("stop").cast("timestamp_ntz"))


@query("stream_status_latest", "SELECT image_id, arg_max(status, seq) AS status, max(seq) AS seq FROM {batch_log} GROUP BY image_id")
def stream_status_latest(t):
    log = t.batch_log.select("seq", "image_id", "status")
    stream = L.file_stream(t.spark, L.in_slices(log, F.col("seq")), log.schema, 1)
    return L.drain(L.latest_status(stream), "complete")


@query("stream_late_drop", """WITH e AS (SELECT event_id, ts, event_type, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS late FROM events) SELECT event_type, count(*) AS n FROM e WHERE late = 0 GROUP BY event_type""")
def stream_late_drop(t):
    """Events that come after the watermark has passed their window are dropped: every tenth event arrives in a last file."""
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.lit(0.0).alias("value"))
    path = L.in_slices(e.filter("event_id % 10 <> 0"), F.col("ts"))
    mark = e.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2100-01-01").cast("timestamp").alias("ts"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    # a batch judges lateness by the watermark of the batch before the last one: two marks pass before the late events
    for extra in (mark, mark, e.filter("event_id % 10 = 0"), mark.withColumn("ts", F.lit("2200-01-01").cast("timestamp"))):
        time.sleep(1.1)  # file streams take files in order of their times, which have a resolution of a second on some stores
        extra.coalesce(1).write.mode("append").parquet(path)
    out = L.drain(L.tumbling(L.file_stream(t.spark, path, e.schema, 1), delay=_PATIENT))
    return out.filter("event_type <> 'end'").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("stream_map_chunks", "SELECT det_id AS label, slide_id FROM {detections} WHERE det_id % 2 = 1 UNION ALL SELECT det_id // 2 AS label, slide_id FROM {detections} WHERE det_id % 2 = 0")
def stream_map_chunks(t):
    """A stream of labels joined with a static table of new names."""
    chunks = t.detections.select(F.col("det_id").alias("label"), "slide_id")
    mapping = t.detections.filter("det_id % 2 = 0").select(F.col("det_id").alias("label"), F.floor(F.col("det_id") / 2).alias("new_label"))
    return L.drain(L.map_chunks(L.file_stream(t.spark, L.in_slices(chunks, F.col("label")), chunks.schema), mapping)).select("label", "slide_id")
