"""Streams of status and error events.

Each function takes a streaming (or batch) frame and returns the transformed
frame; ``drain`` runs a query over all files that are there and stops.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ocellus.sources.scratch import _root


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """A stream of the parquet files under ``path``, a few per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def in_slices(df: DataFrame, order: Column, slices: int = 4) -> str:
    """Write a table as files in order of time, the way a log directory fills; the folder's path comes back."""
    path = f"{_root(df.sparkSession)}/ocellus-log-{uuid.uuid4().hex}"
    df.repartitionByRange(slices, order).sortWithinPartitions(order).write.parquet(path)
    return path


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over what there is, with its own checkpoint, and read what it wrote.

    Append streams go to parquet files; an update or complete stream keeps its last
    state through ``foreachBatch`` into one folder per batch, of which the result is read.
    """
    spark = stream.sparkSession
    out = f"{_root(spark)}/ocellus-sink-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n:09d}")).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    done = spark.read.option("basePath", out).parquet(out)
    if mode == "complete":
        last = done.agg(F.max("batch")).first()[0]
        return done.filter(F.col("batch") == last).drop("batch")
    return done


def tumbling(events: DataFrame, size: str = "1 day", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and mean per window and kind; windows close when the watermark passes them."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a user: events at most ``gap`` apart."""
    out = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "user_id", "n")


def latest_status(log: DataFrame) -> DataFrame:
    """Status of highest sequence per image; late updates never overwrite newer ones."""
    return log.groupBy("image_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def retries(log: DataFrame, idle_ms: int = 1000):
    """(image_id, status) of images left in processing when no update came for ``idle_ms``: they go back to pending."""

    def step(key, parts, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            status = state.get[1]
            state.remove()
            if status == "processing":
                yield pd.DataFrame({"image_id": [key[0]], "status": ["pending"]})
            return
        seq, status = state.get if state.exists else (-1, "")
        for part in parts:
            top = part.sort_values("seq").iloc[-1]
            if top.seq > seq:
                seq, status = int(top.seq), str(top.status)
        state.update((seq, status))
        state.setTimeoutDuration(idle_ms)

    return log.groupBy("image_id").applyInPandasWithState(step, "image_id long, status string", "seq long, status string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def map_chunks(chunks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Streamed chunks of labels renamed by a static table; labels without a new name stay."""
    return chunks.join(mapping, "label", "left").withColumn("label", F.coalesce("new_label", "label")).drop("new_label")
