"""State of a batch as an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Which status wins when an image has several
PRIORITY = {"completed": 4, "failed": 3, "processing": 2, "pending": 1}


def priority(status: str = "status"):
    out = F.lit(0)
    for name, rank in PRIORITY.items():
        out = F.when(F.col(status) == name, rank).otherwise(out)
    return out


def best_status(log: DataFrame, key: str = "image_id", seq: str = "seq") -> DataFrame:
    """One row per image: the highest status, of equals the first. Rows without a key are dropped."""
    w = Window.partitionBy(key).orderBy(priority().desc(), seq)
    return log.filter(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def pending(log: DataFrame, retry_failed: bool = False, key: str = "image_id", seq: str = "seq") -> DataFrame:
    """Entries still to do, interrupted ones reset to pending; the first entry of each image.

    With ``retry_failed`` failed entries come too. Without, an image is left out if
    any entry of it failed, completed, or carries an error message.
    """
    waiting = log.filter(F.col("status").isin("pending", "processing"))
    if retry_failed:
        todo = log.filter(F.col("status").isin("pending", "processing", "failed"))
    else:
        done = log.filter(F.col("status").isin("failed", "completed") | (F.trim("error_message") != "")).select(key).distinct()
        todo = waiting.join(done, key, "left_anti")
    reset = F.col("status") == "processing"
    todo = todo.withColumn("error_message", F.when(reset, "").otherwise(F.col("error_message"))).withColumn("status", F.when(reset, "pending").otherwise(F.col("status")))
    w = Window.partitionBy(key).orderBy(seq)
    return todo.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
