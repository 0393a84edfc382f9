"""The batch driver: a cohort analysed under an append-only log of states, with resume and retry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.config import DEFAULTS, EngineConfig
from ocellus.operators.analysis import analyze
from ocellus.operators.batch import pending
from ocellus.sources.records import append_progress, write_snapshot
from ocellus.sources.scratch import exists, written

LOG = "image_id long, seq long, status string, error_message string, cells long, run long"


def log_of(spark, folder: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{folder}/log") if exists(spark, f"{folder}/log") else spark.createDataFrame([], LOG)


def state_of(spark, folder: str) -> DataFrame:
    """One row per image: its last entry in the log."""
    return log_of(spark, folder).groupBy("image_id").agg(F.max_by(F.struct("seq", "status", "error_message", "cells", "run"), "seq").alias("s")).select("image_id", "s.*")


def _problem():
    bad = lambda c: F.col(c).isNull() | (F.col(c) <= 0)
    return F.when(bad("width") | bad("height"), "failed: image has no size").when(F.col("mpp").isNull() | F.isnan("mpp") | (F.col("mpp") <= 0), "failed: no valid resolution")


def run_batch(slides: DataFrame, detections: DataFrame, tumors: DataFrame, folder: str, config: EngineConfig = DEFAULTS, extent: int = 2000) -> DataFrame:
    """Analyse what the log in ``folder`` leaves to do and return the state of all images.

    A slide is logged as pending when first seen, as processing while its run goes
    on, then as completed or failed. Slides left in processing by a lost run start
    anew; failed ones only with ``config.retry_failed``; completed ones never. A slide
    without size or resolution fails with a message and fails no other. Results of
    a run stand in ``cells/run=N`` and ``summary/run=N`` before its slides count as
    completed, so ``results`` never shows half a run. Slides with a null slide_id are
    left out, of repeated ones one row counts. One driver at a time may write to a folder.
    """
    spark = slides.sparkSession
    slides = written(slides.filter("slide_id IS NOT NULL").dropDuplicates(["slide_id"]))
    image = F.col("slide_id").alias("image_id")
    run = (log_of(spark, folder).agg(F.max("run")).first()[0] or 0) + 1

    def log(images: DataFrame, step: int, status: str, error=F.lit(""), cells=F.lit(0)) -> None:
        images.select("image_id", F.lit(4 * run + step).cast("long").alias("seq"), F.lit(status).alias("status"), error.alias("error_message"), cells.cast("long").alias("cells"), F.lit(run).cast("long").alias("run")).write.mode("append").parquet(f"{folder}/log")
        said = F.concat_ws(" ", F.lit("image"), F.col("image_id"), F.lit(status), F.nullif(error, F.lit("")))
        append_progress(images.select(said.alias("message")), f"{folder}/progress")

    write_snapshot(spark, config, f"{folder}/settings/run={run}")
    log(written(slides.select(image).join(state_of(spark, folder), "image_id", "left_anti")), 0, "pending")
    todo = written(pending(state_of(spark, folder), config.retry_failed).select("image_id").join(slides.select(image), "image_id", "left_semi"))
    if todo.isEmpty():
        return state_of(spark, folder)
    log(todo, 1, "processing")
    mine = slides.join(todo, slides.slide_id == todo.image_id, "left_semi").withColumn("_problem", _problem())
    sound = mine.filter("_problem IS NULL").drop("_problem")
    here = sound.select("slide_id")
    out = analyze(sound, detections.join(here, "slide_id", "left_semi"), tumors.join(here, "slide_id", "left_semi"), config, extent)
    out["cells"].write.mode("overwrite").parquet(f"{folder}/cells/run={run}")
    # the summary is of the cells as written, so that they are not computed again
    cells = spark.read.parquet(f"{folder}/cells/run={run}").groupBy("slide_id").agg(F.count("*").alias("cells"), F.sum("area_px").alias("px"), F.avg("area_um2").alias("mean_um2"), F.stddev_pop("area_um2").alias("std_um2"))
    sound.select("slide_id", "image_name").join(cells, "slide_id", "left").fillna(0, ["cells", "px"]).write.mode("overwrite").parquet(f"{folder}/summary/run={run}")
    log(mine.filter("_problem IS NOT NULL").select(image, "_problem"), 2, "failed", F.col("_problem"))
    log(spark.read.parquet(f"{folder}/summary/run={run}").select(image, "cells"), 3, "completed", cells=F.col("cells"))
    return state_of(spark, folder)


def results(spark, folder: str, kind: str = "cells") -> DataFrame:
    """Rows of ``kind`` ("cells" or "summary") of the runs in which their slides were completed."""
    done = state_of(spark, folder).filter("status = 'completed'").select(F.col("image_id").alias("slide_id"), "run")
    rows = spark.read.parquet(f"{folder}/{kind}")
    return rows.withColumn("run", F.col("run").cast("long")).join(done, ["slide_id", "run"], "left_semi").drop("run")
