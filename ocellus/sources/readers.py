"""Readers and writers of the files around an analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of slide images
IMAGE_EXTENSIONS = (".svs", ".ndpi", ".tiff", ".tif", ".vms", ".vmu", ".scn", ".mrxs", ".svslide", ".bif", ".czi", ".png", ".jpg", ".jpeg")

CELL_SCHEMA = """cell_id LONG, area_px LONG, area_um2 DOUBLE, cx DOUBLE, cy DOUBLE, grid LONG, mpp DOUBLE,
    closest_tumor LONG, distance_um DOUBLE, distance_bin STRING"""

RESULT_SCHEMA = """image_name STRING, image_path STRING, output_dir STRING, total_cells INT, num_tumors INT, total_time DOUBLE, processing_status STRING,
    error_message STRING, median_size DOUBLE, average_size DOUBLE, area_stats MAP<STRING, DOUBLE>, distance_stats MAP<STRING, DOUBLE>, timestamp_start STRING, timestamp_end STRING"""
STATE_SCHEMA = f"""batch_id STRING, start_time STRING, base_output_dir STRING, summary_dir STRING, total_images INT, processed_images INT, successful_images INT, failed_images INT,
    config_snapshot MAP<STRING, STRING>, args_snapshot MAP<STRING, STRING>, image_results ARRAY<STRUCT<{RESULT_SCHEMA.replace(' STRING', ': STRING').replace(' INT,', ': INT,').replace(' DOUBLE,', ': DOUBLE,').replace(' MAP<', ': MAP<').replace('<STRING, DOUBLE>', '<STRING, DOUBLE>')}>>"""


def list_images(spark: SparkSession, path: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """(path, length, modified) of image files in a folder or of one file, sorted; contents are never read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.filter(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")).orderBy("path")


def read_cells(spark: SparkSession, paths: list[str] | str, schema: str = CELL_SCHEMA) -> DataFrame:
    """Per-slide cell tables as one frame, tagged with the file that each row came from."""
    df = spark.read.schema(schema).option("header", True).csv(paths)
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def write_cells(cells: DataFrame, path: str, by: str = "slide_id", kind: str = "parquet") -> None:
    """Cell tables partitioned by slide, each slide's in one file: not one per task and slide."""
    getattr(cells.repartition(by).write.mode("overwrite").partitionBy(by).option("header", True), kind)(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def write_geojson(features: DataFrame, path: str, *gates: bool) -> bool:
    """One feature per line, written only if every gate is open."""
    if not all(gates):
        return False
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)
    return True


def read_batch_states(spark: SparkSession, base: str, strict: bool = False) -> DataFrame:
    """Batch states ``<base>/*/batch_summary/*_state.json``; unreadable files are skipped, or raise with ``strict``."""
    state = spark.read.schema(STATE_SCHEMA + ", _corrupt STRING").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    df = state.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(f"{base}/*/batch_summary/*_state.json")
    return df.filter(F.col("_corrupt").isNull() & F.col("batch_id").isNotNull()).drop("_corrupt").withColumn("state_file", F.col("_metadata.file_path"))


def ome_mpp(xml: Column) -> Column:
    """Mean pixel size in µm of the first image description that has both sizes; null without valid ones.

    Works on OME-XML text: attributes of the first ``Pixels`` element with both
    PhysicalSizeX and PhysicalSizeY, whatever its namespace prefix.
    """
    from ocellus.functions.scalars import pair_mpp

    tags = F.regexp_extract_all(xml, F.lit(r"<(?:\w+:)?Pixels\b([^>]*)>"), 1)
    has = lambda a: F.lit(rf"\b{a}\s*=\s*['\"]")
    tag = F.get(F.filter(tags, lambda x: F.regexp_like(x, has("PhysicalSizeX")) & F.regexp_like(x, has("PhysicalSizeY"))), F.lit(0))
    at = lambda a: F.nullif(F.regexp_extract(tag, rf"\b{a}\s*=\s*['\"]([^'\"]*)['\"]", 1), F.lit(""))
    return pair_mpp(at("PhysicalSizeX"), at("PhysicalSizeY"), at("PhysicalSizeXUnit"), at("PhysicalSizeYUnit"))


def first_present(columns: list[str], aliases: list[str]) -> str | None:
    """The first alias that a table has."""
    return next((a for a in aliases if a in columns), None)


def resolve_columns(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns renamed to canonical names by alias lists; names without a match are absent."""
    found = {name: first_present(df.columns, options) for name, options in aliases.items()}
    return df.select(*[F.col(f"`{have}`").alias(name) for name, have in found.items() if have])


def predict(windows: DataFrame, model, schema: str) -> DataFrame:
    """Detections of a pluggable model: ``model(batch)`` maps a pandas frame of windows to one of detections, with an error column instead of a failed task."""
    import pandas as pd

    names = [f.split()[0] for f in schema.split(",")]

    def run(batches):
        for b in batches:
            try:
                yield model(b).assign(error=None)[[*names, "error"]]
            except Exception as e:  # one bad batch must not fail the job; it is retried window by window
                for i in range(len(b)):
                    try:
                        yield model(b.iloc[i : i + 1]).assign(error=None)[[*names, "error"]]
                    except Exception as one:
                        yield pd.DataFrame({**{n: [b.iloc[i].get(n)] for n in names}, "error": [str(one) or str(e)]})

    return windows.mapInPandas(run, f"{schema}, error string")
