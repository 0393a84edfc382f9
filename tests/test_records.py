"""The batch driver and the records of a run: resume, retry, isolation of failures, round trips."""

import datetime
import os
import time

from ocellus.config import EngineConfig
from ocellus.operators import runs as D
from ocellus.sources import records as R
from ocellus.streaming import logs as L

SLIDES = "slide_id long, image_name string, width long, height long, mpp double"
DETECTIONS = "det_id long, slide_id long, x1 long, y1 long, x2 long, y2 long, area_px long, score double"
TUMORS = "tumor_key long, slide_id long, x1 long, y1 long, x2 long, y2 long, score double"


def frames(spark, slides):
    dets = [(10, 1, 0, 0, 60, 60, 3600, 0.9), (11, 1, 200, 200, 260, 260, 3600, 0.8), (20, 2, 0, 0, 60, 60, 3600, 0.9), (30, 3, 0, 0, 60, 60, 3600, 0.9)]
    return spark.createDataFrame(slides, SLIDES), spark.createDataFrame(dets, DETECTIONS), spark.createDataFrame([(5, 1, 100, 100, 180, 180, 1.0)], TUMORS)


def state(df):
    return {r.image_id: (r.status, r.error_message, r.cells) for r in df.collect()}


def test_driver_isolates_failures_and_retries_them_on_demand(spark, tmp_path):
    folder = f"file://{tmp_path}/batch"
    slides = [(1, "a", 2000, 2000, 0.5), (2, "b", 2000, 2000, None), (3, "c", 0, 2000, 0.5), (4, "d", 2000, 2000, 0.5), (4, "d", 2000, 2000, 0.5), (None, "e", 1, 1, 0.5)]
    first = state(D.run_batch(*frames(spark, slides), folder))
    assert first == {1: ("completed", "", 2), 2: ("failed", "failed: no valid resolution", 0), 3: ("failed", "failed: image has no size", 0), 4: ("completed", "", 0)}
    mended = [(1, "a", 2000, 2000, 0.5), (2, "b", 2000, 2000, 0.5), (3, "c", 2000, 2000, 0.5), (4, "d", 2000, 2000, 0.5)]
    assert state(D.run_batch(*frames(spark, mended), folder)) == first  # failed slides wait for a retry
    again = state(D.run_batch(*frames(spark, mended), folder, EngineConfig(retry_failed=True)))
    assert {k: v[0] for k, v in again.items()} == dict.fromkeys((1, 2, 3, 4), "completed") and again[2][2] == 1
    assert sorted((r.slide_id, r.cell_id) for r in D.results(spark, folder).collect()) == [(1, 1), (1, 2), (2, 1), (3, 1)]
    assert sorted((r.slide_id, r.cells) for r in D.results(spark, folder, "summary").collect()) == [(1, 2), (2, 1), (3, 1), (4, 0)]
    said = [r.message for r in R.read_progress(spark, f"{folder}/progress").collect()]
    assert said.count("image 2 processing") == 2 and "image 2 failed failed: no valid resolution" in said and said.count("image 1 processing") == 1


def test_driver_resumes_an_interrupted_run(spark, tmp_path):
    folder = f"file://{tmp_path}/batch"
    lost = [(1, 4, "pending", "", 0, 1), (1, 5, "processing", "", 0, 1), (2, 4, "pending", "", 0, 1), (2, 7, "completed", "", 1, 1)]
    spark.createDataFrame(lost, D.LOG).write.parquet(f"{folder}/log")
    # cells that the lost run had written for slide 1 do not count
    spark.createDataFrame([(1, 99), (2, 1)], "slide_id long, cell_id long").write.parquet(f"{folder}/cells/run=1")
    done = state(D.run_batch(*frames(spark, [(1, "a", 2000, 2000, 0.5), (2, "b", 2000, 2000, 0.5)]), folder))
    assert done == {1: ("completed", "", 2), 2: ("completed", "", 1)}
    assert sorted((r.slide_id, r.cell_id) for r in D.results(spark, folder).select("slide_id", "cell_id").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_driver_takes_no_slides(spark, tmp_path):
    assert state(D.run_batch(*frames(spark, []), f"file://{tmp_path}/batch")) == {}


def test_snapshot_returns_as_settings(spark, tmp_path):
    was = EngineConfig(min_area_um2=10.0, window=(512, 512), output_dir="there")
    R.write_snapshot(spark, was, str(tmp_path / "s"))
    assert EngineConfig().with_saved(R.read_snapshot(spark, str(tmp_path / "s"))) == was
    assert EngineConfig(output_dir="here").with_saved(R.read_snapshot(spark, str(tmp_path / "s"))).output_dir == "here"


def test_progress_lines(spark, tmp_path):
    path = str(tmp_path / "p")
    at = datetime.datetime(2024, 5, 6, 7, 8, 9)
    df = spark.createDataFrame([("one\ntwo", at), (None, at), ("", at)], "message string, at timestamp")
    R.append_progress(df, path, df["at"])
    R.append_progress(df.limit(1), path, df["at"])
    spark.createDataFrame([("other",)], "value string").write.mode("append").text(path)
    assert sorted((str(r.at), r.message) for r in R.read_progress(spark, path).collect()) == [("2024-05-06 07:08:09", ""), *[("2024-05-06 07:08:09", "one two")] * 2]


def test_font_listings(spark):
    listing = "name type encoding emb sub uni object ID\n-----\nABC+Arial  CID TrueType   Identity-H yes yes no 12 0\r\nOld Type 3 Custom no no yes 7 0  \n Indented Type 1 X yes no no 1 0\nbroken line\n"
    df = spark.createDataFrame([(1, listing), (2, "nothing"), (3, None)], "id long, report string")
    rows = {r.name: r for r in R.font_rows(df, ["id"]).collect()}
    assert set(rows) == {"ABC+Arial", "Old"} and rows["ABC+Arial"].font_type == "CID TrueType" and rows["ABC+Arial"].embedded and rows["Old"].generation == "0"
    found = {(r.id, r.problem, r.fonts) for r in R.font_problems(df, ["id"]).collect()}
    assert found == {(1, "type 3", "Old (Type 3)"), (1, "not embedded", "Old (Type 3)"), (2, "no fonts", ""), (3, "no fonts", "")}


def test_areas_are_probed_once(spark, tmp_path):
    probes = tmp_path / "probes"
    probes.mkdir()

    def probe(path):
        open(f"{probes}/{path}-{time.time_ns()}", "w").close()
        return {"a": 6, "b": None}[path]  # c raises

    when = datetime.datetime(2024, 1, 1)
    schema, cache = "path string, modified timestamp", f"file://{tmp_path}/cache"
    files = spark.createDataFrame([("a", when), ("b", when), ("c", when), ("a", when)], schema)
    for _ in range(2):
        assert {r.path: r.area_px for r in R.pixel_areas(files, cache, probe).collect()} == {"a": 6, "b": None, "c": None}
    assert sorted(n.split("-")[0] for n in os.listdir(probes)) == ["a", "b", "c"]
    later = spark.createDataFrame([("a", datetime.datetime(2024, 1, 2))], schema)  # a changed file is probed again
    assert [r.area_px for r in R.pixel_areas(later, cache, probe).collect()] == [6] and len(os.listdir(probes)) == 4


def test_first_existing_cell_table_counts(spark, tmp_path):
    def table(folder, name, text):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)

    column = R.AREA_COLUMN
    table("one", R.CELL_TABLE_NAMES[0].format(image="im 1"), f"id,{column}\n1,2\n2,4\n3,9\n4,\n")
    table("one", R.CELL_TABLE_NAMES[2], f"{column}\n100\n")
    table("two", R.CELL_TABLE_NAMES[1].format(image="im2"), "other\n5\n")  # unusable, yet the first that exists
    table("two", R.CELL_TABLE_NAMES[2], f"{column}\n100\n")
    table("three", R.CELL_TABLE_NAMES[2], f"{column}\n7\n")
    images = spark.createDataFrame([("one", "im 1"), ("two", "im2"), ("three", "im3"), ("four", "im4")], "folder string, image_name string")
    got = {r.folder: (r.median_size, r.average_size) for r in R.size_stats(images, str(tmp_path)).collect()}
    assert got == {"one": (4.0, 5.0), "two": (0.0, 0.0), "three": (7.0, 7.0), "four": (0.0, 0.0)}


def test_started_stream_resets_interrupted_images(spark, tmp_path):
    rows = [(1, 1, "processing"), (2, 2, "processing"), (3, 2, "completed"), (4, 3, "pending"), (5, 3, "processing")]
    spark.createDataFrame(rows, "seq long, image_id long, status string").write.parquet(str(tmp_path / "log"))
    stream = L.retries(L.file_stream(spark, str(tmp_path / "log"), "seq long, image_id long, status string"), idle_ms=200)
    query = stream.writeStream.format("memory").queryName("reset_images").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("reset_images").count() < 2:
            time.sleep(0.5)
        assert sorted((r.image_id, r.status) for r in spark.table("reset_images").collect()) == [(1, "pending"), (3, "pending")]
    finally:
        query.stop()
