import hashlib

import numpy as np
from pyspark.sql import functions as F

from quirespark.functions import pixels
from quirespark.sources import assets, images, sinks
from quirespark.streaming import stateless


def test_images_and_crops(spark, tmp_path):
    (tmp_path / "a.ppm").write_bytes(pixels.encode(np.zeros((4, 6, 3), np.uint8)))
    (tmp_path / "b.ppm").write_bytes(b"not an image")
    got = {r["path"][-5:]: (r["width"], r["height"], r["error"] is None) for r in images.read_images(spark, str(tmp_path), "*.ppm").collect()}
    assert got == {"a.ppm": (6, 4, True), "b.ppm": (None, None, False)}
    page = images.read_images(spark, str(tmp_path), "a.ppm").select(F.lit(1).alias("doc_id"), F.lit(0).alias("page_idx"), "content")
    boxes = spark.createDataFrame([(1, 0, 7, 1.0, 1.0, 3.0, 4.0), (1, 0, 8, 9.0, 9.0, 12.0, 12.0)], "doc_id int, page_idx int, idx int, x1 double, y1 double, x2 double, y2 double")
    [c] = images.crops(page, boxes).collect()
    assert (c["idx"], c["width"], c["height"]) == (7, 2, 3)


def test_data_source(spark, tmp_path):
    from quirespark.sources.datasource import register

    register(spark)
    for n in range(3):
        (tmp_path / f"{n}.ppm").write_bytes(pixels.encode(np.zeros((2 + n, 3, 3), np.uint8)))
    got = spark.read.format("page_images").option("path", f"{tmp_path}/*.ppm,{tmp_path}/none.ppm").option("files_per_partition", "2").load()
    assert sorted((r["height"] or 0, r["error"] is None) for r in got.collect()) == [(0, False), (2, True), (3, True), (4, True)]


def test_presets(spark):
    from quirespark.sources.presets import class_labels, class_settings

    n = {r["family"]: r["count"] for r in class_labels(spark).groupBy("family").count().collect()}
    assert n["page_25"] == 25 and n["page_23_small"] == 23 and n["page_20"] == 20 and n["page_17_large"] == 17 and len(n) == 15
    assert class_settings(spark).filter("setting = 'page_25' and label = 'seal'").first()["threshold"] == 0.45


def test_dictionary_and_registry(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a\n b\n\nc\n")
    assert [r["entry"] for r in images.read_dictionary(spark, str(tmp_path / "d.txt")).orderBy("pos").collect()] == ["a", " b", "", "c"]
    digest = hashlib.sha256((tmp_path / "d.txt").read_bytes()).hexdigest()
    known = assets.registry(spark, [("d.txt", digest, 8), ("e.txt", "0", 1)])
    files = spark.read.format("binaryFile").load(str(tmp_path / "d.txt"))
    assert [r["ok"] for r in assets.verify(files, known).collect()] == [True]
    assert assets.resolve(str(tmp_path / "d.txt"), "/nowhere", []) == str(tmp_path / "d.txt")


def test_names_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("/x/file.pdf#3",), ("scan.png",), ("plain",)], "p string")
    assert [r[0] for r in df.select(sinks.stem(F.col("p"))).collect()] == ["file_3", "scan", "plain"]
    pages = spark.createDataFrame([(1, 0, "{}", "# a")], "doc_id int, page_idx int, json string, markdown string")
    sinks.save_pages(pages, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out/markdown")).select("value").collect()] == ["# a"]


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", "Title" if i % 2 else "text", 0.0, 0.0, 5.0, 5.0 * (i != 3)) for i in range(6)]
    df = spark.createDataFrame(rows, "ts string, label string, x1 double, y1 double, x2 double, y2 double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = stateless.typed_elements(stateless.read_parquet_stream(spark, str(tmp_path / "in"), df.schema))
    q = stateless.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["kind"], r["n"]) for r in spark.table("counts").groupBy("kind").agg(F.sum("n").alias("n")).collect()} == {("text", 3), ("paragraph_title", 2)}
