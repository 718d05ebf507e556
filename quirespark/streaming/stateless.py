"""Stateless operators over streams: an extension, as batch and streaming plans share expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import elements as E
from quirespark.functions import geometry as G
from quirespark.functions import text as T
from quirespark.functions.geometry import Box


def read_parquet_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def typed_elements(detections: DataFrame) -> DataFrame:
    """Detections with kind, category and area, invalid boxes dropped."""
    kind = E.type_of(F.col("label"))
    return detections.filter(G.is_valid(Box.of())).withColumn("kind", kind).withColumn("category", E.category(kind)).withColumn("area", G.box_area(Box.of()))


def cleaned_text(docs: DataFrame, column: str = "text") -> DataFrame:
    return docs.withColumn(column, T.clean_ocr(F.col(column)))


def windowed_counts(elements: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Elements by kind and time window; rows later than ``late`` are dropped."""
    return elements.withWatermark(time, late).groupBy(F.window(time, window), "kind").agg(F.count(F.lit(1)).alias("n"))
