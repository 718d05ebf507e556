"""Page images and dictionaries as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_SCHEMA = "path string, content binary, width int, height int, error string"


def read_images(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*", strict: bool = False) -> DataFrame:
    """(path, content, width, height, error) of image files, as bytes.

    Undecodable files keep their row with an error; ``strict`` fails the job
    instead, which makes loading all-or-nothing.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths).select("path", "content")
    out = probe(raw)
    if strict:
        out = out.withColumn("path", F.when(F.col("error").isNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("cannot read "), F.col("path"), F.lit(": "), F.col("error")))))
    return out


def probe(raw: DataFrame) -> DataFrame:
    """(path, content) with the decoded size or the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from quirespark.functions.pixels import decode

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    h, w = decode(bytes(content)).shape[:2]
                    rows.append((path, content, w, h, None))
                except Exception as e:  # noqa: BLE001 - the row carries it
                    rows.append((path, content, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "content", "width", "height", "error"]).astype({"width": "Int32", "height": "Int32"})

    return raw.mapInPandas(run, IMAGE_SCHEMA)


def crops(pages: DataFrame, boxes: DataFrame, keys: Sequence[str] = ("doc_id", "page_idx")) -> DataFrame:
    """keys, idx, content, width, height, wh_ratio: the crop of each box of each page (content, as bytes).

    A page's boxes travel to its image once, packed; crops without extent are
    left out.
    """
    packed = boxes.groupBy(*keys).agg(F.collect_list(F.struct("idx", "x1", "y1", "x2", "y2")).alias("bs"))
    types = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in (*keys, "idx")) + ", content binary, width int, height int, wh_ratio double"

    def run(batches):
        from quirespark.functions.pixels import crop, decode, encode

        for b in batches:
            for row in b.to_dict("records"):
                image, rows = decode(bytes(row["content"])), []
                for s in row["bs"]:
                    part = crop(image, (s["x1"], s["y1"], s["x2"], s["y2"]))
                    if part is not None:
                        h, w = part.shape[:2]
                        rows.append([*(row[k] for k in keys), s["idx"], encode(part), w, h, w / h])
                yield pd.DataFrame(rows, columns=[*keys, "idx", "content", "width", "height", "wh_ratio"])

    return pages.select(*keys, "content").join(packed, list(keys)).mapInPandas(run, schema)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(pos, entry): a text file's lines in order, ends of line removed; one file, one task."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r?\n$", "").alias("v"))
    return whole.select(F.posexplode(F.split("v", "\r?\n", -1)).alias("pos", "entry"))


def read_whole(spark: SparkSession, path: str) -> str:
    """A small text file as one string."""
    return spark.read.text(path, wholetext=True).first()[0]


class PdfSource:
    """Pages of PDF files: (path, page_no, width, height, content). Needs a renderer, which is given.

    ``render(content, page_no, max_size)`` returns (width, height, bytes);
    ``count(content)`` the number of pages. Scaling: ``max_size`` capped at three
    times the page, twice the page by default.
    """

    def __init__(self, count, render):
        self.count, self.render = count, render

    def pages(self, files: DataFrame, max_size: tuple[int, int] | None = None) -> DataFrame:
        count, render = self.count, self.render

        def run(batches):
            for b in batches:
                for path, content in zip(b["path"], b["content"]):
                    for n in range(1, count(bytes(content)) + 1):
                        w, h, image = render(bytes(content), n, max_size)
                        yield pd.DataFrame([(path, n, w, h, image)], columns=["path", "page_no", "width", "height", "content"])

        return files.select("path", "content").mapInPandas(run, "path string, page_no int, width int, height int, content binary")
