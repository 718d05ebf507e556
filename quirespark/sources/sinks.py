"""Writers of page results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """File name of an input without its ending; ``file.pdf#3`` gives ``file_3``."""
    name = F.element_at(F.split(path, "/"), -1)
    page = F.regexp_extract(name, r"#(\d+)$", 1)
    base = F.regexp_replace(F.regexp_replace(name, r"#\d+$", ""), r"(?<=.)\.[^.]*$", "")
    return F.when(page != "", F.concat(base, F.lit("_"), page)).otherwise(base)


def page_name(page: Column) -> Column:
    """``page_001`` of page 1."""
    return F.format_string("page_%03d", page)


def save_pages(pages: DataFrame, folder: str, columns: Sequence[str] = ("json", "html", "markdown"), keys: Sequence[str] = ("doc_id", "page_idx")) -> None:
    """Each of ``columns`` as text under ``folder/<column>``, partitioned by document and page."""
    for c in columns:
        if c in pages.columns:
            pages.select(*keys, F.col(c).alias("value")).write.mode("overwrite").partitionBy(*keys).text(f"{folder}/{c}")


def save_documents(docs: DataFrame, folder: str, column: str = "markdown", key: str = "doc_id") -> None:
    """One text a document under ``folder``, partitioned by document."""
    docs.select(key, F.col(column).alias("value")).write.mode("overwrite").partitionBy(key).text(folder)


def save_crops(crops: DataFrame, folder: str) -> None:
    """Crops (path, content) as a binary table; a consumer writes files from it."""
    crops.write.mode("overwrite").parquet(folder)


def export_markdown_with_images(elements: DataFrame, markdown: DataFrame, crops: DataFrame, folder: str) -> None:
    """Markdown of pages, and the crops of pictures and charts under the names that it refers to."""
    r = lambda c: F.format_string("%.0f", F.bround(F.col(c).cast("double"), 0))
    pics = elements.filter(F.col("kind").isin("image", "chart")).join(crops.select("doc_id", "page_idx", "idx", "content"), ["doc_id", "page_idx", "idx"])
    name = F.concat(F.lit("imgs/img_in_"), "kind", F.lit("_box_"), r("x1"), F.lit("_"), r("y1"), F.lit("_"), r("x2"), F.lit("_"), r("y2"), F.lit(".jpg"))
    save_pages(markdown, f"{folder}/pages", ("markdown",))
    save_crops(pics.select("doc_id", "page_idx", name.alias("path"), "content"), f"{folder}/images")
