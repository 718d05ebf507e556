"""Page images as a Python data source: ``spark.read.format("page_images").option("path", "/folder/*.ppm")``."""

from __future__ import annotations

import glob

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        files = sorted(f for p in self.options["path"].split(",") for f in (glob.glob(p) or [p]))
        size = max(int(self.options.get("files_per_partition", "64")), 1)
        return [InputPartition(files[i : i + size]) for i in range(0, len(files), size)] or [InputPartition([])]

    def read(self, partition):
        from quirespark.functions.pixels import decode

        for path in partition.value:
            try:
                with open(path, "rb") as f:
                    content = f.read()
                h, w = decode(content).shape[:2]
                yield path, content, w, h, None
            except (OSError, ValueError) as e:
                yield path, None, None, None, f"{type(e).__name__}: {e}"[:200]


class PageImages(DataSource):
    """Options: path (comma-separated, globs allowed; on a file system that all executors mount), files_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "page_images"

    def schema(self) -> str:
        return "path string, content binary, width int, height int, error string"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageImages)
