"""A registry of named files with their sizes and digests, and its checks."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def registry(spark: SparkSession, entries: Iterable[tuple[str, str, int]]) -> DataFrame:
    """(name, sha256, size) of known files; look-ups broadcast it where its size allows."""
    return spark.createDataFrame(list(entries), "name string, sha256 string, size long")


def find(names: DataFrame, known: DataFrame) -> DataFrame:
    """``names`` (name) with the registered digest and size, null where unknown."""
    return names.join(known, "name", "left")


def resolve(path: str, cache: str, known: Iterable[str]) -> str:
    """An existing path as it is, a registered bare name in the cache; anything else raises.

    Nothing is downloaded: a registered file must have been placed in the cache.
    """
    if os.path.exists(path):
        return path
    if os.path.basename(path) == path and path in set(known):
        held = os.path.join(cache, path)
        if os.path.exists(held):
            return held
        raise FileNotFoundError(f"{path} is registered but not in {cache}")
    raise FileNotFoundError(path)


def verify(files: DataFrame, known: DataFrame) -> DataFrame:
    """Binary files (path, content) with ok: name, size and SHA-256 agree with the registry."""
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    joined = named.join(known, "name", "left")
    return joined.select("path", "name", F.coalesce((F.sha2("content", 256) == F.col("sha256")) & (F.length("content") == F.col("size")), F.lit(False)).alias("ok"))
