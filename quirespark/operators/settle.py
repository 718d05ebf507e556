"""Intermediate results that several later steps read, written once to the cluster's shared folder.

A plan that reads a model's output or a fold's in ten places would run it ten
times. ``settled`` writes it under ``spark.checkpoint.dir`` and reads it back,
which also cuts lineage: a lost executor costs the reading task alone. Where the
setting is absent and all tasks run in this process, a temporary folder serves;
on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="quirespark-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def settled(frame: DataFrame, name: str = "part") -> DataFrame:
    """``frame`` computed now, and read from its table from here on."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/quirespark/settled-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what this session settled; results not yet written elsewhere become unreadable."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001
