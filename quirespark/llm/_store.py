"""Intermediate tables in the cluster's shared folder.

Lineage is cut by writing a table into the folder named by
``spark.checkpoint.dir`` and reading it back, so that a lost executor costs a
retry of the reading task and never of the work behind the table. Where the
setting is absent and all tasks run in this process (tests, a laptop) one
temporary folder per session is used; on a cluster its absence is an error, as
other machines would not see such a folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: paths written, by application; ``release`` deletes them
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` or, if unset, our own."""
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


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quirespark/{name}-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    path = fresh_path(spark, name)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path  # noqa: SLF001 - for discard()
    return out


def release(spark: SparkSession) -> None:
    """Delete every table that this session wrote; results that were not yet written elsewhere become unreadable."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of ``materialise`` that no later plan reads."""
    path = getattr(df, "_quire_path", None)
    if path:
        written = _WRITTEN.get(spark.sparkContext.applicationId, [])
        if path in written:
            written.remove(path)
        _delete(spark, path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Delete the tables written inside at the end, but for those given to the function it yields.

    An operator keeps the tables that its result still reads; they last until
    the caller's own ``passing``, ``discard`` or ``release``.
    """
    app = spark.sparkContext.applicationId
    before, kept = set(_WRITTEN.get(app, [])), set()
    yield lambda *tables: kept.update(path_of(t) for t in tables)
    for path in [p for p in _WRITTEN.get(app, []) if p not in before and p not in kept]:
        _WRITTEN[app].remove(path)
        _delete(spark, path)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have, in any case of letters."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def path_of(df: DataFrame) -> str:
    return df._quire_path  # noqa: SLF001


def read_shared(path: str, columns: list[str] | None = None):
    """A table of ``materialise`` as a pyarrow table, for use inside a task."""
    import pyarrow as pa
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, where = (fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:")))
    files = [f.path for f in system.get_file_info(fs.FileSelector(where)) if f.path.endswith(".parquet")]
    if not files:
        return pa.table({c: [] for c in columns or []})
    return ds.dataset(sorted(files), filesystem=system, format="parquet").to_table(columns=columns)
