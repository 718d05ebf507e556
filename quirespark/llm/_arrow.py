"""Arrow batches cut to a bounded size before Python objects are made of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

SLICE_BYTES = 2 << 20
SLICE_ROWS = 1024
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark, most_bytes: int = BATCH_BYTES) -> None:
    """Lower the session's Arrow batches to ``most_bytes``: a task holds one on either side of its Python worker.

    The setting is read when a plan runs, so it stays for the session; it is
    never raised, and any size that it is written in is understood.
    """
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get(_BATCH_CONF)))
    if not 0 < now <= most_bytes:
        spark.conf.set(_BATCH_CONF, f"{most_bytes}b")


def slices(batches: Iterable, text: int | str, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator:
    """Slices of record batches with at most ``most_bytes`` of the text column and ``most_rows`` rows; a longer text comes alone.

    Of a column of lists the elements are counted.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        column = b.column(text)
        length = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
        sizes = pc.fill_null(length(column), 0).to_pylist()
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if i > at and (held + n > most_bytes or i - at >= most_rows):
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < len(sizes) or not sizes:
            yield b.slice(at)
