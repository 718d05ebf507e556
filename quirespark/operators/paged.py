"""Order-dependent functions over the rows of a page.

A page's rows are packed into one array by an ordered aggregate and go to Python
as part of an Arrow batch of many pages. That costs microseconds a page, where a
grouped pandas function would pay milliseconds for each, and pages are small and
many. A page's rows must fit in memory, as they would in any fold over them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rows = list[dict[str, Any]]


def kinds_of(frame: DataFrame, names: Sequence[str]) -> str:
    """Schema text of some columns."""
    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    return ", ".join(f"`{n}` {types[n]}" for n in names)


def arrow_schema(ddl: str):
    """The Arrow schema of schema text; needs a session, so it is made on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def per_page(frame: DataFrame, run: Callable[[Rows], Rows], schema: str, keys: Sequence[str], order: str = "idx") -> DataFrame:
    """keys and the fields of ``schema`` of what ``run`` makes of each page's rows, given by ``order``.

    Only columns but the keys reach ``run``; select what it needs beforehand.
    """
    rest = [c for c in frame.columns if c not in keys and c != order]
    packed = frame.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("__rows"))
    full = f"{kinds_of(frame, keys)}, {schema}"

    want = arrow_schema(full)

    def go(batches):
        import pyarrow as pa

        for b in batches:
            head = [b.column(k).to_pylist() for k in keys]
            # columns become lists as wholes: a page's own lists of structs would cost a scalar object a value
            lists = b.column("__rows")
            starts = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            flat = lists.flatten()
            names = [order, *rest]
            rows = [dict(zip(names, v)) for v in zip(*[flat.field(n).to_pylist() for n in names])]
            out: Rows = []
            for i in range(b.num_rows):
                own = {k: h[i] for k, h in zip(keys, head)}
                for r in run(rows[starts[i] : starts[i + 1]]):
                    r.update(own)
                    out.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in want], schema=want)

    return packed.mapInArrow(go, full)


def picked(frame: DataFrame, pick: Callable, keys: Sequence[str], order: str = "idx") -> DataFrame:
    """Rows of ``frame`` that ``pick`` keeps, with ``rank``: a fold over many pages at once, without an object a row.

    ``pick(columns, starts)`` gets a batch's rows as Arrow arrays by name, pages
    one after the other by ``order`` and each beginning at its start (the last
    start is the end), and gives the positions to keep, page by page, and the
    rank of each.
    """
    rest = [c for c in frame.columns if c not in keys and c != order]
    packed = frame.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("__rows"))
    full = f"{kinds_of(frame, keys)}, {kinds_of(frame, [order, *rest])}, rank int"

    def go(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column("__rows")
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            columns = {n: flat.field(n) for n in (order, *rest)}
            at, rank = pick(columns, starts)
            take = pa.array(at, pa.int64())
            page = pa.array(np.searchsorted(starts, at, side="right") - 1, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(page) for k in keys], *[c.take(take) for c in columns.values()], pa.array(rank, pa.int32())], names=[*keys, *columns, "rank"])

    return packed.mapInArrow(go, full).select(*frame.columns, "rank")


def columns_by_page(frame: DataFrame, run: Callable, schema: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What ``run`` makes of whole pages' rows as they are sorted, many pages at once and none packed into an array.

    ``run(batch, page)`` gets an Arrow batch of ``frame``'s columns, pages one
    after the other and each by ``order``, with the number of each row's page in
    it, and gives a batch of ``schema``. A page that several Arrow batches share
    waits for its last one. Rows that lie by their keys already are not shuffled.
    """
    from pyspark.sql import Window

    numbered = frame.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    def go(batches):
        import numpy as np
        import pyarrow as pa

        def made(parts):
            # not a table's chunks: those part, unsaid, where texts pass 2 GB, and this raises
            whole = parts[0] if len(parts) == 1 else pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*[x.columns for x in parts])], schema=parts[0].schema)
            return run(whole, np.cumsum(whole.column("__n").to_numpy() == 1) - 1)

        waiting: list = []
        for b in batches:
            first = np.flatnonzero(b.column("__n").to_numpy() == 1)
            if len(first):
                last = int(first[-1])
                done = [x for x in (*waiting, b.slice(0, last)) if x.num_rows]
                if done:
                    yield made(done)
                waiting = [b.slice(last)]
            elif b.num_rows:
                waiting.append(b)
        if waiting:
            yield made(waiting)

    return numbered.mapInArrow(go, schema)
