"""The model boundary: recognition tasks as ``mapInPandas`` stages behind adapters.

No weights are part of this library. An adapter is built once in each Python
worker by a factory and gets lists of items; a task fixes what goes in, what
comes out and what is checked. A failing batch is retried item by item, and a
failing item keeps its row with an error, so that one bad page never fails a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BOX = "x1 double, y1 double, x2 double, y2 double"
_POINTS = "array<struct<x:double,y:double>>"


class ModelAdapter(Protocol):
    """A model: ``execute`` gives one result an item, in order; ``batch_size`` is a hint."""

    batch_size: int

    def execute(self, items: list[dict[str, Any]]) -> list[Any]: ...


@dataclass(frozen=True)
class Task:
    """Input columns, output fields, and whether an item gives one result or a list (rows numbered by ``item``)."""

    name: str
    inputs: tuple[str, ...]
    output: str
    many: bool = False

    def fields(self) -> list[str]:
        return [p.strip().split(" ")[0] for p in _top_level(self.output)]


def _top_level(schema: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += c
    return [*parts, cur]


TASKS = {
    t.name: t
    for t in (
        Task("text_detection", ("content",), f"poly {_POINTS}, {_BOX}, score double", True),
        Task("text_recognition", ("content",), "text string, score double, positions array<double>, columns array<int>, steps int"),
        Task("layout_detection", ("content",), f"label string, score double, {_BOX}", True),
        Task("table_structure", ("content",), "tokens array<string>, boxes array<array<double>>, score double"),
        Task("table_cells", ("content",), f"label string, score double, {_BOX}", True),
        Task("table_classification", ("content",), "label string, score double"),
        Task("formula_recognition", ("content",), "latex string, score double"),
        Task("seal_detection", ("content",), f"poly {_POINTS}, {_BOX}, score double", True),
        Task("document_orientation", ("content",), "label string, score double"),
        Task("document_rectification", ("content",), "image binary, width int, height int"),
        Task("line_orientation", ("content",), "label string, score double"),
        Task("region_recognition", ("content", "task"), "text string"),
        Task("page_parse", ("content",), f"label string, {_BOX}, angle int, text string", True),
    )
}


def run_task(frame: DataFrame, task: Task | str, factory: Callable[[], ModelAdapter], keys: Sequence[str], threshold: float | None = None) -> DataFrame:
    """keys, (item,) the task's fields, error: one row an input row, or one a result for tasks of many.

    Below ``threshold`` a recognised row keeps its place with an empty text, while
    a detected box goes. Inputs are cut to keys and the task's columns first, as
    nothing is pruned through a Python stage.
    """
    task = TASKS[task] if isinstance(task, str) else task
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    names = task.fields()
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    schema = f"{head}, {'item int, ' if task.many else ''}{task.output}, error string"
    columns = [*keys, *(["item"] if task.many else []), *names, "error"]

    def attempt(model: ModelAdapter, items: list[dict]) -> list[tuple[Any, str | None]]:
        try:
            out = model.execute(items)
            if len(out) != len(items):
                raise ValueError(f"{len(out)} results for {len(items)} items")
            return [(o, None) for o in out]
        except Exception as e:  # noqa: BLE001 - the row carries it
            if len(items) == 1:
                return [(None, f"{type(e).__name__}: {e}"[:500])]
            return [r for i in items for r in attempt(model, [i])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        size = max(int(getattr(model, "batch_size", 1) or 1), 1)
        for b in batches:
            records, rows = b.to_dict("records"), []
            for at in range(0, len(records), size):
                part = records[at : at + size]
                for rec, (result, error) in zip(part, attempt(model, [{c: r[c] for c in task.inputs} for r in part])):
                    own = [rec[k] for k in keys]
                    if error is not None:
                        rows.append([*own, *([-1] if task.many else []), *([None] * len(names)), error])
                    elif task.many:
                        kept = [r for r in result if threshold is None or r.get("score") is None or r["score"] >= threshold]
                        rows += [[*own, n, *(r.get(f) for f in names), None] for n, r in enumerate(kept)]
                    else:
                        r = dict(result)
                        if threshold is not None and r.get("score") is not None and r["score"] < threshold and "text" in r:
                            r["text"] = ""
                        rows.append([*own, *(r.get(f) for f in names), None])
            yield pd.DataFrame(rows, columns=columns)

    return frame.select(*dict.fromkeys([*keys, *task.inputs])).mapInPandas(run, schema)


def pooled_recognition(crops: DataFrame, factory: Callable[[], ModelAdapter], keys: Sequence[str], parts: int | None = None, threshold: float | None = None) -> DataFrame:
    """Recognition of all pages' crops together, batches of like width: ranged and sorted by aspect ratio.

    Page and position travel as keys, so nothing needs scattering back.
    """
    n = parts or int(crops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pooled = crops.repartitionByRange(n, "wh_ratio").sortWithinPartitions("wh_ratio")
    return run_task(pooled, "text_recognition", factory, keys, threshold)


def keyed_recognition(jobs: DataFrame, factory: Callable[[], ModelAdapter], keys: Sequence[str], batch_keys: Sequence[str] = ("task",)) -> DataFrame:
    """Region recognition with like jobs side by side: partitioned by a salted batch key, so that a common task spreads."""
    n = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = jobs.repartition(n, *batch_keys, F.pmod(F.xxhash64(*keys), F.lit(n))).sortWithinPartitions(*batch_keys)
    return run_task(salted, "region_recognition", factory, keys)


# -- composition and checks


def chain(*edges: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One DataFrame function of several, applied in order."""

    def run(frame: DataFrame) -> DataFrame:
        for e in edges:
            frame = frame.transform(e)
        return frame

    return run


def validated(frame: DataFrame, **rules) -> DataFrame:
    """``frame`` failing at the first row that breaks a rule (name=column condition); null breaks it too."""
    for name, rule in rules.items():
        first = frame.columns[0]
        frame = frame.withColumn(first, F.when(F.coalesce(rule, F.lit(False)), F.col(f"`{first}`")).otherwise(F.raise_error(F.lit(f"validation failed: {name}"))))
    return frame


def finite(value):
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def scores_valid(scores, low: float = 0.0, high: float = 1.0):
    """Every score of an array within bounds; nulls break it."""
    return F.forall(scores, lambda s: F.coalesce((s >= low) & (s <= high), F.lit(False)))


def same_length(*arrays):
    out = F.lit(True)
    for a in arrays[1:]:
        out = out & (F.size(a) == F.size(arrays[0]))
    return out


def shapes_valid(values, shape):
    """An image's flat values match its (channels, height, width)."""
    return (F.size(values) > 0) & (F.size(values) == shape["c"] * shape["h"] * shape["w"])
