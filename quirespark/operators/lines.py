"""Text boxes into lines and lines into text, inside one element or cell."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rect = tuple[float, float, float, float]
_BREAKLESS = frozenset(",;:，；：、")


@dataclass(slots=True)
class Span:
    box: Rect
    text: str | None = None
    confidence: float | None = None
    label: str | None = None

    @property
    def mid(self) -> tuple[float, float]:
        return (self.box[0] + self.box[2]) / 2, (self.box[1] + self.box[3]) / 2


def overlaps(a: Rect, b: Rect, more_than: float = 3.0) -> bool:
    return min(a[2], b[2]) - max(a[0], b[0]) > more_than and min(a[3], b[3]) - max(a[1], b[1]) > more_than


def on_line(a: Rect, b: Rect, share: float = 0.6, y_tolerance: float = 10.0) -> bool:
    ha, hb = max(a[3] - a[1], 1.0), max(b[3] - b[1], 1.0)
    low = min(ha, hb)
    if max(min(a[3], b[3]) - max(a[1], b[1]), 0.0) / low >= share:
        return True
    return abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2) <= max(low * 0.5, 1.0, y_tolerance * 0.25)


def into_lines(spans: Sequence[Span]) -> list[list[Span]]:
    """Lines from the top, each from the left; a span belongs to a line by the line's first span."""
    lines: list[list[Span]] = []
    for s in sorted(spans, key=lambda s: s.mid[1]):
        if lines and on_line(lines[-1][0].box, s.box):
            lines[-1].append(s)
        else:
            lines.append([s])
    return [sorted(x, key=lambda s: s.mid[0]) for x in lines]


def _ascii_letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def joined_text(spans: Sequence[Span], container: Rect | None) -> str:
    """Text of the spans in reading order.

    On a line, and at a line's end that fills the container, words part by a
    space after an ASCII letter; a hyphen at such an end goes. A line that stops
    well short of the container's right edge (half its width after a letter, 0.3
    otherwise) ends a paragraph, unless it ends in a comma, colon or the like.
    Formulas are wrapped in dollar signs, two where they start a line.
    """
    out, prev = "", None
    for s in (s for line in into_lines(spans) for s in line):
        if not s.text:
            continue
        if prev is not None:
            if not on_line(prev.box, s.box):
                wraps = breaks = False
                if container is not None:
                    tail = out.rstrip()[-1:]
                    gap = container[2] - prev.box[2]
                    breaks = tail not in _BREAKLESS or not tail
                    breaks = breaks and gap > (container[2] - container[0]) * (0.5 if tail and _ascii_letter(tail) else 0.3)
                    wraps = not breaks
                if out.endswith("-") and wraps:
                    out = out[:-1]
                elif breaks:
                    out += "" if out.endswith("\n") else "\n"
                elif out and _ascii_letter(out[-1]):
                    out += " "
            elif (out and _ascii_letter(out[-1])) or prev.label == "formula":
                out += " "
        text = s.text
        if s.label == "formula" and not text.startswith(("$", r"\(", r"\[")):
            mark = "$$" if not out or out.endswith("\n") else "$"
            text = f"{mark}{text}{mark}"
        out += text
        prev = s
    return out.rstrip()


def line_facts(spans: Sequence[Span]) -> tuple[float, float, int]:
    """(left edge of the first span, right edge of the last, number of lines)."""
    flat = [s for line in into_lines(spans) for s in line]
    n, at = 1, flat[0].box
    for s in flat[1:]:
        if not on_line(at, s.box):
            n, at = n + 1, s.box
    return flat[0].box[0], flat[-1].box[2], n


def stitch_elements(elements: DataFrame, regions: DataFrame, with_formulas: bool = True, keys: Sequence[str] = ("doc_id", "page_idx")) -> DataFrame:
    """``elements`` with text, seg_start_x, seg_end_x and num_lines of the regions that they overlap by over 3 pixels.

    Tables and seals keep their own content, as do formulas if any were
    recognised (``with_formulas``). A region may serve several elements.
    Elements that none meets keep what they have.
    """
    from quirespark.operators.joins import overlap_join

    kept = ["table", "seal", *(["formula"] if with_formulas else [])]
    asks = elements.filter(~F.col("kind").isin(*kept)).select(*keys, "idx", "x1", "y1", "x2", "y2")
    hits = overlap_join(asks, regions.filter(F.col("text").isNotNull()).select(*keys, "region_idx", "x1", "y1", "x2", "y2", "text", "confidence", "label"), 3.0, keys)
    packed = hits.groupBy(*keys, "idx").agg(
        F.first(F.struct("x1", "y1", "x2", "y2")).alias("box"),
        F.sort_array(F.collect_list(F.struct("r_region_idx", "r_x1", "r_y1", "r_x2", "r_y2", "r_text", "r_confidence", "r_label"))).alias("spans"),
    )
    types = {f.name: f.dataType.simpleString() for f in elements.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in (*keys, "idx")) + ", t string, a double, b double, n int"

    def run(batches):
        for part in batches:
            rows = []
            for row in part.to_dict("records"):
                spans = [Span((s["r_x1"], s["r_y1"], s["r_x2"], s["r_y2"]), s["r_text"], s["r_confidence"], s["r_label"]) for s in row["spans"]]
                b = row["box"]
                a, e, n = line_facts(spans)
                rows.append([*(row[k] for k in keys), row["idx"], joined_text(spans, (b["x1"], b["y1"], b["x2"], b["y2"])), a, e, n])
            yield pd.DataFrame(rows, columns=[*keys, "idx", "t", "a", "b", "n"])

    found = packed.mapInPandas(run, schema)
    out = elements.join(found, [*keys, "idx"], "left")
    new = {"text": F.coalesce("t", "text"), "seg_start_x": F.coalesce("a", "seg_start_x"), "seg_end_x": F.coalesce("b", "seg_end_x"), "num_lines": F.coalesce("n", "num_lines")}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in elements.columns))
