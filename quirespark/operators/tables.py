"""Text of tables: boxes split at cell edges, matched to cells, joined, and written into the table's markup.

A table's cells and the text boxes over it are one group; matching with a
tolerance band and row alignment by token order run on that group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from json.encoder import encode_basestring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions.sequences import align_rows, cell_grid, ends_cell, html_of_parts, html_parts, row_starts
from quirespark.functions.text import split_by_ratio
from quirespark.operators.lines import Span, joined_text, overlaps
from quirespark.operators.paged import arrow_schema, columns_by_page

Rect = tuple[float, float, float, float]
COST_BAND = 1e-4


@dataclass(slots=True)
class Cell:
    box: Rect
    row: int | None = None
    col: int | None = None
    text: str | None = None


def area(b: Rect) -> float:
    return max((b[2] - b[0]) * (b[3] - b[1]), 0.0)


def common(a: Rect, b: Rect) -> float:
    return max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)


def share(a: Rect, b: Rect) -> float:
    """Part of ``a`` that lies in ``b``."""
    size = area(a)
    return common(a, b) / size if size > 0 else 0.0


def iou(a: Rect, b: Rect) -> float:
    both = common(a, b)
    union = area(a) + area(b) - both
    return both / union if union > 0 else 0.0


def covering(box: Rect, rects: Sequence[Rect], more_than: float) -> list[int]:
    """Positions of the rects in which more than that part of the box lies: ``share`` without a call a pair."""
    x1, y1, x2, y2 = box
    size, out = (x2 - x1) * (y2 - y1), []
    if size > 0:
        for i, (a, b, c, d) in enumerate(rects):
            w = (c if c < x2 else x2) - (a if a > x1 else x1)
            if w > 0:
                h = (d if d < y2 else y2) - (b if b > y1 else y1)
                if h > 0 and w * h / size > more_than:
                    out.append(i)
    return out


# -- splitting


def cut_edges(box: Rect, cells: Sequence[Rect]) -> tuple[list[float], bool]:
    """(edges inside the box, whether they are x edges): edges a pixel apart are one; wide boxes prefer x."""

    def edges(lo: int, hi: int) -> list[float]:
        out: list[float] = []
        for v in sorted(c[k] for c in cells for k in (lo, hi) if box[lo] < c[k] < box[hi]):
            if not out or v - out[-1] >= 1.0:
                out.append(v)
        return out

    xs, ys = edges(0, 2), edges(1, 3)
    across = box[2] - box[0] >= box[3] - box[1] if xs and ys else bool(xs)
    return (xs, True) if across else (ys, False)


def split_span(span: Span, cells: Sequence[Rect]) -> list[Span] | None:
    """Parts of a text box that lies over several cells, None if it is not to be split.

    Over 0.05 of the box must lie in each of two or more cells. Text is dealt out
    by the parts' widths; by heights, or whole lines if there are enough.
    """
    hit = covering(span.box, cells, 0.05)
    if len(hit) < 2:
        return None
    hit = [cells[i] for i in hit]
    cuts, across = cut_edges(span.box, hit)
    if not cuts:
        return None
    if not span.text:
        return []
    k = 0 if across else 1
    ends = [span.box[k], *cuts, span.box[k + 2]]
    ranges = [(a, b) for a, b in zip(ends, ends[1:]) if b > a]
    lines = span.text.split("\n")
    if lines[-1] == "":
        lines.pop()
    if not across and len(lines) >= len(ranges):
        each = len(lines) // len(ranges)
        texts = ["\n".join(lines[i * each : (i + 1) * each if i < len(ranges) - 1 else None]) for i in range(len(ranges))]
    else:
        texts = split_by_ratio(span.text, [b - a for a, b in ranges])
    box = (lambda a, b: (a, span.box[1], b, span.box[3])) if across else (lambda a, b: (span.box[0], a, span.box[2], b))
    return [Span(box(a, b), t, span.confidence) for (a, b), t in zip(ranges, texts)]


def segments_over_cells(box: Rect, cells: Sequence[Rect]) -> list[Rect]:
    """Pieces of a box along x: before, over, between and after the given cells, each once."""
    out: list[Rect] = []
    at = box[0]
    for c in sorted(cells, key=lambda c: c[0]):
        lo, hi = max(c[0], box[0]), min(c[2], box[2])
        if lo > at:
            out.append((at, box[1], lo, box[3]))
        if hi > lo:
            out.append((lo, box[1], hi, box[3]))
        at = max(at, hi)
    if at < box[2]:
        out.append((at, box[1], box[2], box[3]))
    return list(dict.fromkeys(out))


# -- matching


def _better(cost: tuple[float, float], best: tuple[float, float] | None, at: int, best_at: int | None) -> bool:
    if best is None or best_at is None:
        return True
    if cost[0] + COST_BAND < best[0]:
        return True
    if abs(cost[0] - best[0]) <= COST_BAND:
        if cost[1] + COST_BAND < best[1]:
            return True
        return abs(cost[1] - best[1]) <= COST_BAND and at < best_at
    return False


def _distance(cell: Rect, box: Rect, corner: bool) -> float:
    d = [abs(a - b) for a, b in zip(cell, box)]
    return sum(d) + (min(d[0] + d[1], d[2] + d[3]) if corner else 0.0)


def _upper_cell(cells: Sequence[Cell], box: Rect, at: int, cost: float, costs: dict[int, tuple[float, float]]) -> int:
    """The cell above in the column, for a box over their common edge with much of it in both."""
    cell = cells[at]
    if cell.row in (None, 0) or cell.col is None:
        return at
    up = next((i for i, c in enumerate(cells) if c.row == cell.row - 1 and c.col == cell.col), None)
    edge = cell.box[1]
    if up is None or not box[1] < edge < box[3] or min(share(box, cell.box), share(box, cells[up].box)) < 0.35:
        return at
    return up if up in costs and costs[up][0] <= cost + 0.12 else at


def match_cells(cells: Sequence[Cell], boxes: Sequence[Rect], overlap_needed: bool = True, corner: bool = False) -> dict[int, int]:
    """Cell of each box (by position); boxes without one are left out.

    First the cell that holds the box's centre and over 0.7 of it; else least
    (1 - IoU, distance), where costs within a band of 1e-4 tie and the first wins.
    ``corner`` adds the corner distance and the preference for the upper cell.
    """
    out = {}
    rects = [c.box for c in cells]
    for k, b in enumerate(boxes):
        cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        inside = next((i for i in covering(b, rects, 0.7) if rects[i][0] <= cx <= rects[i][2] and rects[i][1] <= cy <= rects[i][3]), None)
        if inside is not None:
            out[k] = inside
            continue
        best, at, costs = None, None, {}
        for i, c in enumerate(rects):
            v = iou(b, c)
            if overlap_needed and v <= 0:
                continue
            costs[i] = (1.0 - v, _distance(c, b, corner))
            if _better(costs[i], best, i, at):
                best, at = costs[i], i
        if at is not None:
            out[k] = _upper_cell(cells, b, at, best[0], costs) if corner else at
    return out


def cell_rows(boxes: Sequence[Rect], tolerance: float) -> tuple[list[int], list[int]]:
    """(positions row by row, row boundaries): a cell joins a row while its top is near the row's *first* top."""
    rows: list[list[int]] = []
    lefts, tops = [b[0] for b in boxes], [b[1] for b in boxes]
    for i in sorted(range(len(boxes)), key=tops.__getitem__):
        if rows and abs(tops[i] - tops[rows[-1][0]]) <= tolerance:
            rows[-1].append(i)
        else:
            rows.append([i])
    order, flags = [], [0]
    for r in rows:
        order += sorted(r, key=lefts.__getitem__)
        flags.append(len(order))
    return order, flags


def merged_fragments(texts: Sequence[str]) -> str | None:
    """One cell's fragments with line breaks between, bold marks dropped, end stripped; None if nothing is left."""
    if len(texts) == 1:
        return texts[0].rstrip() or None
    out = []
    for i, t in enumerate(texts):
        t = t.removeprefix(" ").replace("<b>", "").replace("</b>", "")
        if t and i < len(texts) - 1 and not t.endswith(" "):
            t += "<br/>"
        out.append(t)
    return "".join(out).rstrip() or None


def joined_fragments(texts: Sequence[str]) -> str:
    """As ``merged_fragments`` for end-to-end tables: bold marks only at the ends, the end kept."""
    out = []
    for i, t in enumerate(texts):
        if len(texts) > 1:
            t = t.removeprefix(" ").removeprefix("<b>").removesuffix("</b>")
            if t and i < len(texts) - 1 and not t.endswith(" "):
                t += "<br/>"
        out.append(t)
    return "".join(out)


@dataclass(frozen=True)
class Shape:
    """What a table's tokens alone decide."""

    starts: list[int]  # number of the first cell of every row that has one
    slots: list[tuple[int, int]]  # (row, place in it) of every cell
    places: list[tuple[int, int]]  # (row, column) of every cell, spans counted
    parts: tuple[list[tuple[str, bool]], str]  # markup round the texts


#: tables have few shapes; those of the last are kept
@lru_cache(maxsize=256)
def shape(tokens: tuple[str, ...]) -> Shape:
    starts = row_starts(tokens)
    ends = [*starts, sum(map(ends_cell, tokens))]
    slots: list[tuple[int, int]] = []
    row = local = 0
    for t in tokens:
        if t == "<tr>":
            local = 0
        elif ends_cell(t):
            slots.append((row, local))
            local += 1
            if row + 1 < len(ends) and len(slots) >= ends[row + 1]:
                row += 1
    return Shape(starts, slots, [g[:2] for g in cell_grid(tokens)], html_parts(tokens))


def match_rows(cells: list[Cell], tokens: Sequence[str], spans: Sequence[Span], tolerance: float, once: bool) -> tuple[list[int | None], set[int]] | None:
    """(cell of each token cell, matched spans), filling texts; None if there is nothing to match.

    Cells in rows are aligned with the token rows; within a row a cell takes every
    span of which over 0.7 lies in it. ``once`` gives a span to its first row only.
    """
    if not cells or not tokens or not spans:
        return None
    form = shape(tuple(tokens))
    if not form.starts:
        return None
    rects = [c.box for c in cells]
    order, flags = cell_rows(rects, tolerance)
    aligned = [*align_rows(flags, form.starts), len(order)]
    over: dict[int, list[int]] = {}
    for k, s in enumerate(spans):
        for i in covering(s.box, rects, 0.7):
            over.setdefault(i, []).append(k)
    if once:
        taken: set[int] = set()
        for a, b in zip(aligned, aligned[1:]):
            row = [i for i in order[a:b] if i in over]
            for i in row:
                over[i] = [k for k in over[i] if k not in taken]
            taken.update(k for i in row for k in over[i])
    mapping: list[int | None] = []
    used: set[int] = set()
    for row, local in form.slots:
        at = aligned[row] + local if row < len(aligned) else len(order)
        cell = order[at] if at < len(order) else None
        mapping.append(cell)
        # a place beyond the row's cells takes the text of a later cell, but no spans
        hits = over.get(cell) if cell is not None and row + 1 < len(aligned) and at < aligned[row + 1] else None
        if hits:
            used.update(hits)
            text = merged_fragments([spans[k].text for k in hits if spans[k].text is not None])
            if text is not None and not (cells[cell].text or "").strip():
                cells[cell].text = text
    return (mapping, used) if mapping else None


_YES, _NO = "✓üÜL√☑", "✗Xx✕✖☒"


def checkbox_text(texts: Sequence[str | None]) -> list[str | None]:
    """Check marks unified; L, X and x only in tables that show both kinds."""
    one = [t.strip() if t is not None and len(t.strip()) == 1 else "" for t in texts]
    if not any(one):
        return list(texts)
    both = any(t and t in _YES for t in one) and any(t and t in _NO for t in one)
    say = lambda t: "✓" if t in ("ü", "Ü", "√", "☑") or (t == "L" and both) else "✗" if t in ("✕", "✖", "☒") or (t in ("X", "x") and both) else None
    return [say(o) or t if o else t for o, t in zip(one, texts)]


def checkbox(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``cells`` with check marks unified table by table, as a window."""
    from pyspark.sql import Window

    from quirespark.functions.text import strip

    t = strip(F.col("text"))
    w = Window.partitionBy(*keys)
    sees = lambda marks: F.max(F.coalesce(t.isin(*marks), F.lit(False)).cast("int")).over(w) == 1
    both = sees(_YES) & sees(_NO)
    new = F.when(t.isin("ü", "Ü", "√", "☑") | ((t == "L") & both), "✓").when(t.isin("✕", "✖", "☒") | (t.isin("X", "x") & both), "✗")
    return cells.withColumn("text", F.coalesce(new, F.col("text")))


@dataclass(slots=True)
class Table:
    box: Rect
    cells: list[Cell]
    tokens: list[str] = field(default_factory=list)
    e2e: bool = False
    detected: bool = False
    html: str | None = None


def tiny_symbol(text: str | None, confidence: float | None, box: Rect) -> str | None:
    w, h = max(box[2] - box[0], 0.0), max(box[3] - box[1], 0.0)
    if text == "=" and confidence is not None and confidence < 0.45:
        if w <= 9.5 and h <= 7.5:
            return ","
        if w <= 12.5 and 7.5 < h <= 10.5:
            return "-"
    if text == "0" and confidence is not None and confidence < 0.20 and w <= 14.5 and h <= 14.5:
        return ";"
    return text


def fill_table(table: Table, spans: Sequence[Span], formulas: Sequence[tuple[Rect, str]], used: set[int], tolerance: float = 10.0) -> set[int]:
    """Put texts into a table's cells and write its markup; positions of the spans that it took, which ``used`` gathers."""
    took: set[int] = set()
    if not table.cells:
        return took
    plain = table.e2e and not table.detected
    rects = [c.box for c in table.cells]
    parted: list[tuple[int | None, Span]] = []
    whole: list[tuple[int | None, Span]] = []
    for k, s in enumerate(spans):
        if k in used or not overlaps(table.box, s.box):
            continue
        parts = split_span(s, rects) if not plain and s.text is not None else None
        if parts is None:
            whole.append((k, s))
            continue
        took.add(k)
        parted += [(None, p) for p in parts if p.text]
    pool: list[tuple[int | None, Span]] = []
    for k, s in parted + whole:
        text = tiny_symbol(s.text, s.confidence, s.box) if s.text in ("=", "0") else s.text
        if text and text.strip():
            pool.append((k, s if text == s.text else Span(s.box, text, s.confidence, s.label)))
    for b, latex in formulas:
        if b[2] - b[0] > 1 and b[3] - b[1] > 1 and overlaps(table.box, b):
            pool.append((None, Span(b, latex if latex.startswith("$") and latex.endswith("$") else f"${latex}$", 1.0)))
    only = [s for _, s in pool]
    done = match_rows(table.cells, table.tokens, only, tolerance, table.detected) if not plain and table.tokens else None
    if done is not None:
        took |= {pool[k][0] for k in done[1] if pool[k][0] is not None}
    else:
        home = match_cells(table.cells, [s.box for s in only], overlap_needed=not plain, corner=plain)
        took |= {pool[k][0] for k in home if pool[k][0] is not None}
        held: dict[int, list[Span]] = {}
        for k, i in home.items():
            held.setdefault(i, []).append(only[k])
        for i, mine in held.items():
            cell = table.cells[i]
            if not (cell.text or "").strip():
                text = joined_fragments([s.text for s in mine]) if plain else joined_text(mine, cell.box)
                cell.text = text or cell.text
    for cell, text in zip(table.cells, checkbox_text([c.text for c in table.cells])):
        cell.text = text
    if table.tokens:
        table.html = html_of_parts(*shape(tuple(table.tokens)).parts, cell_texts(table.cells, table.tokens, done[0] if done else None))
    used |= took
    return took


def cell_texts(cells: Sequence[Cell], tokens: Sequence[str], mapping: Sequence[int | None] | None = None) -> list[str | None]:
    """Texts in token order: by a mapping, else by (row, column), else by position."""
    if mapping is not None:
        return [cells[i].text if i is not None else None for i in mapping]
    if not cells:
        return []
    slots = {(c.row, c.col): c.text for c in cells if c.row is not None and c.col is not None}
    places = shape(tuple(tokens)).places
    return [slots.get(g) for g in places] if slots else [cells[i].text if i < len(cells) else None for i in range(len(places))]


def _json_texts(texts: Sequence[str | None]) -> str:
    """As ``json.dumps`` without escapes, which makes an encoder a call."""
    return f"[{', '.join('null' if t is None else encode_basestring(t) for t in texts)}]"


#: packed rows of a page: its tables, their cells, its text regions, its formulas
_TABLE, _CELL, _REGION, _FORMULA = range(4)


def stitch_tables(tables: DataFrame, cells: DataFrame, regions: DataFrame, formulas: DataFrame | None = None, keys: Sequence[str] = ("doc_id", "page_idx")) -> DataFrame:
    """One row a table: keys, table_idx, html, cells (JSON array of texts) and used_regions (indices of text regions).

    A page's tables are filled in turn, as a text that one took is gone for the
    next. ``tables`` has table_idx, box, tokens, is_e2e, has_detected; ``cells``
    table_idx, cell_idx, box, row, col, text; ``regions`` region_idx, box, text,
    confidence, label; ``formulas`` formula_idx, box, latex.

    All rows of a page are brought together by one exchange at most and go to
    Python as they are sorted, column by column: no join and no list of a page.
    """
    box = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    kind = lambda k: F.lit(k).cast("tinyint").alias("__kind")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    rows = tables.select(*keys, kind(_TABLE), "table_idx", *box, "tokens", flag("is_e2e"), flag("has_detected"))
    rows = rows.unionByName(cells.select(*keys, kind(_CELL), "table_idx", "cell_idx", *box, "row", "col", "text"), allowMissingColumns=True)
    # a region without text fills nothing and is never used
    rows = rows.unionByName(regions.filter(F.col("text").isNotNull()).select(*keys, kind(_REGION), "region_idx", *box, "text", "confidence", "label"), allowMissingColumns=True)
    if formulas is not None:
        rows = rows.unionByName(formulas.select(*keys, kind(_FORMULA), "formula_idx", *box, F.col("latex").alias("text")), allowMissingColumns=True)
    order = [c for c in ("__kind", "table_idx", "cell_idx", "region_idx", "formula_idx", "x1", "y1", "x2", "y2", "tokens", "is_e2e", "has_detected", "row", "col", "text", "confidence", "label") if c in rows.columns]
    kinds = {f.name: f.dataType.simpleString() for f in tables.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", table_idx {kinds['table_idx']}, html string, cells string, used_regions array<int>"
    want = arrow_schema(schema)

    def run(b, page):
        import numpy as np
        import pyarrow as pa

        kind = b.column("__kind").to_numpy()

        def part(k, *names):
            """(where each page's rows of a kind begin among them, their boxes, other columns of theirs)."""
            at = np.flatnonzero(kind == k)
            rows = pa.array(at)
            box, lists = ([_values(b.column(n).take(rows)) for n in some] for some in (("x1", "y1", "x2", "y2"), names))
            return np.searchsorted(page[at], np.arange(page[-1] + 2)).tolist(), list(zip(*box)), *lists

        t_at, t_box, t_idx, e2e, detected = part(_TABLE, "table_idx", "is_e2e", "has_detected")
        c_at, c_box, c_idx, c_row, c_col, c_text = part(_CELL, "table_idx", "row", "col", "text")
        r_at, r_box, r_idx, r_text, r_conf, r_label = part(_REGION, "region_idx", "text", "confidence", "label")
        f_at, f_box, f_text = part(_FORMULA, "text")
        t_rows = pa.array(np.flatnonzero(kind == _TABLE))
        lists = b.column("tokens").take(t_rows)
        words, ends = _values(lists.flatten()), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        html, texts, taken, sizes = [], [], [], [0]
        for p in range(len(t_at) - 1):
            if t_at[p] == t_at[p + 1]:
                continue
            spans = [Span(r_box[i], r_text[i], r_conf[i], r_label[i]) for i in range(r_at[p], r_at[p + 1])]
            fs = [(f_box[i], f_text[i]) for i in range(f_at[p], f_at[p + 1])]
            mine: dict = {}
            for i in range(c_at[p], c_at[p + 1]):
                mine.setdefault(c_idx[i], []).append(i)
            used: set[int] = set()
            for k in range(t_at[p], t_at[p + 1]):
                table = Table(t_box[k], [Cell(c_box[i], c_row[i], c_col[i], c_text[i]) for i in mine.get(t_idx[k], ())], words[ends[k] : ends[k + 1]], e2e[k], detected[k])
                took = fill_table(table, spans, fs, used)
                html.append(table.html)
                texts.append(_json_texts([c.text for c in table.cells]))
                taken += sorted(r_idx[r_at[p] + i] for i in took)
                sizes.append(len(taken))
        used_regions = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(taken, pa.int32()))
        columns = [*[b.column(k).take(t_rows) for k in (*keys, "table_idx")], pa.array(html, pa.string()), pa.array(texts, pa.string()), used_regions]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, want)], schema=want)

    return columns_by_page(rows, run, schema, keys, order)


def _values(column) -> list:
    """An Arrow array's values as Python's; numpy makes them at once where none is null."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def token_grid(tokens: Column) -> Column:
    """Array of structs (row, col, row_span, col_span) of a token array's cells."""

    @F.pandas_udf("array<struct<row:int,col:int,row_span:int,col_span:int>>")
    def run(values: pd.Series) -> pd.Series:
        names = ("row", "col", "row_span", "col_span")
        return values.map(lambda v: None if v is None else [dict(zip(names, g)) for g in cell_grid(list(v))])

    return run(tokens)
