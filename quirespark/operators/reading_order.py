"""Reading order of boxes on a page.

Recursive cuts and insertion orders depend on the whole page, so they run page by
page in Python (a page holds at most a few hundred boxes). Orders that are plain
sort keys are windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.elements import TYPES
from quirespark.operators import paged
from quirespark.operators.paged import Rows, kinds_of

PAGE = ("doc_id", "page_idx")
Rect = tuple[float, float, float, float]


# -- plain orders


def poly_order(frame: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """``frame`` with rank (from 0): top edge, then input position."""
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("y1", "idx")) - 1)


def column_order(frame: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """``frame`` with rank of the two-column order; page width in ``width``.

    From top to bottom, a box starting in the left quarter and ending within three
    fifths is of the left column, one starting beyond two fifths of the right; any
    other box spans the page, and what the columns gathered comes before it.
    """
    by_y = Window.partitionBy(*keys).orderBy("y1", "x1", "idx")
    left = (F.col("x1") < F.col("width") / 4.0) & (F.col("x2") < 3.0 * F.col("width") / 5.0)
    side = F.when(left, 0).when(F.col("x1") > 2.0 * F.col("width") / 5.0, 1).otherwise(2)
    out = frame.withColumn("__side", side).withColumn("__flush", F.sum((F.col("__side") == 2).cast("int")).over(by_y.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("__side") == 2).cast("int"))
    w = Window.partitionBy(*keys).orderBy("__flush", "__side", "y1", "x1", "idx")
    return out.withColumn("rank", F.row_number().over(w) - 1).drop("__side", "__flush")


# -- quad order: a single insertion pass over a 10-pixel band, not a sort key


def quad_order(boxes: Sequence[Rect], band: float = 10.0) -> list[int]:
    """Positions by (y, x), each then moved left past neighbours on its line that start further right."""
    order = sorted(range(len(boxes)), key=lambda i: (boxes[i][1], boxes[i][0]))
    for i in range(len(order) - 1):
        j = i
        while j >= 0:
            cur, nxt = boxes[order[j]], boxes[order[j + 1]]
            if not (abs(nxt[1] - cur[1]) < band and nxt[0] < cur[0]):
                break
            order[j], order[j + 1] = order[j + 1], order[j]
            j -= 1
    return order


# -- recursive cuts


def _segments(spans: list[tuple[int, int]], min_gap: int) -> list[tuple[int, int]]:
    """Covered stretches of integer spans; stretches whose covered ends lie at most ``min_gap`` apart are one."""
    if not spans or max(abs(e) for _, e in spans) == 0:
        return []
    most = max(abs(e) for _, e in spans)
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((min(abs(s), abs(e)), min(max(abs(s), abs(e)), most + 1)) for s, e in spans):
        if lo >= hi:
            continue
        # the last covered position is one before the end
        if out and lo - out[-1][1] + 1 <= max(min_gap, 1):
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _cut(boxes: list[tuple[int, int, int, int]], ids: list[int], first: int, out: list[int], min_gap: int) -> None:
    """Cut along axis ``first`` (0: x, 1: y), then the other, and go on inside; an uncut stretch is in its second axis' order."""
    second = 1 - first
    if not boxes:
        return
    order = sorted(range(len(boxes)), key=lambda i: boxes[i][first])
    spans = [(boxes[i][first], boxes[i][first + 2]) for i in order]
    # the first axis cuts at any break, the second at breaks over the gap
    for lo, hi in _segments(spans, 1):
        part = sorted((i for i in order if lo <= abs(boxes[i][first]) < hi), key=lambda i: boxes[i][second])
        cuts = _segments([(boxes[i][second], boxes[i][second + 2]) for i in part], min_gap)
        if len(cuts) == 1:
            out.extend(ids[i] for i in part)
            continue
        for a, b in cuts:
            inner = [i for i in part if a <= abs(boxes[i][second]) < b]
            _cut([boxes[i] for i in inner], [ids[i] for i in inner], first, out, min_gap)


def xycut(boxes: Sequence[Rect], vertical: bool = True, min_gap: int = 1) -> list[int]:
    """Positions in reading order; ``vertical`` cuts rows first, else columns first. Coordinates are truncated."""
    whole = [tuple(int(v) for v in b) for b in boxes]
    out: list[int] = []
    _cut(whole, list(range(len(whole))), 1 if vertical else 0, out, min_gap)
    return out


def overlap_of(a: Rect, b: Rect) -> float:
    """Intersection over the area of ``a``."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    size = (a[2] - a[0]) * (a[3] - a[1])
    return w * h / size if w > 0 and h > 0 and size > 0 else 0.0


def assign_regions(elements: Sequence[Rect], regions: Sequence[Rect], above: float) -> list[int | None]:
    """The region that covers most of each element, over ``above``; the first of equals."""
    out: list[int | None] = []
    for e in elements:
        best, share = None, above
        for k, r in enumerate(regions):
            if (v := overlap_of(e, r)) > share:
                best, share = k, v
        out.append(best)
    return out


def region_hierarchy_order(elements: Sequence[Rect], regions: Sequence[Rect], above: float = 0.1) -> list[int]:
    """Regions in cut order, elements in cut order inside their region, unassigned ones last."""
    if not regions:
        return xycut(elements)
    home = assign_regions(elements, regions, above)
    out: list[int] = []
    for k in [*xycut(regions), None]:
        mine = [i for i, h in enumerate(home) if h == k]
        out.extend(mine[i] for i in xycut([elements[i] for i in mine]))
    return out


# -- enhanced order

_MASKED = ("doc_title", "cross_layout", "cross_reference")
_WIDE_WORDS = 10.0


@dataclass
class Block:
    box: Rect
    at: int
    kind: str = "text"
    lines: int = 1
    role: str = field(default="")
    flat: bool = field(default=True)
    line_height: float = field(default=0.0)

    def __post_init__(self) -> None:
        if not self.role:
            w, h = self.box[2] - self.box[0], self.box[3] - self.box[1]
            self.lines = max(int(self.lines or 1), 1)
            self.role = TYPES.get(self.kind, ("other", "normal_text"))[1]
            self.flat, self.line_height = w >= h, h / self.lines

    @property
    def area(self) -> float:
        return (self.box[2] - self.box[0]) * (self.box[3] - self.box[1])

    @property
    def long_side(self) -> float:
        return max(self.box[2] - self.box[0], self.box[3] - self.box[1])


def axis_iou(a: Rect, b: Rect, axis: int) -> float:
    union = max(a[axis + 2], b[axis + 2]) - min(a[axis], b[axis])
    return max(min(a[axis + 2], b[axis + 2]) - max(a[axis], b[axis]), 0.0) / union if union > 0 else 0.0


def mark_cross_layout(blocks: list[Block]) -> None:
    """Sort by (left, width) and mark, in place, blocks that run across columns."""
    if len(blocks) < 2:
        return
    blocks.sort(key=lambda b: (b.box[0], b.box[2] - b.box[0]))
    was = [b.role for b in blocks]
    n = len(blocks)
    side = [[axis_iou(a.box, b.box, 0) for b in blocks] for a in blocks]
    near = [[j for j in range(n) if j != i and side[i][j] > 0] for i in range(n)]
    wide = [b.long_side > b.line_height * _WIDE_WORDS for b in blocks]

    def crosses(i: int) -> bool:
        me = blocks[i]
        for r in near[i]:
            if was[r] in _MASKED or blocks[r].role == "cross_layout":
                continue
            if me.role == "cross_layout":
                return False
            share = overlap_of(me.box, blocks[r].box)
            if share > 0:
                if was[r] == "vision":
                    blocks[r].role = "cross_layout"
                    continue
                if share > 0.1 and me.area < blocks[r].area:
                    return True
            for s in near[i]:
                if s == r or was[s] in _MASKED or blocks[s].role == "cross_layout":
                    continue
                if overlap_of(me.box, blocks[s].box) > 0.1:
                    if was[s] == "vision":
                        blocks[s].role = "cross_layout"
                        continue
                    if was[i] == "vision" or me.area < blocks[s].area:
                        return True
                if side[r][s] == 0 and axis_iou(blocks[r].box, blocks[s].box, 1) > 0:
                    if was[i] == "vision" or (was[r] == was[s] == "normal_text" and wide[r] and wide[s]):
                        return True
        return False

    for i in range(n):
        if was[i] not in _MASKED and crosses(i):
            blocks[i].role = "cross_reference" if was[i] == "reference" else "cross_layout"


def shrink_overlaps(blocks: list[Block], axis: int = 1) -> None:
    """Sort by end along ``axis`` and part, in place, neighbours that overlap slightly or touch within 3 pixels."""
    blocks.sort(key=lambda b: b.box[axis + 2])
    for one, two in zip(blocks, blocks[1:]):
        cut, across = axis_iou(one.box, two.box, axis), axis_iou(one.box, two.box, 1 - axis)
        if not ((across > 0 and 0 < cut < 0.1) or abs(one.box[axis + 2] - two.box[axis]) <= 3.0):
            continue
        middle = math.floor((max(one.box[axis], two.box[axis]) + min(one.box[axis + 2], two.box[axis + 2])) / 2.0)
        first, last = (one, two) if one.box[axis] < two.box[axis] else (two, one)
        a, b = list(first.box), list(last.box)
        a[axis + 2], b[axis] = middle - 1.0, middle + 1.0
        if first is two:
            # in the other order the outer ends move
            a, b = list(two.box), list(one.box)
            b[axis], a[axis + 2] = middle - 1.0, middle + 1.0
        # from_coords orders nothing: bounds are taken anew
        norm = lambda r: (min(r[0], r[2]), min(r[1], r[3]), max(r[0], r[2]), max(r[1], r[3]))
        first.box, last.box = norm(a), norm(b)


def edge_gap(a: Rect, b: Rect, weights: Sequence[float] = (1.0, 1.0, 1.0, 1.0)) -> float:
    h, v = axis_iou(a, b, 0), axis_iou(a, b, 1)
    if h > 0 and v > 0:
        return 0.0
    gap = 0.0
    for axis, share, (wa, wb) in ((0, h, weights[:2]), (1, v, weights[2:])):
        if share == 0:
            gap += min(abs(a[axis] - b[axis + 2]), abs(a[axis + 2] - b[axis])) * (wa if a[axis + 2] < b[axis] else wb)
    return gap


def edge_weights(role: str, flat: bool) -> tuple[float, float, float, float]:
    if role == "doc_title":
        return (1.0, 0.1, 0.1, 1.0) if flat else (0.2, 0.1, 1.0, 1.0)
    return (1.0, 1.0, 0.1, 1.0) if role in ("paragraph_title", "vision", "vision_title", "cross_layout") else (1.0, 1.0, 1.0, 0.1)


def insert_weighted(block: Block, done: list[Block]) -> None:
    """Beside the placed block of least cost: 10^4 x edge gap in 50-pixel steps, its top, twice its left."""
    x1, y1, x2, _ = block.box
    weights = edge_weights(block.role, block.flat)
    least, least_up, at = math.inf, math.inf, 0
    for k, other in enumerate(done):
        ox1, oy1, _, oy2 = other.box
        gap = math.floor(edge_gap(block.box, other.box, weights) / 50.0) * 50.0
        up, left = oy1, ox1
        if block.role != "unordered" and oy2 < y1:
            up, left = -up, -left
        if abs(least_up - up) <= EDGE_TOLERANCE:
            up = least_up
        cost = gap * EDGE_WEIGHT + up * UP_WEIGHT + left * LEFT_WEIGHT
        least_up = min(least_up, up)
        if cost < least:
            least = cost
            if int(math.floor(y1) / 2) != int(math.floor(oy1) / 2):
                mine, its = y1, oy1
            elif int(math.floor(x1) / 2) != int(math.floor(x2) / 2):
                mine, its = x1, ox1
            else:
                mine, its = (sum(((b[i] + b[i + 2]) / 2) ** 2 for i in (0, 1)) for b in (block.box, other.box))
            at = k + 1 if mine > its else k
    done.insert(min(at, len(done)), block)


EDGE_TOLERANCE = 2.0
EDGE_WEIGHT, UP_WEIGHT, LEFT_WEIGHT = 1e4, 1.0, 2.0


def insert_manhattan(block: Block, done: list[Block]) -> None:
    """Right after the placed block whose top-left corner is nearest."""
    if not done:
        done.append(block)
        return
    gaps = [abs(block.box[0] - o.box[0]) + abs(block.box[1] - o.box[1]) for o in done]
    done.insert(gaps.index(min(gaps)) + 1, block)


def seat_captions(done: list[Block]) -> None:
    """Move each caption beside the nearest picture or table within three of its line heights."""
    moves = []
    for i, b in enumerate(done):
        if b.role != "vision_title":
            continue
        gaps = [(edge_gap(b.box, o.box), j) for j, o in enumerate(done) if o.role == "vision"]
        if not gaps:
            continue
        gap, j = min(gaps)
        if gap < done[j].line_height * 3.0:
            moves.append((i, j if b.box[1] < done[j].box[1] else j + 1))
    for at, to in reversed(moves):
        if to not in (at, at + 1):
            b = done.pop(at)
            done.insert(min(to - 1 if at < to else to, len(done)), b)


def merged_spans(spans: Sequence[tuple[float, float]]) -> list[tuple[int, int]]:
    """Union of truncated one-dimensional spans; touching ones are one."""
    out: list[list[int]] = []
    for s, e in sorted(((int(a), int(b)) for a, b in spans), key=lambda p: p[0]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out]


def cut_by_columns(blocks: list[Block]) -> list[Block]:
    """Columns first on pages of one column or of single lines, rows first elsewhere."""
    columns = merged_spans([(b.box[0], b.box[2]) for b in blocks])
    single = max((b.lines for b in blocks), default=1) == 1
    shrink_overlaps(blocks)
    return [blocks[i] for i in xycut([b.box for b in blocks], vertical=not (len(columns) == 1 or single))]


def main_order(blocks: list[Block]) -> list[Block]:
    """Body blocks: cut, then document titles, pictures and crossing blocks, unordered ones and captions are fitted in."""
    if not blocks:
        return []
    mark_cross_layout(blocks)
    fitted = ("cross_layout", "cross_reference", "vision", "vision_title")
    groups: dict[str, list[Block]] = {"cut": [], "title": [], "fit": [], "loose": []}
    for b in blocks:
        groups["fit" if b.role in fitted else "title" if b.role == "doc_title" else "loose" if b.role == "unordered" else "cut"].append(b)
    by_y = lambda bs: sorted(bs, key=lambda b: b.box[1])
    done = cut_by_columns(groups["cut"]) if groups["cut"] else []
    for i, b in enumerate(by_y(groups["title"])):
        done.insert(0, b) if i == 0 else insert_weighted(b, done)
    for b in by_y(groups["fit"]):
        insert_weighted(b, done)
    for b in by_y(groups["loose"]):
        insert_manhattan(b, done)
    seat_captions(done)
    return done


def enhanced_order(boxes: Sequence[Rect], kinds: Sequence[str], lines: Sequence[int | None] | None = None) -> list[int]:
    """Positions: headers from the top, the body, footers from the top."""
    blocks = [Block(tuple(map(float, b)), i, k, (lines[i] if lines is not None else 1) or 1) for i, (b, k) in enumerate(zip(boxes, kinds))]
    part = lambda role: sorted((b for b in blocks if b.role == role), key=lambda b: b.box[1])
    body = main_order([replace(b) for b in blocks if b.role not in ("header", "footer")])
    return [b.at for b in [*part("header"), *body, *part("footer")]]


# -- as operators

_HOW = ("quad", "xycut", "xycut_columns", "enhanced", "regions")


def order_pages(frame: DataFrame, how: str = "enhanced", keys: Sequence[str] = PAGE, above: float = 0.1) -> DataFrame:
    """``frame`` with rank (int, from 0) in reading order within each page.

    Rows bring idx and x1..y2; ``enhanced`` also kind and optionally num_lines;
    ``regions`` treats rows of kind ``region`` as regions and ranks the others.
    Boxes that a cut loses (no extent) come last, in input order.
    """
    if how not in _HOW:
        raise ValueError(f"how must be one of {_HOW}")

    def run(page: Rows) -> Rows:
        boxes = [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in page]
        if how == "quad":
            order = quad_order(boxes)
        elif how == "enhanced":
            order = enhanced_order(boxes, [r["kind"] for r in page], [r.get("num_lines") for r in page])
        elif how == "regions":
            regions = [b for r, b in zip(page, boxes) if r["kind"] == "region"]
            page = [r for r in page if r["kind"] != "region"]
            order = region_hierarchy_order([(r["x1"], r["y1"], r["x2"], r["y2"]) for r in page], regions, above)
        else:
            order = xycut(boxes, vertical=how == "xycut")
        seen = set(order)
        order = [*order, *(i for i in range(len(page)) if i not in seen)]
        return [{**page[i], "rank": n} for n, i in enumerate(order)]

    names = [c for c in frame.columns if c not in keys]
    return paged.per_page(frame, run, f"{kinds_of(frame, names)}, rank int", keys).select(*frame.columns, "rank")
