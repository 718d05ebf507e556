"""Order-dependent suppression and merging of boxes, one page at a time.

A suppressed box must not suppress others, so these are folds and not
self-joins. Each fold is a plain function over numpy arrays, run page by page. A
page's boxes are bounded by the detector.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.operators import paged
from quirespark.operators.paged import Rows, kinds_of

PAGE = ("doc_id", "page_idx")


def pairwise(boxes: np.ndarray, i: int, inclusive: bool = False) -> np.ndarray:
    """IoU of box ``i`` against all boxes."""
    one = 1.0 if inclusive else 0.0
    w = np.maximum(np.minimum(boxes[:, 2], boxes[i, 2]) - np.maximum(boxes[:, 0], boxes[i, 0]) + one, 0)
    h = np.maximum(np.minimum(boxes[:, 3], boxes[i, 3]) - np.maximum(boxes[:, 1], boxes[i, 1]) + one, 0)
    size = (boxes[:, 2] - boxes[:, 0] + one) * (boxes[:, 3] - boxes[:, 1] + one)
    union = size + size[i] - w * h
    return np.divide(w * h, union, out=np.zeros(len(boxes)), where=union > 0)


def by_score(scores: np.ndarray) -> np.ndarray:
    """Positions by falling score, earlier first on ties; NaN counts as equal to its neighbours' order, last."""
    return np.argsort(-np.nan_to_num(scores, nan=-np.inf), kind="stable")


def nms(boxes: np.ndarray, classes: np.ndarray, scores: np.ndarray, above: float = 0.5, most: int = 100) -> list[int]:
    """Kept positions in falling score: a box drops if a kept one of its class overlaps it by more than ``above``."""
    order, gone, keep = by_score(scores), np.zeros(len(boxes), bool), []
    for i in order:
        if gone[i]:
            continue
        keep.append(int(i))
        if len(keep) >= most:
            break
        gone |= (classes == classes[i]) & (pairwise(boxes, i) > above)
    return keep


def layout_nms(boxes: np.ndarray, classes: np.ndarray, scores: np.ndarray, same: float = 0.6, other: float = 0.98) -> list[int]:
    """Kept positions in falling score over all classes, with pixel-inclusive IoU; NaN overlaps drop."""
    order, gone, keep = by_score(scores), np.zeros(len(boxes), bool), []
    for i in order:
        if gone[i]:
            continue
        keep.append(int(i))
        share = pairwise(boxes, i, inclusive=True)
        gone |= ~(share < np.where(classes == classes[i], same, other))
    return keep


def merge_two(a: Sequence[float], b: Sequence[float], mode: str) -> tuple[float, ...]:
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    if mode == "union":
        return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])
    first = size(a) >= size(b) if mode == "large" else size(a) <= size(b)
    return tuple(a) if first else tuple(b)


def nms_merge(boxes: np.ndarray, classes: np.ndarray, scores: np.ndarray, modes: dict, above: float = 0.5, most: int = 100) -> list[tuple[int, tuple[float, ...], object, float]]:
    """(source position, box, class, score) of merged groups.

    A group starts at its best box and takes in every later box of its class that
    overlaps the box as merged so far; score is the best, position the first. The
    ``most`` best groups stay, in source order.
    """
    # plain numbers: an array call a pair costs more than the pair
    order, rows, names, said = by_score(scores).tolist(), np.asarray(boxes, float).tolist(), list(classes), np.asarray(scores, float).tolist()
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    out, left = [], order
    while left:
        i, *rest = left
        box, best, first, left = tuple(rows[i]), said[i], i, []
        mode = modes.get(names[i], "large")
        for j in rest:
            if names[j] == names[i]:
                r = rows[j]
                both = max(min(r[2], box[2]) - max(r[0], box[0]), 0.0) * max(min(r[3], box[3]) - max(r[1], box[1]), 0.0)
                union = size(r) + size(box) - both
                if (both / union if union > 0 else 0.0) > above:
                    box, best, first = merge_two(box, tuple(r), mode), max(best, said[j]), min(first, j)
                    continue
            left.append(j)
        out.append((first, box, names[i], best))
    return sorted(out[:most], key=lambda r: r[0])


def _smaller_share(boxes: np.ndarray, i: int) -> np.ndarray:
    w = np.maximum(np.minimum(boxes[:, 2], boxes[i, 2]) - np.maximum(boxes[:, 0], boxes[i, 0]), 0)
    h = np.maximum(np.minimum(boxes[:, 3], boxes[i, 3]) - np.maximum(boxes[:, 1], boxes[i, 1]), 0)
    size = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    low = np.minimum(size, size[i])
    return np.divide(w * h, low, out=np.zeros(len(boxes)), where=low > 0)


def overlap_removed(boxes: np.ndarray, labels: Sequence[str], above: float = 0.5) -> set[int]:
    """Positions to drop: of an overlapping pair the image, else the smaller, else the later.

    A box that drops while it is compared goes on being compared to the end of
    its own pass.
    """
    gone: set[int] = set()
    size = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]) if len(boxes) else np.zeros(0)
    for i in range(len(boxes)):
        if i in gone:
            continue
        share = _smaller_share(boxes, i)
        for j in range(i + 1, len(boxes)):
            if j in gone or not share[j] > above:
                continue
            one, two = labels[i] == "image", labels[j] == "image"
            gone.add((i if one else j) if one != two else (i if size[i] < size[j] else j))
    return gone


def overlap_filtered(boxes: np.ndarray, labels: Sequence[str], above: float = 0.7) -> list[int]:
    """Kept positions: ``reference`` boxes go first; then of an overlapping pair the smaller, the later on ties.

    An image and a box of another label never drop one another, and a dropped
    box is compared no further.
    """
    keep = [i for i in range(len(boxes)) if labels[i] != "reference"]
    gone: set[int] = set()
    size = np.maximum((boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]), 0) if len(boxes) else np.zeros(0)
    for n, i in enumerate(keep):
        share = _smaller_share(boxes, i)
        for j in keep[n + 1 :]:
            if i in gone:
                break
            if j in gone or share[j] <= above or ("image" in (labels[i], labels[j]) and labels[i] != labels[j]):
                continue
            gone.add(j if size[i] >= size[j] else i)
    return [i for i in keep if i not in gone]


def _boxes(page: Rows) -> np.ndarray:
    return np.array([(r["x1"], r["y1"], r["x2"], r["y2"]) for r in page], float).reshape(-1, 4)


def _col(page: Rows, name: str, kind: type | None = None) -> np.ndarray:
    return np.array([r[name] for r in page], kind) if kind else np.array([r[name] for r in page], object)


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _codes(column) -> np.ndarray:
    """Equal values as equal numbers; null is a value of its own."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _hits(starts: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions (i, j), i before j on one page, that ``test`` finds, sorted by i and then j.

    Pages of one size are taken together, large pages in blocks of rows, so that
    at most about ``most`` pairs are held at once whatever a page's size.
    """
    sizes = np.diff(starts)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        hit = test(i, j)
        found.append((i[hit], j[hit]))

    for c in np.unique(sizes[sizes > 1]).tolist():
        pages = starts[:-1][sizes == c].astype(np.int64)
        if c * c <= 2 * most:
            i, j = np.triu_indices(c, 1)
            step = max(1, most // len(i))
            for k in range(0, len(pages), step):
                at = pages[k : k + step, None]
                add((at + i).ravel(), (at + j).ravel())
        else:
            step = max(1, most // c)
            for at in pages.tolist():
                for k in range(0, c - 1, step):
                    i, j = np.nonzero(np.arange(c)[None, :] > np.arange(k, min(k + step, c - 1))[:, None])
                    add(at + k + i, at + j)
    i, j = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def _corners(columns: dict) -> np.ndarray:
    return np.stack([_numbers(columns[c]) for c in ("x1", "y1", "x2", "y2")], axis=1).reshape(-1, 4)


def _iou_of(boxes: np.ndarray, i: np.ndarray, j: np.ndarray, one: float = 0.0) -> np.ndarray:
    a, b = boxes[i], boxes[j]
    both = np.maximum(np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]) + one, 0) * np.maximum(np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]) + one, 0)
    size = lambda r: (r[:, 2] - r[:, 0] + one) * (r[:, 3] - r[:, 1] + one)
    union = size(a) + size(b) - both
    return np.divide(both, union, out=np.zeros(len(both)), where=union > 0)


def _ranked(columns: dict, starts: np.ndarray) -> np.ndarray:
    """Positions by page and falling score, as ``by_score`` has them."""
    page = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return np.lexsort((-np.nan_to_num(_numbers(columns["score"]), nan=-np.inf), page))


def _left(starts: np.ndarray, kept: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Kept positions and their rank within the page, at most ``most`` of a page."""
    at = np.flatnonzero(kept)
    before = np.concatenate(([0], np.cumsum(kept)))
    rank = before[at] - before[starts[np.searchsorted(starts, at, side="right") - 1]]
    return (at, rank) if most is None else (at[rank < most], rank[rank < most])


def _greedy(columns: dict, starts: np.ndarray, drops: Callable, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Greedy suppression over a batch of pages: only pairs that ``drops`` names are walked, best first."""
    order = _ranked(columns, starts)
    boxes, classes = _corners(columns)[order], _codes(columns["cls"])[order]
    i, j = _hits(starts, lambda i, j: drops(boxes, classes, i, j))
    kept = np.ones(len(order), bool)
    for a, b in zip(i.tolist(), j.tolist()):
        if kept[a]:
            kept[b] = False
    at, rank = _left(starts, kept, most)
    return order[at], rank


def apply_nms(frame: DataFrame, above: float = 0.5, most: int = 100, keys: Sequence[str] = PAGE) -> DataFrame:
    """Greedy same-class suppression of (x1..y2, cls, score, idx) rows by page."""

    def drops(boxes, classes, i, j):
        return (classes[i] == classes[j]) & (_iou_of(boxes, i, j) > above)

    return paged.picked(frame, lambda c, s: _greedy(c, s, drops, most), keys)


def apply_layout_nms(frame: DataFrame, keys: Sequence[str] = PAGE, same: float = 0.6, other: float = 0.98) -> DataFrame:
    """Greedy suppression over all classes with pixel-inclusive overlap."""

    def drops(boxes, classes, i, j):
        return ~(_iou_of(boxes, i, j, 1.0) < np.where(classes[i] == classes[j], same, other))

    return paged.picked(frame, lambda c, s: _greedy(c, s, drops, None), keys)


def apply_nms_merge(frame: DataFrame, modes: dict[str, str], above: float = 0.5, most: int = 100, keys: Sequence[str] = PAGE) -> DataFrame:
    """Merged groups by page: keys, idx of the first member, cls, score and box."""

    def run(page: Rows) -> Rows:
        found = nms_merge(_boxes(page), _col(page, "cls"), _col(page, "score", float), modes, above, most)
        return [{"idx": page[i]["idx"], "cls": c, "score": s, **dict(zip(("x1", "y1", "x2", "y2"), map(float, b)))} for i, b, c, s in found]

    asks = frame.select(*keys, "idx", "cls", "score", "x1", "y1", "x2", "y2")
    return paged.per_page(asks, run, f"{kinds_of(frame, ['idx', 'cls'])}, score double, x1 double, y1 double, x2 double, y2 double", keys)


def _shares_of(boxes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = boxes[i], boxes[j]
    both = np.maximum(np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0]), 0) * np.maximum(np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]), 0)
    size = lambda r: (r[:, 2] - r[:, 0]) * (r[:, 3] - r[:, 1])
    low = np.minimum(size(a), size(b))
    return np.divide(both, low, out=np.zeros(len(both)), where=low > 0)


def _is(column, value: str) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.equal(column, value), False).to_numpy(zero_copy_only=False)


def remove_overlaps(frame: DataFrame, above: float = 0.5, keys: Sequence[str] = PAGE, label: str = "label") -> DataFrame:
    """Rows that ``overlap_removed`` leaves of each page."""

    def kept(columns: dict, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        boxes, image = _corners(columns), _is(columns[label], "image")
        size = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
        i, j = _hits(starts, lambda i, j: _shares_of(boxes, i, j) > above)
        falls = np.where(image[i] != image[j], np.where(image[i], i, j), np.where(size[i] < size[j], i, j))
        left, now, goes = np.ones(len(boxes), bool), -1, False
        for a, b, f in zip(i.tolist(), j.tolist(), falls.tolist()):
            # a box that drops in its own pass goes on comparing
            if a != now:
                now, goes = a, left[a]
            if goes and left[b]:
                left[f] = False
        return _left(starts, left)

    return paged.picked(frame, kept, keys)


def filter_overlaps(frame: DataFrame, above: float = 0.7, keys: Sequence[str] = PAGE, label: str = "label") -> DataFrame:
    """Rows that ``overlap_filtered`` leaves of each page."""

    def kept(columns: dict, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        boxes, image, left = _corners(columns), _is(columns[label], "image"), ~_is(columns[label], "reference")
        size = np.maximum((boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]), 0)
        i, j = _hits(starts, lambda i, j: (_shares_of(boxes, i, j) > above) & (image[i] == image[j]) & left[i] & left[j])
        left = left.copy()
        for a, b, f in zip(i.tolist(), j.tolist(), np.where(size[i] >= size[j], j, i).tolist()):
            if left[a] and left[b]:
                left[f] = False
        return _left(starts, left)

    return paged.picked(frame, kept, keys)


def drop_large_images(frame: DataFrame, keys: Sequence[str] = PAGE, image: str = "image") -> DataFrame:
    """Without image boxes of more than 82 % of a landscape page (93 % otherwise); pages left empty keep all theirs, as do single boxes."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    area = (F.least("x2", "width") - F.greatest("x1", F.lit(0.0))) * (F.least("y2", "height") - F.greatest("y1", F.lit(0.0)))
    most = F.when(F.col("width") > F.col("height"), 0.82).otherwise(0.93) * F.col("width") * F.col("height")
    flagged = frame.withColumn("__keep", (F.col("label") != image) | (area <= most)).withColumn("__kept", F.sum(F.col("__keep").cast("int")).over(w)).withColumn("__n", F.count(F.lit(1)).over(w))
    return flagged.filter(F.col("__keep") | (F.col("__kept") == 0) | (F.col("__n") <= 1)).drop("__keep", "__kept", "__n")


def containment_modes(frame: DataFrame, modes: dict[str, str], formula: str | None = "formula", keys: Sequence[str] = PAGE) -> DataFrame:
    """Without boxes that their class's merge mode drops: contained ones (large) or containers (small).

    Not order-dependent: a self-join by page and one ``max`` a box and mode. A
    formula inside anything but a formula does not count as contained.
    """
    from quirespark.functions.geometry import Box, is_contained

    a, b = frame.alias("a"), frame.select(*keys, F.col("idx").alias("j_idx"), F.col("label").alias("j_label"), *(F.col(c).alias(f"j_{c}") for c in ("x1", "y1", "x2", "y2"))).alias("b")
    pairs = a.join(b, list(keys)).filter(F.col("idx") != F.col("j_idx")).filter(is_contained(Box.of(), Box.of("j_")))
    if formula is not None:
        pairs = pairs.filter(~((F.col("label") == formula) & (F.col("j_label") != formula)))
    drops = None
    for label, mode in modes.items():
        if mode == "large":
            part = pairs.filter(F.col("j_label") == label).select(*keys, "idx")
        elif mode == "small":
            hit = pairs.filter(F.col("label") == label)
            inner = hit.select(*keys, "idx").distinct()
            part = hit.select(*keys, F.col("j_idx").alias("idx")).distinct().join(inner, [*keys, "idx"], "left_anti")
        else:
            continue
        drops = part if drops is None else drops.unionByName(part)
    return frame if drops is None else frame.join(drops.distinct(), [*keys, "idx"], "left_anti")


def dedup_sections(lines: DataFrame, keys: Sequence[str] = ("doc_id",), pos: str = "pos", text: str = "line") -> DataFrame:
    """Lines without later repeats of a ``**Header**`` line of the same document."""
    from pyspark.sql import Window

    bare = T.strip(F.col(text))
    head = bare.rlike(r"^\*\*.+\*\*$")
    w = Window.partitionBy(*keys, F.when(head, bare)).orderBy(pos)
    return lines.withColumn("__n", F.when(head, F.row_number().over(w)).otherwise(1)).filter("__n = 1").drop("__n")
