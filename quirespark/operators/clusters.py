"""Deterministic k-means: boxes reduced to a number of rectangles, and heading levels of titles.

Initial centres are chosen by rule, not at random, so results repeat; the work
is a page's or a table's.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.operators import paged
from quirespark.operators.paged import Rows, kinds_of

PAGE = ("doc_id", "page_idx")


def first_centers(points: np.ndarray, k: int) -> np.ndarray:
    """The point of median x, then k - 1 times the point furthest from all chosen, the first of equals."""
    if k >= len(points):
        return points.astype(float).copy()
    order = np.argsort(points[:, 0], kind="stable")
    chosen = [points[order[len(points) // 2]]]
    while len(chosen) < k:
        far = ((points[:, None, :] - np.array(chosen)[None]) ** 2).sum(axis=2).min(axis=1)
        if far.sum() <= 0:
            break
        chosen.append(points[int(far.argmax())])
    return np.array(chosen, float)


#: up to so many boxes plain numbers beat arrays
FEW = 48


def _few_labels(points: list[list[float]], n: int, rounds: int) -> tuple[list[int], int]:
    """(cluster of each point, number of centres): the steps of ``first_centers`` and ``reduce_boxes`` on plain numbers."""
    away = lambda p, c: (p[0] - c[0]) * (p[0] - c[0]) + (p[1] - c[1]) * (p[1] - c[1])
    order = sorted(range(len(points)), key=lambda i: points[i][0])
    centers = [points[order[len(points) // 2]]]
    far = [away(p, centers[0]) for p in points]
    while len(centers) < n and max(far) > 0:
        centers.append(points[far.index(max(far))])
        far = [min(f, away(p, centers[-1])) for p, f in zip(points, far)]
    k, labels = len(centers), [0] * len(points)
    for _ in range(rounds):
        was, labels = labels, [min(range(k), key=[away(p, c) for c in centers].__getitem__) for p in points]
        for c in range(k):
            if mine := [p for p, at in zip(points, labels) if at == c]:
                x = y = 0.0
                for p in mine:
                    x, y = x + p[0], y + p[1]
                centers[c] = [x / len(mine), y / len(mine)]
        if labels == was:
            break
    return labels, k


def reduce_boxes(boxes: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """At most ``n`` enclosing rectangles of boxes clustered by centre; all boxes if there are no more than ``n``."""
    boxes = np.asarray(boxes, float).reshape(-1, 4)
    if not len(boxes) or n <= 0:
        return np.zeros((0, 4))
    if n >= len(boxes):
        return boxes
    points = np.stack([(boxes[:, 0] + boxes[:, 2]) / 2, (boxes[:, 1] + boxes[:, 3]) / 2], axis=1)
    if len(boxes) <= FEW and np.isfinite(boxes).all():
        labels, k = _few_labels(points.tolist(), n, rounds)
        rows = boxes.tolist()
        few = [[r for r, at in zip(rows, labels) if at == c] for c in range(k)]
        return np.array([[min(r[0] for r in g), min(r[1] for r in g), max(r[2] for r in g), max(r[3] for r in g)] for g in few if g])
    centers = first_centers(points, n)
    labels = np.zeros(len(points), int)
    for _ in range(rounds):
        now = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = (now != labels).any()
        labels = now
        for c in range(len(centers)):
            if (labels == c).any():
                centers[c] = points[labels == c].mean(axis=0)
        if not moved:
            break
    groups = [boxes[labels == c] for c in range(len(centers))]
    return np.array([[g[:, 0].min(), g[:, 1].min(), g[:, 2].max(), g[:, 3].max()] for g in groups if len(g)])


def cells_with_ocr(cells: np.ndarray, scores: Sequence[float], ocr: np.ndarray, n: int) -> np.ndarray:
    """Detected cells brought towards ``n`` with the help of text boxes.

    More than ``n`` keep the best scores. Text boxes less than 0.6 covered by the
    cells are added: merged with the cells down to ``n`` if there were too many
    cells, else clustered into as many as are missing. With 0.6 n or fewer left,
    the text boxes alone are clustered.
    """
    cells, ocr = np.asarray(cells, float).reshape(-1, 4), np.asarray(ocr, float).reshape(-1, 4)
    if n == 0:
        return np.zeros((0, 4))
    if not len(cells):
        return reduce_boxes(ocr, n)
    if len(cells) == n:
        return cells
    many = len(cells) > n
    if many:
        s = np.asarray(scores, float) if len(scores) == len(cells) else np.ones(len(cells))
        cells = cells[np.argsort(-s, kind="stable")[:n]]
    missed = []
    for o in ocr:
        w = np.maximum(np.minimum(cells[:, 2], o[2]) - np.maximum(cells[:, 0], o[0]), 0)
        h = np.maximum(np.minimum(cells[:, 3], o[3]) - np.maximum(cells[:, 1], o[1]), 0)
        size = (o[2] - o[0]) * (o[3] - o[1])
        if not (size > 0 and (w * h).sum() / size >= 0.6):
            missed.append(o)
    out = cells
    if missed:
        extra = np.array(missed)
        out = reduce_boxes(np.concatenate([cells, extra]), n) if many else np.concatenate([cells, reduce_boxes(extra, n - len(cells))])
    return reduce_boxes(ocr, n) if len(out) <= 0.6 * n else out


def mean(values: list[float]) -> float:
    """numpy's mean to the last bit: up to seven values it adds in order; for so few, a call costs more than the sum."""
    if len(values) > 7:
        return float(np.mean(values))
    total = 0.0
    for v in values:
        total += v
    return total / len(values)


def levels_of(values: Sequence[float], falling: bool) -> list[int] | None:
    """Heading levels 2 to 5 of values clustered in at most four groups; None where all are alike."""
    if len(values) < 2:
        return None
    v = np.asarray(values, float)
    if not np.isfinite(v).all():
        keep = np.isfinite(v)
        if keep.sum() < 2:
            return None
        inner = levels_of(v[keep].tolist(), falling)
        if inner is None:
            return None
        at = iter(inner)
        return [next(at) if k else 0 for k in keep]
    v = v.tolist()
    s = sorted(v)
    k = min(sum(b - a > 1e-3 for a, b in zip(s, s[1:])) + 1, 4, len(v))
    if k <= 1:
        return None
    centers = [s[min(int((i + 0.5) / k * len(s)), len(s) - 1)] for i in range(k)]
    near: list[int] = []
    for n in range(17):
        was, near = near, [min(range(k), key=[abs(x - c) for c in centers].__getitem__) for x in v]
        # what no round changed, no later one changes
        if near == was or n == 16:
            break
        for c in range(k):
            if mine := [x for x, at in zip(v, near) if at == c]:
                centers[c] = mean(mine)
    rank = {c: i for i, c in enumerate(sorted(range(k), key=lambda c: -centers[c] if falling else centers[c]))}
    return [min(max(rank[c] + 2, 2), 6) for c in near]


def vote(semantic: int | None, font: int | None, indent: int | None) -> int:
    """The level of most votes: numbering counts twice; ties go to the numbered level, then to the lower one."""
    score: dict[int, int] = {}
    for level, weight in ((semantic, 2), (font, 1), (indent, 1)):
        if level:
            score[level] = score.get(level, 0) + weight
    if not score:
        return semantic or 2
    return min(score, key=lambda lv: (-score[lv], lv != semantic, lv))


def title_levels(elements: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, idx, level of each paragraph title: voted by numbering, line height and indent."""
    from quirespark.functions.text import title_level

    titles = elements.filter(F.col("kind") == "paragraph_title").select(*keys, "idx", "x1", "y1", "y2", "num_lines", title_level(F.col("text")).alias("semantic"))

    def run(page: Rows) -> Rows:
        heights = [max(max(r["y2"] - r["y1"], 1.0) / max(r["num_lines"] or 1, 1), 1.0) for r in page]
        font = levels_of(heights, True) or [None] * len(page)
        indent = levels_of([r["x1"] for r in page], False) or [None] * len(page)
        return [{"idx": r["idx"], "level": vote(r["semantic"], f or None, i or None)} for r, f, i in zip(page, font, indent)]

    return paged.per_page(titles, run, f"{kinds_of(elements, ['idx'])}, level int", keys)


def reduce_to_structure(detected: DataFrame, structure: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Detected cells (idx, box) clustered down to the number of structure cells of their table."""
    counted = detected.select(*keys, "idx", "x1", "y1", "x2", "y2").join(structure.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), list(keys))

    def run(page: Rows) -> Rows:
        out = reduce_boxes(np.array([(r["x1"], r["y1"], r["x2"], r["y2"]) for r in page], float), page[0]["__n"])
        return [{"idx": i, **dict(zip(("x1", "y1", "x2", "y2"), map(float, b)))} for i, b in enumerate(out)]

    return paged.per_page(counted, run, f"{kinds_of(detected, ['idx'])}, x1 double, y1 double, x2 double, y2 double", keys)
