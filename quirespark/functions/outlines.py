"""Outline geometry in numpy, for use inside pandas functions: hulls, minimum-area rectangles, simplification, offsets."""

from __future__ import annotations

import numpy as np


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Hull of points in counter-clockwise order (monotone chain)."""
    pts = np.unique(np.asarray(points, float), axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[np.ndarray] = []
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        for p in seq:
            while len(out) >= 2 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def min_area_rect(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """(cx, cy, width, height, degrees) of the least rectangle around points; its long side has the angle."""
    hull = convex_hull(points)
    if len(hull) == 0:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    if len(hull) < 3:
        lo, hi = hull.min(axis=0), hull.max(axis=0)
        d = hi - lo
        c = (lo + hi) / 2
        return float(c[0]), float(c[1]), float(np.hypot(*d)), 0.0, float(np.degrees(np.arctan2(*(hull[-1] - hull[0])[::-1])))
    best = None
    edges = np.roll(hull, -1, axis=0) - hull
    for a in np.unique(np.mod(np.arctan2(edges[:, 1], edges[:, 0]), np.pi / 2)):
        rot = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
        p = hull @ rot.T
        lo, hi = p.min(axis=0), p.max(axis=0)
        w, h = hi - lo
        if best is None or w * h < best[0]:
            c = rot.T @ ((lo + hi) / 2)
            best = (w * h, float(c[0]), float(c[1]), float(w), float(h), float(np.degrees(a)))
    return best[1:]


def rect_points(cx: float, cy: float, w: float, h: float, degrees: float) -> np.ndarray:
    a = np.radians(degrees)
    rot = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    return np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2 @ rot.T + (cx, cy)


def simplify(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Douglas-Peucker: points further than ``epsilon`` from the chord between kept neighbours."""
    pts = np.asarray(points, float)
    if len(pts) <= 2:
        return pts
    keep = np.zeros(len(pts), bool)
    keep[[0, -1]] = True
    stack = [(0, len(pts) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        chord, rel = pts[b] - pts[a], pts[a + 1 : b] - pts[a]
        length = np.hypot(*chord)
        far = np.abs(chord[0] * rel[:, 1] - chord[1] * rel[:, 0]) / length if length else np.hypot(rel[:, 0], rel[:, 1])
        k = int(far.argmax())
        if far[k] > epsilon:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return pts[keep]


def area(points: np.ndarray) -> float:
    x, y = np.asarray(points, float).T if len(points) else (np.zeros(0), np.zeros(0))
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2) if len(x) >= 3 else 0.0


def perimeter(points: np.ndarray) -> float:
    p = np.asarray(points, float)
    return float(np.hypot(*(np.roll(p, -1, axis=0) - p).T).sum()) if len(p) else 0.0


def offset(points: np.ndarray, ratio: float) -> np.ndarray:
    """A convex outline pushed out by area x ratio / perimeter, corners mitred."""
    p = np.asarray(points, float)
    length = perimeter(p)
    if len(p) < 3 or length <= 0:
        return p
    d = area(p) * ratio / length
    x, y = p.T
    if np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)) < 0:
        p = p[::-1]
    e = np.roll(p, -1, axis=0) - p
    size = np.hypot(e[:, 0], e[:, 1])
    e, p = e[size > 0] / size[size > 0][:, None], p[size > 0]
    out = np.stack([e[:, 1], -e[:, 0]], axis=1)
    before = np.roll(out, 1, axis=0)
    bisector = out + before
    scale = 2.0 / np.maximum((bisector**2).sum(axis=1), 1e-6)
    return p + bisector * scale[:, None] * d


def inside_mask(points: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels whose row crosses the outline around their centre column (scanline fill)."""
    p = np.asarray(points, float)
    mask = np.zeros((height, width), bool)
    x1, y1 = p.T
    x2, y2 = np.roll(p, -1, axis=0).T
    for row in range(max(0, int(np.floor(y1.min()))), min(height, int(np.ceil(y1.max())) + 1)):
        y = row + 0.5
        cross = ((y1 <= y) & (y < y2)) | ((y2 <= y) & (y < y1))
        xs = np.sort(x1[cross] + (y - y1[cross]) * (x2[cross] - x1[cross]) / (y2[cross] - y1[cross]))
        for a, b in zip(xs[::2], xs[1::2]):
            mask[row, max(0, int(np.ceil(a - 0.5))) : min(width, int(np.floor(b - 0.5)) + 1)] = True
    return mask


def score_inside(prob: np.ndarray, points: np.ndarray) -> float:
    """Mean of a probability map inside an outline, 0 when that is empty."""
    mask = inside_mask(points, prob.shape[1], prob.shape[0])
    return float(prob[mask].mean()) if mask.any() else 0.0
