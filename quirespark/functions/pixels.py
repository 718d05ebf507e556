"""Image arrays in numpy for use inside pandas functions: decoding, crops, resizing, normalisation, detector maps.

Rows carry encoded bytes, never pixels; a function decodes, works and encodes
inside one call. Portable pixmaps (P5, P6) are read and written here; other
formats need an imaging library, used if it is installed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np

from quirespark.functions import outlines as O

try:
    from PIL import Image as _pil
except ImportError:
    _pil = None

Rect = tuple[float, float, float, float]


def decode(content: bytes) -> np.ndarray:
    """Bytes to an (h, w, 3) array of bytes, by content and not by name."""
    m = re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*" + rb"\s+".join([rb"([0-9]+)"] * 3) + rb"\s", content)
    if m:
        w, h = int(m[2]), int(m[3])
        depth = 3 if m[1] == b"6" else 1
        flat = np.frombuffer(content, np.uint8, w * h * depth, m.end()).reshape(h, w, depth)
        return np.repeat(flat, 3, axis=2) if depth == 1 else flat.copy()
    if _pil is None:
        raise ValueError("only portable pixmaps can be read without an imaging library")
    import io

    return np.asarray(_pil.open(io.BytesIO(content)).convert("RGB"))


def encode(image: np.ndarray) -> bytes:
    """A binary portable pixmap of an image."""
    h, w = image.shape[:2]
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def crop(image: np.ndarray, box: Rect) -> np.ndarray | None:
    """The part of an image inside a box cut to it; None without extent."""
    h, w = image.shape[:2]
    x1, y1 = max(int(np.floor(box[0])), 0), max(int(np.floor(box[1])), 0)
    x2, y2 = min(int(np.ceil(box[2])), w), min(int(np.ceil(box[3])), h)
    return image[y1:y2, x1:x2].copy() if x2 > x1 and y2 > y1 else None


def crop_many(image: np.ndarray, boxes: Sequence[Rect]) -> list[np.ndarray | None]:
    return [crop(image, b) for b in boxes]


def _sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples, edges repeated."""
    h, w = image.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
    low = image[y1, x0] * (1 - fx) + image[y1, x1] * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = image.shape[:2]
    x = (np.arange(width) + 0.5) * w / width - 0.5
    y = (np.arange(height) + 0.5) * h / height - 0.5
    return _sample(image.astype(float), *np.meshgrid(x, y))


def quad_corners(points: np.ndarray) -> np.ndarray:
    """Four corners ordered top-left, top-right, bottom-right, bottom-left."""
    p = np.asarray(points, float)
    p = p[np.argsort(p[:, 0], kind="stable")]
    left, right = p[:2][np.argsort(p[:2, 1], kind="stable")], p[2:][np.argsort(p[2:, 1], kind="stable")]
    return np.array([left[0], right[0], right[1], left[1]])


def crop_quad(image: np.ndarray, points: Sequence[Sequence[float]], tall: float = 1.5) -> np.ndarray | None:
    """A quadrilateral straightened by its perspective; turned if at least ``tall`` times as high as wide."""
    q = np.asarray(points, float)
    if len(q) != 4:
        q = O.rect_points(*O.min_area_rect(q))
    q = quad_corners(q)
    side = lambda a, b: float(np.hypot(*(q[a] - q[b])))
    w, h = int(max(side(0, 1), side(3, 2))), int(max(side(0, 3), side(1, 2)))
    if w < 1 or h < 1:
        return None
    to = np.array([[0, 0], [w, 0], [w, h], [0, h]], float)
    rows = []
    for (x, y), (u, v) in zip(to, q):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    a = np.array(rows)
    m = np.append(np.linalg.lstsq(a[:, :8], a[:, 8], rcond=None)[0], 1).reshape(3, 3)
    gx, gy = np.meshgrid(np.arange(w), np.arange(h))
    p = m @ np.stack([gx.ravel(), gy.ravel(), np.ones(w * h)])
    out = _sample(image.astype(float), (p[0] / p[2]).reshape(h, w), (p[1] / p[2]).reshape(h, w))
    return np.rot90(out).copy() if h >= tall * w else out


def crop_quads(image: np.ndarray, quads: Sequence[Sequence[Sequence[float]]]) -> list[np.ndarray | None]:
    return [crop_quad(image, q) for q in quads]


def gray(image: np.ndarray) -> np.ndarray:
    return np.rint(image[..., 0] * 0.2126 + image[..., 1] * 0.7152 + image[..., 2] * 0.0722).astype(np.uint8)


def crop_margin(image: np.ndarray, white: int = 200) -> np.ndarray:
    """The image without its near-white margin, by stretched brightness."""
    g = gray(image).astype(float)
    lo, hi = g.min(), g.max()
    if lo == hi:
        return image
    ink = ((g - lo) / (hi - lo) * 255).astype(np.uint8) < white
    if not ink.any():
        return image
    ys, xs = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    return image[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1].copy()


def crop_to(image: np.ndarray, width: int, height: int, where: str = "center") -> np.ndarray:
    """A window of a size: centred or in a named corner (top_left, top_right, bottom_left, bottom_right)."""
    h, w = image.shape[:2]
    if width > w or height > h:
        raise ValueError("the window is larger than the image")
    x = {"center": (w - width) // 2, "top_left": 0, "bottom_left": 0}.get(where, w - width)
    y = {"center": (h - height) // 2, "top_left": 0, "top_right": 0}.get(where, h - height)
    return image[y : y + height, x : x + width].copy()


def turn(image: np.ndarray, angle: float) -> np.ndarray:
    """Turned clockwise by 90, 180 or 270 degrees; any other angle leaves it."""
    k = {90: 3, 180: 2, 270: 1}.get(int(angle), 0)
    return np.rot90(image, k).copy() if k else image


def detection_size(width: int, height: int, limit: int = 960, kind: str = "max", most: int = 4000, multiple: int = 32) -> tuple[int, int]:
    """(width, height) for a detector: the longest side at most (``max``) or shortest at least (``min``) the limit, in multiples."""
    side = max(width, height) if kind == "max" else min(width, height)
    ratio = limit / side if (side > limit if kind == "max" else side < limit) else 1.0
    w, h = width * ratio, height * ratio
    if max(w, h) > most:
        w, h = w * most / max(w, h), h * most / max(w, h)
    fit = lambda v: max(int(round(v / multiple)) * multiple, multiple)
    return fit(w), fit(h)


def recognition_size(width: int, height: int, line_height: int = 48, most_ratio: float | None = None) -> tuple[int, int]:
    """(width, height) of a text line scaled to the recogniser's height."""
    ratio = width / max(height, 1)
    return max(int(np.ceil(line_height * (min(ratio, most_ratio) if most_ratio else ratio))), 1), line_height


def factor_size(width: int, height: int, factor: int = 28, least: int = 56 * 56, most: int = 14 * 14 * 4 * 1280) -> tuple[int, int]:
    """(width, height) in multiples of a factor with an area between two bounds; more than 200 times as long as wide raises."""
    if max(width, height) / max(min(width, height), 1) > 200:
        raise ValueError("aspect ratio above 200")
    fit = lambda v, f: max(f(v / factor) * factor, factor)
    w, h = fit(width, round), fit(height, round)
    if w * h > most:
        s = np.sqrt(width * height / most)
        w, h = fit(width / s, lambda v: int(np.floor(v))), fit(height / s, lambda v: int(np.floor(v)))
    elif w * h < least:
        s = np.sqrt(least / (width * height))
        w, h = fit(width * s, lambda v: int(np.ceil(v))), fit(height * s, lambda v: int(np.ceil(v)))
    return int(w), int(h)


def letterbox(image: np.ndarray, width: int, height: int, fill: Sequence[int] = (0, 0, 0)) -> np.ndarray:
    """Scaled to fit a frame, centred on a fill colour."""
    h, w = image.shape[:2]
    s = min(width / w, height / h)
    small = resize(image, max(int(w * s), 1), max(int(h * s), 1))
    out = np.empty((height, width, 3), np.uint8)
    out[:] = np.asarray(fill, np.uint8)
    y, x = (height - small.shape[0]) // 2, (width - small.shape[1]) // 2
    out[y : y + small.shape[0], x : x + small.shape[1]] = small
    return out


def mask(image: np.ndarray, boxes: Sequence[Rect], fill: Sequence[int] = (255, 255, 255)) -> np.ndarray:
    """A copy with boxes painted over."""
    out = image.copy()
    h, w = image.shape[:2]
    for b in boxes:
        out[max(int(b[1]), 0) : max(min(int(b[3]), h), 0), max(int(b[0]), 0) : max(min(int(b[2]), w), 0)] = fill
    return out


def stack_vertically(images: Sequence[np.ndarray], aligns: Sequence[str]) -> np.ndarray:
    """Crops one below the other on white; the n-th alignment places the one after the n-th."""
    width = max(i.shape[1] for i in images)
    out = np.full((sum(i.shape[0] for i in images), width, 3), 255, np.uint8)
    y = 0
    for k, img in enumerate(images):
        how = aligns[0 if k == 0 else min(k - 1, len(aligns) - 1)] if aligns else "center"
        x = {"left": 0, "right": width - img.shape[1]}.get(how, (width - img.shape[1]) // 2)
        out[y : y + img.shape[0], x : x + img.shape[1]] = img
        y += img.shape[0]
    return out


def to_tensor(images: Sequence[np.ndarray], scale: float = 1 / 255, mean: Sequence[float] = (0.485, 0.456, 0.406), std: Sequence[float] = (0.229, 0.224, 0.225), bgr: bool = False) -> np.ndarray:
    """(n, 3, h, w) floats of (x * scale - mean) / std; images share one size."""
    x = np.stack([i[..., ::-1] if bgr else i for i in images]).astype(np.float32)
    return np.transpose((x * scale - np.asarray(mean, np.float32)) / np.asarray(std, np.float32), (0, 3, 1, 2))


def formula_tensor(image: np.ndarray, width: int = 672, height: int = 192) -> np.ndarray:
    """(1, 1, h, w) of a formula: margin off, fitted on white, gray, normalised."""
    g = gray(letterbox(crop_margin(image), width, height, (255, 255, 255))).astype(np.float32) / 255
    return ((g - 0.7931) / 0.1738)[None, None]


def rectified(tensor: np.ndarray, scale: float = 255.0) -> list[np.ndarray]:
    """RGB images of (n, 3, h, w) planes of blue, green and red within 0 and 1."""
    return [np.clip(np.rint(np.transpose(t[::-1], (1, 2, 0)) * scale), 0, 255).astype(np.uint8) for t in tensor]


def _components(on: np.ndarray) -> list[np.ndarray]:
    """Pixel coordinates (x, y) of each 8-connected blob, by runs and union-find."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows: list[list[tuple[int, int, int]]] = []
    for line in on:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], line.astype(np.int8), [0]))))
        runs = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            parent.append(len(parent))
            me = len(parent) - 1
            for pa, pb, pid in rows[-1] if rows else []:
                if pa <= b and a <= pb:
                    x, y = root(me), root(pid)
                    parent[max(x, y)] = min(x, y)
            runs.append((a, b, me))
        rows.append(runs)
    out: dict[int, list[tuple[int, int]]] = {}
    for y, runs in enumerate(rows):
        for a, b, i in runs:
            out.setdefault(root(i), []).extend((x, y) for x in range(a, b))
    return [np.array(p, float) for _, p in sorted(out.items())]


def boxes_from_map(prob: np.ndarray, width: int, height: int, threshold: float = 0.3, least_score: float = 0.6, ratio: float = 1.5, most: int = 1000, least_side: float = 3.0, polygon: bool = False) -> list[tuple[np.ndarray, float]]:
    """(corners on a width x height page, score) of the blobs of a probability map.

    A blob becomes its minimum-area rectangle (or simplified hull), is scored by
    the mean inside, pushed out by area x ratio / perimeter and scaled.
    """
    h, w = prob.shape
    out = []
    for blob in _components(prob > threshold)[:most]:
        hull = O.convex_hull(np.concatenate([blob, blob + (1, 0), blob + (0, 1), blob + (1, 1)]))
        rect = O.min_area_rect(hull)
        if min(rect[2], rect[3]) < least_side:
            continue
        shape = O.simplify(np.concatenate([hull, hull[:1]]), 0.002 * O.perimeter(hull))[:-1] if polygon else O.rect_points(*rect)
        score = O.score_inside(prob, shape)
        if score < least_score:
            continue
        grown = O.offset(shape, ratio)
        if not polygon:
            grown = quad_corners(O.rect_points(*O.min_area_rect(grown)))
        grown = np.stack([np.clip(np.rint(grown[:, 0] / w * width), 0, width), np.clip(np.rint(grown[:, 1] / h * height), 0, height)], axis=1)
        if min(O.min_area_rect(grown)[2:4]) >= least_side + 2:
            out.append((grown, score))
    return out
