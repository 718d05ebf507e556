"""Spatial joins between box tables.

Every join has the page among its keys, so it is an equi-join with the overlap
test as residual; ``grid`` adds cells of a coarse grid to the key for pages with
very many boxes. Choices among matches are aggregates over (score, index)
structs, which fixes ties and needs no window sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions import geometry as G
from quirespark.functions.geometry import Box

PAGE = ("doc_id", "page_idx")


def _sides(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    renamed = right.select(*keys, *(F.col(c).alias(prefix + c) for c in right.columns if c not in keys))
    return left.join(renamed, list(keys))


def grid(frame: DataFrame, cell: float, prefix: str = "") -> DataFrame:
    """``frame`` with a row for each grid cell (gx, gy) that the box touches."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(prefix + lo) / cell), F.floor(F.greatest(F.col(prefix + hi), F.col(prefix + lo)) / cell))
    return frame.withColumn("gx", F.explode(span("x1", "x2"))).withColumn("gy", F.explode(span("y1", "y2")))


def overlap_join(left: DataFrame, right: DataFrame, more_than: float = 3.0, keys: Sequence[str] = PAGE, cell: float | None = None) -> DataFrame:
    """One row for each pair whose overlap exceeds ``more_than`` pixels both ways; right columns get ``r_``.

    A left row appears once for each right row it meets. With ``cell``, pairs are
    found by grid cell and reported in the one cell of their overlap's corner.
    """
    if cell is None:
        pairs = _sides(left, right, keys, "r_")
        return pairs.filter(G.overlaps(Box.of(), Box.of("r_"), more_than))
    pairs = _sides(grid(left, cell), grid(right, cell), [*keys, "gx", "gy"], "r_")
    a, b = Box.of(), Box.of("r_")
    home = (F.col("gx") == F.floor(F.greatest(a.x1, b.x1) / cell)) & (F.col("gy") == F.floor(F.greatest(a.y1, b.y1) / cell))
    return pairs.filter(G.overlaps(a, b, more_than) & home).drop("gx", "gy")


def associate(ocr: DataFrame, regions: DataFrame, within: bool = True, more_than: float = 3.0, keys: Sequence[str] = PAGE) -> DataFrame:
    """Boxes that some region overlaps (``within``), or those that none does."""
    r = regions.select(*keys, *(F.col(c).alias("r_" + c) for c in ("x1", "y1", "x2", "y2")))
    same = [ocr[k] == r[k] for k in keys]
    hit = G.overlaps(Box(*(ocr[c] for c in ("x1", "y1", "x2", "y2"))), Box.of("r_"), more_than)
    cond = hit
    for s in same:
        cond = s & cond
    return ocr.join(r, cond, "left_semi" if within else "left_anti")


def argmax_join(
    left: DataFrame, right: DataFrame, score: Callable[[Box, Box], Column], above: float = 0.0, keys: Sequence[str] = PAGE, left_id: str = "idx", right_id: str = "idx",
    at_least: bool = False, last: bool = False, where: Callable[[], Column] | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """``left`` with match (the best right row's id, null if none) and match_score.

    A pair counts if its score exceeds ``above`` (``at_least``: reaches it) and
    ``where``, over right columns prefixed ``r_``, holds. The first right id wins
    equal scores, or the ``last``. ``carry`` brings right columns along as ``m_``.
    """
    pairs = _sides(left.select(*dict.fromkeys([*keys, left_id, "x1", "y1", "x2", "y2", *(["kind"] if "kind" in left.columns else [])])), right, keys, "r_")
    pairs = pairs.withColumn("__s", score(Box.of(), Box.of("r_")))
    pairs = pairs.filter((F.col("__s") >= above) if at_least else (F.col("__s") > above))
    if where is not None:
        pairs = pairs.filter(where())
    rank = F.struct(F.col("__s").alias("s"), (F.col("r_" + right_id) if last else -F.col("r_" + right_id)).alias("i"))
    best = pairs.groupBy(*keys, left_id).agg(F.max_by(F.struct(F.col("r_" + right_id).alias("match"), F.col("__s").alias("match_score"), *(F.col("r_" + c).alias("m_" + c) for c in carry)), rank).alias("__b"))
    return left.join(best, [*keys, left_id], "left").select(*left.columns, "__b.*")


def assign_regions(elements: DataFrame, regions: DataFrame, above: float = 0.1, keys: Sequence[str] = PAGE) -> DataFrame:
    """Elements with the region that covers most of them, over ``above``; the first of equals."""
    return argmax_join(elements, regions, G.ioa, above, keys)


def region_membership(elements: DataFrame, regions: DataFrame, least: float = 0.1, keys: Sequence[str] = PAGE) -> tuple[DataFrame, DataFrame]:
    """(regions numbered from 1 by top and left edge as order_index, bridge of region order_index and element idx).

    An element belongs to the region that covers most of it, if at least ``least``.
    """
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy(*keys).orderBy("y1", "x1", "idx"))
    numbered = regions.withColumn("order_index", order)
    home = argmax_join(elements, numbered.drop("idx").withColumnRenamed("order_index", "idx"), G.ioa, least, keys, at_least=True)
    return numbered, home.filter("match is not null").select(*keys, F.col("match").alias("order_index"), "idx")


def cross_cell(ocr: DataFrame, cells: DataFrame, above: float = 0.05, least: int = 2, keys: Sequence[str] = PAGE) -> DataFrame:
    """Boxes of which more than ``above`` lies in each of at least ``least`` cells: keys, idx, cells (sorted ids)."""
    pairs = _sides(ocr.select(*keys, "idx", "x1", "y1", "x2", "y2"), cells.select(*keys, "idx", "x1", "y1", "x2", "y2"), keys, "r_")
    hit = pairs.filter(G.ioa(Box.of(), Box.of("r_")) > above)
    return hit.groupBy(*keys, "idx").agg(F.sort_array(F.collect_list("r_idx")).alias("cells")).filter(F.size("cells") >= least)


def covered_cells(ocr: DataFrame, cells: DataFrame, above: float = 0.5, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, idx, cells: cells of which a box covers more than ``above``, by left edge."""
    pairs = _sides(ocr.select(*keys, "idx", "x1", "y1", "x2", "y2"), cells.select(*keys, "idx", "x1", "y1", "x2", "y2"), keys, "r_")
    hit = pairs.filter(G.overlap_over_second(Box.of(), Box.of("r_")) > above)
    return hit.groupBy(*keys, "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("r_x1", "r_idx"))), lambda s: s["r_idx"]).alias("cells"))


def split_by_blocks(boxes: DataFrame, blocks: DataFrame, least: float = 0.3, more_than: float = 2.0, keys: Sequence[str] = PAGE) -> DataFrame:
    """Detection boxes, those that two or more blocks share replaced by the shared parts.

    A part counts if it is over ``more_than`` pixels both ways and at least
    ``least`` of the box; parts follow the blocks' order.
    """
    pairs = _sides(boxes, blocks.select(*keys, "idx", "x1", "y1", "x2", "y2"), keys, "r_")
    part = G.intersection_box(Box.of(), Box.of("r_"), more_than)
    hits = pairs.withColumn("__p", part).filter(F.col("__p").isNotNull() & (G.ioa(Box.of(), Box.of("r_")) >= least))
    parts = hits.groupBy(*keys, "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("r_idx", "__p"))), lambda s: s["__p"]).alias("__parts")).filter(F.size("__parts") >= 2)
    joined = boxes.join(parts, [*keys, "idx"], "left").withColumn("__b", F.explode(F.coalesce("__parts", F.array(Box.of().struct()))))
    others = [c for c in boxes.columns if c not in ("x1", "y1", "x2", "y2")]
    return joined.select(*others, "__b.*").select(*boxes.columns)


def nearest_match(ocr: DataFrame, cells: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Boxes with the cell of least (1 - IoU, L1 distance), IoU positive; the first cell of equals.

    Exact costs; ``tables.match_cells`` adds the tolerance band of the full rule.
    """
    pairs = _sides(ocr.select(*keys, "idx", "x1", "y1", "x2", "y2"), cells, keys, "r_")
    share, far = G.iou(Box.of(), Box.of("r_")), G.l1_distance(Box.of(), Box.of("r_"))
    pairs = pairs.withColumn("__i", share).filter("__i > 0")
    best = pairs.groupBy(*keys, "idx").agg(F.min(F.struct((1 - F.col("__i")).alias("c"), far.alias("d"), F.col("r_idx").alias("match"))).alias("__b"))
    return ocr.join(best, [*keys, "idx"], "left").select(*ocr.columns, F.col("__b.match").alias("match"))


def grid_lookup(tokens: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Token slots (keys, pos, row, col) with the text of the cell there; of cells that share a slot the last.

    Tables none of whose cells has a place take texts by position.
    """
    placed = cells.filter("row is not null and col is not null").groupBy(*keys, "row", "col").agg(F.max_by("text", "idx").alias("__t"))
    any_placed = placed.select(*keys).distinct().withColumn("__any", F.lit(True))
    by_pos = cells.select(*keys, F.col("idx").alias("pos"), F.col("text").alias("__p"))
    out = tokens.join(placed, [*keys, "row", "col"], "left").join(any_placed, list(keys), "left").join(by_pos, [*keys, "pos"], "left")
    return out.select(*tokens.columns, F.when(F.col("__any"), F.col("__t")).otherwise(F.col("__p")).alias("text"))


def reconcile_cells(structure: DataFrame, detected: DataFrame, keys: Sequence[str] = PAGE, above: float = 0.001) -> DataFrame:
    """Structure cells with the bounds of the detections whose best cell they are; their own box if none.

    Detections beyond the number of structure cells are to be clustered down
    first (``clusters.reduce_boxes``).
    """
    home = argmax_join(detected, structure, G.ioa, above, keys).filter("match is not null")
    bounds = home.groupBy(*keys, F.col("match").alias("idx")).agg(F.min("x1").alias("b1"), F.min("y1").alias("b2"), F.max("x2").alias("b3"), F.max("y2").alias("b4"))
    joined = structure.join(bounds, [*keys, "idx"], "left")
    boxes = {c: F.coalesce(b, c).alias(c) for c, b in zip(("x1", "y1", "x2", "y2"), ("b1", "b2", "b3", "b4"))}
    return joined.select(*(boxes.get(c, F.col(c)) for c in structure.columns))


def match_regions(targets: DataFrame, elements: DataFrame, tables: DataFrame | None = None, formulas: DataFrame | None = None, same: float = 0.5, any_: float = 0.7, generic: bool = True, keys: Sequence[str] = PAGE) -> DataFrame:
    """Targets (idx, kind, box) with matched_text, match_score, match_source and same_category.

    A table takes the table, a formula the formula of best IoU of at least
    ``same``; failing that (and if ``generic``) they match as others do: the
    element of their category of best IoU of at least ``same``, else any of at
    least ``any_``. Candidates need text. Pictures and charts never match, and
    regions and others skip the pass by category. The last candidate wins equals.
    """
    from quirespark.functions.elements import category
    from quirespark.functions.text import strip

    def named(frame: DataFrame, text: str) -> DataFrame:
        return frame.select(*keys, "idx", "x1", "y1", "x2", "y2", strip(F.col(text)).alias("text"), *([category(F.col("kind")).alias("cat")] if "kind" in frame.columns else [])).filter("text != ''")

    def best(candidates: DataFrame, least: float, source: str, by_category: bool, only: Column) -> DataFrame:
        asks = targets.filter(only)
        where = (lambda: (F.col("r_cat") == category(F.col("kind"))) & ~category(F.col("kind")).isin("region", "other")) if by_category else None
        hit = argmax_join(asks, candidates, G.iou, least, keys, at_least=True, last=True, where=where, carry=["text"]).filter("match is not null")
        return hit.select(*keys, "idx", F.struct(F.col("m_text").alias("matched_text"), "match_score", F.lit(source).alias("match_source"), F.lit(by_category or source != "layout").alias("same_category")).alias("hit"))

    kind = F.col("kind")
    plain = ~kind.isin("chart", "image", "header_image", "footer_image")
    if not generic:
        plain = plain & ~kind.isin("table", "formula")
    passes = []
    if tables is not None:
        passes.append(best(named(tables, "html"), same, "table", False, kind == "table"))
    if formulas is not None:
        passes.append(best(named(formulas, "latex"), same, "formula", False, kind == "formula"))
    layout = named(elements, "text")
    passes += [best(layout, same, "layout", True, plain), best(layout, any_, "layout", False, plain)]
    out, hits = targets, []
    for n, p in enumerate(passes):
        out = out.join(p.withColumnRenamed("hit", f"__h{n}"), [*keys, "idx"], "left")
        hits.append(F.col(f"__h{n}"))
    return out.withColumn("__hit", F.coalesce(*hits)).select(*targets.columns, "__hit.*")


def fill_formulas(elements: DataFrame, formulas: DataFrame, keys: Sequence[str] = PAGE, least: float = 0.05) -> DataFrame:
    """Formula elements without text take the LaTeX of their best formula.

    Best is the greater share of either in the other, if at least ``least``; else
    the nearest formula of which one centre lies inside the other's box.
    """
    need = elements.filter((F.col("kind") == "formula") & F.col("text").isNull())
    both = lambda a, b: F.greatest(G.ioa(a, b), G.ioa(b, a))
    first = argmax_join(need, formulas, both, least, keys, at_least=True, carry=["latex"])

    def close(a: Box, b: Box) -> Column:
        (ax, ay), (bx, by) = G.box_center(a), G.box_center(b)
        inside = ((bx >= a.x1) & (bx <= a.x2) & (by >= a.y1) & (by <= a.y2)) | ((ax >= b.x1) & (ax <= b.x2) & (ay >= b.y1) & (ay <= b.y2))
        return F.when(inside, -((ax - bx) * (ax - bx) + (ay - by) * (ay - by)))

    second = argmax_join(need, formulas, close, float("-inf"), keys, carry=["latex"])
    one = first.select(*keys, "idx", F.col("m_latex").alias("l1"))
    two = second.select(*keys, "idx", F.col("m_latex").alias("l2"))
    out = elements.join(one, [*keys, "idx"], "left").join(two, [*keys, "idx"], "left")
    return out.select(*(F.coalesce("text", "l1", "l2").alias("text") if c == "text" else F.col(c) for c in elements.columns))


def clear_inline_formulas(elements: DataFrame, below: float = 80_000.0) -> DataFrame:
    """Small formula elements lose text and order: their formula is part of a line."""
    small = (F.col("kind") == "formula") & (F.col("text") != "") & (G.box_area(Box.of()) < below)
    hit = F.coalesce(small, F.lit(False))
    out = elements.withColumn("text", F.when(~hit, F.col("text")))
    return out.withColumn("order_index", F.when(~hit, F.col("order_index"))) if "order_index" in elements.columns else out


def third_box_between(pairs: DataFrame, boxes: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Pairs (a_idx, b_idx and both boxes as a_ and b_) whose common bounds some third box meets."""
    union = G.union_box(Box.of("a_"), Box.of("b_"))
    third = boxes.select(*keys, F.col("idx").alias("t_idx"), *(F.col(c).alias("t_" + c) for c in ("x1", "y1", "x2", "y2")))
    cond = (F.col("t_idx") != F.col("a_idx")) & (F.col("t_idx") != F.col("b_idx")) & G.overlaps(union, Box.of("t_"), 0.0)
    for k in keys:
        cond = cond & (pairs[k] == third[k])
    return pairs.join(third, cond, "left_semi")


def apply_settings(detections: DataFrame, settings: DataFrame, default_threshold: float, default_mode: str = "large") -> DataFrame:
    """Detections over their class's threshold, with its merge_mode; ``settings`` has a row a class (label, threshold, merge_mode)."""
    out = detections.join(settings, "label", "left")
    return out.filter(F.col("score") >= F.coalesce("threshold", F.lit(default_threshold))).withColumn("merge_mode", F.coalesce("merge_mode", F.lit(default_mode))).drop("threshold")


def orphan_regions(regions: DataFrame, used: DataFrame, elements: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Text regions that no step used and that deserve an element of their own.

    Left out are regions of which over 0.3 lies in a table or over 0.5 in a
    picture, and those above a figure's caption within its width (10 % to either
    side) unless over half lies in a text or title.
    """
    free = regions.filter(F.col("text").isNotNull()).join(used.select(*keys, "idx"), [*keys, "idx"], "left_anti")
    e = elements.select(*keys, F.col("kind").alias("e_kind"), *(F.col(c).alias("e_" + c) for c in ("x1", "y1", "x2", "y2")))
    a, b = Box(*(free[c] for c in ("x1", "y1", "x2", "y2"))), Box.of("e_")

    def on(hit: Column) -> Column:
        for k in keys:
            hit = (free[k] == e[k]) & hit
        return hit

    covered = (F.col("e_kind").isin("table") & (G.ioa(a, b) > 0.3)) | (F.col("e_kind").isin("image", "chart") & (G.ioa(a, b) > 0.5))
    free1 = free.join(e, on(covered), "left_anti")
    margin = (b.x2 - b.x1) * 0.1
    under = F.col("e_kind").isin("figure_title", "chart_title", "figure_table_chart_title") & (a.y2 < b.y2) & (a.x1 >= b.x1 - margin) & (a.x2 <= b.x2 + margin)
    inside = F.col("e_kind").isin("text", "doc_title", "paragraph_title", "abstract") & (G.ioa(a, b) > 0.5)
    in_figure = free.join(e, on(under), "left_semi").select(*keys, "idx")
    in_text = free.join(e, on(inside), "left_semi").select(*keys, "idx")
    return free1.join(in_figure.join(in_text, [*keys, "idx"], "left_anti"), [*keys, "idx"], "left_anti")
