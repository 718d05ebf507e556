"""Windows over ordered rows: islands, running numbers, continuation of paragraphs, as-of values, batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.functions.elements import takes_order_index

PAGE = ("doc_id", "page_idx")


def merge_intervals(frame: DataFrame, low: str, high: str, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, low, high of the unions of truncated intervals; touching ones merge."""
    cut = frame.select(*keys, F.col(low).cast("int").alias("low"), F.col(high).cast("int").alias("high"))
    w = Window.partitionBy(*keys).orderBy("low", "high")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = cut.withColumn("__new", F.when(F.col("low") <= before, 0).otherwise(1))
    islands = flagged.withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__g").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("__g")


def cluster_values(frame: DataFrame, value: str, tolerance: float, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, cluster (from 0), mean, n: runs of sorted values whose neighbours lie within the tolerance."""
    w = Window.partitionBy(*keys).orderBy(value)
    flagged = frame.withColumn("__new", F.coalesce((F.col(value) - F.lag(value).over(w) > tolerance).cast("int"), F.lit(0)))
    runs = flagged.withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return runs.groupBy(*keys, "cluster").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def nearest(values: DataFrame, positions: DataFrame, keys: Sequence[str], value: str = "value", position: str = "position", idx: str = "pos_idx") -> DataFrame:
    """``values`` with the idx of the nearest position of their group, the first of equals."""
    rows = values.withColumn("__id", F.struct(*values.columns))
    best = rows.join(positions, list(keys)).groupBy(*keys, "__id").agg(F.min_by(idx, F.struct(F.abs(F.col(value) - F.col(position)), F.col(idx))).alias("nearest"))
    return best.select("__id.*", "nearest")


def order_indices(frame: DataFrame, position: str = "rank", keys: Sequence[str] = PAGE) -> DataFrame:
    """``frame`` with order_index: 1, 2, ... over the types that reading order counts, else null."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    counts = takes_order_index(F.col("kind"))
    return frame.withColumn("order_index", F.when(counts, F.sum(counts.cast("int")).over(w)).cast("int"))


def starts_segment(x1: Column, x2: Column, start_x: Column, prev: Column, near: float = 10.0) -> Column:
    """Whether an element starts a paragraph, given the struct (x1, x2, seg_end_x, num_lines) of the text before.

    False, a continuation, if the earlier text has several lines and fills its
    last one, this one's first line is not indented, and the two are close. The
    first text of a page continues if it starts at its left edge.
    """
    start = F.coalesce(start_x, x1)
    meets = (x1 < prev["x2"]) & (x2 > prev["x1"])
    left = F.when(meets, F.least(x1, prev["x1"])).otherwise(x1)
    right = F.when(meets, F.greatest(x2, prev["x2"])).otherwise(x2)
    gap = F.when(meets, 0.0).otherwise(F.abs(x1 - prev["x2"]))
    goes_on = (
        (F.abs(right - F.coalesce(prev["seg_end_x"], prev["x2"])) < near)
        & (start - left < near)
        & (F.coalesce(prev["num_lines"], F.lit(1)) > 1)
        & (gap < F.greatest(prev["x2"] - prev["x1"], x2 - x1))
    )
    return F.when(prev.isNull(), ~(start - x1 < near)).otherwise(~goes_on)


def segment_flags(elements: DataFrame, position: str = "rank", keys: Sequence[str] = PAGE) -> DataFrame:
    """``elements`` with seg_start: against the last text or reference entry before it on the page."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    texts = F.when(F.col("kind").isin("text", "reference_content"), F.struct("x1", "x2", "seg_end_x", "num_lines"))
    marked = elements.withColumn("__prev", F.last(texts, ignorenulls=True).over(w))
    return marked.withColumn("seg_start", starts_segment(F.col("x1"), F.col("x2"), F.col("seg_start_x"), F.col("__prev"))).drop("__prev")


def continuation_flags(elements: DataFrame, pages: DataFrame | None = None, position: str = "rank", keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, para_start, para_end of each page with elements.

    The first text starts a paragraph if it begins in the left 5 % of the page;
    the last ends one if it stops short of the right 10 %. Width comes from
    ``pages``, else from the right-most element. Pages without texts have both.
    """
    prose = F.col("kind").isin("text", "doc_title", "paragraph_title", "abstract", "reference")
    per = elements.groupBy(*keys).agg(
        F.max("x2").alias("__w"),
        F.min_by(F.when(prose, F.col("x1")), F.when(prose, F.col(position))).alias("__l"),
        F.max_by(F.when(prose, F.col("x2")), F.when(prose, F.col(position))).alias("__r"),
    )
    width = F.col("__w")
    if pages is not None:
        per = per.join(pages.select(*keys, F.col("width").alias("__pw")), list(keys), "left")
        width = F.coalesce("__pw", "__w")
    return per.select(*keys, F.coalesce(F.col("__l") <= width * 0.05, F.lit(True)).alias("para_start"), F.coalesce(F.col("__r") <= width - width * 0.1, F.lit(True)).alias("para_end"))


def coverage_levels(frame: DataFrame, low: str, high: str, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, at, to, n: stretches [at, to) of integers that equally many (n, at least one) truncated intervals cover, by running sums of their ends."""
    lo, hi = F.abs(F.col(low).cast("int")), F.abs(F.col(high).cast("int"))
    ends = frame.select(*keys, F.explode(F.array(F.struct(F.least(lo, hi).alias("at"), F.lit(1).alias("d")), F.struct(F.greatest(lo, hi).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("at")
    level = steps.withColumn("n", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("at").over(w))
    return level.filter("n > 0 and to is not null").select(*keys, "at", "to", "n")


def coverage(frame: DataFrame, low: str, high: str, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, at, n: how many truncated intervals cover each integer."""
    return coverage_levels(frame, low, high, keys).select(*keys, F.explode(F.sequence("at", F.col("to") - 1)).alias("at"), "n")


def covered_stretches(frame: DataFrame, low: str, high: str, min_value: int = 0, min_gap: int = 1, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, start, stop: ``split_profile`` of ``coverage`` from stretches of one level, without a row an integer."""
    over = coverage_levels(frame, low, high, keys).filter(F.col("n") > min_value)
    w = Window.partitionBy(*keys).orderBy("at")
    parted = (F.col("at") - F.lag("to").over(w) + 1 > max(min_gap, 1)).cast("int")
    runs = over.withColumn("__new", F.coalesce(parted, F.lit(0))).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "__g").agg(F.min("at").alias("start"), F.max("to").alias("stop")).drop("__g")


def split_profile(profile: DataFrame, min_value: int = 0, min_gap: int = 1, keys: Sequence[str] = PAGE) -> DataFrame:
    """keys, start, stop of stretches over ``min_value`` that gaps of more than ``min_gap`` part."""
    over = profile.filter(F.col("n") > min_value)
    w = Window.partitionBy(*keys).orderBy("at")
    runs = over.withColumn("__new", F.coalesce((F.col("at") - F.lag("at").over(w) > min_gap).cast("int"), F.lit(0))).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "__g").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("stop")).drop("__g")


def align_rows(flags: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``starts`` (keys, start) with the greatest flag up to each, the start itself if there is none: an as-of match.

    Flags rise with their position, as row boundaries do.
    """
    both = starts.select(*keys, F.col("start").alias("__at"), F.lit(1).alias("__q"), F.lit(None).cast("long").alias("__f")).unionByName(flags.select(*keys, F.col("flag").alias("__at"), F.lit(0).alias("__q"), F.col("flag").cast("long").alias("__f")))
    w = Window.partitionBy(*keys).orderBy("__at", "__q").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("aligned", F.coalesce(F.max("__f").over(w), F.col("__at").cast("long"))).filter("__q = 1").select(*keys, F.col("__at").alias("start"), "aligned")


def batches(frame: DataFrame, size: int, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``frame`` with batch_id and item: consecutive chunks of ``size`` rows within each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.row_number().over(w) - 1
    return frame.withColumn("batch_id", F.floor(n / size).cast("long")).withColumn("item", (n % size).cast("int"))


ASPECTS = ((0.0, 0.8, "tall"), (0.8, 1.2, "square"), (1.2, 2.5, "normal"), (2.5, 4.5, "wide"), (4.5, 3.4e38, "ultra_wide"))


def aspect_bucket(ratio: Column, buckets: Sequence[tuple[float, float, str]] = ASPECTS) -> Column:
    """Name of the first bucket (from, below, name) that holds the ratio."""
    out = None
    for low, high, name in buckets:
        hit = (ratio >= low) & (ratio < high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def aspect_step(width: Column, height: Column, tolerance: float) -> Column:
    """Number of the tolerance-wide step that an aspect ratio falls into."""
    return F.when((height > 0) & F.lit(tolerance > 0), F.floor(width / height / tolerance)).otherwise(F.lit(0)).cast("long")


def best_target(width: Column, height: Column, targets: Sequence[tuple[int, int]], tolerance: float) -> Column:
    """``WxH`` of the first target whose aspect ratio is within the tolerance, null if none is."""
    out = F.lit(None).cast("string")
    for w, h in reversed(targets):
        out = F.when((height > 0) & (F.abs(width / F.when(height > 0, height) - w / h) <= tolerance), F.lit(f"{w}x{h}")).otherwise(out)
    return out


def bucket_stats(images: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Images per aspect bucket; those outside every bucket are left out."""
    named = images.withColumn("bucket", aspect_bucket(F.col("width") / F.greatest("height", F.lit(1)))).filter("bucket is not null")
    return named.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def bucketed(images: DataFrame, most: int, order: str = "idx", keys: Sequence[str] = ()) -> DataFrame:
    """Images (width, height) with bucket, at most ``most`` (0: all) to a bucket in input order."""
    out = images.withColumn("bucket", aspect_bucket(F.col("width") / F.greatest("height", F.lit(1))))
    if not most:
        return out
    w = Window.partitionBy(*keys, "bucket").orderBy(order)
    return out.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def compatible_batches(images: DataFrame, how: str, most: int, tolerance: float = 0.1, step: int = 32, targets: Sequence[tuple[int, int]] = (), keys: Sequence[str] = (), order: Sequence[str] = ("idx",)) -> DataFrame:
    """Images with shape_key and batch_id: batches of at most ``most`` images that share a shape key.

    ``how``: ``exact`` size, ``aspect`` step, ``longest`` side in steps, or the
    first of ``targets`` of a fitting aspect ratio (``target``). Provenance
    columns stay, so images and crops of many pages batch alike.
    """
    w, h = F.col("width"), F.col("height")
    key = {"exact": F.concat_ws("x", w, h), "aspect": aspect_step(w, h, tolerance).cast("string"), "longest": F.floor(F.greatest(w, h) / step).cast("string"), "target": best_target(w, h, targets, tolerance)}[how]
    return batches(images.withColumn("shape_key", key), most, order, (*keys, "shape_key"))


NEVER_MERGED = tuple("chart footer_image header_image image seal table".split())


def merge_groups(elements: DataFrame, position: str = "rank", keys: Sequence[str] = PAGE) -> DataFrame:
    """``elements`` (label and box) with merge_group and merge_align; null outside groups of two or more.

    A text joins the element before it (pictures, seals and tables aside) if that
    is a text, and either they share no x-range and this one stands close to the
    right of it, above its lower edge; or they share x-range, their gap is below
    half the taller one, exactly one pair of edges agrees within five pixels, and
    their common bounds meet some third element.
    """
    from quirespark.functions import geometry as G
    from quirespark.functions.geometry import Box
    from quirespark.operators.joins import third_box_between

    label = F.coalesce("label", F.lit(""))
    flow = elements.filter(~label.isin(*NEVER_MERGED))
    w = Window.partitionBy(*keys).orderBy(position)
    lagged = flow.select("*", *(F.lag(c).over(w).alias("b_" + c) for c in ("idx", "label", "x1", "y1", "x2", "y2")))
    a, b = Box.of(), Box.of("b_")
    texts = (F.col("label") == "text") & (F.col("b_label") == "text")
    shared = G.axis_overlap_ratio(a, b, "x")
    beside = texts & (shared == 0) & (a.x1 > b.x2) & (a.y1 < b.y2) & (a.x1 - b.x2 < F.greatest(G.width(a), G.width(b), F.lit(0.0)) * 0.3)
    left, right = F.abs(a.x1 - b.x1) <= 5.0, F.abs(a.x2 - b.x2) <= 5.0
    under = texts & (shared > 0) & (a.y2 >= b.y1) & (F.abs(a.y1 - b.y2) < F.greatest(G.height(a), G.height(b), F.lit(0.0)) * 0.5) & (left != right)
    marked = lagged.withColumn("__beside", F.coalesce(beside, F.lit(False))).withColumn("__under", F.coalesce(under, F.lit(False)))
    asks = marked.filter("__under").select(*keys, F.col("idx").alias("a_idx"), "b_idx", *(F.col(c).alias("a_" + c) for c in ("x1", "y1", "x2", "y2")), *(F.col("b_" + c) for c in ("x1", "y1", "x2", "y2")))
    crossed = third_box_between(asks, elements, keys).select(*keys, F.col("a_idx").alias("idx"), F.lit(True).alias("__third"))
    marked = marked.join(crossed, [*keys, "idx"], "left").withColumn("__joins", F.col("__beside") | (F.col("__under") & F.coalesce("__third", F.lit(False))))
    runs = marked.withColumn("__g", F.sum((~F.col("__joins")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__g"))
    align = F.when(F.col("__joins") & F.col("__beside"), "center").when(F.col("__joins"), G.alignment(a, b))
    found = runs.withColumn("__n", size).filter("__n > 1").select(*keys, "idx", F.col("__g").cast("int").alias("merge_group"), align.alias("merge_align"))
    return elements.join(found, [*keys, "idx"], "left").select(*elements.columns, "merge_group", "merge_align")


def label_fixes(elements: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Footnotes above the lowest text become texts; a lone paragraph title over 0.3 of the largest area a document title."""
    w = Window.partitionBy(*keys)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    low = F.greatest(F.max(F.when(F.col("kind") == "text", F.col("y2"))).over(w), F.lit(0.0))
    lone = (F.sum((F.col("kind") == "paragraph_title").cast("int")).over(w) == 1) & (F.sum((F.col("kind") == "doc_title").cast("int")).over(w) == 0)
    big = area > F.greatest(F.max(area).over(w), F.lit(0.0)) * 0.3
    kind = F.when((F.col("kind") == "footnote") & (F.col("y2") < low), "text").when((F.col("kind") == "paragraph_title") & lone & big, "doc_title").otherwise(F.col("kind"))
    return elements.withColumn("kind", kind)
