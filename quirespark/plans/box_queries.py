"""Queries over boxes: joins, geometry, windows, types, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import elements as E
from quirespark.functions import geometry as G
from quirespark.functions.geometry import Box
from quirespark.operators import joins as J
from quirespark.operators import suppress, windows
from quirespark.plans.inputs import BOXES, boxes, rounded, sides, table

DOC = ("doc_id",)
#: SQL of a pair's overlap, with sides a and b
_W, _H = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1))", "greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_I = f"({_W} * {_H})"
_A, _B = "((a.x2 - a.x1) * (a.y2 - a.y1))", "((b.x2 - b.x1) * (b.y2 - b.y1))"
_IOU = f"({_I} / ({_A} + {_B} - {_I}))"
_SIDES = f"WITH {BOXES}, e AS (SELECT * FROM boxes WHERE idx % 2 = 0), r AS (SELECT * FROM boxes WHERE idx % 2 = 1)"
_OVER = "least(a.x2, b.x2) - greatest(a.x1, b.x1) > 3 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 3"


def region_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    return J.assign_regions(e, r, 0.1, DOC).select("doc_id", "idx", F.col("match").alias("region_idx"), F.round("match_score", 6).alias("share"))


SQL = {
    "region_assign": f"""{_SIDES},
p AS (SELECT a.doc_id, a.idx, b.idx AS r, {_I} / {_A} AS s FROM e a JOIN r b ON a.doc_id = b.doc_id WHERE {_I} / {_A} > 0.1),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY s DESC, r) AS n FROM p)
SELECT e.doc_id, e.idx, m.r AS region_idx, round(m.s, 6) AS share FROM e LEFT JOIN m ON e.doc_id = m.doc_id AND e.idx = m.idx AND m.n = 1"""
}


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    return J.overlap_join(e, r, 3.0, DOC).select("doc_id", "idx", "r_idx")


SQL["overlap_pairs"] = f"{_SIDES} SELECT a.doc_id, a.idx, b.idx AS r_idx FROM e a JOIN r b ON a.doc_id = b.doc_id WHERE {_OVER}"


def overlap_pairs_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    return J.overlap_join(e, r, 3.0, DOC, cell=40.0).select("doc_id", "idx", "r_idx")


SQL["overlap_pairs_grid"] = SQL["overlap_pairs"]


def associate_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    return J.associate(e, r, True, 3.0, DOC).select("doc_id", "idx")


def associate_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    return J.associate(e, r, False, 3.0, DOC).select("doc_id", "idx")


SQL["associate_within"] = f"{_SIDES} SELECT a.doc_id, a.idx FROM e a WHERE EXISTS (SELECT 1 FROM r b WHERE a.doc_id = b.doc_id AND {_OVER})"
SQL["associate_outside"] = f"{_SIDES} SELECT a.doc_id, a.idx FROM e a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.doc_id = b.doc_id AND {_OVER})"


def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ratio and distance between the two tables' boxes of a page."""
    e, r = sides(spark, sf_dir)
    p = J._sides(e, r, DOC, "r_")  # noqa: SLF001
    a, b = Box.of(), Box.of("r_")
    out = {
        "inter": G.intersection_area(a, b), "iou": G.iou(a, b), "iou_inclusive": G.iou_inclusive(a, b), "ioa": G.ioa(a, b), "over_second": G.overlap_over_second(a, b), "ioa_smaller": G.ioa_smaller(a, b), "ratio_large": G.overlap_ratio(a, b, "large"),
        "axis_x": G.axis_overlap_ratio(a, b, "x"), "axis_y_small": G.axis_overlap_ratio(a, b, "y", "small"), "l1": G.l1_distance(a, b), "corner": G.corner_distance(a, b), "edge_gap": G.nearest_edge_distance(a, b),
    }
    flags = {"inside": G.is_fully_inside(a, b, 5.0), "contained": G.is_contained(a, b), "on_line": G.same_line(a, b), "on_text_line": G.same_text_line(a, b), "align": G.alignment(a, b)}
    return p.select("doc_id", "idx", "r_idx", *(F.round(v, 6).alias(k) for k, v in out.items()), *(v.alias(k) for k, v in flags.items()))


_IW, _IH = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1)", "greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1)"
_LOW = "least(a.y2 - a.y1, b.y2 - b.y1)"
_GX = "least(abs(a.x1 - b.x2), abs(a.x2 - b.x1))"
_GY = "least(abs(a.y1 - b.y2), abs(a.y2 - b.y1))"
SQL["box_measures"] = f"""{_SIDES}
SELECT a.doc_id, a.idx, b.idx AS r_idx, round({_I}, 6) AS inter, round({_IOU}, 6) AS iou,
  round({_IW} * {_IH} / ((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1) + (b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1) - {_IW} * {_IH}), 6) AS iou_inclusive,
  round({_I} / {_A}, 6) AS ioa, round({_I} / {_B}, 6) AS over_second, round({_I} / least({_A}, {_B}), 6) AS ioa_smaller, round({_I} / greatest({_A}, {_B}), 6) AS ratio_large,
  round({_W} / (greatest(a.x2, b.x2) - least(a.x1, b.x1)), 6) AS axis_x, round({_H} / {_LOW}, 6) AS axis_y_small,
  round(abs(a.x1 - b.x1) + abs(a.y1 - b.y1) + abs(a.x2 - b.x2) + abs(a.y2 - b.y2), 6) AS l1,
  round(abs(a.x1 - b.x1) + abs(a.y1 - b.y1) + abs(a.x2 - b.x2) + abs(a.y2 - b.y2) + least(abs(a.x1 - b.x1) + abs(a.y1 - b.y1), abs(a.x2 - b.x2) + abs(a.y2 - b.y2)), 6) AS corner,
  round(CASE WHEN {_W} > 0 AND {_H} > 0 THEN 0.0 ELSE CASE WHEN {_W} = 0 THEN {_GX} ELSE 0.0 END + CASE WHEN {_H} = 0 THEN {_GY} ELSE 0.0 END END, 6) AS edge_gap,
  a.x1 + 5 >= b.x1 AND a.y1 + 5 >= b.y1 AND a.x2 - 5 <= b.x2 AND a.y2 - 5 <= b.y2 AS inside, {_I} / {_A} >= 0.9 AS contained, {_H} > 0.5 * {_LOW} AS on_line,
  {_H} / greatest({_LOW}, 1) >= 0.6 OR abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) <= greatest(0.5 * {_LOW}, 1, 2.5) AS on_text_line,
  CASE WHEN abs(a.x1 - b.x1) <= 5 THEN 'left' WHEN abs(a.x2 - b.x2) <= 5 THEN 'right' ELSE 'center' END AS align
FROM e a JOIN r b ON a.doc_id = b.doc_id"""


def box_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level geometry: sizes, padding, clamping, scaling, normalising, turning, and polygons of boxes."""
    b = boxes(spark, sf_dir)
    box, w, h = Box.of(), F.lit(100.0), F.lit(90.0)
    poly = G.poly_of(box)
    turned = G.poly_box(G.poly_rotate_back(poly, (F.col("idx") % 4) * 90.0, F.lit(130.0), F.lit(120.0)))
    cx, cy = G.poly_center(poly)
    grown, padded, kept = G.scale_about_center(box, 1.2, 0.8), G.pad(box, w, h, 0.1), G.to_page(box, w, h)
    return b.select(
        "doc_id", "idx", F.round(G.box_area(box), 6).alias("area"), F.round(G.poly_area(poly), 6).alias("poly_area"), F.round(G.poly_perimeter(poly), 6).alias("perimeter"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"),
        G.min_side(box).alias("min_side"), G.long_side(box).alias("long_side"), F.round(grown.x1, 6).alias("grown_x1"), F.round(grown.y2, 6).alias("grown_y2"), F.round(padded.x1, 6).alias("pad_x1"), F.round(padded.y2, 6).alias("pad_y2"),
        kept.x2.alias("kept_x2"), kept.y2.alias("kept_y2"), turned.x1.alias("turned_x1"), turned.y2.alias("turned_y2"), F.round(G.normalise(box, w, h)[2], 6).alias("unit_x2"), G.is_valid(box).alias("valid"),
    )


SQL["box_scalars"] = f"""WITH {BOXES}
SELECT doc_id, idx, round((x2 - x1) * (y2 - y1), 6) AS area, round((x2 - x1) * (y2 - y1), 6) AS poly_area, round(2 * (x2 - x1) + 2 * (y2 - y1), 6) AS perimeter, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy,
  least(x2 - x1, y2 - y1) AS min_side, greatest(x2 - x1, y2 - y1) AS long_side, round((x1 + x2) / 2 - (x2 - x1) * 1.2::DOUBLE / 2, 6) AS grown_x1, round((y1 + y2) / 2 + (y2 - y1) * 0.8::DOUBLE / 2, 6) AS grown_y2,
  round(greatest(x1 - greatest(x2 - x1, 1) * 0.1::DOUBLE, 0), 6) AS pad_x1, round(least(y2 + greatest(y2 - y1, 1) * 0.1::DOUBLE, 90), 6) AS pad_y2, least(x2, 100.0::DOUBLE) AS kept_x2, least(y2, 90.0::DOUBLE) AS kept_y2,
  CASE idx % 4 WHEN 0 THEN x1 WHEN 1 THEN 120.0::DOUBLE - y2 WHEN 2 THEN 130.0::DOUBLE - x2 ELSE y1 END AS turned_x1, CASE idx % 4 WHEN 0 THEN y2 WHEN 1 THEN x2 WHEN 2 THEN 120.0::DOUBLE - y1 ELSE 130.0::DOUBLE - x1 END AS turned_y2,
  round(least(x2 / 100, 1.0::DOUBLE), 6) AS unit_x2, x2 > x1 AND y2 > y1 AS valid
FROM boxes"""


def element_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typing of labels: kind, category, order role, task and the predicates."""
    k = E.type_of(F.upper("label"))
    return boxes(spark, sf_dir).select(
        "doc_id", "idx", k.alias("typed"), E.category(k).alias("category"), E.order_role(k).alias("role"), E.recognition_task(k).alias("task"), E.is_title(k).alias("is_title"), E.is_visual(k).alias("is_visual"), E.is_caption(k).alias("is_caption"),
        E.should_ocr(k).alias("should_ocr"), E.is_auxiliary(k).alias("is_auxiliary"), E.takes_order_index(k).alias("ordered"), E.has(F.col("text")).alias("has_text"), F.round(E.class_setting({"text": 0.05, "table": 0.02}, k, 0.03), 6).alias("threshold"),
    )


_CAT = "CASE kind WHEN 'text' THEN 'text' WHEN 'paragraph_title' THEN 'title' WHEN 'doc_title' THEN 'title' WHEN 'table' THEN 'table' WHEN 'image' THEN 'visual' WHEN 'chart' THEN 'visual' WHEN 'figure_table_chart_title' THEN 'caption' WHEN 'formula' THEN 'formula' WHEN 'footnote' THEN 'footer' WHEN 'header' THEN 'header' WHEN 'reference_content' THEN 'special' WHEN 'number' THEN 'special' ELSE 'other' END"
SQL["element_types"] = f"""WITH {BOXES}, k AS (SELECT doc_id, idx, text, CASE WHEN kind = 'figure_title' THEN 'figure_table_chart_title' ELSE kind END AS kind FROM boxes)
SELECT doc_id, idx, kind AS typed, {_CAT} AS category,
  CASE WHEN kind = 'paragraph_title' THEN 'paragraph_title' WHEN kind = 'doc_title' THEN 'doc_title' WHEN kind IN ('table', 'image', 'chart') THEN 'vision' WHEN kind = 'figure_table_chart_title' THEN 'vision_title' WHEN kind = 'footnote' THEN 'footer' WHEN kind = 'header' THEN 'header' WHEN kind = 'number' THEN 'unordered' ELSE 'normal_text' END AS role,
  CASE WHEN kind = 'image' THEN NULL WHEN kind IN ('table', 'chart', 'formula') THEN kind ELSE 'ocr' END AS task, kind IN ('doc_title', 'paragraph_title') AS is_title, kind IN ('image', 'chart') AS is_visual, kind = 'figure_table_chart_title' AS is_caption,
  kind IN ('text', 'paragraph_title', 'doc_title', 'figure_table_chart_title', 'footnote', 'header', 'reference_content', 'number') AS should_ocr, kind IN ('number', 'footnote', 'header') AS is_auxiliary,
  kind NOT IN ('footnote', 'header', 'number', 'other') AS ordered, text IS NOT NULL AS has_text, CASE kind WHEN 'text' THEN 0.05::DOUBLE WHEN 'table' THEN 0.02::DOUBLE ELSE 0.03::DOUBLE END AS threshold
FROM k"""


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.merge_intervals(boxes(spark, sf_dir), "x1", "x2", DOC)


SQL["interval_merge"] = f"""WITH {BOXES}, c AS (SELECT doc_id, CAST(trunc(x1) AS INTEGER) AS low, CAST(trunc(x2) AS INTEGER) AS high FROM boxes),
f AS (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY doc_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM c),
g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT doc_id, min(low) AS low, max(high) AS high FROM g GROUP BY doc_id, g"""


def position_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.cluster_values(boxes(spark, sf_dir), "x1", 8.0, DOC), "mean")


SQL["position_clusters"] = f"""WITH {BOXES}, f AS (SELECT doc_id, x1, CASE WHEN x1 - lag(x1) OVER (PARTITION BY doc_id ORDER BY x1) > 8 THEN 1 ELSE 0 END AS n FROM boxes),
g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY x1 ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cluster FROM f)
SELECT doc_id, cluster, round(avg(x1), 6) AS mean, count(*) AS n FROM g GROUP BY doc_id, cluster"""


def order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.order_indices(boxes(spark, sf_dir), "idx", DOC).select("doc_id", "idx", "order_index")


SQL["order_numbers"] = f"""WITH {BOXES}, k AS (SELECT doc_id, idx, kind NOT IN ('footnote', 'header', 'number', 'other') AS c FROM boxes)
SELECT doc_id, idx, CASE WHEN c THEN CAST(count(*) FILTER (c) OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) END AS order_index FROM k"""


def coverage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.covered_stretches(boxes(spark, sf_dir), "y1", "y2", 0, 2, DOC)


SQL["coverage_profile"] = f"""WITH {BOXES}, c AS (SELECT DISTINCT doc_id, unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS pos FROM boxes),
f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 2 THEN 1 ELSE 0 END AS n FROM c),
g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + 1 AS INTEGER) AS stop FROM g GROUP BY doc_id, g"""


def label_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.label_fixes(boxes(spark, sf_dir), DOC).select("doc_id", "idx", "kind")


SQL["label_fixes"] = f"""WITH {BOXES}, w AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, max(y2) FILTER (kind = 'text') OVER (PARTITION BY doc_id) AS low, max((x2 - x1) * (y2 - y1)) OVER (PARTITION BY doc_id) AS most,
  count(*) FILTER (kind = 'paragraph_title') OVER (PARTITION BY doc_id) AS p, count(*) FILTER (kind = 'doc_title') OVER (PARTITION BY doc_id) AS d FROM boxes)
SELECT doc_id, idx, CASE WHEN kind = 'footnote' AND y2 < low THEN 'text' WHEN kind = 'paragraph_title' AND p = 1 AND d = 0 AND area > most * 0.3::DOUBLE THEN 'doc_title' ELSE kind END AS kind FROM w"""


def continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.continuation_flags(boxes(spark, sf_dir), None, "idx", DOC)


SQL["continuation"] = f"""WITH {BOXES}, t AS (SELECT *, kind IN ('text', 'doc_title', 'paragraph_title', 'abstract', 'reference') AS prose FROM boxes)
SELECT doc_id, coalesce(arg_min(x1, idx) FILTER (prose) <= max(x2) * 0.05::DOUBLE, true) AS para_start, coalesce(arg_max(x2, idx) FILTER (prose) <= max(x2) - max(x2) * 0.1::DOUBLE, true) AS para_end FROM t GROUP BY doc_id"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("seg_start_x", F.lit(None).cast("double")).withColumn("seg_end_x", F.col("x2") - (F.col("idx") % 3) * 4)
    return windows.segment_flags(b, "idx", DOC).select("doc_id", "idx", "seg_start")


SQL["segments"] = f"""WITH {BOXES}, b AS (SELECT *, x2 - (idx % 3) * 4 AS seg_end FROM boxes),
p AS (SELECT *, max(CASE WHEN kind IN ('text', 'reference_content') THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi FROM b)
SELECT a.doc_id, a.idx, CASE WHEN b.idx IS NULL THEN NOT (a.x1 - a.x1 < 10) ELSE NOT (
  abs(CASE WHEN a.x1 < b.x2 AND a.x2 > b.x1 THEN greatest(a.x2, b.x2) ELSE a.x2 END - b.seg_end) < 10
  AND a.x1 - CASE WHEN a.x1 < b.x2 AND a.x2 > b.x1 THEN least(a.x1, b.x1) ELSE a.x1 END < 10 AND b.num_lines > 1
  AND CASE WHEN a.x1 < b.x2 AND a.x2 > b.x1 THEN 0 ELSE abs(a.x1 - b.x2) END < greatest(b.x2 - b.x1, a.x2 - a.x1)) END AS seg_start
FROM p a LEFT JOIN b ON a.doc_id = b.doc_id AND a.pi = b.idx"""


def row_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    flags = r.select("doc_id", F.col("y1").cast("long").alias("flag")).distinct()
    starts = e.select("doc_id", F.col("y1").cast("long").alias("start")).distinct()
    return windows.align_rows(flags, starts, DOC)


SQL["row_alignment"] = f"""{_SIDES}, s AS (SELECT DISTINCT doc_id, CAST(y1 AS BIGINT) AS start FROM e), f AS (SELECT DISTINCT doc_id, CAST(y1 AS BIGINT) AS flag FROM r)
SELECT s.doc_id, s.start, coalesce(max(f.flag), s.start) AS aligned FROM s LEFT JOIN f ON s.doc_id = f.doc_id AND f.flag <= s.start GROUP BY s.doc_id, s.start"""


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("width", F.col("x2") - F.col("x1")).withColumn("height", F.col("y2") - F.col("y1"))
    return windows.compatible_batches(b, "aspect", 3, 0.5, keys=DOC).select("doc_id", "idx", "shape_key", "batch_id", "item", windows.aspect_bucket(F.col("width") / F.col("height")).alias("bucket"))


SQL["batched"] = f"""WITH {BOXES}, k AS (SELECT doc_id, idx, (x2 - x1) / (y2 - y1) AS ratio, CAST(CAST(floor((x2 - x1) / (y2 - y1) / 0.5::DOUBLE) AS BIGINT) AS VARCHAR) AS shape_key FROM boxes),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, shape_key ORDER BY idx) - 1 AS n FROM k)
SELECT doc_id, idx, shape_key, n // 3 AS batch_id, CAST(n % 3 AS INTEGER) AS item, CASE WHEN ratio < 0.8 THEN 'tall' WHEN ratio < 1.2 THEN 'square' WHEN ratio < 2.5 THEN 'normal' WHEN ratio < 4.5 THEN 'wide' ELSE 'ultra_wide' END AS bucket FROM n"""


def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select((F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))
    return windows.bucket_stats(b)


SQL["bucket_stats"] = f"""WITH {BOXES}, k AS (SELECT (x2 - x1) / (y2 - y1) AS ratio FROM boxes)
SELECT CASE WHEN ratio < 0.8 THEN 'tall' WHEN ratio < 1.2 THEN 'square' WHEN ratio < 2.5 THEN 'normal' WHEN ratio < 4.5 THEN 'wide' ELSE 'ultra_wide' END AS bucket, count(*) AS n FROM k GROUP BY 1"""


def cross_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    return J.cross_cell(e, r, 0.05, 2, DOC).select("doc_id", "idx", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",").alias("cells"))


SQL["cross_cells"] = f"""{_SIDES} SELECT a.doc_id, a.idx, string_agg(CAST(b.idx AS VARCHAR), ',' ORDER BY b.idx) AS cells FROM e a JOIN r b ON a.doc_id = b.doc_id WHERE {_I} / {_A} > 0.05 GROUP BY a.doc_id, a.idx HAVING count(*) >= 2"""


def covered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    return J.covered_cells(e, r, 0.5, DOC).select("doc_id", "idx", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",").alias("cells"))


SQL["covered_cells"] = f"""{_SIDES} SELECT a.doc_id, a.idx, string_agg(CAST(b.idx AS VARCHAR), ',' ORDER BY b.x1, b.idx) AS cells FROM e a JOIN r b ON a.doc_id = b.doc_id WHERE {_I} / {_B} > 0.5 GROUP BY a.doc_id, a.idx"""


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return suppress.containment_modes(b, {"text": "large", "table": "small", "figure": "union"}, "formula", DOC).select("doc_id", "idx")


SQL["containment"] = f"""WITH {BOXES}, p AS (SELECT a.doc_id, a.idx AS i, b.idx AS j, a.label AS li, b.label AS lj FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.idx <> b.idx WHERE {_I} / {_A} >= 0.9 AND NOT (a.label = 'formula' AND b.label <> 'formula')),
d AS (SELECT doc_id, i AS idx FROM p WHERE lj = 'text' UNION SELECT doc_id, j FROM p WHERE li = 'table' AND (doc_id, j) NOT IN (SELECT (doc_id, i) FROM p WHERE li = 'table'))
SELECT b.doc_id, b.idx FROM boxes b WHERE (b.doc_id, b.idx) NOT IN (SELECT (doc_id, idx) FROM d)"""


def large_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("width", F.lit(40.0)).withColumn("height", F.lit(30.0))
    return suppress.drop_large_images(b, DOC, "figure").select("doc_id", "idx")


SQL["large_images"] = f"""WITH {BOXES}, k AS (SELECT *, label <> 'figure' OR (least(x2, 40.0::DOUBLE) - greatest(x1, 0)) * (least(y2, 30.0::DOUBLE) - greatest(y1, 0)) <= 0.82::DOUBLE * 40 * 30 AS keep FROM boxes)
SELECT doc_id, idx FROM (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY doc_id) AS kept, count(*) OVER (PARTITION BY doc_id) AS n FROM k) WHERE keep OR kept = 0 OR n <= 1"""


def nearest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    return J.nearest_match(e, r, DOC).select("doc_id", "idx", "match")


_L1 = "abs(a.x1 - b.x1) + abs(a.y1 - b.y1) + abs(a.x2 - b.x2) + abs(a.y2 - b.y2)"
SQL["nearest_cells"] = f"""{_SIDES}, p AS (SELECT a.doc_id, a.idx, b.idx AS m, row_number() OVER (PARTITION BY a.doc_id, a.idx ORDER BY 1 - {_IOU}, {_L1}, b.idx) AS n FROM e a JOIN r b ON a.doc_id = b.doc_id WHERE {_I} > 0)
SELECT e.doc_id, e.idx, p.m AS match FROM e LEFT JOIN p ON e.doc_id = p.doc_id AND e.idx = p.idx AND p.n = 1"""


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    return J.reconcile_cells(r, e, DOC).select("doc_id", "idx", "x1", "y1", "x2", "y2")


SQL["reconcile"] = f"""{_SIDES}, p AS (SELECT a.doc_id, a.x1, a.y1, a.x2, a.y2, b.idx AS m, row_number() OVER (PARTITION BY a.doc_id, a.idx ORDER BY {_I} / {_A} DESC, b.idx) AS n FROM e a JOIN r b ON a.doc_id = b.doc_id WHERE {_I} / {_A} > 0.001),
u AS (SELECT doc_id, m, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM p WHERE n = 1 GROUP BY doc_id, m)
SELECT r.doc_id, r.idx, coalesce(u.x1, r.x1) AS x1, coalesce(u.y1, r.y1) AS y1, coalesce(u.x2, r.x2) AS x2, coalesce(u.y2, r.y2) AS y2 FROM r LEFT JOIN u ON r.doc_id = u.doc_id AND r.idx = u.m"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    return J.region_membership(e, r, 0.1, DOC)[1].select("doc_id", "order_index", "idx")


SQL["membership"] = f"""{_SIDES}, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y1, x1, idx) AS INTEGER) AS oi FROM r),
p AS (SELECT a.doc_id, a.idx, b.oi, row_number() OVER (PARTITION BY a.doc_id, a.idx ORDER BY {_I} / {_A} DESC, b.oi) AS n FROM e a JOIN o b ON a.doc_id = b.doc_id WHERE {_I} / {_A} >= 0.1)
SELECT doc_id, oi AS order_index, idx FROM p WHERE n = 1"""


def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    return J.split_by_blocks(e, r, 0.3, 2.0, DOC).select("doc_id", "idx", "x1", "y1", "x2", "y2")


SQL["block_split"] = f"""{_SIDES}, p AS (SELECT a.doc_id, a.idx, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1, least(a.x2, b.x2) AS x2, least(a.y2, b.y2) AS y2, count(*) OVER (PARTITION BY a.doc_id, a.idx) AS n
  FROM e a JOIN r b ON a.doc_id = b.doc_id WHERE least(a.x2, b.x2) - greatest(a.x1, b.x1) > 2 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 2 AND {_I} / {_A} >= 0.3)
SELECT doc_id, idx, x1, y1, x2, y2 FROM p WHERE n >= 2 UNION ALL SELECT doc_id, idx, x1, y1, x2, y2 FROM e WHERE (doc_id, idx) NOT IN (SELECT (doc_id, idx) FROM p WHERE n >= 2)"""


def region_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    return J.match_regions(e.select("doc_id", "idx", "kind", "x1", "y1", "x2", "y2"), r, None, None, 0.2, 0.3, True, DOC).select("doc_id", "idx", "matched_text", F.round("match_score", 6).alias("score"), "same_category")


_CA, _CB = _CAT.replace("kind", "a.kind").replace("'figure_table_chart_title'", "'figure_title'"), _CAT.replace("kind", "b.kind").replace("'figure_table_chart_title'", "'figure_title'")
SQL["region_match"] = f"""{_SIDES}, p AS (SELECT a.doc_id, a.idx, b.idx AS m, b.text, {_IOU} AS s, {_CA} = {_CB} AND {_CA} <> 'other' AS same FROM e a JOIN r b ON a.doc_id = b.doc_id WHERE b.text IS NOT NULL AND a.kind NOT IN ('chart', 'image')),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY same DESC, s DESC, m DESC) AS n FROM (SELECT doc_id, idx, m, text, s, true AS same FROM p WHERE same AND s >= 0.2 UNION ALL SELECT doc_id, idx, m, text, s, false FROM p WHERE s >= 0.3))
SELECT e.doc_id, e.idx, q.text AS matched_text, round(q.s, 6) AS score, q.same AS same_category FROM e LEFT JOIN q ON e.doc_id = q.doc_id AND e.idx = q.idx AND q.n = 1"""


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    used = e.filter("idx % 8 = 0").select("doc_id", "idx")
    return J.orphan_regions(e, used, r, DOC).select("doc_id", "idx")


SQL["orphans"] = f"""{_SIDES} SELECT a.doc_id, a.idx FROM e a WHERE a.text IS NOT NULL AND a.idx % 8 <> 0
  AND NOT EXISTS (SELECT 1 FROM r b WHERE a.doc_id = b.doc_id AND ((b.kind = 'table' AND {_I} / {_A} > 0.3) OR (b.kind IN ('image', 'chart') AND {_I} / {_A} > 0.5)))
  AND NOT (EXISTS (SELECT 1 FROM r b WHERE a.doc_id = b.doc_id AND b.kind = 'figure_title' AND a.y2 < b.y2 AND a.x1 >= b.x1 - (b.x2 - b.x1) * 0.1 AND a.x2 <= b.x2 + (b.x2 - b.x1) * 0.1)
    AND NOT EXISTS (SELECT 1 FROM r b WHERE a.doc_id = b.doc_id AND b.kind IN ('text', 'doc_title', 'paragraph_title') AND {_I} / {_A} > 0.5))"""


def class_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = spark.createDataFrame([("text", 0.05, "union"), ("table", 0.02, None)], "label string, threshold double, merge_mode string")
    return J.apply_settings(boxes(spark, sf_dir), settings, 0.08).select("doc_id", "idx", "merge_mode")


SQL["class_settings"] = f"""WITH {BOXES} SELECT doc_id, idx, CASE WHEN label = 'text' THEN 'union' ELSE 'large' END AS merge_mode FROM boxes WHERE score >= CASE label WHEN 'text' THEN 0.05::DOUBLE WHEN 'table' THEN 0.02::DOUBLE ELSE 0.08::DOUBLE END"""


def formula_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = sides(spark, sf_dir)
    out = J.fill_formulas(e.select("doc_id", "idx", "kind", "x1", "y1", "x2", "y2", "text"), r.select("doc_id", "idx", "x1", "y1", "x2", "y2", F.concat(F.lit("f"), F.col("idx").cast("string")).alias("latex")), DOC)
    return J.clear_inline_formulas(out, 300.0).select("doc_id", "idx", "text")


_M = f"greatest({_I} / {_A}, {_I} / {_B})"
_IN = "((b.x1 + b.x2) / 2 BETWEEN a.x1 AND a.x2 AND (b.y1 + b.y2) / 2 BETWEEN a.y1 AND a.y2) OR ((a.x1 + a.x2) / 2 BETWEEN b.x1 AND b.x2 AND (a.y1 + a.y2) / 2 BETWEEN b.y1 AND b.y2)"
SQL["formula_fill"] = f"""{_SIDES}, p AS (SELECT a.doc_id, a.idx, b.idx AS m, {_M} AS s, ({_IN}) AS near, pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2) AS d FROM e a JOIN r b ON a.doc_id = b.doc_id WHERE a.kind = 'formula' AND a.text IS NULL),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, idx ORDER BY pass, CASE WHEN pass = 1 THEN -s ELSE d END, m) AS n FROM (SELECT *, 1 AS pass FROM p WHERE s >= 0.05 UNION ALL SELECT *, 2 FROM p WHERE near))
SELECT e.doc_id, e.idx, CASE WHEN e.kind = 'formula' AND (e.x2 - e.x1) * (e.y2 - e.y1) < 300 THEN NULL ELSE coalesce(e.text, CASE WHEN q.m IS NOT NULL THEN 'f' || CAST(q.m AS VARCHAR) END) END AS text FROM e LEFT JOIN q ON e.doc_id = q.doc_id AND e.idx = q.idx AND q.n = 1"""


def page_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.operators.render import page_summary

    b = boxes(spark, sf_dir).withColumnRenamed("idx", "region_idx").withColumnRenamed("score", "confidence")
    return rounded(page_summary(b, DOC), "mean_confidence")


SQL["page_aggregates"] = f"""WITH {BOXES} SELECT doc_id, count(*) AS n_regions, count(text) AS n_texts, round(avg(score), 6) AS mean_confidence, coalesce(string_agg(text, chr(10) ORDER BY idx), '') AS all_text FROM boxes GROUP BY doc_id"""


def two_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.operators.reading_order import column_order

    return column_order(boxes(spark, sf_dir).withColumn("width", F.lit(130.0)), DOC).select("doc_id", "idx", "rank")


SQL["two_column_order"] = f"""WITH {BOXES}, s AS (SELECT *, CASE WHEN x1 < 130 / 4.0 AND x2 < 3 * 130 / 5.0 THEN 0 WHEN x1 > 2 * 130 / 5.0 THEN 1 ELSE 2 END AS side FROM boxes),
f AS (SELECT *, count(*) FILTER (side = 2) OVER (PARTITION BY doc_id ORDER BY y1, x1, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fl FROM s)
SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY fl, side, y1, x1, idx) - 1 AS INTEGER) AS rank FROM f"""


def polygon_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.operators.reading_order import poly_order

    return poly_order(boxes(spark, sf_dir), DOC).select("doc_id", "idx", "rank")


SQL["polygon_order"] = f"WITH {BOXES} SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y1, idx) - 1 AS INTEGER) AS rank FROM boxes"


# -- folds: no SQL, held against brute force in tests


def _slim(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Boxes with no more columns than a fold reads, as nothing is pruned through Python."""
    return boxes(spark, sf_dir).select("doc_id", "idx", "x1", "y1", "x2", "y2", *more)


def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.apply_nms(_slim(spark, sf_dir, "cls", "score"), 0.3, 100, DOC).select("doc_id", "idx", "rank")


def layout_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.apply_layout_nms(_slim(spark, sf_dir, "cls", "score"), DOC).select("doc_id", "idx", "rank")


def nms_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.apply_nms_merge(boxes(spark, sf_dir), {"A": "union", "N": "small"}, 0.2, 100, DOC)


def overlap_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.remove_overlaps(_slim(spark, sf_dir, "kind"), 0.5, DOC, "kind").select("doc_id", "idx")


def overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.filter_overlaps(_slim(spark, sf_dir, "kind"), 0.7, DOC, "kind").select("doc_id", "idx")


def merged_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.merge_groups(boxes(spark, sf_dir), "idx", DOC).select("doc_id", "idx", "merge_group", "merge_align")


def _ordered(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quirespark.operators.reading_order import order_pages

        b = _slim(spark, sf_dir, "kind", "num_lines")
        if how == "regions":
            b = b.withColumn("kind", F.when(F.col("idx") % 4 == 0, "region").otherwise(F.col("kind")))
        return order_pages(b, how, DOC).select("doc_id", "idx", "rank")

    return run


quad_order, xycut_order, enhanced_order, region_order = _ordered("quad"), _ordered("xycut"), _ordered("enhanced"), _ordered("regions")


def title_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.operators.clusters import title_levels as levels

    b = boxes(spark, sf_dir).withColumn("kind", F.when(F.col("idx") % 2 == 0, "paragraph_title").otherwise(F.col("kind"))).withColumn("text", F.when(F.col("idx") % 3 == 0, F.concat(F.lit("1.2 "), F.col("text"))).otherwise(F.col("text")))
    return levels(b, DOC)


def reduced_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.operators.clusters import reduce_to_structure

    e, r = sides(spark, sf_dir)
    return reduce_to_structure(_slim(spark, sf_dir), r, DOC)


QUERIES = {
    f.__name__: f
    for f in (
        region_assign, overlap_pairs, overlap_pairs_grid, associate_within, associate_outside, box_measures, box_scalars, element_types, interval_merge, position_clusters, order_numbers, coverage_profile, label_fixes, continuation, segments, row_alignment,
        batched, bucket_stats, cross_cells, covered_cells, containment, large_images, nearest_cells, reconcile, membership, block_split, region_match, orphans, class_settings, formula_fill, page_aggregates, two_column_order, polygon_order,
        nms, layout_nms, nms_merge, overlap_removal, overlap_filter, merged_neighbours, title_levels, reduced_cells,
    )
} | {"quad_order": quad_order, "xycut_order": xycut_order, "enhanced_order": enhanced_order, "region_order": region_order}
